"""Readers. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortspark.functions.nulls import not_isin_safe
from cohortspark.operators.ordering import global_order
from cohortspark.operators.relational import union_rows


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    missing: str = "NA",
    text_default: str | None = "",
    multi_line: bool = False,
) -> DataFrame:
    """Headered CSV. ``missing`` is NULL; an empty text cell is empty text unless the default is None.

    ``multi_line`` is for files whose cells hold line breaks; such a file is read by one task.

    Spark reads both "NA" and an empty cell as NULL once a null marker is set, so the file is read
    with the marker kept as text and the marker is replaced per column.
    """
    raw = StructType([StructField(f.name, StringType()) for f in schema])
    text = spark.read.schema(raw).csv(path, header=True, multiLine=multi_line, escape='"')
    out = []
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        known = F.when(cell != missing, cell)
        if f.dataType.simpleString() == "string":
            if text_default is not None:
                known = F.when(cell.isNull(), F.lit(text_default)).otherwise(known)
            out.append(known.alias(f.name))
        else:
            out.append(known.try_cast(f.dataType).alias(f.name))
    return text.select(*out)


def read_csv_checked(
    spark: SparkSession, path: str, schema: StructType, missing: str = "NA", multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a headered CSV; every line is in exactly one of them.

    A line with too few or too many cells is rejected as it stands, one with a cell that does not fit its column's type with its
    cells written as CSV again, both as ``line`` and with their ``reasons``, one per fault. ``missing`` and empty cells are NULL and no fault, but in a column
    that is not nullable. Both frames are projections of one read without a shuffle. Blank lines are skipped, as by ``read_csv``.
    """
    kept = "_line"
    raw = StructType([*[StructField(f.name, StringType()) for f in schema], StructField(kept, StringType())])
    text = spark.read.schema(raw).csv(
        path, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=kept, enforceSchema=True
    )
    cells, faults = [], [F.when(F.col(kept).isNotNull(), F.lit("wrong number of cells"))]
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        known = F.when(cell != missing, cell)
        value = known if isinstance(f.dataType, StringType) else known.try_cast(f.dataType)
        cells.append(value.alias(f.name))
        told = F.concat(F.lit(f"{f.name}: not {f.dataType.simpleString()}: "), known)
        faults.append(F.when(F.col(kept).isNull() & known.isNotNull() & value.isNull(), told))
        if not f.nullable:
            faults.append(F.when(F.col(kept).isNull() & known.isNull(), F.lit(f"{f.name}: missing")))
    reasons = F.array_compact(F.array(*faults))
    shown = F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    judged = text.withColumns({"_reasons": reasons, "_shown": F.coalesce(kept, shown)})
    accepted = judged.filter(F.size("_reasons") == 0).select(*cells)
    rejected = judged.filter(F.size("_reasons") > 0).select(F.col("_shown").alias("line"), F.col("_reasons").alias("reasons"))
    return accepted, rejected


#: column classes from narrow to wide; a column read under several classes takes the widest
CLASSES = {"integer": "bigint", "numeric": "double", "character": "string"}


def column_classes(classes: DataFrame, column: str, imports: Sequence[str] | None = None) -> dict[str, str]:
    """The widest class of every column over the named imports, from a table with a row per column.

    Missing classes and "NA" are passed over; a column without any class is character; another word is an error. The table has a row
    per column of a schema, so it is read whole.
    """
    imports = list(imports or [c for c in classes.columns if c != column])
    order, out = list(CLASSES), {}
    for r in classes.select(column, *imports).collect():
        given = [r[i] for i in imports if r[i] is not None and r[i] != "NA"]
        for g in given:
            if g not in CLASSES:
                raise ValueError(f"{r[column]}: unknown class {g}")
        widest = max((order.index(g) for g in given), default=len(order) - 1)
        out[r[column]] = order[max(widest, order.index(out.get(r[column], order[0])))]
    return out


def apply_classes(df: DataFrame, classes: dict[str, str], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(typed, ledger): the columns cast to their classes, and a row per cell that could not be.

    A cell that does not fit becomes NULL in the typed frame and stands in the ledger as (key, column, value, class). Columns
    without a class stay as they are; classes of absent columns are passed over.
    """
    named = [c for c in df.columns if c in classes]
    cast = {c: F.col(f"`{c}`").try_cast(CLASSES[classes[c]]) for c in named}
    typed = df.select(*[cast[c].alias(c) if c in cast else F.col(f"`{c}`") for c in df.columns])
    faults = [
        F.when(
            F.col(f"`{c}`").isNotNull() & cast[c].isNull(),
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(classes[c]).alias("class")),
        )
        for c in named
    ]
    if not faults:
        faults = [F.lit(None).cast("struct<column:string,value:string,class:string>")]
    ledger = df.select(*[F.col(f"`{k}`").alias(f"key_{k}") for k in key], F.explode(F.array_compact(F.array(*faults))).alias("_f"))
    return typed, ledger.select(*[F.col(f"`key_{k}`").alias(k) for k in key], "_f.*")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: dict | None = None,
) -> DataFrame:
    """Partitioned read of a database table or view; filters and columns are pushed down."""
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )


def code_list(
    codes: DataFrame,
    code_ref: str,
    ref: str = "CodeRef",
    value: str = "Value",
    label: str = "Label",
    row_no: str | None = None,
) -> DataFrame:
    """Labels of one code list, ordered by value (then label); ``row_no`` names a column for the place in that order."""
    found = codes.filter(F.col(ref) == code_ref).select(value, label).distinct()
    return global_order(found, [value, label], row_no) if row_no else found.orderBy(value, label)


def without(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is not in the list; missing values stay."""
    return df.filter(not_isin_safe(F.col(column), values))


def reconcile_imports(
    imports: Sequence[tuple[DataFrame, dict[str, str]]], types: dict[str, str]
) -> DataFrame:
    """Stack several imports of one table: rename each to common names, cast to common types."""
    parts = []
    for frame, names in imports:
        renamed = frame.withColumnsRenamed(names)
        known = [F.col(c).try_cast(t).alias(c) for c, t in types.items() if c in renamed.columns]
        parts.append(renamed.select(*known))
    return union_rows(*parts).select(*types)


def observation_dates(
    imports: Sequence[tuple[DataFrame, DataFrame, dict[str, str], dict[str, str]]],
    session: str,
    key: str,
    day: str,
    types: dict[str, str],
) -> DataFrame:
    """Days each individual was observed, per import: events and sessions renamed, joined, stacked."""
    days = []
    for events, sessions, event_names, session_names in imports:
        seen = events.withColumnsRenamed(event_names).select(session, key).distinct()
        dated = sessions.withColumnsRenamed(session_names).select(session, day)
        rows = seen.join(dated, session, "left").select(
            *[F.col(c).cast(types[c]).alias(c) for c in (key, day)]
        )
        days.append(rows.distinct())
    return union_rows(*days)
