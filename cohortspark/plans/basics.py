"""The relational building blocks on their own: sources, predicates, joins, grouping, reshaping, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.functions.nulls import fill, ifelse_na, n_distinct_na, not_isin_safe, sum_strict
from cohortspark.operators import relational as rel
from cohortspark.operators.ordering import day_table, id_slice, shifted
from cohortspark.plans import roles
from cohortspark.plans.registry import query
from cohortspark.plans.roles import PRIORITIES, sql
from cohortspark.session import shared_folder
from cohortspark.sources import readers, writers

# --------------------------------------------------------------------------------------- sources


@query(
    "code_list",
    "SELECT DISTINCT p_size AS value, p_brand AS label FROM part WHERE p_type = 'ECONOMY'",
)
def code_list(spark, sf):
    codes = roles.table(spark, sf, "part").select(
        F.col("p_type").alias("ref"), F.col("p_size").alias("value"), F.col("p_brand").alias("label")
    )
    return readers.code_list(codes, "ECONOMY", "ref", "value", "label")


@query(
    "code_list_numbered",
    """SELECT CAST(row_number() OVER (ORDER BY value, label) AS BIGINT) AS row_no, value, label
       FROM (SELECT DISTINCT p_size AS value, p_brand AS label FROM part WHERE p_type = 'ECONOMY')""",
)
def code_list_numbered(spark, sf):
    codes = roles.table(spark, sf, "part").select(
        F.col("p_type").alias("ref"), F.col("p_size").alias("value"), F.col("p_brand").alias("label")
    )
    return readers.code_list(codes, "ECONOMY", "ref", "value", "label", row_no="row_no")


@query(
    "sorted_export",
    """SELECT CAST(row_number() OVER (ORDER BY event_type NULLS LAST, value NULLS LAST, event_id) AS VARCHAR) AS row_name,
         event_type AS behaviour, value AS amount, event_id AS ref FROM events""",
)
def sorted_export(spark, sf):
    rows = roles.table(spark, sf, "events").select(
        F.col("event_type").alias("behaviour"), F.col("value").alias("amount"), F.col("event_id").alias("ref")
    )
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    writers.write_csv(rows, path, order=["behaviour", "amount", "ref"], row_names="row_name")
    kinds = StructType.fromDDL("row_name string, behaviour string, amount double, ref bigint")
    return readers.read_csv(spark, path, kinds)


@query(
    "csv_rejects",
    """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS visits, NULL AS line, NULL AS reasons FROM customer WHERE c_custkey % 7 > 3
       UNION ALL
       SELECT NULL, NULL, CASE c_custkey % 7 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_custkey || ',x' || c_nationkey
           WHEN 2 THEN c_custkey || ',' || c_nationkey || ',more' ELSE ',NA' END,
         CASE c_custkey % 7 WHEN 1 THEN 'visits: not bigint: x' || c_nationkey WHEN 3 THEN 'id: missing' ELSE 'wrong number of cells' END
       FROM customer WHERE c_custkey % 7 <= 3""",
)
def csv_rejects(spark, sf):
    """A file in which four lines of seven are broken, split into accepted rows and rejects."""
    key, visits, kind = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_custkey") % 7
    line = (
        F.when(kind == 0, key)
        .when(kind == 1, F.concat(key, F.lit(",x"), visits))
        .when(kind == 2, F.concat(key, F.lit(","), visits, F.lit(",more")))
        .when(kind == 3, F.lit(",NA"))
        .otherwise(F.concat(key, F.lit(","), visits))
    )
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    lines = roles.table(spark, sf, "customer").select(line.alias("id,visits"))
    lines.write.csv(path, header=True, sep="\x01", quote="\x00")
    schema = StructType.fromDDL("id bigint not null, visits bigint")
    accepted, rejected = readers.read_csv_checked(spark, path, schema)
    none = F.lit(None).cast("string")
    good = accepted.select("id", "visits", none.alias("line"), none.alias("reasons"))
    empty = F.lit(None).cast("bigint")
    bad = rejected.select(empty.alias("id"), empty.alias("visits"), "line", F.array_join("reasons", "; ").alias("reasons"))
    return rel.union_rows(good, bad)


def _classed(spark, sf):
    """Customers as text under a table of column classes that two imports disagree on."""
    kind = F.col("c_custkey") % 4
    text = F.col("c_nationkey").cast("string")
    raw = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("ref"),
        F.when(kind == 0, F.concat(text, F.lit(".5"))).otherwise(text).alias("duration"),
        F.when(kind == 1, F.concat(F.lit("n"), text)).when(kind == 2, F.lit(None)).otherwise(text).alias("total"),
        F.col("c_mktsegment").alias("observer"),
    )
    table = spark.createDataFrame(
        [("ref", "integer", "integer"), ("duration", "integer", "numeric"), ("total", "integer", "NA"), ("observer", "integer", "character")],
        "column_name string, first string, second string",
    )
    return readers.apply_classes(raw, readers.column_classes(table, "column_name"), ["ref"])


@query(
    "typed_columns",
    """SELECT c_custkey AS ref, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS duration,
         CASE WHEN c_custkey % 4 IN (0, 3) THEN c_nationkey::BIGINT END AS total, c_mktsegment AS observer FROM customer""",
)
def typed_columns(spark, sf):
    return _classed(spark, sf)[0]


@query(
    "failed_casts",
    """SELECT c_custkey::VARCHAR AS ref, 'total' AS "column", 'n' || c_nationkey AS value, 'integer' AS class
       FROM customer WHERE c_custkey % 4 = 1""",
)
def failed_casts(spark, sf):
    return _classed(spark, sf)[1]


@query(
    "neighbours_in_order",
    """SELECT o_orderkey * 1000 AS ref, o_orderstatus AS status,
         LEAD(o_totalprice) OVER w AS next_amount, LAG(o_totalprice) OVER w AS last_amount, LAG(o_custkey) OVER w AS last_animal
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)""",
)
def neighbours_in_order(spark, sf):
    """Next and previous values in groups that each hold a third of all rows, ordered by sparse ids."""
    rows = roles.table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 1000).alias("ref"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_custkey").alias("animal"),
    )
    width = id_slice(rows, "ref", 1 << 12)
    ahead = shifted(rows, ["status"], ["ref"], {"amount": "next_amount"}, width=width)
    both = shifted(ahead, ["status"], ["ref"], {"amount": "last_amount", "animal": "last_animal"}, "lag", width)
    return both.drop("amount", "animal")


@query(
    "csv_round_trip",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name
         ELSE 'a "quoted", name' END AS name,
         CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS balance FROM customer""",
)
def csv_round_trip(spark, sf):
    c = F.col("c_custkey")
    rows = roles.table(spark, sf, "customer").select(
        c.alias("id"),
        F.when(c % 3 == 0, "").when(c % 3 == 1, F.col("c_name")).otherwise('a "quoted", name').alias("name"),
        F.when(c % 5 > 0, F.col("c_acctbal")).alias("balance"),
    )
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, StructType.fromDDL("id bigint, name string, balance double"))


@query(
    "reconcile_imports",
    """SELECT CAST(o_orderkey AS BIGINT) AS ref, CAST(o_custkey AS VARCHAR) AS animal,
         CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DOUBLE) AS amount FROM orders
       UNION ALL SELECT event_id, 'u' || user_id, CAST(ts AS DATE), NULL FROM events""",
)
def reconcile_imports(spark, sf):
    old = roles.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    new = roles.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        "ts",
    )
    return readers.reconcile_imports(
        [
            (
                old,
                {"o_orderkey": "ref", "o_custkey": "animal", "o_orderdate": "day", "o_totalprice": "amount"},
            ),
            (new, {"event_id": "ref", "user_id": "animal", "ts": "day"}),
        ],
        {"ref": "bigint", "animal": "string", "day": "date", "amount": "double"},
    )


# ------------------------------------------------------------------------------------ predicates


@query(
    "predicates",
    sql(
        """SELECT event_id, CASE WHEN label IS NULL OR label <> 'P' THEN 'kept' ELSE 'left' END AS not_in,
             CASE WHEN label = 'F' THEN 1 WHEN label <> 'F' THEN 0 END AS flag,
             CASE WHEN grp LIKE '%HIGH%' THEN 'Yes' ELSE 'No' END AS is_high,
             COALESCE(CAST(unit AS VARCHAR), 'None') AS unit
           FROM (SELECT *, NULLIF(status, 'O') AS label,
                   CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS unit FROM order_days)
           WHERE grp <> '5-LOW' AND day >= DATE '1996-01-01'""",
        "order_days",
    ),
)
def predicates(spark, sf):
    e = F.col("event_id")
    rows = roles.order_days(spark, sf).filter(
        (F.col("grp") != "5-LOW") & (F.col("day") >= F.lit("1996-01-01").cast("date"))
    )
    rows = rows.withColumns(
        {
            "label": F.when(F.col("status") != "O", F.col("status")),
            "unit": F.when(e % 4 > 0, e % 4),
        }
    )
    out = rows.select(
        "event_id",
        F.when(not_isin_safe(F.col("label"), ["P"]), "kept").otherwise("left").alias("not_in"),
        ifelse_na(F.col("label") == "F", F.lit(1), F.lit(0)).alias("flag"),
        F.when(F.col("grp").rlike("HIGH"), "Yes").otherwise("No").alias("is_high"),
        "unit",
    )
    return fill(out, {"unit": "None"})


# ----------------------------------------------------------------------------------------- joins

_LABELLED = """SELECT animal, segment, CASE WHEN segment <> 'MACHINERY' THEN segment END AS label FROM entity"""


@query(
    "null_safe_join",
    sql(
        """SELECT l.animal, l.label, s.n_members FROM labelled l
           LEFT JOIN (SELECT label, COUNT(*) AS n_members FROM labelled GROUP BY label) s
             ON s.label IS NOT DISTINCT FROM l.label""",
        "entity",
        labelled=_LABELLED,
    ),
)
def null_safe_join(spark, sf):
    label = F.when(F.col("segment") != "MACHINERY", F.col("segment"))
    rows = roles.entity(spark, sf).select("animal", label.alias("label"))
    return rel.group_values(rows, "label", n_members=F.count(F.lit(1)))


@query(
    "full_outer_counts",
    sql(
        """SELECT COALESCE(g.animal, r.animal) AS animal, COALESCE(g.n, 0) AS given,
             COALESCE(r.n, 0) AS received, COALESCE(g.n, 0) + COALESCE(r.n, 0) AS total
           FROM (SELECT animal, COUNT(*) AS n FROM obs GROUP BY animal) g
           FULL JOIN (SELECT k + 100 AS animal, COUNT(*) AS n FROM obs GROUP BY k) r
             ON r.animal = g.animal""",
        "obs",
    ),
)
def full_outer_counts(spark, sf):
    rows = roles.obs(spark, sf)
    given = rows.groupBy("animal").agg(F.count(F.lit(1)).alias("given"))
    received = rows.groupBy((F.col("k") + 100).alias("animal")).agg(F.count(F.lit(1)).alias("received"))
    out = fill(rel.natural_join(given, received, "full"), {"given": 0, "received": 0})
    return out.withColumn("total", F.col("given") + F.col("received"))


@query(
    "except_rows",
    sql(
        """SELECT DISTINCT animal, day FROM order_days
           EXCEPT SELECT animal, day FROM shipments""",
        "order_days",
        "shipments",
    ),
)
def except_rows(spark, sf):
    days = roles.order_days(spark, sf).select("animal", "day").distinct()
    return rel.anti(days, roles.shipments(spark, sf).select("animal", "day"))


@query(
    "semi_rows",
    sql(
        """SELECT DISTINCT animal, day FROM order_days
           INTERSECT SELECT animal, day FROM shipments""",
        "order_days",
        "shipments",
    ),
)
def semi_rows(spark, sf):
    days = roles.order_days(spark, sf).select("animal", "day").distinct()
    return rel.semi(days, roles.shipments(spark, sf).select("animal", "day"))


@query(
    "latest_with_ties",
    sql(
        """SELECT animal, day, event_id FROM (SELECT *, MAX(day) OVER (PARTITION BY animal) AS last
             FROM order_days) WHERE day = last""",
        "order_days",
    ),
)
def latest_with_ties(spark, sf):
    rows = roles.order_days(spark, sf).select("animal", "day", "event_id")
    return rel.keep_extreme(rows, "animal", "day", "max")


@query(
    "first_row_per_key",
    sql(
        """SELECT animal, grp, day, event_id FROM (SELECT *, ROW_NUMBER() OVER
             (PARTITION BY animal, grp ORDER BY day, event_id) AS rn FROM order_days) WHERE rn = 1""",
        "order_days",
    ),
)
def first_row_per_key(spark, sf):
    rows = roles.order_days(spark, sf).select("animal", "grp", "day", "event_id")
    return rel.keep_first(rows, ["animal", "grp"], ["day", "event_id"])


# ------------------------------------------------------------------------- grouping and reshaping


@query(
    "group_aggregates",
    sql(
        """SELECT grp, COUNT(*) AS n, COUNT(DISTINCT label) + MAX(CASE WHEN label IS NULL THEN 1 ELSE 0 END)
             AS n_labels, CAST(CASE WHEN COUNT(*) = COUNT(early) THEN SUM(early) END AS BIGINT) AS strict_total,
             CAST(SUM(early) AS BIGINT) AS total, MIN(day) AS first_day, MAX(day) AS last_day
           FROM (SELECT *, NULLIF(status, 'O') AS label,
                   CASE WHEN grp <> '2-HIGH' OR event_id % 2 = 0 THEN event_id END AS early FROM order_days)
           GROUP BY grp""",
        "order_days",
    ),
)
def group_aggregates(spark, sf):
    early = F.when((F.col("grp") != "2-HIGH") | (F.col("event_id") % 2 == 0), F.col("event_id"))
    rows = roles.order_days(spark, sf).withColumns(
        {"label": F.when(F.col("status") != "O", F.col("status")), "early": early}
    )
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        n_distinct_na(F.col("label")).alias("n_labels"),
        sum_strict(F.col("early")).alias("strict_total"),
        F.sum("early").alias("total"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


@query(
    "group_by_all_but",
    sql(
        """SELECT animal, grp, status, COUNT(*) AS n FROM (SELECT animal, grp, status, event_id
             FROM order_days) GROUP BY animal, grp, status""",
        "order_days",
    ),
)
def group_by_all_but(spark, sf):
    rows = roles.order_days(spark, sf).select("animal", "grp", "status", "event_id")
    return rel.group_by_all_but(rows, "event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "grand_total",
    """SELECT COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem""",
    exact=("total",),
)
def grand_total(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return roles.table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.sum(price).alias("total")
    )


_WIDE = ", ".join(f"COALESCE(SUM(weight) FILTER (grp = '{p}'), 0) AS \"{p}\"" for p in PRIORITIES)
_WEIGHED = """SELECT o.animal, o.grp, CAST(l_quantity AS DECIMAL(12,2)) AS weight FROM order_days o
    JOIN lineitem ON l_orderkey = o.event_id"""


def _weighed(spark, sf):
    lines = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_quantity").cast("decimal(12,2)").alias("weight")
    )
    return roles.order_days(spark, sf).join(lines, "event_id").select("animal", "grp", "weight")


@query(
    "to_wide",
    sql(f"SELECT animal, {_WIDE} FROM weighed GROUP BY animal", "order_days", weighed=_WEIGHED),
    exact=PRIORITIES,
)
def to_wide(spark, sf):
    return rel.to_wide(_weighed(spark, sf), "animal", "grp", PRIORITIES, "weight")


@query(
    "to_long",
    sql(
        " UNION ALL ".join(
            f"SELECT animal, '{p}' AS grp, \"{p}\" AS weight FROM wide" for p in PRIORITIES
        ),
        "order_days",
        weighed=_WEIGHED,
        wide=f"SELECT animal, {_WIDE} FROM weighed GROUP BY animal",
    ),
    exact=("weight",),
)
def to_long(spark, sf):
    wide = rel.to_wide(_weighed(spark, sf), "animal", "grp", PRIORITIES, "weight")
    return rel.to_long(wide, "animal", PRIORITIES, "grp", "weight")


@query(
    "day_table",
    sql(
        """SELECT animal, day, n_rows, CAST(COALESCE(SUM(n_rows) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
               AND 1 PRECEDING), 0) AS BIGINT) AS rows_before, ROW_NUMBER() OVER w AS day_no,
             LAG(day) OVER w AS previous_day, LEAD(day) OVER w AS next_day
           FROM (SELECT animal, day, COUNT(*) AS n_rows FROM order_days GROUP BY animal, day)
           WINDOW w AS (PARTITION BY animal ORDER BY day)""",
        "order_days",
    ),
)
def days(spark, sf):
    return day_table(roles.order_days(spark, sf), ["animal"], "day")


# --------------------------------------------------------------------------------------- scalars


@query(
    "scalars",
    sql(
        """SELECT event_id, UPPER('c' || animal) AS "animal.id",
             regexp_replace(grp, '[^A-Za-z0-9._]', '.', 'g') AS plain,
             day + 14 AS later, day - 88 AS earlier, CAST(day - to_months(3) AS DATE) AS three_months_before,
             CAST(day + to_months(12) AS DATE) AS birthday,
             date_diff('day', day, DATE '2001-12-31') AS remaining,
             ROUND(date_diff('day', day, DATE '2001-12-31') / 30.4375, 6) AS months,
             TRY_CAST(LEFT(grp, 1) AS INTEGER) AS code, TRY_CAST(grp AS INTEGER) AS no_code
           FROM order_days""",
        "order_days",
    ),
)
def scalars(spark, sf):
    end = F.lit(roles.LAST_DAY).cast("date")
    left = F.datediff(end, "day").cast("bigint")
    rows = roles.order_days(spark, sf).select(
        "event_id",
        F.upper(F.concat(F.lit("c"), F.col("animal").cast("string"))).alias("animal id"),
        F.regexp_replace("grp", "[^A-Za-z0-9._]", ".").alias("plain"),
        F.date_add("day", 14).alias("later"),
        F.date_sub("day", 88).alias("earlier"),
        F.add_months("day", -3).alias("three_months_before"),
        F.add_months("day", 12).alias("birthday"),
        left.alias("remaining"),
        F.round(left / 30.4375, 6).alias("months"),
        F.substring("grp", 1, 1).try_cast("int").alias("code"),
        F.col("grp").try_cast("int").alias("no_code"),
    )
    return rel.make_names(rows)


_HALF_NULL = "SELECT event_id, value, CASE WHEN event_id % 2 = 1 THEN user_id END AS animal FROM events"
_NAMES = "SELECT animal, COUNT(*) AS n, MIN(event_id) AS first_event FROM half GROUP BY animal HAVING animal IS NULL OR animal % 3 > 0"


def _half_null(spark, sf):
    rows = roles.table(spark, sf, "events").select(
        "event_id", "value", F.when(F.col("event_id") % 2 == 1, F.col("user_id")).alias("animal")
    )
    names = rows.groupBy("animal").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return rows, names.filter(F.col("animal").isNull() | (F.col("animal") % 3 > 0))


@query(
    "heavy_key_join",
    f"""WITH half AS ({_HALF_NULL}), names AS ({_NAMES})
        SELECT event_id, value, half.animal, n, first_event FROM half LEFT JOIN names
        ON half.animal IS NOT DISTINCT FROM names.animal""",
)
def heavy_key_join(spark, sf):
    rows, names = _half_null(spark, sf)
    return rel.heavy_join(rows, names, "left", "animal")


@query(
    "heavy_key_anti",
    f"""WITH half AS ({_HALF_NULL}), names AS ({_NAMES})
        SELECT event_id, value, animal FROM half
        WHERE NOT EXISTS (SELECT 1 FROM names WHERE names.animal IS NOT DISTINCT FROM half.animal)""",
)
def heavy_key_anti(spark, sf):
    rows, names = _half_null(spark, sf)
    return rel.heavy_join(rows, names, "left_anti", "animal")


_LEVELS = ("click", "error", "purchase", "signup", "view")


@query(
    "contingency_found_levels",
    "SELECT user_id % 7 AS part, "
    + ", ".join(f"COUNT(*) FILTER (event_type = '{v}') AS {v}" for v in _LEVELS)
    + " FROM events GROUP BY ALL",
)
def contingency_found_levels(spark, sf):
    """The columns come from the data; only the check names them."""
    rows = roles.table(spark, sf, "events").select((F.col("user_id") % 7).alias("part"), "event_type")
    return rel.contingency(rows, "part", "event_type")


@query(
    "wide_found_levels",
    "SELECT user_id % 7 AS part, "
    + ", ".join(f"CAST(COALESCE(SUM(event_id) FILTER (event_type = '{v}'), 0) AS BIGINT) AS {v}" for v in _LEVELS)
    + " FROM events GROUP BY ALL",
)
def wide_found_levels(spark, sf):
    rows = roles.table(spark, sf, "events").select((F.col("user_id") % 7).alias("part"), "event_type", "event_id")
    return rel.to_wide(rows, "part", "event_type", None, "event_id")
