"""Quality rules: a threshold table compiled into native expressions, no user functions.

``measure`` adds the counts, ``decide`` compiles the table into one verdict. Every step is a projection, so
nothing is shuffled and a document is judged where it is read.

Defined results: a null text counts as empty (0 words, rejected as too short); repeated rows are each judged;
other columns, also ones named like a measure's inputs, are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import SPACE, SPACE_CHARS, whole_text

#: fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als "
    "de la le et les en des un du une que est pour par dans avec qui pas sur au "
    "el y los las se del por con no su para es al lo"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Bounds of a ratio; ``least_words``: shorter documents are not judged by it."""

    ratio: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: the verdict on documents that pass the base rules
RULES = (
    Rule("chars_per_word", low=2.0, high=15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("marks_per_word", high=0.7),
    Rule("stop_words_per_word", low=0.02, least_words=60),
    Rule("duplicate_lines_per_line", high=0.5),
    Rule("bullet_lines_per_line", high=0.9),
    Rule("cut_lines_per_line", high=0.5),
)


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words from __words: words inside word windows that the text holds twice or more."""
    n = F.size("__words")
    hashed = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)]),
    )
    df = df.withColumn("__h", F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = F.sort_array(
        F.transform(F.sequence(F.lit(0), F.size("__h") - 1), lambda i: F.struct(F.get(F.col("__h"), i).alias("h"), i.alias("i")))
    )
    df = df.withColumn("__o", F.when(some, ordered))

    def at(k: Column) -> Column:
        return F.get(F.col("__o"), k)

    twice = F.filter(
        F.sequence(F.lit(0), F.size("__o") - 1),
        lambda k: F.coalesce(at(k)["h"] == F.get(F.col("__o"), k - 1)["h"], F.lit(False))
        | F.coalesce(at(k)["h"] == F.get(F.col("__o"), k + 1)["h"], F.lit(False)),
    )
    df = df.withColumn("__k", F.when(F.col("__o").isNotNull(), twice))
    df = df.withColumn("__s", F.when(F.col("__k").isNotNull(), F.sort_array(F.transform("__k", lambda k: at(k)["i"]))))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("__s") - 1),
        F.lit(0).cast("bigint"),
        lambda total, k: total
        + F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("__s"), k + 1) - F.get(F.col("__s"), k)), F.lit(WINDOW)),
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("__s").isNotNull(), covered).otherwise(F.lit(0).cast("bigint")))
    return df.drop("__h", "__o", "__k", "__s")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``ratios``."""
    df = df.withColumn("__text", whole_text(text))
    df = df.withColumn("__trimmed", F.btrim("__text", F.lit(SPACE_CHARS)))
    df = df.withColumn(
        "__words",
        F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(
            F.split("__trimmed", f"[{SPACE}]+")
        ),
    )
    df = df.withColumn(
        "__lines", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__marks": F.regexp_count("__text", F.lit("[!?]")),
            "__stops": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))),
            "__n_lines": F.size("__lines"),
            "__bullets": F.size(F.filter("__lines", lambda x: F.ltrim(x).rlike(r"^[-*•]\s"))),
            "__cut": F.size(F.filter("__lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        }
    )
    df = _repeated(df)
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("__n_lines"), F.lit(1))
    ratios = {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("__marks") / words,
        "stop_words_per_word": F.col("__stops") / words,
        "duplicate_lines_per_line": F.col("n_dup_lines") / lines,
        "bullet_lines_per_line": F.col("__bullets") / lines,
        "cut_lines_per_line": F.col("__cut") / lines,
    }
    df = df.withColumn("ratios", F.struct(*[v.alias(k) for k, v in ratios.items()]))
    return df.drop("__text", "__trimmed", "__words", "__lines", "__marks", "__stops", "__n_lines", "__bullets", "__cut")


def decide(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept: the base rules, then every row of the threshold table."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passes = F.lit(True)
    for rule in rules:
        ratio, holds = F.col("ratios")[rule.ratio], F.lit(True)
        if rule.low is not None:
            holds &= ratio >= rule.low
        if rule.high is not None:
            holds &= ratio <= rule.high
        if rule.least_words:
            holds |= F.col("n_words") < rule.least_words
        passes &= holds
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes)


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their measures and the verdict ``kept``."""
    return decide(measure(df, text), rules)


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    A filter on the verdict alone would be pushed below the projections, with every intermediate value written out
    again in the condition; the row number, which cannot be moved, holds it above them.
    """
    judged = apply_rules(df, text, rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).select(*df.columns)
