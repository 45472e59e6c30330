"""The registered queries: thin projections of what the operators return, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import bpe, centroids, chat, lm, neardup, packing, pages, quality_rules, repeats, resampling, subwords, topk, toxicity
from cohortspark.llm.common import remainder, table
from cohortspark.llm.registry import query
from cohortspark.session import staged

#: the conversation every run formats besides the table's: it holds control strings
PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def _escaped(column: str) -> str:
    out = column
    for raw, code in chat.ESCAPES:
        out = f"replace({out}, '{raw}', '{code}')"
    return out


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op1_chat_formatting",
    check=f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
    UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(replace({_escaped("role")}, ':', '\\c')) + length({_escaped("text")})) AS BIGINT)
           AS formatted_chars
FROM rows GROUP BY conv_id""",
)
def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    rows = rows.withColumn("role", F.coalesce("role", F.lit("")))  # so that a row without any value is a turn, too
    made = chat.format_conversations(rows, "conv_id")
    made = made.withColumn("turns", chat.read_turns(F.col("formatted")))
    made = made.withColumn("trained", chat.trained_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query(
    "op7_quality_rules",
    check=rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
windows AS (
    SELECT rid, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3),
           lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g
    FROM docs WHERE len(w) >= 5
),
twice AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid),
counts AS (
    SELECT doc_id, len(w) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           len(regexp_extract_all(text, '[!?]')) AS marks,
           len(list_filter(w, lambda x: list_contains({quality_rules.STOP_WORDS!r}, lower(x)))) AS stops,
           len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]\s'))) AS bullets,
           len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS cut,
           greatest(len(lines), 1) AS n_lines
    FROM docs LEFT JOIN covered USING (rid)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15
       AND n_symbols / n_words <= 0.1 AND marks / n_words <= 0.7 AND (n_words < 60 OR stops / n_words >= 0.02)
       AND n_dup_lines / n_lines <= 0.5 AND bullets / n_lines <= 0.9 AND cut / n_lines <= 0.5 AS kept
FROM judged""",
)
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _digits(ids: str = "ids") -> Column:
    """The lower-case hex digest of decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path, pattern)
    return bpe.decode(encoded, path, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        _digits().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: fixed values: the vocabulary's only special token, which the tokenizers library reads in texts, and the end id
SPECIAL, END_ID = (("<|endoftext|>", 50256),), 2


def packed(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents with their places; the ranks give the ids of byte_bpe_50k.json."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "text"), path, pattern, special=SPECIAL)
    pieces = packing.cut(encoded, END_ID, capacity).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return packing.pack(staged(pieces), "length", ["doc_id", "piece"], capacity)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query(
    "op9_exact_topk",
    check="""
WITH vectors AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20""",
)
def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where(topk.whole_vector("embedding"))
    rows = rows.select("vec_id", topk.scaled("embedding").alias("vector"))
    return topk.top_k(rows, "vec_id", "vector", F.col("vec_id") % 20 == 0, k=20)


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    texts = pages.extract_pages(table(spark, sf, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def quality_scores(spark: SparkSession, sf: str, docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``docs`` with held_out and score, in place of the text or beside it, learned from the folder's labelled documents."""
    held_out = remainder("doc_id", 4) == 2
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    model = subwords.fit(table(spark, sf, "documents"), labels, "quality", ~held_out, "doc_id")
    return subwords.score(docs.withColumn("held_out", held_out), model, keep_text=keep_text)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality_scores(spark, sf, table(spark, sf, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs.withColumn("held_out", held_out), labels, "toxic", ~held_out, "doc_id")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_minhash_neardup")
def op8_minhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    found = neardup.classes(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    docs = table(spark, sf, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = lm.score(docs, ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _clustering_sql(s: centroids.Settings = centroids.Settings()) -> str:
    """All rounds as a chain of tables: vectors v, centroids c0, c1, ..., assignments a0, a1, ..."""
    inner = "list_inner_product({0}.v, {0}.v) - 2 * list_inner_product({0}.v, {1}.v) + list_inner_product({1}.v, {1}.v)"
    far = inner.format("x", "c")
    chain = []
    for r in range(s.rounds + 1):
        chain.append(
            f"""a{r} AS MATERIALIZED (
    SELECT rid, x.v, arg_min(k, ({far}) * {s.k} + k) AS k, min({far}) AS d FROM vectors x, c{r} c GROUP BY rid, x.v)"""
        )
        if r < s.rounds:
            mean = "list(floor_mean ORDER BY j)"
            chain.append(
                f"""c{r + 1} AS MATERIALIZED (
    SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT k, {mean} AS v FROM (
            SELECT k, j, (sum(v[j])::BIGINT - ((sum(v[j])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
            FROM a{r}, range(1, {s.dimension + 1}) AS t(j) GROUP BY k, j) GROUP BY k) m USING (k))"""
            )
    last = s.rounds
    return f"""
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE len(embedding) = {s.dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{s.salt}' || vec_id), v) - 1 AS k, v
    FROM vectors ORDER BY sha256('{s.salt}' || vec_id), v LIMIT {s.k}
),
{",".join(chain)}
SELECT x.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{last} a JOIN vectors x USING (rid) JOIN c{last} c ON a.k = c.k"""


@query("op12_centroid_clustering", check=_clustering_sql())
def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


#: CRC-32 of the words of a table ``distinct_words`` (word), by the register's table of 256 steps
_CRC_SQL = """
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
digits AS (SELECT word, hex(word) AS x FROM distinct_words),
crcs AS MATERIALIZED (
    SELECT word, xor(list_reduce([4294967295] || list_transform(range(1, length(x), 2),
               lambda p: 16 * (strpos('0123456789ABCDEF', x[p]) - 1) + strpos('0123456789ABCDEF', x[p + 1]) - 1),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM digits, crc_table
)"""

_PLAIN_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op13_importance_resampling",
    check=f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN_WORDS} AS w FROM documents),
doc_words AS MATERIALIZED (SELECT rid, unnest(w) AS word FROM docs),
goal_words AS MATERIALIZED (SELECT unnest({_PLAIN_WORDS}) AS word FROM benchmark),
distinct_words AS (SELECT word FROM doc_words UNION SELECT word FROM goal_words),
{_CRC_SQL},
buckets AS (SELECT word, crc % 10000 AS b FROM crcs),
have AS (SELECT b, count(*) AS n FROM doc_words JOIN buckets USING (word) GROUP BY b),
want AS (SELECT b, count(*) AS n FROM goal_words JOIN buckets USING (word) GROUP BY b),
gain AS (
    SELECT r.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM doc_words) + 10000) AS DOUBLE)
           / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM goal_words) + 10000) AS DOUBLE))) AS BIGINT) AS g
    FROM range(10000) AS r(b) LEFT JOIN have s USING (b) LEFT JOIN want t USING (b)
),
sums AS (
    SELECT rid, CAST(sum(g) AS BIGINT) AS g, count(*) AS n
    FROM doc_words JOIN buckets USING (word) JOIN gain USING (b) GROUP BY rid
),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features,
           CASE WHEN n > 0 THEN (g - (g % n + n) % n) // n ELSE 0 END AS weight,
           CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE)
               / 4294967296))) AS BIGINT) AS noise
    FROM docs LEFT JOIN sums USING (rid)
),
placed AS (
    SELECT *, weight + noise AS score, n_features >= 20 AS able,
           row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place
    FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN able AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed""",
)
def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256"
    )
