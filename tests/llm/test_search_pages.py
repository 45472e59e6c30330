"""Exact search and page extraction against brute-force versions; the SQL checks of the native queries."""

from __future__ import annotations

import html
import re
from pathlib import Path

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from cohortspark.llm import pages, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="shared tables not available")
@pytest.mark.parametrize("name", ["op1_chat_formatting", "op7_quality_rules", "op9_exact_topk"])
def test_sql(name, spark):
    found = oracle.differences(registry.queries()[name](spark, SF), oracle.connect(SF), registry.oracle_sql()[name])
    assert [f for f in found if "'boolean', 'BOOLEAN'" not in f] == []


@pytest.mark.parametrize("shard, tile", [(4096, 2048), (7, 3)])
def test_topk(spark, shard, tile):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=4).round(1).tolist() for _ in range(60)] + [[0.5, 0.5, 0.5, 0.5]] * 40
    vectors += [None, [], [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(3, vectors[3], "again"), (None, vectors[0], "y")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string").where(topk.whole_vector("embedding"))
    df = df.withColumn("v", topk.scaled("embedding"))
    got = {}
    for r in topk.top_k(df, "vec_id", "v", F.col("vec_id") % 5 == 0, k=7, shard=shard, tile=tile).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in enumerate(vectors[:100])}
    assert set(got) == {i for i in ints if i % 5 == 0}
    for q, found in got.items():
        scored = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:7]
        assert found == {k + 1: (i, -s) for k, (s, i) in enumerate(scored)}
    assert topk.top_k(df.where("false"), "vec_id", "v", F.lit(True)).count() == 0


def test_topk_large_numbers_stay_exact():
    a = np.array([[2**31, 3]])
    assert topk._products(a, np.array([[2**30, 1]])).tolist() == [[2**61 + 3]]
    with pytest.raises(OverflowError):
        topk._products(a, np.array([[2**40, 1]]))
    found = topk.best(np.array([0]), np.array([[2**31]]), np.array([1, 2, 3]), np.array([[2**30], [2**30 + 1], [2**30]]), 2)
    assert found["vec_id"].tolist() == [2, 1]


def page(k, article, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>t{k}</title><script>var t="</p>";</script><style>p{{}}</style></head><body>'
        f'<header><h1>Site</h1></header><nav><ul><li><a href="/{k}">m{k}</a></li></ul></nav><!-- c{k} -->'
        f'<div class="ad-box">buy {k}</div>{article}{extra}<form><input><label>mail</label></form>'
        f'<div id="comments"><article class="comment"><p>nice {k}</p></article></div><footer>&copy; s{k}</footer></body></html>'
    )


def test_pages_semantic(spark):
    hard = "<p>a &amp; b &lt;i&gt; &am x&nbsp;y<br>c<b>d</b>e <p>same on all</p> <ul><li>one<li>two</ul><aside>no</aside>"
    rows = [(k, f"http://h.example/{k}", page(k, f"<article><h1>T{k}</h1>{hard}<p>tail {k}</article>", "<aside>x</aside>"), "old") for k in range(9)]
    rows += [(100, "http://h.example/odd", "<div><p>other layout 1 < 2</p></div>", None), (101, None, None, None), (102, "http://h.example/e", "", None)]
    rows += [(103, "http://solo.example/", page(103, "<article><p>alone</p></article>"), None), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = pages.extract_pages(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[3] == "T3 a & b <i> &am x y cde same on all one two tail 3"
    assert (got[100], got[101], got[102], got[103]) == ("other layout 1 < 2", "", "", "alone")
    assert pages.extract_pages(df.where("false")).count() == 0


def test_pages_without_semantic_marks(spark):
    def plain(k):
        body = " ".join(f"word{k}x{i}" for i in range(30))
        return f'<html><body><div class="c1"><a href="/">home</a></div><div class="c2"><p>{body}</p><p>more {k}</p><p>Printed on paper</p></div><div class="c3"><span>v{k}</span></div></body></html>'

    rows = [(k, f"https://p.example/{k}", plain(k)) for k in range(8)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == " ".join(f"word{k}x{i}" for i in range(30)) + f" more {k}"


def test_pages_keep_articles_with_many_copies(spark):
    def plain(k):
        return f'<html><body><div class="c1"><p>own text of story {k} which is long enough</p><p>Printed on paper</p></div></body></html>'

    rows = [(k, f"https://p.example/{k}", plain(k)) for k in range(4)] + [(10 + k, f"https://p.example/0?{k % 3}", plain(0)) for k in range(6)]
    rows += [(20 + k, f"https://one.example/{k}", plain(7)) for k in range(5)]
    # addresses of one article whose bodies differ elsewhere
    rows += [(30 + k, f"https://q.example/{k}", plain(8).replace("<html>", f"<html><head><title>{k}</title></head>")) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(df).collect()}
    for k in [0, 1, 2, 3, *range(10, 16)]:
        assert got[k] == f"own text of story {k if k < 10 else 0} which is long enough"
    assert {got[20 + k] for k in range(5)} == {"own text of story 7 which is long enough Printed on paper"}
    assert {got[30 + k] for k in range(4)} == {"own text of story 8 which is long enough Printed on paper"}
    joined = pages.extract_pages(df, sent=0).collect()
    assert {r["page_id"]: r["text"] for r in joined} == got


@pytest.mark.skipif(not Path(SF).exists(), reason="shared tables not available")
def test_pages_of_the_table(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.queries()["op10_html_extraction"](spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        text = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\x00", body))).replace("\x00", " ")
        assert r["text"] == " ".join(text.split()) and r["n_chars"] == len(r["text"])
