"""Equivalence classes of page tokens: vectors, order, nesting, and what they decide on hosts without semantic marks."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pandas as pd

from cohortspark.llm import pages

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, rows, **settings):
    return {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, SCHEMA), **settings).collect()}


def test_classes_equal_those_of_whole_vectors(spark):
    """The hashed vectors part tokens as the vectors themselves do, also with repeated bodies."""
    rng = random.Random(3)
    bodies = []
    for k in range(12):
        parts = "".join(f"<p>{rng.choice('abc')}</p>" + "<i>same</i>" * rng.randrange(2) for _ in range(rng.randrange(1, 4)))
        bodies.append(f"<div><h1>t</h1>{parts}</div>" + "<hr>" * (k % 2))
    bodies += [bodies[0]] * 5
    vectors = defaultdict(lambda: [0] * 12)
    for k, body in enumerate(bodies[:12]):
        for t, text, _, _ in pages.sequence(body):
            vectors[t, text][k] += 1
    distinct = [bodies[:12].index(b) for b in bodies[:12]]
    want = defaultdict(set)
    for t, v in vectors.items():
        want[tuple(n for k, n in enumerate(v) if distinct[k] == k)].add(t)
    copies = Counter(bodies)
    frame = pd.DataFrame({"__host": "h", "__html": bodies, "__n": [copies[b] for b in bodies]})
    sums = pd.concat(list(pages._counted(iter([frame.iloc[:7], frame.iloc[7:]]))))
    sums = sums.groupby(["token", "text"]).sum(numeric_only=True).reset_index()
    sums["f1"], sums["f2"] = sums["f1"] % pages.PRIME, sums["f2"] % pages.PRIME
    got = pages.classes(sums["token"].tolist(), sums["text"].tolist(), list(zip(sums["support"].round(), sums["f1"], sums["f2"])))
    groups = defaultdict(set)
    for t, (c, text) in got.items():
        groups[c].add((t, text))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def told(page, groups):
    of = {pages.token(t): c for c, group in groups.items() for t in group}
    return pages.witness(page, of, Counter(of.values()))


def test_order_slots_and_crossing():
    a, b = ["/div", "/div>", "/div/h1", "/div/h1>"], ["/div/p", "/div/p>"]
    says, chars = told("<div><h1>x</h1><p>one</p><p>three</p></div>", {0: a, 1: b})
    assert says[0][0] and says[1][0] and says[0][2] == "" and says[1][2] == "0.3"
    assert chars == {"/div/h1": 1, "/div/p": 8}
    # paragraphs in two slots, and another order of the outer class
    moved, _ = told("<div><p>one</p><h1>x</h1><p>two</p></div>", {0: a, 1: b})
    assert moved[1][2] == "*" and moved[0][1] == says[0][1]
    swap = ["/u", "/u>", "/v", "/v>"]
    one, two = told("<u></u><v></v>", {0: swap})[0], told("<v></v><u></u>", {0: swap})[0]
    assert one[0][0] and two[0][0] and one[0][1] != two[0][1]
    assert not told("<u></u><v></v><v></v><u></u>", {0: swap})[0][0][0]
    # a class that starts inside a repetition and ends behind it is not sound
    cross, _ = told("<u></u><v></v><w></w>", {0: ["/u", "/v"], 1: ["/u>", "/w"]})
    assert cross[0][0] and not cross[1][0]


def test_nested_classes_lead_to_the_root():
    assert pages.nest({0: "", 1: "0.2", 2: "1.1", 3: "*", 4: "3.1", 5: "6.1", 6: "5.1", 7: "8.1", 8: ""}, {0, 1, 2, 3, 4, 5, 6, 7}) == {0, 1, 2, 7}


def plain(k, body, side=""):
    return f'<html><body><div class="c1"><a href="/">home</a></div><div class="c2">{body}</div>{side}<div class="c3"><span>v{k}</span></div></body></html>'


def long(k):
    return " ".join(f"word{k}x{i}" for i in range(30))


def test_template_text_goes_and_repeated_content_stays(spark):
    """Text of a class with elements is template; a paragraph that half of the pages repeat in varied company is content."""
    rows = []
    for k in range(8):
        quote = "<p>A saying that many pages quote</p>" if k % 2 else ""
        notice = "<div><p>Please note the date</p></div>" if k < 6 else ""
        rows.append((k, f"https://p.example/{k}", plain(k, f"<p>{long(k)}</p>{quote}{notice}<p>more {k}</p><div><i>Printed on paper</i></div>")))
    got = texts(spark, rows)
    for k in range(8):
        assert got[k] == long(k) + (" A saying that many pages quote" if k % 2 else "") + f" more {k}"
    assert texts(spark, rows, sent=0) == got


def test_shared_headings_stay(spark):
    rows = [(k, f"https://h.example/{k}", plain(k, f"<h2>Introduction</h2><p>{long(k)}</p><h2>Results</h2><p>more {k}</p>")) for k in range(6)]
    assert texts(spark, rows)[4] == f"Introduction {long(4)} Results more 4"


def test_labels_of_articles_and_their_headers(spark):
    body = '<header class="site"><p>Site</p></header><article class="post category-social"><header><h1>T{0}</h1></header><p>own {0} text</p></article>'
    comment = '<article class="comment"><p>nice</p></article>'
    rows = [(k, f"https://a.example/{k}", body.format(k) + comment) for k in range(4)]
    assert texts(spark, rows) == {k: f"T{k} own {k} text" for k in range(4)}


def test_a_part_that_moves_makes_no_template_but_keeps_the_region(spark):
    rows = []
    for k in range(8):
        part = '<div class="x"><b>unmarked</b></div>'
        main = f'<div class="c2"><p>{long(k)}</p></div>'
        rows.append((k, f"https://m.example/{k}", f"<html><body>{part + main if k % 2 else main + part}</body></html>"))
    got = texts(spark, rows)
    assert all(got[k] == long(k) for k in range(8))


def test_long_pages_nulls_and_other_hosts(spark):
    rows = [(k, "https://l.example/x", plain(k, "".join(f"<p>{k} {i} text</p>" for i in range(5000)))) for k in range(3)]
    rows += [(10, None, None), (11, "https://l.example/y", ""), (12, "https://one.example", plain(12, f"<p>{long(12)}</p>")), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", __host int").withColumnRenamed("__host", "text")
    out = pages.extract_pages(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[2] == " ".join(f"2 {i} text" for i in range(5000)) and got[10] == got[11] == "" and got[12] == long(12)
