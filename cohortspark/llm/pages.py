"""HTML extraction by equivalence classes of the tokens that a host's pages share.

Every page is read as a sequence of tokens: an element's start and end (each named by the path of tags and classes from the root)
and a text (path and whole text). Three passes over the pages, each one map over partitions:

1. A token's occurrence vector holds its count on every distinct page body of the host. It is never built: a linear hash of it, the sum of
   count times a random weight of the body, is summed with map-side combine. Tokens on two and on half of the bodies with one
   vector are an equivalence class.
2. Every page tells of each class whether its tokens come in repetitions of one order, which order that is, and in which slot of
   which class (the gap after its k-th token) the repetitions lie, with a stack. A class is ordered if all pages tell the same order and
   none crosses another; it is nested if all its repetitions lie in one slot. Classes that are both make the template, a tree of
   classes in slots of classes; an unordered one falls apart into the start and end of its single elements, which nest by their paths.
3. Text outside the template's own tokens stands in slots. The template's elements that hold the slots' text are the candidates of the main region:
   the shallowest article-like one with most of that text, or the deepest one that holds nearly all; names of tags and classes tell which
   slots are menus, headers, footers, sidebars, notices, adverts, forms or comments, since classes cannot. The region's slots are
   extracted whole. Where no element is article-like, texts of valid classes that hold elements too are constant and left out, but
   headings stay; a class of texts alone is content that pages repeat.

Defined results: a null or empty page gives the empty text; a null url is a host of its own; a host with one distinct body, and a page that
lacks its host's main region, are their own template; a page left with nothing keeps the region's whole text; repeated rows are each
extracted; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import staged

#: fixed values of the markup language: elements without content, and elements whose content is no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: elements that start a block of text
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: a start tag on the left ends an open element on the right, up to the nearest of the stops
CLOSES = {
    **{t: ("p",) for t in BLOCK - {"br", "td", "th", "tr", "caption", "option", "body", "html", "head"}},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
STOPS = frozenset("article aside body div footer form header html main nav ol section table td th ul blockquote".split())
#: elements and class, id or role words that hold no main text
ASIDE_TAGS = frozenset("nav header footer aside form head script style noscript template button select iframe svg menu dialog textarea".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer sidebar aside rail widget notice notices alert cookie cookies consent gdpr popup modal overlay "
    "comment comments reply replies respond disqus form login signup search subscribe subscription newsletter share sharing social "
    "related recommended pagination pager toolbar skip hidden copyright legal disclaimer contentinfo complementary".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody post entry story main content".split())

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: text inside a heading
HEADING = re.compile(r"/h[1-6](?:[./]|$)")
#: a word of a label; a number of up to two digits names a kind, a longer one a single element
WORD = re.compile(r"(?:[a-z]+|[A-Z][a-z]*)(?:\d{1,2}(?!\d))?")


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's name in a path, long numbers left out, and whether it marks text that is not the page's own."""
    if not attributes.strip():
        return tag, tag in ASIDE_TAGS
    given = {}
    for key, *values in ATTRIBUTE.findall(attributes):
        given.setdefault(key.lower(), "".join(values))
    label = " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop"))
    words = [w.lower() for w in WORD.findall(label)]
    told = words
    if tag in MAIN_TAGS:  # only what a label begins with tells of an article: "comment", but not "category-social"
        told = [w.lower() for w in (WORD.search(name) for name in label.split()) if w for w in [w[0]]]
    aside = tag in ASIDE_TAGS or "hidden" in given or any(w.rstrip("0123456789") in ASIDE_WORDS for w in told)
    return (f"{tag}.{'-'.join(words)}" if words else tag), aside and tag not in ("html", "body")


def read(page: str) -> Iterator[tuple[str, str, bool, bool, str]]:
    """Events in page order: ("open", path, aside, block, ""), ("text", path, aside, False, decoded text), ("close", ...) when
    the element of the path ends and ("end", ...) for an end tag without an element. ``block``: a block of text ends here.
    """
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # tag, path, aside

    def closed(k: int) -> Iterator[tuple[str, str, bool, bool, str]]:
        while len(stack) > k:
            tag, path, aside = stack.pop()
            yield "close", path, aside, tag in BLOCK, ""

    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            yield "text", stack[-1][1], stack[-1][2], False, html.unescape(page[at:stop])
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            if tag[0].startswith("<![CDATA["):
                yield "text", stack[-1][1], stack[-1][2], False, tag[0][9:].removesuffix("]]>")
            continue
        name = tag[2].lower()
        if tag[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    yield from closed(k)
                    break
            else:
                yield "end", stack[-1][1], stack[-1][2], name in BLOCK, ""
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in CLOSES.get(name, ()):
                yield from closed(k)
                break
            if stack[k][0] in STOPS:
                break
        label, aside = _name(name, tag[3])
        if name == "header" and aside and any(t in MAIN_TAGS for t, _, _ in stack):  # an article's own title
            aside = False
        path, aside = f"{stack[-1][1]}/{label}", aside or stack[-1][2]
        yield "open", path, aside, name in BLOCK, ""
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = close.start() if close else end
            stack.append((name, path, True))
        elif name not in VOID and not tag[3].rstrip().endswith("/"):
            stack.append((name, path, aside))
    yield from closed(1)


#: occurrence vectors are hashed modulo this prime, twice
PRIME = (1 << 31) - 1


def token(text: str) -> int:
    """A token as a signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def text_token(path: str, text: str) -> int:
    return token(f"{path}#{text}")


def sequence(page: str) -> Iterator[tuple[int, bool, str, int]]:
    """A page's tokens in order: (token, whether it is a text, path, characters of a text outside set-aside parts)."""
    known: dict[str, int] = {}
    for kind, path, aside, _, text in read(page):
        if kind == "text":
            if text := " ".join(text.split()):
                yield text_token(path, text), True, path, 0 if aside else len(text)
        elif kind != "end":
            name = path if kind == "open" else path + ">"
            if name not in known:
                known[name] = token(name)
            yield known[name], False, path, 0


def weights(page: str) -> tuple[int, int]:
    """The two random weights of a page body."""
    digest = hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") % (PRIME - 1) + 1, int.from_bytes(digest[8:], "little") % (PRIME - 1) + 1


def classes(tokens: list[int], texts: list[bool], vectors: list[tuple]) -> dict[int, tuple[int, bool]]:
    """token -> (class, whether it is a text), classes numbered from 0 by their smallest token."""
    number: dict[tuple, int] = {}
    out = {}
    for t, text, vector in sorted(zip(tokens, texts, vectors, strict=True)):
        out[t] = number.setdefault(vector, len(number)), text
    return out


def witness(page: str, of: dict[int, int], sizes: Counter) -> tuple[dict[int, tuple[bool, int, str]], Counter]:
    """What a page tells of every class: (sound, order, slots), and the text characters by the nearest element of any class.

    ``order`` is a hash of the tokens' order in a repetition. ``slots`` names the one slot of all repetitions, or "*". A class is
    not sound if its repetitions differ or another class ends inside of one.
    """
    stack: list[list] = []  # class, tokens seen
    orders: dict[int, tuple[int, ...]] = {}
    slots: dict[int, str] = {}
    bad: set[int] = set()
    owed: Counter = Counter()  # tokens of repetitions cut off by another class
    chars: Counter = Counter()
    near: list[str] = [""]
    for t, text, path, n in sequence(page):
        while near[-1] and path != near[-1] and not path.startswith(near[-1] + "/"):
            near.pop()
        c = of.get(t)
        if c is not None and not text and near[-1] != path:
            near.append(path)
        if n:
            chars[near[-1]] += n
        if c is None:
            continue
        if any(open_[0] == c for open_ in stack):
            while stack[-1][0] != c:
                cut, seen = stack.pop()
                bad.add(cut)
                owed[cut] += sizes[cut] - len(seen)
        elif owed[c]:
            owed[c] -= 1
            continue
        else:
            slot = f"{stack[-1][0]}.{len(stack[-1][1])}" if stack else ""
            if slots.setdefault(c, slot) != slot:
                slots[c] = "*"
            stack.append([c, []])
        stack[-1][1].append(t)
        if len(stack[-1][1]) == sizes[c]:
            order = tuple(stack.pop()[1])
            if len(set(order)) < len(order) or orders.setdefault(c, order) != order:
                bad.add(c)
    bad.update(c for c, _ in stack)
    return {c: (c not in bad, token(",".join(map(str, orders.get(c, ())))), slots[c]) for c in slots}, chars


def _parents(path: str) -> list[str]:
    return [path[:k] for k in range(1, len(path)) if path[k] == "/"]


def choose(chars: dict[str, int]) -> tuple[str, bool]:
    """The main region among the template's elements by the text that stands in their slots, and whether it is article-like."""
    below: Counter = Counter()
    for path, n in chars.items():
        for p in [*_parents(path), path] if path else []:
            below[p] += n
    total = sum(chars.values())

    def tag(path: str) -> str:
        return path.rpartition("/")[2].partition(".")[0]

    def like_main(path: str) -> bool:
        words = path.rpartition("/")[2].partition(".")[2].split("-")
        return tag(path) in MAIN_TAGS or any(w in MAIN_WORDS for w in words) and tag(path) not in ("html", "body", "a")

    marked = [p for p in below if like_main(p) and 2 * below[p] >= total]
    articles = [p for p in marked if tag(p) == "article"]
    if marked:
        return min(articles or marked, key=lambda p: (p.count("/"), -below[p], p)), True
    most = [p for p in below if 10 * below[p] >= 8 * total]
    main = max(most, key=lambda p: (p.count("/"), below[p], p), default="")
    while main and tag(main) in ("p", "span", "b", "i", "em", "strong", "a"):
        main = main.rpartition("/")[0]
    return main, False


def deduce(of: dict[int, tuple[int, bool]], told: dict[int, tuple[bool, bool]], chars: dict[str, int]) -> tuple[str, list[int]]:
    """The main region and the constant texts of a host: classes, (ordered, nested) of each, text by element."""
    elements = {c for c, text in of.values() if not text}
    valid = {c for c, (ordered, nested) in told.items() if ordered and nested}
    # elements of unordered classes stand for themselves; those of classes in several slots are content, their text counts above them
    loose = {c for c, (ordered, nested) in told.items() if ordered and not nested}
    inner: Counter = Counter()
    for path, n in chars.items():
        while path and of.get(token(path), (None,))[0] in loose | {None}:
            path = path.rpartition("/")[0]
        inner[path] += n
    main, named = choose(inner)
    constant = [] if named else sorted(t for t, (c, text) in of.items() if text and c in valid and c in elements)
    return main, constant


def nest(slots: dict[int, str], ordered: set[int]) -> set[int]:
    """Ordered classes whose chain of single slots leads to the root; a class around them may be one that fell apart."""
    good: set[int] = set()
    for c in slots:
        chain, at = [], c
        while at in slots and at not in good and at not in chain and slots[at] not in ("", "*"):
            chain.append(at)
            at = int(slots[at].partition(".")[0])
        if at in good or slots.get(at) == "":
            good.update([*chain, at])
    return good & ordered


def extract(page: str, main: str, constant: set[int]) -> str | None:
    """The main region's blocks joined by one space; None if the page has no such region."""
    blocks, now, seen = [], [], False
    for kind, path, aside, block, text in read(page):
        inside = path == main or path.startswith(main + "/")
        if kind == "text":
            if inside and not aside and not (constant and not HEADING.search(path) and text_token(path, " ".join(text.split())) in constant):
                now.append(text)
        else:
            seen |= inside
            if block and now:
                blocks.append(" ".join("".join(now).split()))
                now = []
    blocks.append(" ".join("".join(now).split()))
    return " ".join(b for b in blocks if b) if seen or not main else None


def extracted(page: str, main: str | None, constant: set[int]) -> str:
    """The text of a page under its host's template, or under its own."""
    text = None
    if main is not None:
        text = extract(page, main, constant)
        if text == "" and constant:  # nothing of its own, such as many addresses of one article
            text = extract(page, main, set())
    if text is None:
        chars: Counter = Counter()
        for _, _, path, n in sequence(page):
            chars[path] += n
        text = extract(page, choose({p: n for p, n in chars.items() if n})[0], set())
    return text or ""


COUNTED = "host string, token bigint, text boolean, support double, f1 bigint, f2 bigint"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Support and hashed occurrence vector of the tokens, combined over the pages a task has read so far.

    Each of n copies of a body counts as 1 / n, so supports are those of distinct bodies; a body's weight becomes n times as large for
    all its tokens alike, so equal vectors keep equal hashes.
    """
    def rows(sums: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "token", "text", "support", "f1", "f2"])

    sums: dict[tuple[str, int, bool], list] = {}
    for pages in batches:
        for host, page, n in zip(pages["__host"], pages["__html"], pages["__n"], strict=True):
            one, two = weights(page)
            for (t, text), count in Counter((t, text) for t, text, _, _ in sequence(page)).items():
                old = sums.setdefault((host, t, text), [0.0, 0, 0])
                old[0] += 1 / n
                old[1] = (old[1] + count * one) % PRIME
                old[2] = (old[2] + count * two) % PRIME
        if len(sums) > 100_000:
            yield rows(sums)
            sums = {}
    yield rows(sums)


def _classes(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = list(zip(rows["support"], rows["f1"], rows["f2"], strict=True))
    found = classes(rows["token"].tolist(), rows["text"].tolist(), vectors)
    return pd.DataFrame(
        {
            "__host": [rows["host"].iloc[0]],
            "__tokens": [list(found)],
            "__classes": [[c for c, _ in found.values()]],
            "__texts": [[t for _, t in found.values()]],
        }
    )


TOLD = "host string, class int, path string, bad bigint, low bigint, high bigint, first string, last string, chars bigint"


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the pages a task has read tell of their hosts' classes, and the text by element."""
    def rows(heard: dict, chars: dict) -> pd.DataFrame:
        told = [(h, c, None, *v, 0) for (h, c), v in heard.items()]
        told += [(h, None, p, 0, None, None, None, None, n) for (h, p), n in chars.items()]
        return pd.DataFrame(told, columns=[part.split()[0] for part in TOLD.split(", ")]).astype({"class": "Int32", "low": "Int64", "high": "Int64"})

    heard: dict[tuple[str, int], list] = {}
    chars: Counter = Counter()
    of_host: dict[str, tuple[dict[int, int], Counter]] = {}
    for pages in batches:
        for host, page, tokens_, classes_ in zip(pages["__host"], pages["__html"], pages["__tokens"], pages["__classes"], strict=True):
            if host not in of_host:
                of_host = {} if len(of_host) > 1000 else of_host
                of_host[host] = dict(zip(map(int, tokens_), map(int, classes_), strict=True)), Counter(map(int, classes_))
            says, below = witness(page, *of_host[host])
            for c, (sound, order, slot) in says.items():
                old = heard.setdefault((host, c), [0, order, order, slot, slot])
                old[0] += not sound
                old[1], old[2] = min(old[1], order), max(old[2], order)
                old[3], old[4] = min(old[3], slot), max(old[4], slot)
            for path, n in below.items():
                chars[host, path] += n
        if len(heard) + len(chars) > 100_000:
            yield rows(heard, chars)
            heard, chars = {}, Counter()
    yield rows(heard, chars)


TEMPLATE = "__host string, __main string, __constant array<bigint>"


def _template(found: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The host's template from its classes and what its pages tell of them."""
    if not len(found):
        return pd.DataFrame({"__host": [], "__main": [], "__constant": []})
    first = found.iloc[0]
    of = {int(t): (int(c), bool(x)) for t, c, x in zip(first["__tokens"], first["__classes"], first["__texts"], strict=True)}
    seen = told[told["path"].isna()]
    ordered = {int(c) for c, bad, low, high in zip(seen["class"], seen["bad"], seen["low"], seen["high"], strict=True) if not bad and low == high}
    slots = {int(c): a if a == b else "*" for c, a, b in zip(seen["class"], seen["first"], seen["last"], strict=True)}
    nested = nest(slots, ordered)
    texts = told[told["path"].notna()]
    chars = {p: int(n) for p, n in zip(texts["path"], texts["chars"], strict=True)}
    main, constant = deduce(of, {c: (c in ordered, c in nested) for c in slots}, chars)
    return pd.DataFrame({"__host": [first["__host"]], "__main": [main], "__constant": [constant]})


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        texts = []
        for page, main, constant in zip(pages["__html"], pages["__main"], pages["__constant"], strict=True):
            texts.append(extracted(page, main, set() if constant is None else set(map(int, constant))))
        yield pages.drop(columns=["__html", "__main", "__constant"]).assign(text=texts)


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _beside(pages: DataFrame, templates: DataFrame, how: str, salts: int, sent: int) -> DataFrame:
    """Pages with the columns of their hosts' row of ``templates``.

    A written table of up to ``sent`` bytes goes to all tasks. A larger one is joined by host and a salt of the page, so that a hot host's
    pages stay spread.
    """
    arrays = [c for c, kind in templates.dtypes if kind.startswith("array")]
    width = sum((8 * F.size(c) for c in arrays), F.lit(200))
    if (templates.agg(F.sum(width)).first()[0] or 0) <= sent:
        return pages.join(F.broadcast(templates), "__host", how)
    salted = templates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("__html"), F.lit(salts)).cast("int")
    return pages.withColumn("__salt", salt).join(salted, ["__host", "__salt"], how).drop("__salt")


def extract_pages(df: DataFrame, page: str = "html", url: str = "url", salts: int = 32, sent: int = 32_000_000) -> DataFrame:
    """The rows with ``text`` in place of the page column.

    Counts of repeated bodies, classes and templates are sent to all tasks up to ``sent`` bytes, else joined.
    """
    kept = [f for f in df.schema.fields if f.name not in (page, "text")]
    body = F.coalesce(F.col(f"`{page}`"), F.lit(""))
    pages = df.select(*[F.col(f"`{f.name}`") for f in kept], body.alias("__html"), host(url).alias("__host"))
    own = F.xxhash64(host(url), body)
    bodies = df.select(host(url).alias("__host"), own.alias("__own"), body.alias("__html"))
    copies = staged(df.select(own.alias("__own")).groupBy("__own").agg(F.count("*").alias("__n")).where("__n > 1"))
    held = F.broadcast(copies) if 32 * copies.count() <= sent else copies
    counted = bodies.join(held, "__own", "left").select("__host", "__html", F.coalesce("__n", F.lit(1)).alias("__n"))
    sums = counted.mapInPandas(_counted, COUNTED).groupBy("host", "token", "text")
    sums = sums.agg(
        F.round(F.sum("support")).cast("bigint").alias("support"),
        F.pmod(F.sum("f1"), F.lit(PRIME)).alias("f1"),
        F.pmod(F.sum("f2"), F.lit(PRIME)).alias("f2"),
    )
    # a host's distinct bodies; most texts stand on one of them and leave here
    shared = staged(sums.where("support >= 2"))
    size = bodies.select("__host", "__own").distinct().groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("bodies"))
    some = shared.join(size, "host").where(2 * F.col("support") >= F.col("bodies"))
    found = staged(some.groupBy("host").applyInPandas(_classes, "__host string, __tokens array<bigint>, __classes array<int>, __texts array<boolean>"))
    heard = _beside(bodies.drop("__own"), found.drop("__texts"), "inner", salts, sent).mapInPandas(_told, TOLD)
    heard = heard.groupBy("host", "class", "path").agg(
        F.sum("bad").alias("bad"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("chars").alias("chars"),
    )
    templates = staged(found.groupBy("__host").cogroup(heard.withColumnRenamed("host", "__host").groupBy("__host")).applyInPandas(_template, TEMPLATE))
    joined = _beside(pages, templates, "left", salts, sent).drop("__host")
    return joined.mapInPandas(_extracted, T.StructType([*kept, T.StructField("text", T.StringType())]))
