"""Main text of web pages: flat blocks, shallow features, and a decision tree.

A page is cut into flat text blocks where block-level tags begin or end. Tags and names of parts only cut blocks and drop
what can't be text: navigation, footers, asides, forms, parts named as adverts or comments and the like; where a page marks
its article, what stands outside it. Of the blocks that are left, each has its words and its link density (the share of its
words in links), and so have its two neighbours. A decision tree on these six numbers, grown on the small labelled table
below, says which blocks are text; it is applied as one column expression (nested CASE) over each page's array of blocks.
Pages never move: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: HTML element names by what they do to the text.
RAW = set("script style textarea title".split())
SKIPPED = set("script style template noscript head title iframe object svg math canvas select textarea button datalist audio video label legend output progress meter".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav footer aside form menu dialog header".split())
REPEATED = set("p li dt dd tr td th option".split())
INSIDE = set("article main".split())
#: Words in class, id and role that name a part of a page that is not its article.
NAMED = set(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr
    nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar side aside widget related recommended share sharing social toolbar
    comment comments disqus respond reply replies discussion feedback notice notices alert alerts warning newsletter subscribe subscription signup login search
    pagination pager copyright legal contentinfo complementary dialog form""".split()
)
#: Words that may stand beside those in a name and leave its meaning (`site-footer`, `ad-slot-2`, `comment-list`).
BESIDE = set(
    """area bar block box body bottom col column container content global holder inner item items left list links middle outer page
    panel primary reader readers right row secondary section site slot small sticky text thread top unit user users widgets wrap wrapper zone""".split()
)
#: Elements whose class says something about the page, not about a part of it.
WHOLE = INSIDE | {"html", "body"}
#: Attribute values of a part that holds the article.
ARTICLE = set("article content main post entry story article-body post-content entry-content post-body story-body".split())

#: Comments, declarations and tags. Quotes in a tag count where they are closed before a space or the tag's end; else the tag ends at the next mark.
_QUOTED = r"\"[^\"<>]*+(?:\"|[<>][^\"]*+\"(?=[\s/>]))|'[^'<>]*+(?:'|[<>][^']*+'(?=[\s/>]))"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|{_QUOTED})*+(?=>)|[^<>]*)(?:>|\Z|(?=<))", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
#: Words have a letter or a digit; marks between links are none.
_WORD = re.compile(r"\w\S*")

UNNAMED, IN_ARTICLE, ELSEWHERE = 0, 1, 2


def _elsewhere(name: str) -> bool:
    """Whether a class, id or role names a part that isn't the article: all its words do, or go beside those that do."""
    tokens = [t for t in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])|[0-9]+", name) if t]
    tokens = [t.lower() for t in tokens]
    return any(t in NAMED for t in tokens) and all(t in NAMED or t in BESIDE for t in tokens)


def _part(name: str, attributes: str) -> int:
    """What kind of part an element opens."""
    if name in OUTSIDE:
        return ELSEWHERE
    if attributes and name not in WHOLE:
        names = [x for m in _NAMES.findall(attributes) for x in "".join(m).split()]
        if any(_elsewhere(x) for x in names) or _HIDDEN.search(attributes):
            return ELSEWHERE
        if name in ("div", "section") and any(x.lower() in ARTICLE for x in names):
            return IN_ARTICLE
    return IN_ARTICLE if name in INSIDE else UNNAMED


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, part) of a page's blocks in order. A header inside an article belongs to the article."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter and the part outside them
    text: list[tuple[str, bool]] = []
    part, links, at, n = UNNAMED, 0, 0, len(page)

    def flush() -> None:
        if text:
            whole = _SPACE.sub(" ", "".join(t for t, _ in text)).strip()
            if whole:
                linked = sum(len(_WORD.findall(t)) for t, link in text if link)
                out.append((whole, len(_WORD.findall(whole)), linked, part))
            text.clear()

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append((html.unescape(page[at:]), links > 0))
            break
        if m.start() > at:
            text.append((html.unescape(page[at : m.start()]), links > 0))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in SKIPPED and not m[1]:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name not in INLINE:
                flush()
            at = end.end() if end else n if name in RAW else at
            continue
        if name == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if name in INLINE and name != "a":
            if not m[1] and name not in VOID and m[3] and _part(name, m[3]) == ELSEWHERE:
                flush()
                stack.append((name, part))
                part = ELSEWHERE
            elif m[1] and stack and stack[-1][0] == name:
                flush()
                part = stack.pop()[1]
            continue
        if name == "a":
            continue
        flush()
        links = 0 if not m[1] and name in ("p", "div", "article", "section", "li") else links
        if name in VOID:
            continue
        if not m[1] and stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in REPEATED):
            part = stack.pop()[1]  # an end tag that may be left out
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    part = stack[k][1]
                    del stack[k:]
                    break
        elif name not in REPEATED or m[3]:
            own = IN_ARTICLE if name == "header" and part == IN_ARTICLE else _part(name, m[3])
            stack.append((name, part))
            part = part if part == ELSEWHERE or own == UNNAMED else own
    flush()
    return out


#: The labelled table: a line is a page without tags that name its parts, a word one of its blocks in order: `t` text or
#: `n` not, its words, and behind a stroke those of them that are in links.
LABELLED = """
n3/3 n1 t6 t34 t41/2 t3 t52 n5/5
n2/2 n4/4 t9 t1 t28/1 t33 t2 n3/3 n2
n1/1 n1/1 n1/1 t5 t60 t22 t47/3 n1/1 n1/1
n6/5 n2 t8 t26 t9 t31 t5 t44 n4/3 n3
n1 n3/3 t32 t27 t40 n3/3 n3
n5/5 t7 t18 t24/2 t4 t19 n6/6 n5/5
n2/2 n2/2 n3 t11 t45 t3 t7 t38 n2/2 n2/2
t6 t40 t1 t33 t28
t12
t3
t1
t21
t70
t5 t4
t4 t60
t60 t4
t2 t1 t2
t3 t3 t3 t3
t1 t9 t1 t8 t12 t1
t14 t13 t2 t80 t1 t1 t30
t9 t10 t11 t12
t5 t25/3 t6 t31/1 t7
t8 t50/4 t20 t2
t3 t90 t2/2 t70
t6 t35 t4/4 t42 t30
t7 t28 t3/2 t33
t2 t18 t1/1 t26 t4
t5 t3/2 t4
t6 t10/4 t12
t40/12 t35/9 t30
t20/8 t28 t31/10
t3 t44 t5/2 t36 n2/2
t8 t61 n3/3 n4/4
t9 t37 n5/5
n4/4 t7 t3 t22
n3/3 t5 t2 t2
n7/7 t4 t48 t3
n8/8 t10 t29 t36/2 n9/9
n2/2 n2/2 n2/2 n2/2 t9 t52 t1 t37
n1/1 n1/1 n1/1 n1/1 n1/1
n4/4 n6/6 n3/3
n12/12
n3/3
n1/1 n2 n1/1
n5/5 n1 n6/6 t7 t55 t21
n10/10 n2 n3/3 t6 t31 t42
t8 t33 t25 n4/4 n3 n5/5
t5 t47 t20 n6/6 n2 n3/3 n1/1
n9/8 t6 t24 t30 n8/7
n11/9 t4 t36 t2 t27 n12/10
n6/5 t7 t29 t18
t9 t34 n7/6
n2 n4/4 t11 t41 t38
n1 n5/5 n6/6 t8 t23 t2 t57
n3 n2/2 t9 t64
t7 t32 n2/2 n4
t10 t20 t35 n3/3 n2
t4 t55/6 n3/3 n3
t6 t19 t27 n8/8 n5
t16/2 t14 t3
t120/20 t90/15
t2/1 t30 t28
t15/6 t40
t5 t30 t1 t25 n4/4
t1 t40 n3/3
t2 t9 t1 t60 n2/2
t1 t17 n6/6
n3/3 t1 t21 n5/5 n2
n1 n7/7 t3 t1 t33 n2/2
t24 n2/2
"""

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after")


def features(found: list[tuple[int, int]]) -> np.ndarray:
    """One row a block of (words, words in links), as FEATURES; blocks beyond the ends have no words and no links."""
    words = np.array([0, *(b[0] for b in found), 0], float)
    density = np.array([0, *(b[1] for b in found), 0]) / np.maximum(words, 1)
    return np.stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]], axis=1)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in LABELLED.split("\n"):
        found = [(*map(int, (block[1:] + "/0").split("/")[:2]), block[0] == "t") for block in page.split()]
        if found:
            x.append(features([b[:2] for b in found]))
            y += [b[2] for b in found]
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple | bool:
    """A decision tree by Gini impurity: (feature, limit, tree where feature <= limit, tree elsewhere), or the label; a tie is text."""
    label = bool(y.mean() >= 0.5)
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return label
    gini = lambda z: 2 * z.mean() * (1 - z.mean()) * len(z)
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= limit
            if least <= left.sum() <= len(y) - least and (best is None or gini(y[left]) + gini(y[~left]) < best[0] - 1e-9):
                best = gini(y[left]) + gini(y[~left]), k, float(limit), left
    if best is None or best[0] >= gini(y) - 1e-9:
        return label
    _, k, limit, left = best
    return k, limit, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def decided(tree: tuple | bool, values: dict[str, Column]) -> Column:
    """The tree as a column."""
    if isinstance(tree, bool):
        return F.lit(tree)
    k, limit, low, high = tree
    return F.when(values[FEATURES[k]] <= limit, decided(low, values)).otherwise(decided(high, values))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null, empty and textless pages have the empty text; broken markup is read as far as it goes, pages of any length whole.
    Rows that repeat a page each get a row; an empty table gives none; other columns are ignored.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("words", pa.int32()), ("links", pa.int32()), ("part", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "html"):
                found = [[dict(zip(("text", "words", "links", "part"), b)) for b in blocks(x or "")] for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, kind)], names=["page_id", "url", "blocks"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    ids = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    cut_pages = rows.mapInArrow(cut, f"page_id {ids[0]}, url {ids[1]}, blocks array<struct<text: string, words: int, links: int, part: int>>")
    tree = grow(*labelled())

    left = F.filter("blocks", lambda b: b["part"] != ELSEWHERE)
    marked = F.filter("blocks", lambda b: b["part"] == IN_ARTICLE)
    cut_pages = cut_pages.withColumn("blocks", F.when(F.size(marked) > 0, marked).otherwise(left))

    def is_text(block: Column, i: Column) -> Column:
        near = lambda k: F.get("blocks", i + k)  # noqa: E731  null beyond the ends
        words = lambda b: F.coalesce(b["words"], F.lit(0)).cast("double")
        density = lambda b: F.coalesce(b["links"] / F.greatest(b["words"], F.lit(1)), F.lit(0.0))
        return decided(tree, dict(zip(FEATURES, [f(b) for b in (block, near(-1), near(1)) for f in (words, density)])))

    text = F.array_join(F.transform(F.filter("blocks", is_text), lambda b: b["text"]), " ")
    return cut_pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
