"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of one host.

A page's token stream (its tree of block elements and text) is aligned with the host's wrapper so far. Streams of equal keys match item
by item and their contents are aligned in turn; a text that differs becomes a slot. Where keys differ, items that hold one text on both
sides are matched first. Between those, neighbours of one key, and repeats of a few, fold into repeated groups, and what only one side
has becomes optional; a stretch whose keys recur out of order becomes one repeated group of optional elements.

A page is then aligned with its host's finished wrapper, which tells of every text block whether it is a slot, or the template's own
text, or nothing that it knows. The main text is what stands inside the article (or main) element, or, if the page has none, all over the
page; not inside menus, headers, footers, sidebars, notices, adverts, forms or comments (by names that inside an article
mostly need the wrapper's evidence: constant over the pages, or mostly links); and outside article and main not the template's
text, unless a page has nothing else.

Every different page of the host takes part, in an order that its pages alone decide: by the hash of the html. A host's hashes are cut into
ranges of some LEAF pages by their leading bits; a range is folded in rising order as its pages pass, then 64 neighbouring ranges are merged
at a time, in order. So a host of any size is inferred in parallel, and neither partitions nor copies change its wrapper.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.llm.html_blocks import Block, Element, parse_page
from evenground.runtime import materialize

#: Different pages of a host beyond which their hashes are cut into ranges; bits that a round of merging takes off (64 ranges become one);
#: hashes that a task remembers to pass copies on once.
LEAF, ROUND_BITS, REMEMBERED = 64, 6, 1_000_000
#: Different pages (by their texts) that must agree on a text before it counts as the template's.
CONSTANT_PAGES = 3
#: In place of the region 0: text of the template outside article and main.
TEMPLATE = -0.5
#: Bytes of wrappers up to which they are broadcast; beyond, pages and wrappers meet in a shuffle join.
BROADCAST_BYTES = 16 << 20

# Elements and words of class, id and role names that stand for what is not main text.
DROPPED_NAMES = frozenset("nav footer aside form script style noscript template iframe svg button select option textarea head title object canvas audio video dialog menu".split())
_DROPPED_WORDS = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banners?|sidebars?|side|rail|nav|navbar|navigation|menus?|breadcrumbs?|masthead|footer|foot|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|shar(?:e|es|ing)|social|related|recommend\w*|comments?|commentlist|"
    r"comment\w*|disqus|respond|repl(?:y|ies)|discussion|widgets?|toolbar|pager|pagination|skip|copyright|legal|outbrain|taboola|hidden|contentinfo|complementary|warning|disclaimer|forms?)(?:$|[-_])"
)
# Whole class and role words that need no more evidence inside an article; other names above are asked for some there.
_SURE_WORDS = re.compile(
    r"^(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|(?:ad|advert|sponsor|promo|cookie|consent|gdpr|newsletter|share|sharing|comment|comments|social-share|visually)[-_]"
    r"(?:slot|box|unit|banner|container|wrapper|block|notice|bar|signup|form|buttons?|links?|icons?|list|section|area|thread|body|hidden)|sponsored|sidebar|navbar|breadcrumbs?|cookies?|gdpr|newsletter|"
    r"share|sharing|commentlist|comments|disqus|respond|pagination|outbrain|taboola|hidden|visuallyhidden|is[-_]hidden|navigation|contentinfo|complementary)$"
)
# Name words that inside an article count against what the wrapper finds constant or mostly links.
_DOUBTED_WORDS = re.compile(
    r"(?:^|[-_])(?:advert\w*|adbox|sponsor\w*|promo\w*|banners?|sidebars?|nav|menus?|masthead|footer|cookies?|consent|notices?|alerts?|popups?|newsletter|subscri\w*|signup|login|"
    r"shar(?:e|es|ing)|social|related|recommend\w*|comments?|comment\w*|widgets?|toolbar|pager|outbrain|taboola)(?:$|[-_])"
)
_HEADING_OR_SECTION = frozenset("h1 h2 h3 h4 h5 h6 section article main".split())
_HEADER_WORDS = re.compile(r"(?:^|[-_])(?:header|head|topbar|top)(?:$|[-_])")
_ARTICLE_WORDS = re.compile(r"^(?:articlebody|article-body|post-body|post-content|entry-content|article-content|articlecontent|postcontent|main-content|story-body|article)$")

# trees of MAX_DEPTH elements are walked by functions that call themselves, a few calls an element
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

# A wrapper is JSON: a list of items. Element: ["e", key, repeated, optional, items]; group: ["g", "", repeated, optional, items]; text:
# ["t", crc of the constant text or None, 0, optional, [crcs of up to CONSTANT_PAGES different pages' texts, code points, code points in
# links, crc of the constant texts of a run or None]].


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _stream(element: Element, page: int) -> list:
    items = []
    for child in element.children:
        if isinstance(child, Block):
            items.append(["t", _crc(child.text), 0, 0, [[page], len(child.text), child.linked, _crc(child.text)]])
        else:
            items.append(["e", child.key, 0, 0, _stream(child, page)])
    return items


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] == "t" or a[1] == b[1])


#: How items meet: the same item of two pages, neighbours in a run of one page, or neighbours of whichever pages.
ACROSS, INSIDE, MIXED = 0, 1, 2


def _join_item(a: list, b: list, inside: int = ACROSS) -> list:
    """Two matching items as one; in a run, each text is a slot."""
    if a[0] == "t":
        run = a[4][3] if a[4][3] == b[4][3] and not inside else None
        if inside == INSIDE and a[4][3] is not None and b[4][3] is not None:
            run = _crc(f"{a[4][3]} {b[4][3]}")
        counts = [sorted({*a[4][0], *b[4][0]})[:CONSTANT_PAGES], a[4][1] + b[4][1], a[4][2] + b[4][2], run]
        return ["t", a[1] if a[1] == b[1] and not inside else None, a[2] | b[2], a[3] | b[3], counts]
    return [a[0], a[1], a[2] | b[2], a[3] | b[3], align(a[4], b[4], inside)]


def _fold(items: list) -> list:
    """Neighbours of one key, then repeats of two to four different items, become repeated groups."""
    folded: list = []
    for item in items:
        if folded and item[0] != "t" and _same(folded[-1], item):
            folded[-1] = _join_item(folded[-1], item, INSIDE)
            folded[-1][2] = 1
        else:
            folded.append(item)
    for width in (2, 3, 4):
        at, out = 0, []
        while at < len(folded):
            unit, end = folded[at : at + width], at + width
            while len(unit) == width and len(folded) >= end + width and all(map(_same, unit, folded[end : end + width])):
                unit = [_join_item(a, b, INSIDE) for a, b in zip(unit, folded[end : end + width], strict=True)]
                end += width
            if end > at + width:
                out.append(["g", "|".join(x[1] if x[0] != "t" else "#" for x in unit), 1, 0, unit])
                at = end
            else:
                out.append(folded[at])
                at += 1
        folded = out
    return folded


def _members(items: list) -> Iterator[list]:
    """The items, groups opened."""
    for item in items:
        if item[0] == "g":
            yield from _members(item[4])
        else:
            yield item


def _kind(item: list) -> tuple[str, str]:
    return (item[0], "" if item[0] == "t" else item[1])


def _generalized(items: list) -> list:
    """One repeated group of the different items, each optional."""
    seen: dict = {}
    for part in _members(items):
        key = _kind(part)
        seen[key] = _join_item(seen[key], part, MIXED) if key in seen else part
    return ["g", "*", 1, 0, [[*x[:3], 1, x[4]] for x in seen.values()]]


def _constants(item: list) -> Iterator[int]:
    """The texts (crcs) inside an item that are the same on all of its pages."""
    if item[0] == "t":
        if item[1] is not None:
            yield item[1]
    else:
        for x in item[4]:
            yield from _constants(x)


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of items of one key that hold a text which no other item of either side holds; rising in both."""
    places: list[dict] = []
    for items in (a, b):
        at: dict = {}
        for i, item in enumerate(items):
            for crc in set(_constants(item)):
                at[_kind(item), crc] = -1 if (_kind(item), crc) in at else i
        places.append(at)
    pairs = sorted({(i, places[1][k]) for k, i in places[0].items() if i >= 0 and places[1].get(k, -1) >= 0})
    # the longest rising chain
    ends: list[int] = []
    chain: list[tuple[int, int, int]] = []
    last: list[int] = []
    for i, j in pairs:
        at = bisect_left(ends, j)
        before = last[at - 1] if at else -1
        if before >= 0 and chain[before][0] == i:
            continue
        chain.append((i, j, before))
        ends[at : at + 1], last[at : at + 1] = [j], [len(chain) - 1]
    found, at = [], last[-1] if last else -1
    while at >= 0:
        found.append(chain[at][:2])
        at = chain[at][2]
    return found[::-1]


def _stretches(a: list, b: list) -> Iterator[tuple[list, list, tuple[int, int] | None]]:
    """The stretches of both sides up to each anchor, with the anchor; the last without."""
    at, to = 0, 0
    for i, j in _anchors(a, b):
        yield a[at:i], b[to:j], (i, j)
        at, to = i + 1, j + 1
    yield a[at:], b[to:], None


def align(a: list, b: list, inside: int = ACROSS) -> list:
    """The wrapper of everything that ``a`` or ``b`` matches."""
    if list(map(_kind, a)) == list(map(_kind, b)):
        return [_join_item(x, y, inside) for x, y in zip(a, b, strict=True)]
    out: list = []
    for left, right, anchor in _stretches(a, b):
        out += _merged(left, right, inside)
        if anchor:
            out.append(_join_item(a[anchor[0]], b[anchor[1]], inside))
    return out


def _merged(a: list, b: list, inside: int) -> list:
    """align for stretches without anchors."""
    if list(map(_kind, a)) == list(map(_kind, b)):
        return [_join_item(x, y, inside) for x, y in zip(a, b, strict=True)]
    a, b = _fold(a), _fold(b)
    if list(map(_kind, a)) == list(map(_kind, b)):
        return [_join_item(x, y, inside) for x, y in zip(a, b, strict=True)]
    for side in (a, b):
        kinds = list(map(_kind, _members(side)))
        if len(set(kinds)) < len(kinds):
            return [_generalized([*a, *b])]
    # keys are unique on either side: those of both, in a rising order, are matched
    where = {_kind(y): j for j, y in enumerate(b)}
    ahead, to, out = -1, 0, []
    for x in a:
        j = where.get(_kind(x), -1)
        if j > ahead:
            out += [[*y[:3], 1, y[4]] for y in b[to:j]]
            out.append(_join_item(x, b[j], inside))
            ahead, to = j, j + 1
        else:
            out.append([*x[:3], 1, x[4]])
    out += [[*y[:3], 1, y[4]] for y in b[to:]]
    kinds = list(map(_kind, _members(out)))
    return out if len(set(kinds)) == len(kinds) else [_generalized(out)]


def matched(wrapper: list, items: list) -> list[list | None]:
    """For each item of a page's stream the wrapper's item that it is an instance of, or None."""
    if list(map(_kind, wrapper)) == list(map(_kind, items)):
        return list(wrapper)
    out: list = []
    for left, right, anchor in _stretches(wrapper, items):
        if list(map(_kind, left)) == list(map(_kind, right)):
            out += left
        else:
            known: dict = {}
            for x in _members(left):
                known.setdefault(_kind(x), x)
            out += [known.get(_kind(x)) for x in right]
        if anchor:
            out.append(wrapper[anchor[0]])
    return out


def _texts(element: Element) -> Iterator[str]:
    for child in element.children:
        if isinstance(child, Block):
            yield child.text
        else:
            yield from _texts(child)


def page_wrapper(page: str) -> list:
    root = parse_page(page)
    return _stream(root, _crc("\n".join(_texts(root))))


def as_regex(items: list) -> str:
    """The wrapper as a union-free expression: # a text slot, ' a constant text, + repeated, ? optional."""
    out = []
    for kind, key, repeated, optional, inner in items:
        if kind == "t":
            text = "#" if key is None else "'"
        elif kind == "g":
            text = f"({as_regex(inner)})"
        else:
            text = f"<{key}>{as_regex(inner)}</{key.split('.')[0]}>"
            text = f"({text})" if repeated or optional else text
        out.append(text + "+" * repeated + "?" * optional)
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def _dropped(key: str, in_article: bool) -> int:
    """0: kept; 2: dropped; 1: dropped if the wrapper has evidence (constant text or mostly links), as for most names inside an article."""
    name, *words = re.sub("[0-9]", "", key).split(".")
    if name in ("h", ""):
        name = key.split(".")[0]
    words = [w for w in words if w.strip("@-_")]
    if name in DROPPED_NAMES:
        return 2
    if in_article:
        if name in _HEADING_OR_SECTION:
            words = [w for w in words if w[0] != "@"]
        if any(map(_SURE_WORDS.search, words)):
            return 2
        return int(any(_DOUBTED_WORDS.search(w.removeprefix("@")) for w in words))
    words = [w.removeprefix("@") for w in words]
    return 2 * (name == "header" or any(_DROPPED_WORDS.search(w) or _HEADER_WORDS.search(w) for w in words))


def _is_article(key: str) -> bool:
    name, *words = key.split(".")
    return name == "article" or any(_ARTICLE_WORDS.match(w.removeprefix("@")) for w in words)


def _is_main(key: str) -> bool:
    return key.split(".")[0] == "main" or "main" in key.replace("@", "").split(".")[1:]


def _sound(path: tuple[str, ...], holders: set[str]) -> tuple[int, int]:
    """What is to be done with texts down the path (as in _dropped), and in which sort of region they are: 2 article, 1 main, 0 neither.

    An element that holds an article isn't dropped for its class words (with-sidebar) or for being a form around all of the page. The
    article's own names say nothing against it.
    """
    region = worst = 0
    for key in path:
        inside = region == 2
        if _is_article(key):
            region = 2
        elif _is_main(key):
            region = max(region, 1)
        if not (key in holders and key.split(".")[0] not in DROPPED_NAMES - {"form"}):
            worst = max(worst, _dropped(key, inside or region == 2))
    return worst, region


def _template(item: list) -> bool:
    """Whether a text is the same on enough different pages, or a menu: a run of mostly links that is."""
    pages, chars, linked, run = item[4]
    return len(pages) >= CONSTANT_PAGES and (item[1] is not None or run is not None and 2 * linked > chars)


def _named_template(item: list) -> bool:
    """Of a text in a region whose name says it isn't main text: whether it is the template's or mostly links."""
    pages, chars, linked, run = item[4]
    return len(pages) >= CONSTANT_PAGES and (item[1] is not None or run is not None) or 2 * linked > chars


def _holders(paths: Iterable[tuple[str, ...]]) -> set[str]:
    """Keys of elements that hold an article."""
    return {k for path in paths for i, k in enumerate(path) if any(_is_article(x) for x in path[i + 1 :])}


def _placed(wrapper: list, items: list, element: Element, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Block, list | None]]:
    """(keys down to it, block, the wrapper's text item or None) for every text block of a page, aligned with the wrapper."""
    for told, item, child in zip(matched(wrapper, items), items, element.children, strict=True):
        if isinstance(child, Block):
            yield path, child, told
        else:
            yield from _placed(told[4] if told else [], item[4], child, (*path, child.key))


def extract(page: str, wrapper: list) -> str:
    """The main text of one page: its blocks in the highest region that it has itself, one per line.

    Regions: 2 article, 1 main, 0 neither, -0.5 the template's text outside both, -1 dropped. What the wrapper doesn't know is judged by names
    and links alone.
    """
    root = parse_page(page)
    blocks = list(_placed(wrapper, _stream(root, 0), root))
    holders = _holders({path for path, *_ in blocks})
    found: list[float] = []
    for path, block, told in blocks:
        worst, value = _sound(path, holders)
        doubtful = 2 * block.linked > len(block.text) if told is None else _named_template(told)
        if worst == 2 or worst == 1 and doubtful:
            value = -1
        elif value == 0 and told is not None and _template(told):
            value = TEMPLATE
        found.append(value)
    level = max(found, default=-1)
    return "\n".join(block.text for (_, block, _), value in zip(blocks, found, strict=True) if value == level > -1)


@lru_cache(maxsize=512)
def _read(text: str) -> list:
    return json.loads(text)


def _ranged(pages: DataFrame) -> DataFrame:
    """``host``, ``h`` (hash of the html), ``html``, ``leaf`` (leading bits of the hash) and ``depth`` (how many rounds of bits these are)."""
    keyed = pages.select("host", F.xxhash64("html").alias("h"), "html")
    # the fewest rounds that leave ranges of LEAF pages or fewer, on average; hosts without ranges aren't told
    rounds = F.ceil(F.log2(F.col("count") / LEAF) / ROUND_BITS).cast("int")
    large = materialize(keyed.select("host", "h").distinct().groupBy("host").count().where(F.col("count") > LEAF).select("host", rounds.alias("depth")))
    told = keyed.join(large, "host", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    leaf = F.when(F.col("depth") > 0, F.expr(f"shiftrightunsigned(h, 64 - {ROUND_BITS} * depth)")).otherwise(F.lit(0).cast("long"))
    return told.withColumn("leaf", leaf)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``wrapper`` (JSON), ``expression`` for every host of ``pages`` (host, html), stored."""
    whole_texts(pages.sparkSession)
    schema = "host string, leaf long, depth int, wrapper string"

    def once(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for part in parts:
            if len(seen) > REMEMBERED:
                seen.clear()
            keys = list(zip(part["host"], part["h"], strict=True))
            fresh = [k not in seen and not seen.add(k) for k in keys]
            yield part[fresh]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, held = None, None, None
        row = lambda: pd.DataFrame([(*at, json.dumps(held))], columns=["host", "leaf", "depth", "wrapper"])
        for part in parts:
            for *key, h, page in zip(*(part[c] for c in ("host", "leaf", "depth", "h", "html")), strict=True):
                if key == at and h == last:
                    continue
                if key != at and at is not None:
                    yield row()
                held = align(held, page_wrapper(page)) if key == at else page_wrapper(page)
                at, last = key, h
        if at is not None:
            yield row()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        host, depth, above = key
        merged = reduce(align, map(json.loads, group.sort_values("leaf")["wrapper"]))
        return pd.DataFrame([(host, above, depth - 1, json.dumps(merged))], columns=["host", "leaf", "depth", "wrapper"])

    def shown(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([as_regex(json.loads(x)) for x in part], dtype=object)

    shown.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = _ranged(pages).select("host", "h", "leaf", "depth", "html")
    dealt = rows.mapInPandas(once, "host string, h long, leaf long, depth int, html string").repartition("host", "leaf").sortWithinPartitions("host", "leaf", "h")
    found = materialize(dealt.mapInPandas(fold, schema))
    while not (ranges := found.where("depth > 0")).isEmpty():
        merged = ranges.groupBy("host", "depth", F.expr(f"leaf >> {ROUND_BITS}").alias("_above")).applyInPandas(merge, schema)
        found = materialize(found.where("depth = 0").union(merged))
    return materialize(found.select("host", "wrapper", F.pandas_udf(shown, "string")("wrapper").alias("expression")))


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages`` (page_id, url, html).

    Pages whose url has no host share one wrapper; NULL html counts as empty and gives empty text; NULL ids and repeated rows stay; an
    empty table gives an empty table; other columns are not read.
    """
    whole_texts(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known = infer_wrappers(rows).select("host", "wrapper")
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")

    def texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, wrapper in parts:
            yield pd.Series([extract(p, _read(w)) for p, w in zip(page, wrapper, strict=True)], dtype=object)

    texts.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    found = joined.select("page_id", "url", F.pandas_udf(texts, "string")("html", "wrapper").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
