"""Divergence audit of the sources of each language: the terms that set a source apart, and how far its sources differ.

Every group (lang, source) and every language gives each kept term an integer probability p = 1 + floor(10^9 (count + 2) / (N + 2 V));
two probabilities differ by f = floor((p - q)^2 / (p + q)), which grows with p above q and falls with q below p. All numbers are integers.

Terms of a group are searched by upper bounds: its terms lie in buckets by their count (eight to a doubling, so some hundreds at most), and
a bucket's bound is f of its largest p and of the smallest probability that the language gives a term of it. Buckets are evaluated
best bound first, in rounds of twice as many; a group is done when the best bound not yet seen is strictly below its tenth value.

Pairs of sources start from what they would differ by if neither had any term. A term of one side alone adds a difference that depends
on its count there, so these are summed by the counts' histogram; terms of both sides are met in the terms' postings. Numbers of sources
are cut into blocks: a posting is met block by block, and a task holds the sums of one pair of blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.runtime import materialize, release

#: Documents of its language that a term must stand in, terms told of a group, and the scale of probabilities.
KEPT_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Sources in a block of postings, salts of a language's histogram, buckets of the first round.
BLOCK, SALTS, FIRST = 256, 16, 8
#: Terms that a task counts before it passes them on, bytes of a text that are split at once, rows that go on together.
HELD, SLICE, ROWS = 400_000, 1 << 22, 1 << 16
#: Bytes of a UTF-8 text: letters as lower-case ones, bytes of other characters as they are, all else a blank.
_FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, slice by slice."""
    low = 0
    while low < len(text):
        high = low + SLICE
        while high < len(text) and _FOLDED[text[high]] != 32:
            high += 1
        yield text[low:high].translate(_FOLDED).split()
        low = high


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` of every term in a group, in partial rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                words = list(n)
                for low in range(0, len(words), ROWS):
                    part = words[low : low + ROWS]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[w] for w in part], pa.int64()) for c in (n, docs))], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for words in terms(text):
                    n.update(words)
                    own.update(words)
                in_docs.update(own)
                size += len(n)
                if size > HELD:
                    yield from told()
                    size = 0
        yield from told()

    return _named(docs).select("lang", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t")).mapInArrow(scan, "lang string, source string, term string, n long, docs long")


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")})


def _probability(n: str, total: str) -> Column:
    return F.expr(f"1 + (cast({n} + 2 as decimal(19, 0)) * {SCALE}) div cast({total} + 2 * v as decimal(19, 0))")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _kept(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``lang_n``, ``first`` (one row of each term of a language) of the kept terms, stored."""
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    all_ = Window.partitionBy("lang", "term")
    known = counted.withColumns({"lang_n": F.sum("n").over(all_), "lang_docs": F.sum("docs").over(all_), "first": F.row_number().over(all_.orderBy("source")) == 1})
    return materialize(known.where(F.col("lang_docs") >= KEPT_DOCS).select("lang", "source", "term", "n", "lang_n", "first"))


def _groups(docs: DataFrame, kept: DataFrame, block: int) -> DataFrame:
    """Of every group its ``total``, number ``g`` in its language and block ``b``; the language's ``v``, ``lang_total``, ``blocks``; ``p0`` of a term it lacks; stored."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    rows = _named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    numbered = rows.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    last = numbered.groupBy("lang").agg(F.expr(f"max(g) div {block} + 1").alias("blocks"))
    p0 = F.when(F.col("v") > 0, _probability("0L", "total")).otherwise(F.lit(1).cast("long"))
    return materialize(numbered.join(last, "lang").select("lang", "source", "g", F.expr(f"g div {block}").alias("b"), "blocks", "total", "v", "lang_total", p0.alias("p0")))


def _top(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "term"))
    return rows.withColumn("rank", place).where(F.col("rank") <= TOP)


def search_terms(scored: DataFrame, first: int = FIRST) -> DataFrame:
    """``lang``, ``g``, ``term``, ``value``, ``rank``: the best terms of every group of ``scored`` (lang, g, term, n, p, q)."""
    higher = materialize(scored.where("p > q").select("lang", "g", "term", F.floor(8 * F.log2("n")).cast("int").alias("bucket"), "p", "q"))
    bound = F.expr(_f("max(p)", "min(q)")).alias("bound")
    place = F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("bound"), "bucket"))
    buckets = materialize(higher.groupBy("lang", "g", "bucket").agg(bound).withColumn("place", place))
    best, still, seen, till = None, None, 0, first
    while True:
        now = buckets.where((F.col("place") > seen) & (F.col("place") <= till))
        if still is not None:
            now = now.join(still, ["lang", "g"], "left_semi")
        new = higher.join(now.select("lang", "g", "bucket"), ["lang", "g", "bucket"]).select("lang", "g", "term", F.expr(_f("p", "q")).alias("value"))
        old, left = best, still
        best = materialize(_top(new if old is None else new.unionByName(old.drop("rank"))))
        least = best.groupBy("lang", "g").agg(F.count("*").alias("told"), F.min("value").alias("least"))
        ahead = buckets.where(F.col("place") == till + 1).join(least, ["lang", "g"]).where((F.col("told") < TOP) | (F.col("bound") >= F.col("least")))
        still = materialize(ahead.select("lang", "g"))
        release(*[x for x in (old, left) if x is not None])
        if still.isEmpty():
            release(higher, buckets, still)
            return best
        seen, till = till, 2 * till


def _meetings(block: int):
    """Over rows sorted by language, pair of blocks and term: per pair of sources what the terms of both add to the terms of either."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at = np.zeros((2 * block, 2 * block), np.int64), ("", 0, 0)

        def told() -> Iterator[pa.RecordBatch]:
            lang, i, j = at
            x, y = np.nonzero(sums)
            number = lambda k: pa.array(np.where(k < block, i * block + k, j * block + k - block), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), number(x), number(y), pa.array(sums[x, y])], ["lang", "g", "h", "value"])
            sums[:] = 0

        for part in _parts(batches):
            key = tuple(part[c][0].as_py() for c in ("lang", "i", "j"))
            if key != at:
                yield from told()
                at = key
            _add(sums, part, block)
        yield from told()

    return scan


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole terms of one language and pair of blocks at a time."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows, rest = _whole_runs(rows if rest is None else pa.concat_tables([rest, rows]))
        yield from _same_blocks(rows)
    if rest is not None:
        yield from _same_blocks(rest)


def _changes(rows: pa.Table, *columns: str) -> np.ndarray:
    """Whether each row but the first differs from the one before in some of the columns."""
    out = np.zeros(max(0, rows.num_rows - 1), bool)
    for c in columns:
        column = rows[c].combine_chunks()
        out |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _whole_runs(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows before the last term's, and those."""
    cut = np.flatnonzero(_changes(rows, "lang", "i", "j", "term"))
    last = int(cut[-1]) + 1 if len(cut) else 0
    return rows.slice(0, last), rows.slice(last)


def _same_blocks(rows: pa.Table) -> Iterator[pa.Table]:
    if rows.num_rows:
        cuts = [0, *(np.flatnonzero(_changes(rows, "lang", "i", "j")) + 1).tolist(), rows.num_rows]
        yield from (rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _add(sums: np.ndarray, rows: pa.Table, block: int) -> None:
    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    g, b, p, p0 = (rows[c].to_numpy() for c in ("g", "b", "p", "p0"))
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    run = np.concatenate([[0], np.cumsum(_changes(rows, "term"))])
    place = g - b * block + np.where((b == j) & (i != j), block, 0)
    gap = 1
    here = np.arange(len(g))
    while True:  # rows of a run so far apart: as many rounds as the longest run has rows, two blocks at most
        here = here[here + gap < len(g)]
        here = here[run[here] == run[here + gap]]
        if not len(here):
            return
        x = here if i == j else here[b[here] != b[here + gap]]
        y = x + gap
        both = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
        np.add.at(sums, (place[x], place[y]), both)
        gap += 1


def source_distances(scored: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang``, ``g``, ``h``, ``value`` for every two different groups of a language, either way round."""
    cells = lambda df: df.withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)")))
    one = cells(groups).select("lang", F.col("b").alias("i"), F.col("k").alias("j"), "g", "v", F.col("p0").alias("p0g"))
    two = cells(groups).select("lang", F.col("k").alias("i"), F.col("b").alias("j"), F.col("g").alias("h"), F.col("p0").alias("p0h"))
    none = one.join(two, ["lang", "i", "j"]).where("g < h").select("lang", "g", "h", F.expr(f"v * ({_f('p0g', 'p0h')})").alias("value"))
    # what a source's own terms add, by how many of them have one probability
    counted = scored.groupBy("lang", "g", "p").agg(F.count("*").alias("k_terms"), F.first("p0").alias("p0g"), F.first("blocks").alias("blocks"))
    dealt = cells(counted.withColumn("salt", F.pmod(F.hash("g", "p"), F.lit(SALTS))))
    met = groups.select("lang", F.col("b").alias("k"), F.col("g").alias("h"), F.col("p0").alias("p0h")).withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    alone = dealt.join(met, ["lang", "k", "salt"]).where("g <> h").groupBy("lang", "g", "h").agg(F.expr(f"sum(k_terms * ({_f('p', 'p0h')} - {_f('p0g', 'p0h')}))").alias("value"))
    alone = alone.select("lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "value")
    postings = cells(scored).select("lang", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), "term", "g", "b", "p", "p0")
    dealt = postings.repartition("lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term", "g")
    both = dealt.mapInArrow(_meetings(block), "lang string, g long, h long, value long")
    sums = none.unionByName(alone).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))
    return sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.g", "w.h", "value")


def audit(docs: DataFrame, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for ``docs`` (text, lang, source).

    Part "pair" has every other source of the language with its distance over all kept terms; part "term" the ten terms of highest
    value that the group has and gives a higher probability than its language. Ranks go by falling value, then by the item's bytes.
    NULL text, lang and source count as empty; repeated rows count each; a language without kept terms has pairs of value 0 and no
    terms; an empty table gives an empty table; other columns are not read.
    """
    whole_texts(docs.sparkSession)
    kept = _kept(docs)
    groups = _groups(docs, kept, block)
    scored = kept.join(groups, ["lang", "source"]).withColumns({"p": _probability("n", "total"), "q": _probability("lang_n", "lang_total")})
    scored = materialize(scored.select("lang", "g", "b", "blocks", "term", "n", "p", "q", "p0"))
    release(kept)
    found = search_terms(scored, first).join(groups.select("lang", "g", "source"), ["lang", "g"])
    named = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = source_distances(scored, groups, block).join(named, ["lang", "h"]).join(groups.select("lang", "g", "source"), ["lang", "g"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return both.unionByName(found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
