"""Near copies of whole texts by the Jaccard similarity of their word shingles, complete and verified.

A text is the set of its shingles' hashes. Two sets of similarity 4/5 or more share a member among the first fifth (and one
more) of either, in any order that holds for all sets: those members are the join keys, and lengths and positions rule out what
cannot reach 4/5. The order puts shingles that a share of the texts finds often last, so that a common passage is no key of
texts that hold much else; these texts decide the order only, never what is found.

A group of very many near copies shares nearly all keys. So the first offers are few: the links of SimHash fingerprints within four bits, by
their Golay-code keys, and in each run of a key every member's neighbour and the run's head. What is verified of these becomes
components, and then all pairs of different components are offered. No link between components is lost, and those inside one need no
offer. A key that very many sets of several components still have is cut into blocks of its rows, and every pair of blocks is
a task that compares bitmaps on the spot.

Offered pairs meet their texts' parity bitmaps first: a bitmap has about two bits per shingle, each the parity of the shingles that
fall on it, so two bitmaps differ in no more bits than the sets in shingles, and pairs that differ in too many are done. Only the texts
of what is left are read again, and their whole sets compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.llm.simhash import fingerprint_links, majority
from evenground.operators.components import connected_components
from evenground.runtime import materialize, release

SHINGLE_WORDS = 5
SEED = 42
#: One of so many texts (but so many texts, if there are) is asked for the order of the shingles; how many of them make a shingle a
#: common one, and common ones told.
ORDER_SHARE, ORDER_TEXTS, COMMON_TEXTS, COMMON = 32, 4000, 6, 1_000_000
#: Rows of a key that are compared as a whole; rows of a block of a longer one, and of those compared at once; bytes of their bitmaps.
RUN_ROWS, BLOCK_ROWS, CHUNK, FOLDED = 512, 8192, 256, 128
#: Offered pairs that a task holds before it passes them on.
HELD_PAIRS = 1 << 20
_MEMBER = "key long, sid long, n int, at int"


def all_shingles(text: bytes) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles in order; a text of fewer words is one shingle, one of none has none."""
    parts = text.lower().split()  # bytes: A-Z only, and exactly \\x20 and \\x09-\\x0D
    if not parts:
        return np.zeros(0, np.int64)
    digest, join, words = xxhash.xxh64_intdigest, b" ".join, SHINGLE_WORDS
    return np.array([digest(join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))], np.uint64).view(np.int64)


def shingles(text: bytes) -> np.ndarray:
    """The different hashes of a UTF-8 text's shingles, sorted."""
    return np.unique(all_shingles(text))


def parities(hashes: np.ndarray) -> bytes:
    """A bitmap of two to four bits per member of a set (64 at least): of how many members fall on each bit, the parity."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    counts = np.bincount(hashes & (bits - 1), minlength=bits)
    return np.packbits(counts & 1 == 1, bitorder="little").tobytes()


def at_least_differing(a: bytes, b: bytes) -> int:
    """A lower bound of how many members only one of two sets has, from their bitmaps."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = 8 * min(len(a), len(b))
    for bits in (8 * len(a), 8 * len(b)):
        while bits > size:  # parities of half as many bits
            bits //= 2
            if 8 * len(a) > size:
                x = x >> bits ^ x & (1 << bits) - 1
            else:
                y = y >> bits ^ y & (1 << bits) - 1
    return (x ^ y).bit_count()


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members in the common order, as many as a set of similarity 4/5 cannot avoid."""
    late = np.zeros(len(hashes), np.int64)
    if len(common) and len(hashes):
        found = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = np.where(common[found] == hashes, rank[found], 0)
    return hashes[np.lexsort((hashes, late))][: len(hashes) - (4 * len(hashes) + 4) // 5 + 1]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that many texts of a sample hold."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["h"])

    every = max(1, min(ORDER_SHARE, docs.count() // ORDER_TEXTS))
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.encode("text", "UTF-8").alias("t")).distinct()
    counts = drawn.mapInArrow(members, "h long").groupBy("h").count().where(F.col("count") >= COMMON_TEXTS)
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    rows.sort(key=lambda r: r["h"])
    return np.array([r["h"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)


_SETS = "doc_id long, digest long, sid long, n int, fp long, bits binary, prefix binary"


def _sets(docs: DataFrame) -> DataFrame:
    """Of every row ``doc_id``, ``digest`` (of its text), ``sid`` (of its set), ``n``, SimHash ``fp``, bitmap, ``prefix`` (8 bytes each)."""
    common, rank = _common(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                all_ = all_shingles(text or b"")
                s = np.unique(all_)
                rows.append((set_id(s), len(s), majority(all_.view(np.uint64)), parities(s), _prefix(s, common, rank).tobytes() if len(s) else b""))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            told = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], [x.split()[0] for x in _SETS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.encode("text", "UTF-8").alias("t"))
    return rows.mapInArrow(scan, _SETS)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
        sizes = np.array([len(k) for k in keys], np.int64)
        if not sizes.sum():
            continue
        at = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        columns = [np.concatenate(keys), np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), at]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "sid", "n", "at"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, end of its run for every row) of whole runs of rows that are sorted by their first column."""
    held: list[list[np.ndarray]] = []

    def whole(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        return columns, np.searchsorted(columns[0], columns[0], "right")

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.searchsorted(new[0], new[0][-1], "left"))
        if held and held[0][0][0] != new[0][-1] or last:  # some run ends in this batch
            done = [np.concatenate(c) for c in zip(*held, [c[:last] for c in new], strict=True)]
            held, new = [], [c[last:] for c in new]
            yield whole(done)
        held.append(new)
    if held:
        yield whole([np.concatenate(c) for c in zip(*held, strict=True)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row near in length has too; rows are sorted by key and length, and one is held back."""
    held, paired = None, False

    def told(columns: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["key", "sid", "n", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        columns = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
        key, n = columns[0], columns[2].astype(np.int64)
        pair = (key[1:] == key[:-1]) & (4 * n[1:] <= 5 * n[:-1])
        keep = np.r_[pair, False] | np.r_[paired, pair]
        yield told([c[:-1] for c in columns], keep[:-1])
        held, paired = [c[-1:] for c in columns], bool(keep[-1])
    if held is not None:
        yield told(held, np.array([paired]))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _may(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` members can be similar if the key at ``at`` and ``to`` is the first that they share."""
    return 9 * np.minimum(n - at, m - to) >= 4 * (n + m)


def _offer_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with the one before it and with the first of its key; rows are sorted by key, two of them are held."""
    head = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])  # key, sid, n, at
        rows = rows if last is None else np.concatenate([last, rows], axis=1)
        first = rows[:, np.searchsorted(rows[0], rows[0], "left")]
        if head is not None:
            first = np.where(rows[0] == head[0], head, first)
        one, two = np.concatenate([rows[:, :-1], first], axis=1), np.concatenate([rows[:, 1:], rows], axis=1)
        fit = (one[0] == two[0]) & (one[1] != two[1]) & _may(one[2], one[3], two[2], two[3])
        yield _pairs([one[1, fit]], [two[1, fit]])
        head, last = first[:, -1:], rows[:, -1:]


def _offer_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of different parts in whole runs of a key, which are short."""
    for (_, sid, n, at, part), end in _runs(batches):
        n, at = n.astype(np.int64), at.astype(np.int64)
        i, a, b, gap, held = np.arange(len(sid)), [], [], 1, 0
        while len(i):
            i = i[i + gap < end[i]]
            i = i[4 * n[i + gap] <= 5 * n[i]]  # lengths rise within a run
            fit = i[(part[i] != part[i + gap]) & _may(n[i], at[i], n[i + gap], at[i + gap])]
            a.append(sid[fit])
            b.append(sid[fit + gap])
            held += len(fit)
            gap += 1
            if held > HELD_PAIRS:
                yield _pairs(a, b)
                a, b, held = [], [], 0
        yield _pairs(a, b)


def _words(bitmaps: list[bytes], size: int) -> np.ndarray:
    """(words, rows): bitmaps of ``size`` bytes or more, folded to that size, as unsigned 64-bit words."""
    folded = [np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, size // 8), axis=0) for x in bitmaps]
    return np.ascontiguousarray(np.array(folded, np.uint64).reshape(-1, size // 8).T)


def _offer_block(group: pa.Table) -> pa.Table:
    """Of two blocks of a key's rows (or one) the pairs of different parts whose bitmaps allow them to be similar."""
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    block = group["block"].to_numpy()
    sides = []
    for k in (i, j):
        side = group.filter(pa.array(block == k)).sort_by([("n", "ascending"), ("sid", "ascending")])
        sid, n, at, part = (side[c].to_numpy().astype(np.int64) for c in ("sid", "n", "at", "part"))
        sides.append((sid, n, at, part, side["bits"].to_pylist()))
    (sid, n, at, part, bits), (sid2, m, to, part2, bits2) = sides
    a, b = [], []
    for low in range(0, len(sid), CHUNK):
        c = slice(low, low + CHUNK)
        # in one block only rows that follow; lengths rise, in the second block and from the first block to it
        first = low if i == j else int(np.searchsorted(m, (4 * n[c][0] + 4) // 5))
        d = slice(first, int(np.searchsorted(m, 5 * n[c][-1] // 4, "right")))
        if d.start >= d.stop:
            continue
        size = min(FOLDED, min(map(len, bits[c])), min(map(len, bits2[d])))
        differing = np.zeros((len(sid[c]), len(sid2[d])), np.int32)
        for x, y in zip(_words(bits[c], size), _words(bits2[d], size), strict=True):
            differing += np.bitwise_count(x[:, None] ^ y[None, :])
        fit = (9 * differing <= n[c, None] + m[None, d]) & (part[c, None] != part2[None, d]) & _may(n[c, None], at[c, None], m[None, d], to[None, d])
        x, y = np.nonzero(fit)
        a.append(sid[c][x])
        b.append(sid2[d][y])
    return pa.Table.from_batches([_pairs(a, b)])


def _rest(shared: DataFrame, parts: DataFrame, classes: DataFrame, run_rows: int, block_rows: int) -> DataFrame:
    """``a``, ``b``: the pairs of different ``parts`` (sid, part) that share a key of ``shared`` and may be similar, in part repeatedly."""
    rows = shared.join(parts, "sid", "left").select("key", "sid", "n", "at", F.coalesce("part", "sid").alias("part"))
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key", "rows"))
    mixed = rows.join(keys.where(F.col("rows") <= run_rows).select("key"), "key", "left_semi")
    short = mixed.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(_offer_rest, "a long, b long")
    long = keys.where(F.col("rows") > run_rows)
    if long.isEmpty():
        return short
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "sid")) - 1
    placed = rows.join(long, "key").withColumns({"block": F.floor(place / block_rows), "last": F.floor((F.col("rows") - 1) / block_rows)})
    sides = F.expr("transform(sequence(0L, last), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    grid = placed.join(classes.select("sid", "bits"), "sid").select("key", "sid", "n", "at", "part", "bits", "block", F.explode(sides).alias("ij"))
    blocks = grid.select("key", "sid", "n", "at", "part", "bits", "block", "ij.i", "ij.j").groupBy("key", "i", "j").applyInArrow(_offer_block, "a long, b long")
    return short.union(blocks)


def _verified(offers: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of ``offers`` that are similar, stored. ``classes``: sid, n, bits and the row (low, digest) of each set."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, left, right = (batch.column(c).to_pylist() for c in ("n", "m", "left", "right"))
            keep = [9 * at_least_differing(x, y) <= i + j for i, j, x, y in zip(n, m, left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "members"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            keep = pa.array([similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    told = classes.select("sid", "n", "bits")
    met = offers.distinct().join(told.toDF("a", "n", "left"), "a").join(told.toDF("b", "m", "right"), "b")
    likely = materialize(met.select("a", "b", "n", "m", "left", "right").mapInArrow(near, "a long, b long"))
    asked = likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct()
    rows = classes.join(asked, "sid", "left_semi").select(F.col("low").alias("_low"), F.col("digest").alias("_digest"))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_low")) & (F.xxhash64("text") == F.col("_digest"))
    texts = docs.join(rows, here, "left_semi").select(F.encode("text", "UTF-8").alias("t"))
    members = materialize(texts.mapInArrow(again, "sid long, members binary").dropDuplicates(["sid"]))
    both = likely.join(members.toDF("a", "left"), "a").join(members.toDF("b", "right"), "b")
    links = materialize(both.select("a", "b", "left", "right").mapInArrow(judge, "a long, b long"))
    release(likely, members)
    return links


def near_copies(docs: DataFrame, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id``, ``digest``, ``class_id``, ``component_id`` for every row of ``docs`` (doc_id, text).

    Rows are of one class if links of similarity 4/5 or more between sets of shingles of five words lead from one to the other. component_id
    is the smallest doc_id of the class; digest is xxhash64 of the text. Texts of no word, NULL included, are copies of each other; a
    NULL doc_id is no smallest id; repeated rows give repeated rows; an empty table gives an empty table.
    """
    whole_texts(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = materialize(_sets(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = sets.groupBy("sid").agg(first.alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"))
    classes = materialize(classes.select("sid", "n", "fp", "bits", F.col("row.doc_id").alias("low"), F.col("row.digest").alias("digest")))
    once = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    keys = once.mapInArrow(_expand, _MEMBER).repartition("key").sortWithinPartitions("key", "n", "sid")
    shared = materialize(keys.mapInArrow(_shared, _MEMBER))
    runs = shared.repartition("key").sortWithinPartitions("key", "n", "sid")
    hashed = fingerprint_links(classes.where("n > 0").select("fp"))
    by_hash = classes.where("n > 0").groupBy("fp").agg(F.min("sid").alias("head"))
    some = [
        runs.mapInArrow(_offer_some, "a long, b long"),
        classes.where("n > 0").join(by_hash, "fp").where("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b")),
        hashed.join(by_hash.toDF("a", "x"), "a").join(by_hash.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")),
    ]
    links = _verified(some[0].union(some[1]).union(some[2]), docs, classes)
    parts = connected_components(links, "a", "b").toDF("sid", "part")
    rest = _verified(_rest(shared, parts, classes, run_rows, block_rows), docs, classes)
    release(shared)
    linked = connected_components(links.union(rest), "a", "b").withColumnRenamed("node", "sid")
    classed = classes.select("sid", "low").join(linked, "sid", "left").withColumn("class_id", F.coalesce("component", "sid"))
    named = classed.join(classed.groupBy("class_id").agg(F.min("low").alias("component_id")), "class_id").select("sid", "class_id", "component_id")
    return sets.select("doc_id", "digest", "sid").join(materialize(named), "sid").select("doc_id", "digest", "class_id", "component_id")
