"""SimHash fingerprints of whole texts, linked by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most 4 bits, two of
the segments differ in at most 2 bits together (the third has at least as many as either). A segment's keys are the
Golay codeword indices that it and its one-bit neighbours decode to; segments at distance 2 or less share one. So the two
fingerprints share a pair of indices in one of the three pairs of segments: that is the join key, and every
candidate pair is verified bit by bit. No link is lost.

Different fingerprints only are joined (exact copies collapse first). A run of fingerprints under one key is emitted as
a spanning forest of its verified links, not as all pairs; runs over ``RUN_ROWS`` are cut into blocks, and every pair of
blocks is verified in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.llm.golay import nearby_indices
from evenground.operators.components import connected_components
from evenground.runtime import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Shingle hashes that are held at once; longer texts are counted slice by slice.
SLICE = 1 << 15
#: (lowest bit, bits) of the three segments
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Longest run of one key that one task verifies as a whole.
RUN_ROWS = 4096


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of 64-bit hashes have each bit."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[low : low + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return ones


def _packed(ones: np.ndarray, n: int) -> np.uint64:
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of unsigned 64-bit hashes have, as a signed number; 0 if there are none."""
    return int(_packed(_ones(hashes), len(hashes)).view(np.int64)) if len(hashes) else 0


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text; 0 if it has no word."""
    parts = text.lower().split()  # bytes: A-Z only, and exactly \\x20 and \\x09-\\x0D
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, last, SLICE):
        ones += _ones(np.array([digest(join(parts[i : i + words]), SEED) for i in range(low, min(low + SLICE, last))], np.uint64))
    return int(_packed(ones, last))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` long, ``fp`` long (the 64 bits) for every row; NULL texts count as empty, NULL ids stay NULL."""
    whole_texts(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t or b"") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.encode(F.col(text_column), "UTF-8").alias("t"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


def _keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``prints``, keys): the different keys of every fingerprint, once each."""
    near = [np.sort(nearby_indices(prints >> np.uint64(low) & np.uint64((1 << bits) - 1), bits), axis=1) for low, bits in SEGMENTS]
    fresh = [np.diff(n, axis=1, prepend=n[:, :1] + 1) != 0 for n in near]
    at, keys = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        row, left, right = np.nonzero(fresh[a][:, :, None] & fresh[b][:, None, :])
        at.append(row)
        keys.append(number << 24 | near[a][row, left].astype(np.int64) << 12 | near[b][row, right].astype(np.int64))
    return np.concatenate(at), np.concatenate(keys)


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def _forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links that connect what all verified links connect, within ``left`` or between ``left`` and ``right``."""
    prints = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(prints), np.int8)
    side[len(left) :] = 1
    rest = np.arange(len(prints))
    heads, tails = [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            head = todo.pop()
            hit = _close(prints[rest], prints[head], bits)
            if right is not None:
                hit &= side[rest] != side[head]
            if hit.any():
                found = rest[hit]
                heads.append(np.full(len(found), prints[head]))
                tails.append(prints[found])
                todo.extend(found)
                rest = rest[~hit]
    return heads, tails


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64())])


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], schema=_PAIR)


def _verify(keys: np.ndarray, prints: np.ndarray, bits: int) -> pa.RecordBatch:
    """Links inside every run of equal (sorted) keys."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    sizes = np.diff(starts, append=len(keys))
    heads, tails = [], []
    short = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    for gap in range(1, 8):
        first = np.flatnonzero((keys[:-gap] == keys[gap:]) & short[:-gap]) if len(keys) > gap else []
        if not len(first):
            break
        hit = first[_close(prints[first], prints[first + gap], bits)]
        heads.append(prints[hit])
        tails.append(prints[hit + gap])
    for start, size in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        more = _forest(prints[start : start + size], None, bits)
        heads += more[0]
        tails += more[1]
    return _pairs(heads, tails)


def _scan_runs(bits: int, run_rows: int):
    """Over rows sorted by key: links of whole runs, and the rows of longer runs with a block number each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = prints = np.zeros(0, np.int64)
        open_key, open_rows = None, 0  # a run that is already being cut into blocks

        def blocks(k: int, rows: np.ndarray, before: int) -> pa.RecordBatch:
            number = (before + np.arange(len(rows))) // run_rows
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), none, pa.array(np.full(len(rows), k)), pa.array(number)], schema=_PAIR)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if open_key is not None:
                size = int(np.searchsorted(keys, open_key, "right"))
                yield blocks(open_key, prints[:size], open_rows)
                open_rows += size
                keys, prints = keys[size:], prints[size:]
                if not len(keys):
                    continue
                open_key = None
            last = int(np.searchsorted(keys, keys[-1], "left"))  # the last run may go on
            if last:
                yield _verify(keys[:last], prints[:last], bits)
                keys, prints = keys[last:], prints[last:]
            if len(keys) > run_rows:
                open_key, open_rows = int(keys[0]), len(keys)
                yield blocks(open_key, prints, 0)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield _verify(keys, prints, bits)

    return scan


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links ``a`` < ``b`` (as longs) between the different fingerprints of the column ``fp``.

    They connect exactly what all pairs at ``max_bits`` (4 at most) or fewer differing bits connect.
    """
    if max_bits > 4:
        raise ValueError("the keys cover 4 differing bits at most")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for low in range(0, len(values), 500):
                part = values[low : low + 500]
                at, keys = _keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], ["key", "fp"])

    def across(group: pa.Table) -> pa.Table:
        block, rows = group.column("block").to_numpy(), group.column("a").to_numpy()
        i = group.column("i")[0].as_py()
        j = group.column("j")[0].as_py()
        links = _forest(rows[block == i], None if i == j else rows[block == j], max_bits)
        return pa.Table.from_batches([_pairs(*links).select(["a", "b"])])

    distinct = prints.select("fp").where("fp is not null").distinct()
    sorted_keys = distinct.mapInArrow(expand, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(sorted_keys.mapInArrow(_scan_runs(max_bits, run_rows), "a long, b long, key long, block long").distinct())
    links = found.where("b is not null").select("a", "b")
    cut = found.where("b is null").select("a", "key", "block")
    if cut.isEmpty():
        return links.distinct()
    last = cut.groupBy("key").agg(F.max("block").alias("last"))
    sides = F.expr("transform(sequence(0L, last), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    grid = cut.join(last, "key").select("a", "key", "block", F.explode(sides).alias("ij")).select("a", "key", "block", "ij.i", "ij.j")
    return links.union(grid.groupBy("key", "i", "j").applyInArrow(across, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of ``max_bits`` or fewer differing bits, the row itself
    included. NULL and empty texts have fingerprint zero and link like any other; a NULL doc_id is no smallest id
    (component_id is NULL where nothing else is reachable); repeated rows give repeated rows; an empty table gives an
    empty table; other columns are not read.
    """
    prints = materialize(fingerprints(docs))
    linked = connected_components(fingerprint_links(prints, max_bits), "a", "b")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = smallest.join(linked.withColumnRenamed("node", "fp"), "fp")
    low = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    moved = classes.join(low, "component").select("fp", "component_id")
    # stored, so that both sides of the last join are plain shuffles and a fingerprint that very many rows have can be split
    named = materialize(smallest.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
