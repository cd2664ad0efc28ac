"""Best-fit packing of token pieces into sequences, planned on the length histogram.

The histogram (a count per length, at most ``capacity`` rows however large the corpus) comes to the driver. There the configuration
linear program, one variable per way to fill a sequence, is solved by multiplicative weights: lengths have prices, a knapsack
dynamic programme prices the best configuration around every length, lengths that are covered ahead of schedule get
cheaper. If that isn't at the bound of the total length, the program is solved once more, configuration by configuration. The amounts are
rounded down; what is left is filled sequence by sequence with the fullest subset of the remaining
lengths. Pieces of one length are interchangeable: each gets its rank among them (counted in salted groups, so a frequent
length is no bottleneck), and the plan maps (length, rank) to a sequence and an offset.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.llm.words import encoder
from evenground.runtime import materialize

CAPACITY = 2048
SEPARATOR = 0
ROUNDS = 24
STEP = 4.0
#: Steps of the second solution, and how much of its log weight a length loses that a step covers once.
WEIGHT_STEPS, WEIGHT_LOSS = 400, 0.3
#: Pieces of one length that are ranked in one salted group, about.
GROUP_ROWS = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): ids of the whole text, then the separator, cut at ``capacity``.

    NULL texts count as empty (one piece: the separator); NULL ids and repeated rows stay, each a document of its own.
    ``turn`` numbers the pieces of a task.
    """
    whole_texts(docs.sparkSession)
    end = np.array([SEPARATOR], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, turn = encoder(tokenizer_path).encode, 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = memoryview(ids + end)
                for piece, low in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[low : low + 4 * capacity]
                    rows.append((doc_id, piece, low // 4, len(part) // 4, zlib.crc32(part), turn))
                    turn += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PIECES.replace(" long", "").replace(" int", "").split(", "))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price per size, and the position of a length that it takes (-1: none)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for size in range(1, capacity + 1):
        value[size] = value[size - 1]
        fit = np.searchsorted(lengths, size, "right")
        if fit:
            totals = prices[:fit] + value[size - lengths[:fit]]
            best = int(totals.argmax())
            if totals[best] > value[size] + 1e-12:
                value[size], choice[size] = totals[best], best
    return value, choice


def _fill(left: dict[int, int], room: int) -> list[int]:
    """The remaining lengths, as many times as they remain, with the largest total up to ``room``; longer lengths first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken.append(length)
            at -= length
    return taken


def _around_lengths(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> dict[tuple[int, ...], float]:
    """Amounts of configurations (positions of lengths): each round fills up around every length that is behind schedule."""
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    covered, log_price = np.zeros(len(lengths)), np.log(lengths / capacity)
    for now in range(1, rounds + 1):
        _, choice = _knapsack(lengths, np.exp(log_price), capacity)
        for own in range(len(lengths) - 1, -1, -1):
            short = demand[own] * now / rounds - covered[own]
            if short <= 0:
                continue
            took = [own, *_taken(lengths, choice, capacity - int(lengths[own]))]
            pattern, times = np.unique(took, return_counts=True)
            # no more than the demand allows of any of its lengths
            share = min(short / times[pattern == own][0], float((demand[pattern] / times).min()))
            amounts[tuple(sorted(took, reverse=True))] += share
            covered[pattern] += share * times
        ahead = covered / demand - now / rounds
        log_price = np.log(lengths / capacity) - STEP / rounds * np.clip(ahead, -1, 1)
    return amounts


def _by_weights(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int = WEIGHT_STEPS) -> dict[tuple[int, ...], float]:
    """The same, one configuration a step: the best one at the weights, as much of it as the scarcest of its lengths; what it covers
    loses weight. Scaled so that the least covered length is covered just once."""
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    covered, log_weight = np.zeros(len(lengths)), np.log(lengths / capacity) - np.log(demand)
    for _ in range(steps):
        _, choice = _knapsack(lengths, np.exp(log_weight - log_weight.max()), capacity)
        took = _taken(lengths, choice, capacity)
        pattern, times = np.unique(took, return_counts=True)
        amount = float((demand[pattern] / times).min())
        amounts[tuple(sorted(took, reverse=True))] += amount
        covered[pattern] += amount * times
        log_weight[pattern] -= WEIGHT_LOSS * amount * times / demand[pattern]
    least = float((covered / demand).min())
    return {k: v / least for k, v in amounts.items()} if least > 0 else {}


def _taken(lengths: np.ndarray, choice: np.ndarray, size: int) -> list[int]:
    """Positions of the lengths that the knapsack of ``size`` takes."""
    took: list[int] = []
    while size > 0:
        if choice[size] < 0:
            size -= 1
            continue
        took.append(int(choice[size]))
        size -= int(lengths[choice[size]])
    return took


def _rounded(amounts: dict[tuple[int, ...], float], lengths: np.ndarray, left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Whole numbers of sequences of each configuration (of lengths); what rounding leaves is filled sequence by sequence."""
    left, plan = dict(left), defaultdict(int)
    for took, amount in sorted(amounts.items(), key=lambda x: (-sum(int(lengths[i]) for i in x[0]), x[0])):
        pattern, times = np.unique(took, return_counts=True)
        uses = min(int(amount + 1e-9), *(left[int(lengths[i])] // int(n) for i, n in zip(pattern, times, strict=True)))
        if uses > 0:
            plan[tuple(int(lengths[i]) for i in took)] += uses
            for i, n in zip(pattern, times, strict=True):
                left[int(lengths[i])] -= uses * int(n)
    left = {k: n for k, n in left.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = [longest, *_fill(left, capacity - longest)]
        left[longest] += 1
        need = {k: pattern.count(k) for k in pattern}
        uses = min(left[k] // n for k, n in need.items())
        plan[tuple(sorted(pattern, reverse=True))] += uses
        for k, n in need.items():
            left[k] -= uses * n
            if not left[k]:
                del left[k]
    return plan


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths of one sequence, descending) and how many sequences each fills; every piece is placed once.

    If the first solution isn't at the bound of the total length, the program is solved again, a step a configuration, and the better plan
    is taken.
    """
    left = {int(k): int(n) for k, n in counts.items() if n > 0}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("a length is outside 1 to the capacity")
    whole = {(capacity,): left.pop(capacity)} if capacity in left else {}
    lengths = np.array(sorted(left), np.int64)
    demand = np.array([left[int(x)] for x in lengths], float)
    plan: dict[tuple[int, ...], int] = {}
    if left:
        plan = _rounded(_around_lengths(lengths, demand, capacity, rounds), lengths, left, capacity)
        if sum(plan.values()) > -(-sum(k * n for k, n in left.items()) // capacity):
            other = _rounded(_by_weights(lengths, demand, capacity), lengths, left, capacity)
            plan = min(plan, other, key=lambda p: sum(p.values()))
    return sorted([*plan.items(), *whole.items()], reverse=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, turn and any other columns) with ``sequence_id`` and ``offset``; ``turn`` goes.

    Sequences are gapless from offset 0 and hold ``capacity`` tokens at most. Pieces are expected to be materialized: they are
    read twice.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    starts: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, uses in plan_packing(counts, capacity):
        offset = 0
        for length in pattern:
            starts.append((length, used[length], sequence, offset))
            used[length] += uses
            offset += length
        sequence += uses
    starts.sort()
    table = np.array(starts, np.int64).reshape(-1, 4)
    keys, first, base, offsets = table[:, 0] << 48 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    salts = max(8, sum(counts.values()) // GROUP_ROWS)
    salted = pieces.withColumn("salt", F.pmod("turn", F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("turn")))
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("before", "salt", "turn")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            kept = [n for n in batch.schema.names if n != "rank"]
            placed = [pa.array(base[at] + rank - first[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *placed], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` for every piece of ``docs``.

    Empty and NULL texts are one piece of one separator; an empty table gives an empty table; other columns are not read.
    """
    packed = pack(materialize(token_pieces(docs, tokenizer_path, capacity)), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
