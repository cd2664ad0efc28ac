"""Quality: Bradley-Terry ranking learnt from preference pairs, cut at a quantile of the scores.

A text is described by counts (letters, symbols, repeats, lines, words); each is coded by the quantile bin of the training
texts it falls in. All pairs of one good and one bad training text are preferences; logistic loss on the difference of their
codes gives a weight per bin, and a text's strength is the sum of its bins' weights. The strength at the quantile
that the share of bad labels names is the threshold: it maps to the score 0.3, by a logistic curve whose slope is
fitted on the training texts.

All labelled texts that aren't held out are learnt from. Texts are described where they are read; the descriptions, of one size each
however long the text, are stored and meet the labels in a join, and may be scored as they are. Labelled ones are stored as blocks of codes;
a round passes over the blocks twice. How often a text loses to those of the other label depends on its strength alone, so the first pass
counts strengths in bins, which say it for every bin, and the second sums the codes by it: all pairs, in time
linear in the texts. Sums are of whole numbers, so they don't depend on partitions or their order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.llm.labelled import held_out, labelled_rows
from evenground.runtime import materialize, release

THRESHOLD = 0.3
BINS = 12
ROUNDS = 40
RIDGE = 1e-3
#: Bins of strengths; texts in a stored block; binary digits of weights and shares; of the counts' values that quantiles are told by.
STRENGTHS, BLOCK, DIGITS, VALUE_DIGITS = 4096, 20_000, 24, 9
#: Code points that are counted at once.
SLICE = 1 << 20

_LATIN = [chr(i) for i in range(0x250)]
_KINDS = np.array(
    [0 if c.isspace() else 1 if c.islower() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:'\"!?()-" else 5 for c in _LATIN], np.int64
)
FEATURES = (
    "chars words word_length lower upper digit mark symbol blank other distinct_words top_word line_length lines repeated_lines ended_lines "
    "marked_words capital_words bare_words digit_words squeezed distinct_pairs repeated_next short_words long_words exclaimed barred sentences"
).split()


def describe(text: str) -> list[float]:
    """The numbers in FEATURES for one whole text."""
    kinds, barred, exclaimed = np.zeros(7, np.int64), text.count("|"), text.count("!")
    packer, packed = zlib.compressobj(1), 0
    for low in range(0, len(text), SLICE):
        part = text[low : low + SLICE]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        near = codes < len(_KINDS)
        kinds[:6] += np.bincount(_KINDS[codes[near]], minlength=6)
        kinds[6] += int((~near).sum())
        packed += len(packer.compress(part.encode("utf-8", "surrogatepass")))
    packed += len(packer.flush())
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counted = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    bare = sum(c for w, c in counted.items() if not any(x.isalpha() for x in w))
    marked = sum(c for w, c in counted.items() if not w[-1].isalnum())
    capital = sum(c for w, c in counted.items() if len(w) > 1 and w.isupper())
    digits = sum(c for w, c in counted.items() if any(x.isdigit() for x in w))
    short = sum(c for w, c in counted.items() if len(w) <= 3)
    long = sum(c for w, c in counted.items() if len(w) > 12)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / m, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        kinds[0] / n, kinds[6] / n, len(counted) / m, max(counted.values(), default=0) / m, np.log1p(len(text) / k), np.log1p(len(lines)),
        1 - len(set(lines)) / k, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / k, marked / m, capital / m, bare / m, digits / m, packed / n,
        pairs / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, short / m, long / m, exclaimed / n, barred / n,
        np.log1p(m / max(1, text.count(". ") + text.count(".\n"))),
    ]


@dataclass(frozen=True)
class BradleyTerry:
    """Bin edges and bin weights per feature; strength s maps to a score by slope and the threshold's strength."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    cut: float
    slope: float

    def strengths(self, described: np.ndarray) -> np.ndarray:
        return sum((w[np.searchsorted(e, described[:, i], "right")] for i, (e, w) in enumerate(zip(self.edges, self.weights, strict=True))), np.zeros(len(described)))

    def scores(self, described: np.ndarray) -> np.ndarray:
        at_cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strengths(described) - self.cut) + at_cut, -30, 30)))

    def column(self, text: str = "text") -> Column:
        """The score, 0 to 1, of a text column; NULL counts as empty."""

        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(self.scores(np.array([describe(t or "") for t in part]).reshape(-1, len(FEATURES))))

        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double")(F.col(text))

    def described_column(self, described: str = "described") -> Column:
        """The same of a column from ``described``."""

        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(self.scores(np.frombuffer(b"".join(part)).reshape(-1, len(FEATURES))))

        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double")(F.col(described))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``described`` (the numbers in FEATURES as doubles) for every row of ``docs`` (doc_id, text), stored; texts are moved nowhere."""
    whole_texts(docs.sparkSession)

    def numbers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.array(describe(t or ""), float).tobytes() for t in part], dtype=object)

    numbers.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return materialize(docs.select("doc_id", F.pandas_udf(numbers, "binary")("text").alias("described")))


def _unlabelled(n: np.ndarray) -> BradleyTerry:
    """Without texts of both labels: every text gets the smoothed share of label 1."""
    share = (n[1] + 0.5) / (n.sum() + 1)
    cut = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(share / (1 - share))
    return BradleyTerry([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), float(cut), 1.0)


def _values(described: np.ndarray) -> np.ndarray:
    """Values with VALUE_DIGITS binary digits, so that few are different."""
    share, power = np.frexp(described)
    return np.ldexp(np.rint(np.ldexp(share, VALUE_DIGITS)), power - VALUE_DIGITS)


def choose_edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A feature's edges: ``counts`` (values, 2) of texts of either label with each of the sorted values; labels weigh the same."""
    share = np.cumsum(counts / counts.sum(axis=0), axis=0)
    at = lambda below, q: values[np.minimum(np.searchsorted(below, q - 1e-12), len(values) - 1)]
    # the tails of either class get edges of their own: a rare kind of text lies beyond all quantiles of the common kind
    tails = [at(share[:, y], np.array([0.01, 0.05, 0.95, 0.99])) for y in (0, 1)]
    return np.unique(np.concatenate([at(share.mean(axis=1), np.arange(1, BINS) / BINS), *tails]))


def _summed(blocks: RDD, f: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``f`` of every block (label, codes): one partial sum of some KB per task goes to the driver, without a shuffle in every round."""
    return _each(blocks, f).reduce(np.add)


def _each(blocks: RDD, f: Callable[[int, np.ndarray], np.ndarray]) -> RDD:
    return blocks.map(lambda block: f(block[0], np.frombuffer(block[1], np.uint16).reshape(-1, len(FEATURES))))


def fit_pairs(blocks: RDD, n: np.ndarray, edges: list[np.ndarray]) -> BradleyTerry:
    """Fit on all pairs of a text of label 1 and one of label 0; ``blocks``: (label, codes of texts); ``n``: texts of either label.

    Steps go by a bound of the loss's second derivative, which the codes alone give, with momentum.
    """
    first = np.cumsum([0, *(len(e) + 1 for e in edges)])
    size = int(first[-1])

    def met(y: int, codes: np.ndarray) -> np.ndarray:
        held = np.zeros((len(codes), size), np.float32)
        held[np.arange(len(codes))[:, None], codes] = 1
        out = np.zeros((2, size, size), np.int64)
        out[y] = np.rint(held.T @ held)
        return out

    both = _each(blocks, met).treeReduce(np.add) / n[:, None, None]  # once, and some MB per task
    mean = np.stack([np.diag(m) for m in both])
    bound = (both[0] + both[1] - np.outer(mean[0], mean[1]) - np.outer(mean[1], mean[0])) / 4 + RIDGE * np.eye(size)

    def strengths(weight: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Where the bins begin, their width, and how many texts of either label each holds."""
        parts = [weight[first[i] : first[i + 1]] for i in range(len(edges))]
        low, high = sum(p.min() for p in parts), sum(p.max() for p in parts)
        width = max(high - low, 1e-6) / (STRENGTHS - 1)

        def counted(y: int, codes: np.ndarray) -> np.ndarray:
            out = np.zeros((2, STRENGTHS), np.int64)
            out[y] = np.bincount(np.rint((weight[codes].sum(axis=1) - low) / width).astype(np.int64), minlength=STRENGTHS)
            return out

        return low, width, _summed(blocks, counted)

    def rounded(weight: np.ndarray) -> np.ndarray:
        return np.ldexp(np.rint(np.ldexp(weight, DIGITS)), -DIGITS)

    weight = at = np.zeros(size)
    for step in range(1, ROUNDS + 1):
        low, width, held = strengths(at)
        gaps = 1 / (1 + np.exp(np.clip(width * np.arange(1 - STRENGTHS, STRENGTHS), -30, 30)))  # by the winner's lead
        lost = np.stack([_against(held[1] / n[1], gaps[::-1]), _against(held[0] / n[0], gaps)])
        shares = np.rint(np.ldexp(lost, DIGITS))

        def pulled(y: int, codes: np.ndarray, weight=at, low=low, width=width, shares=shares) -> np.ndarray:
            share = shares[y][np.rint((weight[codes].sum(axis=1) - low) / width).astype(np.int64)]
            out = np.zeros((2, size), np.int64)
            out[y] = np.rint(np.bincount(codes.ravel(), np.repeat(share, codes.shape[1]), size))
            return out

        pull = np.ldexp(_summed(blocks, pulled) / n[:, None], -DIGITS)
        last, weight = weight, at - np.linalg.solve(bound, pull[0] - pull[1] + RIDGE * at)
        at = rounded(weight + (step - 1) / (step + 2) * (weight - last))
    weight = rounded(weight)
    low, width, held = strengths(weight)
    below = np.cumsum(held.sum(axis=0))
    cut = low + width * (min(int(np.searchsorted(below, n[0])), STRENGTHS - 2) + 0.5)
    # the slope of the logistic curve through (cut, THRESHOLD) with the least loss
    slopes, offset = np.geomspace(0.05, 20, 60), np.log(THRESHOLD / (1 - THRESHOLD))
    lead = low + width * np.arange(STRENGTHS) - cut
    losses = [sum((held[y] * np.logaddexp(0, (1 - 2 * y) * (s * lead + offset))).sum() for y in (0, 1)) for s in slopes]
    weights = [weight[first[i] : first[i + 1]] for i in range(len(edges))]
    return BradleyTerry(edges, weights, float(cut), float(slopes[int(np.argmin(losses))]))


def _against(held: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """For every bin the sum over all bins of ``held`` times the gap's value, ``gaps`` running from the least difference to the largest."""
    return np.convolve(held, gaps)[len(held) - 1 : 2 * len(held) - 1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> BradleyTerry:
    """The model learnt from ``labels`` (doc_id, ``label``) and the texts of ``docs`` (doc_id, text).

    Without rows of both labels every text gets the smoothed share of label 1.
    """
    told = described(docs.where(~held_out()))
    model = fit_described(told, labels, label)
    release(told)
    return model


def fit_described(told: DataFrame, labels: DataFrame, label: str = "quality") -> BradleyTerry:
    """``fit`` on a table from ``described``."""

    def gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[list, list] = ([], [])
        for part in parts:
            for y, x in zip(part["y"], part["described"], strict=True):
                held[y].append(x)
                if len(held[y]) == BLOCK:
                    yield pd.DataFrame({"y": [y], "n": [BLOCK], "x": [b"".join(held[y])]})
                    held[y].clear()
        for y in (0, 1):
            if held[y]:
                yield pd.DataFrame({"y": [y], "n": [len(held[y])], "x": [b"".join(held[y])]})

    described = materialize(labelled_rows(told, labels, label).mapInPandas(gathered, "y int, n long, x binary"))
    sizes = {r["y"]: r["n"] for r in described.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    n = np.array([sizes.get(y, 0) for y in (0, 1)])
    if not n.all():
        return _unlabelled(n)

    def valued(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for y, x in zip(part["y"], part["x"], strict=True):
                values = _values(np.frombuffer(x).reshape(-1, len(FEATURES)))
                for i in range(len(FEATURES)):
                    different, count = np.unique(values[:, i], return_counts=True)
                    yield pd.DataFrame({"i": i, "v": different, "n0": count * (y == 0), "n1": count * (y == 1)})

    told = described.mapInPandas(valued, "i int, v double, n0 long, n1 long").groupBy("i", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = np.array(told.orderBy("i", "v").collect(), float)  # 2^VALUE_DIGITS values to a doubling at most
    edges = [choose_edges(found[found[:, 0] == i, 1], found[found[:, 0] == i, 2:]) for i in range(len(FEATURES))]
    first = np.cumsum([0, *(len(e) + 1 for e in edges)])

    def coded(row: Row) -> tuple[int, bytes]:
        x = np.frombuffer(row["x"]).reshape(-1, len(FEATURES))
        codes = np.stack([np.searchsorted(e, x[:, i], "right") + first[i] for i, e in enumerate(edges)], axis=1)
        return row["y"], codes.astype(np.uint16).tobytes()

    blocks = described.rdd.map(coded)
    # a task per core at most, however many partitions the rows came in: every round starts them all twice
    blocks = blocks.coalesce(max(1, min(blocks.getNumPartitions(), described.sparkSession.sparkContext.defaultParallelism))).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_pairs(blocks, n, edges)
    blocks.unpersist()
    release(described)
    return model


def quality(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (score 0.3 or more) for every row of ``docs`` (doc_id, text).

    NULL texts count as empty; a NULL doc_id stays, with held_out false; repeated rows get equal scores; an empty table gives an
    empty table; other columns are not read.
    """
    whole_texts(docs.sparkSession)
    return _scored(docs, model.column())


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``quality`` of ``docs`` by the model that their labelled rows give: every text is described once."""
    told = described(docs)
    return _scored(told, fit_described(told, labels, label).described_column())


def _scored(rows: DataFrame, score: Column) -> DataFrame:
    scored = rows.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
