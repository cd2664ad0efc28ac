"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

A text that holds none of the rules' keywords is done after one look. In the others each rule whose keyword occurs is tried, every
place it matches is a detection, and a detection inside a longer one (or over the same span as one of a rule
further up) is suppressed. The base phrases are counted on their own and are never suppressed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.llm.common import text_or_empty
from evenground.llm.license_rules import Rule, gate, rules

#: Phrases that are always looked for, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.6
#: Items that are joined one by one before a new block begins.
BLOCK = 128
#: A word character of the text as it is, either case of A-Z.
_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_CHAR}+")).cast("long")


def _phrase(words: str) -> str:
    return f"(?<!{_CHAR}){_GAP.join(words.split())}(?!{_CHAR})"


def _table(known: list[Rule]) -> Column:
    """The rules by keyword, as one constant: array of (keyword, rules)."""
    groups: dict[str, list[dict]] = {}
    for r in known:
        groups.setdefault(r.keyword, []).append({"label": r.label, "regex": r.regex, "rank": r.priority, "weight": r.weight})
    text = json.dumps([{"keyword": k, "rules": x} for k, x in groups.items()])
    return F.from_json(F.lit(text), "array<struct<keyword:string,rules:array<struct<label:string,regex:string,rank:int,weight:double>>>>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each item of an int array what all items before it join to (``zero`` for the first).

    Worked out block by block, so that no array grows item by item over the whole length.
    """

    def scanned(items: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(items, state, step, lambda s: s["out"])

    def by_block(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), join))
        return F.flatten(F.zip_with(blocks, scanned(totals, F.lit(zero)), scanned))

    places = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    return _let(F.transform(places, lambda at: F.slice(values, at, BLOCK)), by_block)


_SPANS = "array<struct<start:int,minus_end:int,rank:int,label:string,weight:double>>"


def _spans(text: Column, rule: Column) -> Column:
    """start, minus_end, rank, label, weight of every match of one rule, in code points."""

    def placed(found: Column) -> Column:
        parts = F.transform(F.split(text, rule["regex"]), lambda p: F.length(p))
        steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), (p + F.length(m)).alias("pm")))
        return _let(steps, numbered)

    def numbered(steps: Column) -> Column:
        def span(s: Column, before: Column) -> Column:
            return F.struct((before + s["p"]).alias("start"), (-(before + s["pm"])).alias("minus_end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight"))

        return F.zip_with(steps, _before(F.transform(steps, lambda s: s["pm"]), lambda a, b: a + b, 0), span)

    found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    return _let(found, lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(F.array().cast(_SPANS)))


def detections(text: Column, known: list[Rule] | None = None) -> Column:
    """The unsuppressed detections in a lower-case text: array of (start, minus_end, rank, label, weight) by place.

    Sorted by start, longer first, then rank, a detection lies inside another one if an earlier one ends no sooner.
    """
    tried = F.flatten(F.transform(F.filter(_table(rules() if known is None else known), lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    all_ = F.array_sort(F.flatten(F.transform(tried, lambda r: _spans(text, r))))

    def kept(spans: Column) -> Column:
        furthest = _before(F.transform(spans, lambda x: -x["minus_end"]), lambda a, b: F.greatest(a, b), -1)
        pairs = F.zip_with(spans, furthest, lambda x, before: F.when(-x["minus_end"] > before, x))
        return F.array_compact(pairs)

    return _let(all_, kept)


def may_match(low: Column) -> Column:
    """False for lower-case texts that hold no rule's keyword, which most texts are; the base phrases are covered by the same keywords.

    The costlier regexes are tried only where a digit, or a "cc", occurs at all.
    """
    words, named, cc = gate()
    strong = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return strong | (F.contains(low, F.lit("cc")) & F.rlike(low, F.lit(cc))) | (F.rlike(low, F.lit("[0-9]")) & F.rlike(low, F.lit(named)))


def scan(docs: DataFrame) -> DataFrame:
    """License notices of every row of ``docs`` (doc_id, text).

    ``n_words``; ``n_base``: places of the base phrases; ``first_word``, ``last_word``: the smallest and largest word number at
    which one starts (NULL if none); ``base_labels`` and ``labels`` (base and rules): different, sorted, joined by commas, empty
    if none; ``score``: the highest weight among them, 0 to 1. NULL texts count as empty; NULL ids and repeated rows stay; an
    empty table gives an empty table; other columns are not read.
    """
    known = rules()
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("n_words", count_words(F.col("text")))
    texts = texts.withColumn("low", F.translate("text", _UPPER, _LOWER)).withColumn("gated", F.when(may_match(F.col("low")), F.col("low")))
    counts, firsts, lasts, labels = [], [], [], []
    for number, (words, label) in enumerate(BASE.items()):
        parts = f"_parts{number}"
        texts = texts.withColumn(parts, F.split("gated", _phrase(words)))
        n = F.coalesce(F.size(parts) - 1, F.lit(0))
        n = F.greatest(n, F.lit(0))
        counts.append(n)
        firsts.append(F.when(n > 0, count_words(F.get(parts, F.lit(0)))))
        lasts.append(F.when(n > 0, F.col("n_words") - count_words(F.get(parts, n)) - len(words.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    texts = texts.withColumn("found", F.when(F.col("gated").isNotNull(), detections(F.col("gated"), known)))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    method = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    weight = F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0))
    n_base = reduce(lambda a, b: a + b, counts).cast("long")
    return texts.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",").alias("labels"),
        F.greatest(weight, F.when(n_base > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))).alias("score"),
    )
