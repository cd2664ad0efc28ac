"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions only.

A text's lines are its paragraphs, eight paragraphs in a row a section. Under a paragraph stand its leaves: runs of eight words
(a word over 64 characters counts as several), so that an edit is also located inside a long paragraph. Every node is the
SHA-256 of its children's digests. The fingerprint string is

    root ':' sections joined by '|', each its digest '=' paragraphs joined by '/', each its leaf digests one after another

with the root in full (64 hex digits, equal for equal texts only) and 8 hex digits of the other digests. Two fingerprints are
compared from the root down: only branches that the other side lacks are opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenground.llm.common import text_or_empty
from evenground.runtime import materialize

SECTION_PARAGRAPHS = 8
LEAF = r"(?:\S{1,64}\s*){1,8}|\s+"
#: Rows, and bytes of text, in a range, about.
RANGE_ROWS, RANGE_BYTES = 20_000, 64 << 20
#: Rows (of numbers) up to which a table is broadcast; beyond, it meets the documents in a shuffle join.
BROADCAST_ROWS = 1_000_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def _joined(parts: Column, by: str = "") -> Column:
    return F.array_join(parts, by)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column that is never NULL."""
    leaves = F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256)))

    def tree(grown: Column) -> Column:
        return _let(F.transform(grown, lambda p: F.sha2(_joined(p), 256)), lambda paragraphs: _let(sections(paragraphs), lambda s: render(grown, s)))

    def sections(paragraphs: Column) -> Column:
        return F.transform(_numbers(paragraphs), lambda i: F.sha2(_joined(F.slice(paragraphs, i * SECTION_PARAGRAPHS + 1, SECTION_PARAGRAPHS)), 256))

    def render(grown: Column, parts: Column) -> Column:
        shown = F.transform(grown, lambda p: _joined(F.transform(p, lambda x: F.substring(x, 1, 8))))

        def bodies(paragraphs: Column) -> Column:
            of = lambda i: _joined(F.slice(paragraphs, i * SECTION_PARAGRAPHS + 1, SECTION_PARAGRAPHS), "/")
            return _joined(F.transform(parts, lambda x, i: F.concat(F.substring(x, 1, 8), F.lit("="), of(i))), "|")

        return F.concat_ws(":", F.sha2(_joined(parts), 256), _let(shown, bodies))

    return _let(leaves, tree)


def _numbers(paragraphs: Column) -> Column:
    return F.sequence(F.lit(0), ((F.size(paragraphs) - 1) / SECTION_PARAGRAPHS).cast("int"))


def _sections(print_: Column) -> Column:
    return F.split(F.substring(print_, 66, 1 << 30), r"\|")


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, 10, 1 << 30), "/")))


def _digests(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(".{8}"), F.lit(0))))


def _both(a: Column, b: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use`` of what both arrays hold, what only the first does, and what only the second does; each different item once."""
    parts = F.struct(F.array_intersect(a, b).alias("both"), F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b"))
    return _let(parts, lambda x: use(x["both"], x["a"], x["b"]))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: 1 if the roots are equal, else the leaves that both trees have over all leaves.

    Leaves under a section that both trees have are shared; of the other sections the paragraphs are compared, of the paragraphs
    that only one has the leaves. Equal branches count once, wherever they stand.
    """
    leaves = lambda paragraphs: F.size(_digests(paragraphs))

    def by_leaf(shared: Column, one: Column, two: Column) -> Column:
        return _both(_digests(one), _digests(two), lambda x, y, z: (shared + F.size(x)) / F.greatest(shared + F.size(x) + F.size(y) + F.size(z), F.lit(1)))

    def by_paragraph(shared: Column, one: Column, two: Column) -> Column:
        return _both(_paragraphs(one), _paragraphs(two), lambda x, y, z: by_leaf(shared + leaves(x), y, z))

    below = _both(_sections(a), _sections(b), lambda x, y, z: by_paragraph(leaves(_paragraphs(x)), y, z))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(below)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs that differ, sections with equal digests skipped; paragraphs pair by place."""
    sections = [_sections(x) for x in (a, b)]
    places = F.sequence(F.lit(0), F.greatest(*map(F.size, sections)) - 1)
    differ = F.filter(places, lambda i: ~F.substring(F.get(sections[0], i), 1, 8).eqNullSafe(F.substring(F.get(sections[1], i), 1, 8)))

    def inside(i: Column) -> Column:
        one, two = (F.split(F.substring(F.get(s, i), 10, 1 << 30), "/") for s in sections)
        within = F.sequence(F.lit(0), F.lit(SECTION_PARAGRAPHS - 1))
        return F.transform(F.filter(within, lambda j: ~F.get(one, j).eqNullSafe(F.get(two, j))), lambda j: i * SECTION_PARAGRAPHS + j)

    return F.flatten(F.transform(differ, inside))


def _held(small: DataFrame) -> DataFrame:
    """``small``, to be broadcast if that is proven to be little."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def with_next(docs: DataFrame, columns: list[str], size: Column | None = None, least_ranges: int | None = None) -> DataFrame:
    """``docs`` with ``next_<column>``: the values of the row with the next smaller doc_id; after the smallest, of the largest.

    The ids are cut into ranges of equal width, about RANGE_ROWS rows each; where ids lie so close that a range is heavy (by its sum of
    ``size``, bytes), it is cut again. Each range is a window of its own. The first row of every range is also dealt, as a ghost, behind
    the range before it, so no neighbour is missed and the rows move once. Which range comes before which is the same question
    about the ranges' first ids, a table RANGE_ROWS times smaller, and is answered the same way; counts and extremes alone come
    to the driver. Repeated ids follow one another; rows with a NULL id have no place in the order, and their next values are NULL.
    """
    spark = docs.sparkSession
    n, low, high = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if least_ranges is None:
        least_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, least_ranges if n > least_ranges else 1, n // RANGE_ROWS)
    wide = "decimal(38,0)"
    width = max(1, -(-(int(high) - int(low) + 1) // ranges)) if n else 1
    behind = F.lit(str(high if n else 0)).cast(wide) - F.col("doc_id").cast(wide)
    number = lambda x: F.floor(x).cast("long")
    alone = F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long"))
    placed = docs.withColumn("_range", number(behind / F.lit(str(width)).cast(wide)) if ranges > 1 else alone).withColumn("_part", F.lit(0).cast("long"))
    if size is not None and n:
        weights = placed.groupBy("_range").agg(F.sum(size + 64).alias("w")).where(F.col("w") > RANGE_BYTES)
        heavy = materialize(weights.select(F.col("_range").alias("_heavy"), F.ceil(F.col("w") / RANGE_BYTES).cast("long").alias("_cuts")))
        if not heavy.isEmpty():
            inside = behind - F.col("_range").cast(wide) * F.lit(str(width)).cast(wide)
            placed = placed.join(_held(heavy), placed["_range"] == heavy["_heavy"], "left")
            placed = placed.withColumn("_part", F.coalesce(number(inside * F.col("_cuts") / F.lit(str(width)).cast(wide)), F.lit(0)).cast("long")).drop("_heavy", "_cuts")
    tops = placed.where("doc_id is not null").groupBy("_range", "_part").agg(F.max("doc_id").alias("doc_id"))
    if n <= RANGE_ROWS and ranges == 1:
        dealt = placed.withColumn("_ghost", F.lit(False))
    else:
        tops = materialize(tops.toDF("_of_range", "_of_part", "doc_id"))
        told = with_next(tops, ["doc_id"], least_ranges=1)  # a range, and the first id of the one behind it
        ghosts = _held(materialize(told.select(F.col("next_doc_id").alias("_top"), F.struct(F.col("_of_range").alias("r"), F.col("_of_part").alias("p")).alias("_to"))))
        own = F.struct(F.col("_range").alias("r"), F.col("_part").alias("p"), F.lit(False).alias("ghost"))
        other = F.struct(F.col("_to.r").alias("r"), F.col("_to.p").alias("p"), F.lit(True).alias("ghost"))
        spread = F.struct(F.lit(-1) - F.pmod(F.xxhash64(*columns), F.lit(ranges)), F.lit(0).cast("long"), F.lit(False))
        homes = F.when(F.col("doc_id").isNull(), F.array(spread.cast("struct<r:bigint,p:bigint,ghost:boolean>"))).when(F.col("_to").isNotNull(), F.array(own, other)).otherwise(F.array(own))
        joined = placed.join(ghosts, placed["doc_id"] == ghosts["_top"], "left")
        dealt = joined.select(*docs.columns, F.explode(homes).alias("_home")).select(*docs.columns, F.col("_home.r").alias("_range"), F.col("_home.p").alias("_part"), F.col("_home.ghost").alias("_ghost"))
    window = Window.partitionBy("_range", "_part").orderBy("_ghost", F.desc("doc_id"))
    # a single range is followed by its own first row
    around = Window.partitionBy("_range", "_part").orderBy("_ghost", F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = F.lead(F.lit(True)).over(window).isNotNull()

    def following(c: str) -> Column:
        value = F.lead(c).over(window)
        if ranges == 1 and n <= RANGE_ROWS:
            value = F.when(has, value).otherwise(F.first(c).over(around))
        return F.when(F.col("doc_id").isNotNull(), value).alias(f"next_{c}")

    return dealt.select(*docs.columns, "_ghost", *[following(c) for c in columns]).where("not _ghost").drop("_ghost")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and how alike they and the next one are.

    Edited: the last floor(n_chars / 3) code points give way to the first as many (or all) of the next document's text. NULL texts
    count as empty; a row with a NULL id has an empty next text; of rows with one id each is followed by another of them, the
    last by the next id's; a single row follows itself; an empty table gives an empty table; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    told = with_next(texts.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"], F.octet_length("text"))
    empty = fingerprint(F.lit(""))
    told = told.withColumn("next_fingerprint", F.coalesce("next_fingerprint", empty)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    told = told.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return told.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
