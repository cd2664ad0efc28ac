"""Registered queries: every operator on the star-schema tables, each with the SQL that says what it should return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenground.functions.semantics import annual_rate
from evenground.operators import aggregate, correspondence, estimate, reaggregate, reshape
from evenground.operators.geometry import crs, dissolve, shapes
from evenground.plans import catalogue_geometry, catalogue_sources, meta
from evenground.plans.meta import Variable
from evenground.runtime import read_spread, read_table
from evenground.sources import census_us, elections

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | catalogue_sources.QUERIES | catalogue_geometry.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | catalogue_sources.SQL | catalogue_geometry.SQL


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _text(expression: str) -> Column:
    return F.expr(f"cast({expression} as string)")


# --- metadata ---


@_query(
    """SELECT n_name AS variable, CASE WHEN n_nationkey % 2 = 0 THEN 'label ' || CAST(n_nationkey AS varchar) ELSE n_name || '_CA' || CAST(n_regionkey AS varchar) END AS label, 'CA' || CAST(n_regionkey AS varchar) AS dataset,
    'Manual' AS type, 'Additive' AS aggregation, 'Additive' AS rule FROM nation"""
)
def meta_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read_table(spark, sf_dir, "nation").withColumns({"variable": F.col("n_name"), "label": F.expr("if(n_nationkey % 2 = 0, concat('label ', n_nationkey), '')")})
    return meta.additive_columns(named, F.expr("concat('CA', n_regionkey)"))


_TEXTS = "CASE r_regionkey % 5 WHEN 0 THEN 'Average of v_{k}' WHEN 1 THEN 'Median of v_{k}' WHEN 2 THEN 'Additive' WHEN 3 THEN 'Average to v_{k}' ELSE 'Not additive' END".replace(
    "v_{k}", "' || 'v_' || cast(r_regionkey as varchar) || '"
).replace(" || ''", "")


@_query(
    f"""WITH t AS (SELECT r_name, {_TEXTS} AS aggregation FROM region)
    SELECT r_name, aggregation, CASE WHEN aggregation LIKE '%Average of%' THEN 'Average' WHEN aggregation LIKE '%Median of%' THEN 'Median'
        WHEN aggregation IN ('Additive', 'Not additive') THEN aggregation WHEN aggregation LIKE '%Average to%' THEN 'AverageTo' END AS rule,
        CASE WHEN aggregation LIKE 'Average%' OR aggregation LIKE 'Median%' THEN 'v_' || cast(r_regionkey AS varchar) END AS parent
    FROM (SELECT t.*, r_regionkey FROM t JOIN region USING (r_name))"""
)
def meta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read_table(spark, sf_dir, "region").select("r_name", F.expr(_TEXTS.replace("varchar", "string")).alias("aggregation"))
    text = F.col("aggregation")
    return regions.select("r_name", "aggregation", meta.rule_column(text).alias("rule"), meta.parent_column(text).alias("parent"))


@_query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 2000 + n_nationkey WHEN 1 THEN 1990 + n_nationkey WHEN 2 THEN 2000 + n_nationkey END AS year FROM nation"""
)
def meta_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(
        """CASE n_nationkey % 4 WHEN 0 THEN concat('CA', lpad(cast(n_nationkey as string), 2, '0')) WHEN 1 THEN concat('CA', 1990 + n_nationkey, 'x')
        WHEN 2 THEN concat('TX', cast(n_nationkey as string), 'F') ELSE 'none' END"""
    )
    return read_table(spark, sf_dir, "nation").select("n_nationkey", meta.years_column(name).alias("year"))


# --- aggregation ---

_HOLES = "SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(o_orderkey % 14 AS bigint) AS slot FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").withColumn("price", F.expr("if(o_orderkey % 7 = 0, null, o_totalprice)")).withColumn("slot", F.col("o_orderkey") % 14)


def _additive(*names: str) -> list[Variable]:
    return meta.meta_for_additive_variables("x", {n: n for n in names})


@_query(f"SELECT o_orderpriority, ROUND(SUM(price), 2) AS price FROM ({_HOLES}) GROUP BY 1")
def agg_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregate.aggregate_with_meta(_orders(spark, sf_dir), _additive("price", "absent"), ["o_orderpriority"]), price=2)


@_query(f"SELECT slot, CASE WHEN COUNT(price) = COUNT(*) THEN ROUND(SUM(price), 2) END AS price FROM ({_HOLES}) GROUP BY 1")
def agg_na_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregate.aggregate_with_meta(_orders(spark, sf_dir), _additive("price"), ["slot"], na_rm=False), price=2)


@_query(f"SELECT slot, ROUND(COALESCE(SUM(price), 0), 2) AS price FROM ({_HOLES}) GROUP BY 1")
def agg_na_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregate.aggregate_with_meta(_orders(spark, sf_dir), _additive("price"), ["slot"]), price=2)


def _weighted(spark: SparkSession, sf_dir: str, rule: str, by: list[str], x: Column, units: str | None = None) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(*by, x.alias("x"), F.col("l_quantity").alias("q"))
    rows = [*_additive("q"), Variable("x", "x", "x", rule=rule, parent="q", units=units)]
    return aggregate.aggregate_with_meta(lines, rows, by, quiet=True)


@_query("SELECT l_suppkey, ROUND(SUM(l_discount * l_quantity) / SUM(l_quantity), 8) AS x, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def agg_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weighted(spark, sf_dir, meta.AVERAGE, ["l_suppkey"], F.col("l_discount")), x=8, q=2)


@_query("SELECT l_linenumber, ROUND(SUM(l_tax * l_quantity) / SUM(l_quantity), 8) AS x, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weighted(spark, sf_dir, meta.MEDIAN, ["l_linenumber"], F.col("l_tax")), x=8, q=2)


def _average_to(x: str, base: str) -> str:
    return f"SELECT l_suppkey, ROUND(SUM({x} * {base}) / SUM({base}), 8) AS x, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM({base}), 4) AS base_q FROM lineitem GROUP BY 1"


@_query(_average_to("l_discount", "(l_quantity / (l_discount + 1))"))
def agg_average_to_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weighted(spark, sf_dir, meta.AVERAGE_TO, ["l_suppkey"], F.col("l_discount"), meta.RATIO_UNITS), x=8, q=2, base_q=4)


@_query(_average_to("(l_discount * 100)", "(l_quantity / (l_discount * 100 / 100 + 1))"))
def agg_average_to_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weighted(spark, sf_dir, meta.AVERAGE_TO, ["l_suppkey"], F.col("l_discount") * 100, meta.PERCENT_UNITS), x=8, q=2, base_q=4)


@_query(_average_to("(l_tax + 0.5)", "(l_quantity / (l_tax + 0.5))"))
def agg_average_to_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weighted(spark, sf_dir, meta.AVERAGE_TO, ["l_suppkey"], F.col("l_tax") + 0.5, "Number"), x=8, q=2, base_q=4)


@_query("SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def agg_not_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [Variable("o_totalprice", "o_totalprice", "x", rule=meta.NOT_ADDITIVE)]
    return _rounded(aggregate.aggregate_with_meta(read_table(spark, sf_dir, "orders"), rows, ["o_orderstatus"], quiet=True), o_totalprice=2)


@_query("SELECT ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM orders")
def agg_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregate.aggregate_with_meta(read_table(spark, sf_dir, "orders"), _additive("o_totalprice"), []), o_totalprice=2)


@_query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def agg_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_with_meta(read_table(spark, sf_dir, "orders"), [], ["o_orderpriority", "o_orderstatus"])


# --- correspondences ---


def _ids(spark: SparkSession, sf_dir: str, **ids: str) -> DataFrame:
    return read_spread(spark, sf_dir, "part").select(*[_text(e).alias(n) for n, e in ids.items()])


def _sql_ids(**ids: str) -> str:
    return "SELECT " + ", ".join(f"CAST({e.replace(' div ', ' // ')} AS varchar) AS {n}" for n, e in ids.items()) + " FROM part"


def _closure(ids: str, columns: str, seed: str | None = None, literal: bool = False) -> str:
    """Components by recursion over rows that share an id, as common table expressions ending in u (seed, common_id)."""
    names = columns.split()
    seed = seed or names[0]
    same = "IS NOT DISTINCT FROM" if literal else "="
    links = " UNION ".join(f"SELECT DISTINCT seed, '{c}' AS k, {c} AS v FROM s{'' if literal else f' WHERE {c} IS NOT NULL'}" for c in names[1:] or names)
    return f"""WITH RECURSIVE t AS ({ids}), s AS (SELECT *, {seed} AS seed FROM t), e AS ({links}),
        low AS (SELECT e.seed, m.seed AS other FROM e JOIN (SELECT k, v, MIN(seed) AS seed FROM e GROUP BY k, v) m ON e.k = m.k AND e.v {same} m.v),
        both_ways AS (SELECT seed, other FROM low UNION SELECT other, seed FROM low),
        r AS (SELECT DISTINCT seed, seed AS reach FROM s UNION SELECT r.seed, b.other FROM r JOIN both_ways b ON b.seed = r.reach),
        u AS (SELECT seed, MIN(reach) AS common_id FROM r GROUP BY seed)"""


def _uid(columns: str) -> str:
    parts = ", ".join(f"'{c}:' || COALESCE(STRING_AGG(DISTINCT {c}, ',' ORDER BY {c}), '')" for c in columns.split())
    return f"SELECT common_id, CONCAT_WS(' ', {parts}) AS common_uid FROM s JOIN u USING (seed) GROUP BY common_id"


def _closed(columns: str) -> str:
    return f" SELECT {', '.join(columns.split())}, common_id, common_uid FROM s JOIN u USING (seed) JOIN ({_uid(columns)}) USING (common_id)"


_TWO = {"a": "p_partkey div 3", "b": "p_partkey div 2"}
_THREE = {**_TWO, "c": "p_partkey div 9"}


@_query(_closure(_sql_ids(**_TWO), "a b") + _closed("a b"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence.close_correspondence(_ids(spark, sf_dir, **_TWO))


@_query(_closure(_sql_ids(**_THREE), "a b c") + _closed("a b c"))
def components_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence.close_correspondence(_ids(spark, sf_dir, **_THREE))


_GAPS = {"a": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey div 3 END", "b": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey div 2 END"}


@_query(_closure(_sql_ids(**_GAPS), "a b", "COALESCE(a, '2_' || b, '0_')") + _closed("a b").replace("common_id, common_uid FROM", "NULLIF(common_id, '0_') AS common_id, common_uid FROM"))
def components_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence.close_correspondence(_ids(spark, sf_dir, **_GAPS))


@_query(_closure(_sql_ids(**_GAPS), "a b", "COALESCE(a, '1_NA')", literal=True) + _closed("a b"))
def components_null_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondence.close_correspondence(_ids(spark, sf_dir, **_GAPS), "literal")


@_query(
    f"""SELECT DISTINCT a, b, c, CASE WHEN x.method = y.method THEN x.method ELSE x.method || ',' || y.method END AS method
    FROM (SELECT *, 'one' AS method FROM ({_sql_ids(**_TWO)})) x JOIN (SELECT *, CASE WHEN CAST(c AS int) % 2 = 0 THEN 'one' ELSE 'two' END AS method FROM ({_sql_ids(b=_THREE["b"], c=_THREE["c"])})) y USING (b)"""
)
def correspondence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _ids(spark, sf_dir, **_TWO).withColumn("method", F.lit("one"))
    two = _ids(spark, sf_dir, b=_THREE["b"], c=_THREE["c"]).withColumn("method", F.expr("if(cast(c as int) % 2 = 0, 'one', 'two')"))
    return correspondence.combine_correspondences([one, two]).select("a", "b", "c", "method")


@_query(f"SELECT v AS a, v AS b, 'identifier' AS method FROM ((SELECT a AS v FROM ({_sql_ids(**_TWO)})) INTERSECT (SELECT b FROM ({_sql_ids(b='p_partkey * 3')})))")
def correspondence_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = {"one": _ids(spark, sf_dir, a=_TWO["a"]), "two": _ids(spark, sf_dir, b="p_partkey * 3")}
    return correspondence.identifier_correspondence(data, {"one": "a", "two": "b"})


# --- harmonized datasets ---


def _two_datasets(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    part = read_spread(spark, sf_dir, "part")
    one = part.select(_text(_TWO["a"]).alias("a"), "p_size", "p_retailprice")
    two = part.select(_text(_TWO["b"]).alias("b"), "p_size", "p_retailprice")
    return {"one": one, "two": two}, correspondence.close_correspondence(_ids(spark, sf_dir, **_TWO).distinct())


def _sides(first: str, second: str) -> str:
    one = f"SELECT common_id, {first} FROM (SELECT *, CAST(p_partkey // 3 AS varchar) AS a FROM part) JOIN (SELECT DISTINCT a, common_id FROM s JOIN u USING (seed)) USING (a) GROUP BY 1"
    two = f"SELECT common_id, {second} FROM (SELECT *, CAST(p_partkey // 2 AS varchar) AS b FROM part) JOIN (SELECT DISTINCT b, common_id FROM s JOIN u USING (seed)) USING (b) GROUP BY 1"
    return f" SELECT * FROM ({_uid('a b')}) JOIN ({one}) USING (common_id) JOIN ({two}) USING (common_id)"


@_query(_closure(_sql_ids(**_TWO), "a b") + _sides("CAST(SUM(p_size) AS bigint) AS size_one", "ROUND(SUM(p_retailprice), 2) AS price_two"))
def harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, common = _two_datasets(spark, sf_dir)
    rows = meta.meta_for_additive_variables("one", {"size_one": "p_size"}) + meta.meta_for_additive_variables("two", {"price_two": "p_retailprice"})
    data["one"], data["two"] = data["one"].drop("p_retailprice"), data["two"].drop("p_size")
    return _rounded(aggregate.harmonize(data, common, rows), price_two=2)


@_query(
    _closure(_sql_ids(**_TWO), "a b")
    + _sides("ROUND(SUM(p_retailprice * p_size) / SUM(p_size), 6) AS mean_one, CAST(SUM(p_size) AS bigint) AS size_one", "ROUND(SUM(p_retailprice), 2) AS price_two")
)
def harmonize_meta_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, common = _two_datasets(spark, sf_dir)
    rows = [
        Variable("p_size", "size_one", "one", geo_dataset="one"),
        Variable("p_retailprice", "mean_one", "one", rule=meta.AVERAGE, parent="p_size", geo_dataset="one"),
        Variable("price", "price_two", "two", geo_dataset="two"),
        Variable("extra", "extra", "two", type="Extra", geo_dataset="two"),
    ]
    data["two"] = data["two"].select("b", F.col("p_retailprice").alias("price"), F.col("p_size").alias("extra"))
    return _rounded(aggregate.harmonize(data, common, rows), mean_one=6, price_two=2)


# --- downsampling ---

#: Added before rounding: values that lie exactly between two roundings would go either way by their last bit.
_OFF_TIES = 0.00000123456789

_CHILD_COLUMNS = [
    "l_orderkey",
    "l_linenumber",
    "l_quantity",
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS price",
    "l_tax AS tax",
    "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END AS flag",
]
_CHILD = f"SELECT {', '.join(_CHILD_COLUMNS)} FROM lineitem"


def _parent_child(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    child = lines.selectExpr(*_CHILD_COLUMNS)
    parent = orders.select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 1000).alias("tax"), F.col("o_orderstatus").alias("flag"))
    return child, parent




def _off_ties(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *[F.round(F.col(c) + _OFF_TIES, 3).alias(c) for c in columns])


_WINDOWS = f"""SELECT c.*, o_orderkey IS NOT NULL AS has, o_totalprice AS p_price, o_totalprice / 1000 AS p_tax, o_orderstatus AS p_flag,
    COALESCE(l_quantity / NULLIF(SUM(l_quantity) OVER w, 0), 0) AS weight,
    COALESCE(CASE WHEN COUNT(price) OVER w = COUNT(*) OVER w THEN SUM(price) OVER w END, 0) AS s_price, SUM(tax) OVER w AS s_tax
    FROM ({_CHILD}) c LEFT JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey)"""


@_query(
    f"""SELECT l_orderkey, l_linenumber, ROUND(COALESCE(price, 0) + weight * (p_price - s_price) + {_OFF_TIES}, 3) AS price, ROUND(tax + weight * (p_tax - s_tax) + {_OFF_TIES}, 3) AS tax FROM ({_WINDOWS})
    WHERE has UNION ALL SELECT l_orderkey, l_linenumber, ROUND(price + {_OFF_TIES}, 3), ROUND(tax + {_OFF_TIES}, 3) FROM ({_WINDOWS}) WHERE NOT has"""
)
def reagg_intended(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _parent_child(spark, sf_dir)
    done = reaggregate.downsample(child, parent, {"l_orderkey": "o_orderkey"}, ["price", "tax"], "l_quantity")
    return _off_ties(done, "price", "tax")


_LITERAL_S = "COALESCE(CASE WHEN full_price THEN s_price + s_tax END, 0)"


@_query(
    f"""SELECT l_orderkey, l_linenumber, ROUND(COALESCE(price, 0) + weight * (COALESCE(p_price, 0) - {_LITERAL_S}) + {_OFF_TIES}, 3) AS price,
    ROUND(tax + weight * (COALESCE(p_tax, 0) - {_LITERAL_S}) + {_OFF_TIES}, 3) AS tax
    FROM (SELECT *, COUNT(price) OVER (PARTITION BY l_orderkey) = COUNT(*) OVER (PARTITION BY l_orderkey) AS full_price FROM ({_WINDOWS}))"""
)
def reagg_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _parent_child(spark, sf_dir)
    done = reaggregate.downsample(child, parent, {"l_orderkey": "o_orderkey"}, ["price", "tax"], "l_quantity", "literal")
    return _off_ties(done, "price", "tax")


@_query(f"SELECT l_orderkey, l_linenumber, COALESCE(flag, p_flag) AS flag FROM ({_WINDOWS})")
def reagg_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _parent_child(spark, sf_dir)
    return reaggregate.downsample(child, parent, {"l_orderkey": "o_orderkey"}, ["flag"], "l_quantity").select("l_orderkey", "l_linenumber", "flag")


@_query(f"SELECT l_orderkey, l_linenumber, COALESCE(price, p_price) AS price FROM ({_WINDOWS})")
def reagg_na_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _parent_child(spark, sf_dir)
    return reaggregate.downsample(child, parent, {"l_orderkey": "o_orderkey"}, ["price"], {"price": None}).select("l_orderkey", "l_linenumber", "price")


@_query(f"SELECT l_orderkey, l_linenumber, CASE WHEN has THEN ROUND(weight * p_price + {_OFF_TIES}, 3) END AS total FROM ({_WINDOWS})")
def reagg_missing_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, parent = _parent_child(spark, sf_dir)
    done = reaggregate.downsample(child, parent.withColumnRenamed("price", "total"), {"l_orderkey": "o_orderkey"}, ["total"], "l_quantity")
    return _off_ties(done, "total")


# --- geometry ---


def _boxes(df: DataFrame, key: str, shift: float = 0.0, *more: str) -> DataFrame:
    """Unit squares at (key % 20, key div 20), moved by ``shift``."""
    x, y = F.expr(f"cast({key} % 20 as double)") + shift, F.expr(f"cast({key} div 20 as double)") + shift
    return df.select(key, *more, shapes.rectangle(x, y, x + 1, y + 1).alias("geometry"))


_PAIRS = """SELECT s_suppkey, p_partkey, p_size, p_retailprice,
    GREATEST(0, LEAST(sx + 1, px + 1) - GREATEST(sx, px)) * GREATEST(0, LEAST(sy + 1, py + 1) - GREATEST(sy, py)) AS shared
    FROM (SELECT *, s_suppkey % 20 + CAST({d} AS double) AS sx, s_suppkey // 20 + CAST({d} AS double) AS sy FROM supplier)
    JOIN (SELECT *, p_partkey % 20 AS px, p_partkey // 20 AS py FROM part) ON sx <= px + 1 AND px <= sx + 1 AND sy <= py + 1 AND py <= sy + 1"""


def _sites(spark: SparkSession, sf_dir: str, shift: float) -> DataFrame:
    return _boxes(read_spread(spark, sf_dir, "supplier"), "s_suppkey", shift)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(read_spread(spark, sf_dir, "part"), "p_partkey", 0.0, "p_size", "p_retailprice")


@_query(f"SELECT s_suppkey, ROUND(SUM(shared * p_size), 6) AS p_size FROM supplier LEFT JOIN ({_PAIRS.format(d=0.25)}) USING (s_suppkey) GROUP BY 1")
def estimate_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = estimate.estimate(_sites(spark, sf_dir, 0.25), _parts(spark, sf_dir).drop("p_retailprice"), _additive("p_size"), "s_suppkey", "p_partkey")
    return _rounded(done.drop("geometry"), p_size=6)


@_query(
    f"SELECT s_suppkey, ROUND(SUM(shared * p_size), 6) AS p_size, ROUND(SUM(shared * p_size * p_retailprice) / SUM(shared * p_size), 4) AS p_retailprice FROM supplier LEFT JOIN ({_PAIRS.format(d=0.25)}) USING (s_suppkey) GROUP BY 1"
)
def estimate_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [*_additive("p_size"), Variable("p_retailprice", "p_retailprice", rule=meta.AVERAGE, parent="p_size")]
    done = estimate.estimate(_sites(spark, sf_dir, 0.25), _parts(spark, sf_dir), rows, "s_suppkey", "p_partkey")
    return _rounded(done.drop("geometry"), p_size=6, p_retailprice=4)


@_query(
    f"""SELECT p_partkey, s_suppkey, overlap_fraction FROM (SELECT p_partkey, s_suppkey, ROUND(shared, 6) AS overlap_fraction,
    ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY ROUND(shared, 9) DESC, s_suppkey) AS n FROM ({_PAIRS.format(d=0.3)})) WHERE n = 1"""
)
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = estimate.tag_largest_overlap(_parts(spark, sf_dir).select("p_partkey", "geometry"), _sites(spark, sf_dir, 0.3), "p_partkey", "s_suppkey")
    return _rounded(done.select("p_partkey", "s_suppkey", "overlap_fraction"), overlap_fraction=6)


@_query("SELECT CAST(SUM(p_size) AS double) AS p_size, CAST(COUNT(*) AS double) AS area FROM part")
def estimate_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two triangles of every square share out what the square has: nothing is lost."""
    parts = _parts(spark, sf_dir)
    x, y = F.expr("cast(p_partkey % 20 as double)"), F.expr("cast(p_partkey div 20 as double)")
    halves = F.array(shapes.polygon([(x, y), (x, y + 1), (x + 1, y)]), shapes.polygon([(x + 1, y + 1), (x + 1, y), (x, y + 1)]))
    target = parts.select("p_partkey", F.posexplode(halves).alias("half", "geometry")).withColumn("t", F.col("p_partkey") * 2 + F.col("half"))
    done = estimate.estimate(target.select("t", "geometry"), parts.select("p_partkey", "p_size", "geometry"), _additive("p_size"), "t", "p_partkey")
    return done.agg(F.round(F.sum("p_size"), 4).alias("p_size"), F.round(F.sum(shapes.area(F.col("geometry"))), 6).alias("area"))


@_query(
    """SELECT 'g' || CAST(s_suppkey // 3 AS varchar) AS common_id, CAST(COUNT(*) AS double) AS area_one, CAST(COUNT(*) AS double) * 4 AS area_two, 'unknown' AS method, ROUND(LN(4), 9) AS max_log_ratio FROM supplier GROUP BY 1"""
)
def area_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _sites(spark, sf_dir, 0.0)
    x, y = F.expr("cast(s_suppkey % 20 as double)"), F.expr("cast(s_suppkey div 20 as double)")
    two = read_spread(spark, sf_dir, "supplier").select("s_suppkey", shapes.rectangle(x, y, x + 2, y + 2).alias("geometry"))
    units = one.select("s_suppkey", F.expr("concat('g', s_suppkey div 3)").alias("common_id"))
    return _rounded(estimate.check_areas({"one": one, "two": two}, units), max_log_ratio=9)


_GRIDS = """WITH a AS (SELECT CAST(s_suppkey AS varchar) AS a, (s_suppkey % 10) * 10.0 AS x0, (s_suppkey % 10) * 10.0 + 10 AS x1, (s_suppkey // 10) * 10.0 AS y0, (s_suppkey // 10) * 10.0 + 10 AS y1 FROM supplier),
    b AS (SELECT DISTINCT CAST(s_suppkey // 2 AS varchar) AS b, (s_suppkey % 10 // 2) * 20.0 + 0.2 AS x0, (s_suppkey % 10 // 2) * 20.0 + 20.2 AS x1, (s_suppkey // 10) * 10.0 + 0.2 AS y0, (s_suppkey // 10) * 10.0 + 10.2 AS y1 FROM supplier),
    t AS (SELECT a, b FROM a JOIN b ON (a.x0 + 1 <= b.x1 AND b.x0 <= a.x1 - 1 AND a.y0 + 1 <= b.y1 AND b.y0 <= a.y1 - 1) OR (a.x0 <= b.x1 - 1 AND b.x0 + 1 <= a.x1 AND a.y0 <= b.y1 - 1 AND b.y0 + 1 <= a.y1))"""


@_query(_GRIDS + " SELECT a, b, 'estimate' AS method, MIN(a) OVER (PARTITION BY b) AS common_id FROM t")
def geo_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_spread(spark, sf_dir, "supplier")
    x, y = F.expr("(s_suppkey % 10) * 10.0D"), F.expr("(s_suppkey div 10) * 10.0D")
    a = s.select(_text("s_suppkey").alias("a"), shapes.rectangle(x, y, x + 10, y + 10).alias("geometry"))
    bx, by = F.expr("(s_suppkey % 10 div 2) * 20.0D + 0.2D"), y + 0.2
    b = s.select(_text("s_suppkey div 2").alias("b"), shapes.rectangle(bx, by, bx + 20, by + 10).alias("geometry")).dropDuplicates(["b"])
    done = estimate.estimate_correspondence({"one": a, "two": b}, {"one": "a", "two": "b"}, tolerance=1.0)
    return done.select("a", "b", "method", "common_id")


@_query("SELECT p_partkey // 8 AS g, CAST(COUNT(*) AS double) AS area, 1 AS outlines FROM part WHERE p_partkey % 20 BETWEEN 0 AND 19 GROUP BY 1")
def dissolve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.expr("cast(p_partkey % 8 as double)"), F.expr("cast(p_partkey div 8 as double)")
    boxes = read_spread(spark, sf_dir, "part").select(F.expr("p_partkey div 8").alias("g"), shapes.rectangle(x, y, x + 1, y + 1).alias("geometry"))
    done = dissolve.dissolve(boxes, ["g"])
    return done.select("g", shapes.area(F.col("geometry")).alias("area"), F.size("geometry.polygons").alias("outlines"))


_LCC = """WITH c AS (SELECT c_custkey, RADIANS(-130.0 + c_custkey % 60) AS lon, RADIANS(42.0 + c_custkey % 30) AS lat, SQRT(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101)) AS e FROM customer),
    k AS (SELECT *, TAN(PI() / 4 - lat / 2) / POW((1 - e * SIN(lat)) / (1 + e * SIN(lat)), e / 2) AS t, TAN(PI() / 4 - RADIANS(49) / 2) / POW((1 - e * SIN(RADIANS(49))) / (1 + e * SIN(RADIANS(49))), e / 2) AS t1,
        TAN(PI() / 4 - RADIANS(77) / 2) / POW((1 - e * SIN(RADIANS(77))) / (1 + e * SIN(RADIANS(77))), e / 2) AS t2, TAN(PI() / 4 - RADIANS(63.390675) / 2) / POW((1 - e * SIN(RADIANS(63.390675))) / (1 + e * SIN(RADIANS(63.390675))), e / 2) AS t0,
        COS(RADIANS(49)) / SQRT(1 - e * e * SIN(RADIANS(49)) * SIN(RADIANS(49))) AS m1, COS(RADIANS(77)) / SQRT(1 - e * e * SIN(RADIANS(77)) * SIN(RADIANS(77))) AS m2 FROM c),
    n AS (SELECT *, (LN(m1) - LN(m2)) / (LN(t1) - LN(t2)) AS n FROM k), f AS (SELECT *, 6378137.0 * m1 / (n * POW(t1, n)) AS af FROM n)
    SELECT c_custkey, ROUND(6200000 + af * POW(t, n) * SIN(n * (lon - RADIANS(-91.86666666666666))), 2) AS x, ROUND(3000000 + af * POW(t0, n) - af * POW(t, n) * COS(n * (lon - RADIANS(-91.86666666666666))), 2) AS y FROM f"""


@_query(_LCC)
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.point(F.expr("-130.0D + c_custkey % 60"), F.expr("42.0D + c_custkey % 30"))
    moved = read_spread(spark, sf_dir, "customer").select("c_custkey", crs.project_point(p, 3347).alias("p"))
    return moved.select("c_custkey", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@_query("SELECT n_nationkey, ROUND(32 * SIN(PI() / 32) * (1 + n_nationkey) * (1 + n_nationkey), 6) AS area, CAST(2 * (1 + n_nationkey) AS double) AS width FROM nation")
def circle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = read_table(spark, sf_dir, "nation").select("n_nationkey", shapes.circle(F.lit(5.0), F.lit(7.0), F.expr("1.0D + n_nationkey")).alias("g"))
    box = shapes.bbox(F.col("g"))
    return circles.select("n_nationkey", F.round(shapes.area(F.col("g")), 6).alias("area"), F.round(box["x1"] - box["x0"], 6).alias("width"))


# --- relationship files, older translation ---


@_query(
    """WITH t AS (SELECT CAST(s_suppkey AS varchar) AS s, CAST(n_nationkey AS varchar) AS n, CAST(n_regionkey AS varchar) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s, n, r, MIN(s) OVER (PARTITION BY r) AS common_id FROM t"""
)
def relationship_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read_spread(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("s"), _text("s_nationkey").alias("n"))
    two = read_table(spark, sf_dir, "nation").select(_text("n_nationkey").alias("n"), _text("n_regionkey").alias("r"))
    return correspondence.chain_correspondences([one, two]).select("s", "n", "r", "common_id")


@_query(
    """SELECT DISTINCT a.o AS GEOID00, b.n AS GEOID20 FROM (SELECT CAST(s_suppkey AS varchar) AS o, CASE WHEN s_nationkey < 15 THEN '' ELSE 'old ' END || CAST(s_nationkey AS varchar) AS m FROM supplier) a
    FULL JOIN (SELECT CASE WHEN c_nationkey > 5 THEN '' ELSE 'new ' END || CAST(c_nationkey AS varchar) AS m, CAST(c_custkey AS varchar) AS n FROM customer) b ON a.m = b.m"""
)
def relationship_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of some numbers have a key of their own on either side: their rows match nothing."""
    old = read_spread(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("GEOID00"), F.expr("concat(if(s_nationkey < 15, '', 'old '), s_nationkey)").alias("GEOID10"))
    new = read_spread(spark, sf_dir, "customer").select(F.expr("concat(if(c_nationkey > 5, '', 'new '), c_nationkey)").alias("GEOID10"), _text("c_custkey").alias("GEOID20"))
    return census_us.link_tracts(["dec2000", "dec2020"], old, new)


@_query(
    """SELECT 'A' || CAST(s_suppkey // 2 AS varchar) AS id, ROUND(SUM(s_acctbal), 2) AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 10 <> 8 GROUP BY 1
    UNION ALL SELECT 'C' || CAST(s_suppkey AS varchar), ROUND(s_acctbal, 2) FROM supplier WHERE s_suppkey % 10 = 9 OR s_suppkey % 10 = 8"""
)
def ct_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_spread(spark, sf_dir, "supplier")
    x, y = F.expr("cast(s_suppkey % 10 as double)"), F.expr("cast(s_suppkey div 10 as double)")
    kept = "s_suppkey % 10 >= 8"
    two = s.select(F.expr(f"if({kept}, concat('C', s_suppkey), concat('B', s_suppkey))").alias("id"), "s_acctbal", shapes.rectangle(x, y, x + 1, y + 1).alias("geometry"))
    same = s.where(kept).select(F.expr("concat('C', s_suppkey)").alias("id"), shapes.rectangle(x, y, x + 1, y + 1).alias("geometry"))
    wide = s.where(f"not ({kept}) and s_suppkey % 2 = 0").select(F.expr("concat('A', s_suppkey div 2)").alias("id"), shapes.rectangle(x, y, x + 2, y + 1).alias("geometry"))
    return _rounded(estimate.translate_units(wide.union(same), two, "id", ["s_acctbal"]), s_acctbal=2)


# --- votes, reshaping, rates ---


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("district"), F.col("o_orderstatus").alias("party")).agg(F.count("*").alias("votes"))


_VOTES = "SELECT o_custkey % 50 AS district, o_orderstatus AS party, COUNT(*) AS votes FROM orders GROUP BY 1, 2"


@_query(f"SELECT district, party, votes FROM (SELECT *, RANK() OVER (PARTITION BY district ORDER BY votes DESC) AS r FROM ({_VOTES})) WHERE r = 1")
def top_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.top(_votes(spark, sf_dir), ["district"], "votes")


@_query(f"SELECT *, ROUND(votes / SUM(votes) OVER (PARTITION BY district), 9) AS share FROM ({_VOTES})")
def vote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reshape.share(_votes(spark, sf_dir), ["district"], "votes").select("district", "party", "votes", "share"), share=9)


@_query(
    f"SELECT district, party, COALESCE(votes, 0) AS votes FROM (SELECT DISTINCT district FROM ({_VOTES})) CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) p(party) LEFT JOIN ({_VOTES}) USING (district, party)"
)
def complete_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.complete(_votes(spark, sf_dir), ["district"], "party", ["F", "O", "P", "X"], {"votes": 0}).select("district", "party", "votes")


@_query(f"SELECT district, MAX(votes) FILTER (party = 'F') AS F, MAX(votes) FILTER (party = 'O') AS O, MAX(votes) FILTER (party = 'P') AS P FROM ({_VOTES}) GROUP BY 1")
def pivot_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.wider(_votes(spark, sf_dir), ["district"], "party", "votes", ["F", "O", "P"])


@_query(
    f"""SELECT district, party, votes FROM (SELECT district, UNNEST(['F', 'O', 'P']) AS party, UNNEST([F, O, P]) AS votes FROM
    (SELECT district, MAX(votes) FILTER (party = 'F') AS F, MAX(votes) FILTER (party = 'O') AS O, MAX(votes) FILTER (party = 'P') AS P FROM ({_VOTES}) GROUP BY 1))"""
)
def unpivot_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reshape.wider(_votes(spark, sf_dir), ["district"], "party", "votes", ["F", "O", "P"])
    return reshape.longer(wide, ["district"], ["F", "O", "P"], "party", "votes")


@_query(
    """WITH y AS (SELECT o_custkey % 200 AS g, SUM(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS old, SUM(CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END) AS new FROM orders GROUP BY 1),
    c AS (SELECT g, (new - old) / CAST(old AS double) AS change FROM y WHERE old > 0), r AS (SELECT g, SIGN(change) * (EXP(LN(1 + ABS(change)) / 5) - 1) AS rate FROM c)
    SELECT g, ROUND(rate, 9) AS rate, CASE WHEN rate > -1 AND rate <= -0.02 THEN 'falling' WHEN rate > -0.02 AND rate <= 0.02 THEN 'stable' WHEN rate > 0.02 AND rate <= 10 THEN 'rising' END AS bin FROM r"""
)
def growth_rate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("o_orderkey") % 2
    counts = read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("g")).agg(F.sum(1 - odd).alias("old"), F.sum(odd).alias("new")).where("old > 0")
    rate = annual_rate((F.col("new") - F.col("old")) / F.col("old"), 5)
    return counts.select("g", F.round(rate, 9).alias("rate"), reshape.cut(rate, [-1, -0.02, 0.02, 10], ["falling", "stable", "rising"]).alias("bin"))


_RAW = {
    "FED_NUM": "cast(o_custkey % 100 as {s})",
    "Merge": "case when o_orderkey % 9 = 0 then cast(o_orderkey % 40 as {s}) end",
    "no_poll": "cast(null as {s})",
    "void_poll": "cast(null as {s})",
    "PD_NUM": "case when o_orderkey % 21 = 0 then null else concat(cast(o_orderkey % 40 as {s}), case when o_orderkey % 4 = 0 then 'A' else '' end) end",
    "Party": "o_orderstatus",
    "Incumbent": "cast(null as {s})",
    "Elected": "cast(null as {s})",
    "Votes": "case when o_orderkey % 13 = 0 then 'n/a' else cast(o_orderkey % 300 as {s}) end",
}


@_query(
    "WITH raw AS (SELECT "
    + ", ".join(f"{e.format(s='varchar')} AS {n}" for n, e in _RAW.items())
    + """ FROM orders) SELECT FED_NUM, Party, PD_NUM AS PDNUM, REGEXP_REPLACE(PD_NUM, '[^0-9.]$', '') AS PD_NUM, TRY_CAST(Votes AS int) AS Votes,
    FED_NUM || '_' || COALESCE("Merge", REGEXP_REPLACE(PD_NUM, '[^0-9.]$', '')) AS PD_2019 FROM raw WHERE PD_NUM IS NOT NULL"""
)
def clean_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "orders").select(*[F.expr(_RAW[short].format(s="string")).alias(long) for long, short in elections.COLUMNS.items()])
    return elections.clean_votes(raw, 2019).select("FED_NUM", "Party", "PDNUM", "PD_NUM", "Votes", "PD_2019")
