"""Contingency, propensities, frequencies, runs and overlays over the given tables; queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import scores
from braidwork.operators import runs, tables

#: Sizes of parts that the range query keeps, written as fragments of a domain.
SIZE_FRAGMENTS = "1-10,20-30,45-50"
_ORDER = ["ts", "event_id"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _discount_bin():
    return F.floor(F.round(F.col("l_discount") * 100, 2) / 2).cast("int")


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.contingency(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", _discount_bin())


def log_odds_propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.propensities(contingency(spark, sf_dir), least=4)
    return p.select("bin", "a", "b", "n", F.round("propensity", 6).alias("propensity"))


def _label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return tables.frequencies(both, ["lang"], F.col("toxic") == 1)


def binom_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_frequency(spark, sf_dir).select("lang", "n", "hits", *[F.round(c, 8).alias(c) for c in ("p", "relative2", "se")])


def ratio_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratios(_label_frequency(spark, sf_dir), "lang", "en")
    return r.select("lang", F.round("ratio", 8).alias("ratio"), F.round("se", 8).alias("se"))


def si_binned_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.when(F.col("l_quantity") <= 25, "few").otherwise("many")
    return tables.conserved_cube(_t(spark, sf_dir, "lineitem"), "l_returnflag", many, F.round(F.col("l_tax") * 10, 4), F.col("l_linestatus") == "F").fillna({"kind": "all", "class": "all", "bin": -1})


def mean_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each event type, and its error if each user counts as one independent source."""
    e = _t(spark, sf_dir, "events")
    users = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))
    # the number of users is constant within a type
    m = e.join(users, "event_type").groupBy("event_type").agg(F.avg("value").alias("mean"), scores.mean_error(F.col("value"), F.max("users")).alias("se"))
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return runs.islands(e, "user_id", _ORDER, "event_type", least=2)


def chain_change_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_runs(_t(spark, sf_dir, "events"), "user_id", _ORDER, "event_type").select("event_id", "user_id", "event_type", "run")


def element_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.element_counts(_t(spark, sf_dir, "events"), "user_id", _ORDER, "event_type", blank="view")


def altloc_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("value") > 20, F.col("event_type"))
    return runs.first_value(_t(spark, sf_dir, "events"), "user_id", _ORDER, value)


def lead_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of a user's next event less this one's."""
    return runs.step_to_next(_t(spark, sf_dir, "events"), "user_id", _ORDER, "value").select("event_id", F.round("step", 4).alias("step"))


def gap_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of views of each user."""
    return runs.gap_openings(_t(spark, sf_dir, "events"), "user_id", _ORDER, F.col("event_type") == "view")


def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their place in a user's row, with the users whose row is shorter and two of the types."""
    return runs.column_counts(_t(spark, sf_dir, "events"), "user_id", _ORDER, "event_type", ["view", "click"])


def site_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.offsets(sizes, "user_id", "n", "user_id")


def interval_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the type of the run of two or more that covers their time."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    spans = run_islands(spark, sf_dir)
    return runs.overlay(e, spans, "user_id", "ts", "event_type").select("event_id", "covering")


def range_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = scores.domain_fragments(F.lit(SIZE_FRAGMENTS))
    return _t(spark, sf_dir, "part").where(scores.in_fragments(F.col("p_size"), fragments)).select("p_partkey", "p_size")


def prefix_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the first supplier whose name shares its last five characters: a key of five characters, and of
    equal keys the least id wins."""
    key = F.substring("s_name", -5, 5)
    first = _t(spark, sf_dir, "supplier").groupBy(key.alias("k")).agg(F.min_by(F.struct("s_suppkey", "s_acctbal"), "s_suppkey").alias("s"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", -5, 5).alias("k"))
    return c.join(first, "k", "left").select("c_custkey", F.coalesce("s.s_suppkey", F.lit(-1)).alias("s_suppkey"), F.coalesce("s.s_acctbal", F.lit(-1.0)).alias("sim"))


def anti_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and thousands of account balance of customers and suppliers: union, intersection and both differences."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("thousands"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("thousands"))
    return tables.set_parts(c, s, ("customers", "suppliers"))


def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers all of whose order priorities occur among the orders of status F of the same customer."""
    return tables.inside(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderstatus") == "F")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 dearest line items; ties by order and line."""
    return tables.top(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice", "l_orderkey", "l_linenumber"], 25)


def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 dearest line items of each supplier."""
    return tables.top_in_groups(_t(spark, sf_dir, "lineitem"), "l_suppkey", ["l_extendedprice", "l_orderkey", "l_linenumber"], 8).select("l_suppkey", "l_orderkey", "l_linenumber", "r")


def all_gap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities that occur for a customer, renumbered without the ones that never do."""
    return runs.renumbered(_t(spark, sf_dir, "orders").withColumn("col", F.substring("o_orderpriority", 1, 1).cast("int")), "o_custkey", "col")


_BIN = "floor(round(l_discount*100, 2)/2)::INT"
_FREQ = """f AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1), g AS (
  SELECT lang, n, hits, hits/n::DOUBLE AS p, CASE WHEN hits > 0 THEN (1-hits/n::DOUBLE)/hits ELSE 1.0 END AS relative2, CASE WHEN hits > 0 THEN hits/n::DOUBLE*sqrt((1-hits/n::DOUBLE)/hits) ELSE 0.0 END AS se FROM f
)"""
_RUN = """m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m
), spans AS (SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""

SQL = {
    "contingency": f"SELECT {_BIN} AS bin, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
    "log_odds_propensity": f"""WITH c AS (SELECT {_BIN} AS bin, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), s AS (
  SELECT bin, a, b, sum(n)::BIGINT AS n FROM (SELECT * FROM c UNION ALL SELECT bin, b, a, n FROM c) GROUP BY 1, 2, 3
), st AS (SELECT DISTINCT bin, a FROM s), g AS (
  SELECT x.bin, x.a, y.a AS b, coalesce(s.n, 0) AS n FROM st x JOIN st y ON x.bin = y.bin LEFT JOIN s ON s.bin = x.bin AND s.a = x.a AND s.b = y.a
), t AS (SELECT *, sum(n) OVER (PARTITION BY bin, a) AS fa, sum(n) OVER (PARTITION BY bin, b) AS fb, sum(n) OVER (PARTITION BY bin) AS total FROM g)
SELECT bin, a, b, n, round(CASE WHEN n > 0 THEN ln(total*n/(fa*fb)::DOUBLE) ELSE -ln(10.0) END, 6) AS propensity FROM t WHERE total >= 8""",
    "binom_freq": f"WITH {_FREQ} SELECT lang, n, hits, round(p, 8) AS p, round(relative2, 8) AS relative2, round(se, 8) AS se FROM g",
    "ratio_se": f"WITH {_FREQ} SELECT g.lang, round(g.p/b.p, 8) AS ratio, round(g.p/b.p*sqrt(g.relative2+b.relative2), 8) AS se FROM g, (SELECT * FROM g WHERE lang = 'en') b",
    "si_binned_cube": """WITH r AS (SELECT l_returnflag AS kind, CASE WHEN l_quantity <= 25 THEN 'few' ELSE 'many' END AS class, least(floor(round(l_tax*10, 4)*10), 10)::INT AS bin, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS same FROM lineitem)
SELECT coalesce(kind, 'all') AS kind, coalesce(class, 'all') AS class, coalesce(bin, -1)::INT AS bin, grouping(kind, class, bin)::BIGINT AS grouping, count(*) AS n, sum(same)::BIGINT AS n_same FROM r GROUP BY CUBE (kind, class, bin)""",
    "mean_with_error": "SELECT event_type, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value*value)-avg(value)*avg(value), 0.0)/count(DISTINCT user_id)), 6) AS se FROM events GROUP BY 1",
    "run_islands": f"WITH {_RUN} SELECT user_id, run, event_type, n, first, last FROM spans",
    "chain_change_number": f"WITH {_RUN} SELECT event_id, user_id, event_type, run::BIGINT AS run FROM r",
    "element_count": """WITH m AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT user_id, count(*) FILTER (event_type <> 'view' AND (before IS NULL OR before <> event_type)) AS elements FROM m GROUP BY 1""",
    "altloc_first": "SELECT user_id, event_type AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value > 20) WHERE r = 1",
    "lead_difference": "SELECT event_id, round(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 4) AS step FROM events",
    "site_offsets": "SELECT user_id, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
    "interval_overlay": f"WITH {_RUN} SELECT e.event_id, s.event_type AS covering FROM events e LEFT JOIN spans s ON e.user_id = s.user_id AND e.ts BETWEEN s.first AND s.last",
    "range_semi_join": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 1 AND 10 OR p_size BETWEEN 20 AND 30 OR p_size BETWEEN 45 AND 50",
    "prefix_similarity": """SELECT c_custkey, coalesce(s_suppkey, -1) AS s_suppkey, coalesce(s_acctbal, -1.0) AS sim FROM customer c LEFT JOIN (
  SELECT * FROM (SELECT right(s_name, 5) AS k, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY right(s_name, 5) ORDER BY s_suppkey) AS r FROM supplier) WHERE r = 1
) s ON right(c.c_name, 5) = s.k""",
    "anti_unassigned": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "set_operations": """WITH c AS (SELECT DISTINCT c_nationkey AS nation, floor(c_acctbal/1000)::INT AS thousands FROM customer), s AS (SELECT DISTINCT s_nationkey AS nation, floor(s_acctbal/1000)::INT AS thousands FROM supplier)
SELECT 'union' AS op, * FROM (SELECT * FROM c UNION SELECT * FROM s) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
UNION ALL SELECT 'customers_only', * FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT 'suppliers_only', * FROM (SELECT * FROM s EXCEPT SELECT * FROM c)""",
    "gap_openings": "SELECT user_id, count(*) FILTER (event_type = 'view' AND before IS DISTINCT FROM 'view') AS openings FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1",
    "column_gaps": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS col FROM events)
SELECT col::INT AS col, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) - count(*) AS gaps, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click FROM p GROUP BY 1""",
    "subset_test": """WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), f AS (SELECT DISTINCT o_custkey, o_orderpriority, 1 AS hit FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, count(*) = count(hit) AS inside, count(*)::INT AS n FROM a LEFT JOIN f USING (o_custkey, o_orderpriority) GROUP BY 1""",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25",
    "top_k_per_group": "SELECT l_suppkey, l_orderkey, l_linenumber, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 8",
    "all_gap_columns": """WITH o AS (SELECT DISTINCT o_custkey, substr(o_orderpriority, 1, 1)::INT AS col FROM orders)
SELECT o_custkey, col, dense_rank() OVER (PARTITION BY o_custkey ORDER BY col)::INT AS new_col FROM o""",
}

QUERIES = {
    f.__name__: f
    for f in (contingency, log_odds_propensity, binom_freq, ratio_se, si_binned_cube, mean_with_error, run_islands, chain_change_number, element_count, altloc_first, lead_difference, gap_openings, column_gaps, site_offsets, interval_overlay, range_semi_join, prefix_similarity, anti_unassigned, set_operations, subset_test, top_k, top_k_per_group, all_gap_columns)
}
