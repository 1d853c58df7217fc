"""Queries: relational steps over measurements, with orders and line items standing in for them (REL, SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismframe.operators import results
from prismframe.plans.base import query, table


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("""WITH r AS (SELECT ps AS l_partkey, sk AS l_suppkey, round(avg(p), 4) AS l_extendedprice, count(*) AS n FROM (SELECT l_partkey AS ps, l_suppkey AS sk, l_extendedprice AS p FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, r.l_extendedprice AS l_extendedprice_rhs, r.n FROM lineitem l LEFT JOIN r ON r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey""")
def left_join_multikey(spark, sf):
    """REL01."""
    t = _lines(spark, sf)
    r = t.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("l_extendedprice"), F.count("*").alias("n"))
    return results.left_join(t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), r, ["l_partkey", "l_suppkey"])


@query("""WITH q AS (SELECT l_shipmode AS family, l_partkey % 7 AS n, l_suppkey % 5 AS d, l_linenumber % 3 AS m, count(*) AS quality FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'vq4' WHEN 'N' THEN 'exact' ELSE 'other' END AS l_shipmode, l_partkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY ALL),
t AS (SELECT family, n, d, m, min(quality) AS secs FROM q WHERE d < 3 GROUP BY ALL)
SELECT q.family, q.n, q.d, q.m, q.quality, t.secs, CASE WHEN q.family = 'vq4' THEN q.n % 2 END AS codebooks FROM q LEFT JOIN t ON t.family = q.family AND t.n = q.n AND t.d = q.d AND t.m = q.m WHERE q.family IN ('vq4', 'exact')""")
def join_timings(spark, sf):
    """REL02, REL08: families on their own keys, columns united."""
    family = F.when(F.col("l_returnflag") == "A", "vq4").when(F.col("l_returnflag") == "N", "exact").otherwise("other")
    t = _lines(spark, sf).select(family.alias("family"), (F.col("l_partkey") % 7).alias("n"), (F.col("l_suppkey") % 5).alias("d"), (F.col("l_linenumber") % 3).alias("m"))
    q = t.groupBy("family", "n", "d", "m").agg(F.count("*").alias("quality"))
    secs = q.filter("d < 3").groupBy("family", "n", "d", "m").agg(F.min("quality").alias("secs"))
    vq4 = lambda x: x.withColumn("codebooks", F.when(F.col("family") == "vq4", F.col("n") % 2))
    return results.join_timings(vq4(q), vq4(secs), {"vq4": ("n", "d", "m", "codebooks"), "exact": ("n", "d", "m")}).select("family", "n", "d", "m", "quality", "secs", "codebooks")


@query("""WITH r AS (SELECT o_custkey, o_orderdate, o_orderkey AS o, o_totalprice FROM orders), a AS (
  SELECT l.o_orderkey, l.o_totalprice AS target, r.o AS matched, r.o_totalprice AS value FROM orders l JOIN r ON r.o_custkey = l.o_custkey AND r.o <> l.o_orderkey)
SELECT o_orderkey, matched, value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY (value <= target) DESC, CASE WHEN value <= target THEN -value ELSE value END, matched) AS i FROM a) WHERE i = 1""")
def asof_at_or_below(spark, sf):
    """REL03, FLT09: each order with the customer's other order of the nearest price at or below its own, else the cheapest."""
    o = table(spark, sf, "orders")
    right = o.select("o_custkey", F.col("o_orderkey").alias("matched"), F.col("o_totalprice").alias("value"))
    left = o.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("target"))
    return results.at_or_below(left, right, ["o_custkey"], "target", "value", "o_orderkey", "matched").select("o_orderkey", "matched", "value")


@query("""SELECT p_partkey, p_size, p_retailprice FROM (
  SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM part) WHERE m IS NULL OR p_retailprice > m""")
def pareto_frontier(spark, sf):
    """REL04."""
    return results.pareto(table(spark, sf, "part"), "p_size", "p_retailprice", "p_partkey", ["p_brand"]).select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT l_orderkey, l_linenumber, timing_trial, time FROM lineitem UNPIVOT (time FOR timing_trial IN (l_quantity, l_discount, l_tax))""")
def unpivot_times(spark, sf):
    """REL05."""
    return results.unpivot(_lines(spark, sf), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_returnflag, l_linestatus, round(avg((l_discount > 0.05)::INT), 6) AS share FROM lineitem GROUP BY ALL")
def frac_above_thresh(spark, sf):
    """REL06."""
    return results.share_above(_lines(spark, sf), ["l_returnflag", "l_linestatus"], "l_discount", 0.05).withColumn("share", F.round("share", 6))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' ELSE 'returned' END AS l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def remap_drop(spark, sf):
    """REL07."""
    return results.remap(_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", {"A": "accepted", "R": "returned"})


@query("""SELECT o_orderkey AS id, o_totalprice AS price, NULL AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part""")
def union_outer(spark, sf):
    """REL08."""
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return results.union_outer(a, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity END, (l_extendedprice + l_quantity) / 2) AS time FROM lineitem)
SELECT l_orderkey, l_linenumber, round(time, 6) AS time, round(1 / time, 9) AS throughput, round(avg(CASE WHEN l_returnflag = 'N' THEN time END) OVER (PARTITION BY l_suppkey) / time, 6) AS speedup FROM t""")
def baseline_speedup(spark, sf):
    """REL09, FLT03."""
    t = _lines(spark, sf).withColumn("time", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")))
    got = results.speedups(t, ["l_suppkey"], "l_returnflag", "N", "time", ["l_extendedprice", "l_quantity"])
    return got.select("l_orderkey", "l_linenumber", F.round("time", 6).alias("time"), F.round("throughput", 9).alias("throughput"), F.round("speedup", 6).alias("speedup"))


@query("SELECT o_orderkey, lower(trim(o_orderpriority)) AS o_orderpriority, o_custkey FROM orders WHERE lower(trim(o_orderpriority)) LIKE '%h' AND starts_with(lower(trim(o_orderpriority)), '2')")
def text_filters(spark, sf):
    """REL10, FLT02."""
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus")
    return results.text_filters(t, "o_orderpriority", "2", "h", ["o_orderstatus"])


@query("""SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1""")
def dedup_keep_last(spark, sf):
    """REL11, SNK01, FLT08."""
    return results.keep_last(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, sf):
    """REL12."""
    return results.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_distinct, count(*) = count(DISTINCT o_custkey) AS all_distinct FROM orders")
def is_unique(spark, sf):
    """REL12."""
    return results.is_unique(table(spark, sf, "orders"), "o_custkey")
