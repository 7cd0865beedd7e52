"""Relational queries over the star schema: what Spark brings beyond the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _n():
    return F.count(F.lit(1))


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _day(s: str):
    return F.lit(f"{s} 00:00:00").cast("timestamp")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.where(F.col("l_shipdate") <= _day("1998-09-02")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(_revenue()), 2).alias("sum_revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), _n().alias("lines")
    )


@query("""
SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n, r = _t(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("c_mktsegment", "n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("""
SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 20""")
def largest_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c = _t(spark, sf_dir, "lineitem", "orders", "customer")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(20)


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def customers_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = _t(spark, sf_dir, "customer", "nation", "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name", "c_mktsegment").agg(_n().alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def lines_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(_n().alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS orders FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def order_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.groupingSets([[F.col("o_orderpriority")], [F.col("o_orderstatus")], []], "o_orderpriority", "o_orderstatus").agg(_n().alias("orders"))


@query("SELECT p_brand, quantile_cont(l_quantity, 0.5) AS median_qty, round(stddev_samp(l_extendedprice), 4) AS price_sd, max(l_discount) AS top_discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def brand_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.expr("percentile(l_quantity, 0.5)").alias("median_qty"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("price_sd"), F.max("l_discount").alias("top_discount"))


@query("""
SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before_price, lead(o_totalprice) OVER w AS after_price, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, ntile(4) OVER w::INT AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""".replace("OVER (w ROWS", "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS").replace("ntile(4) OVER w::INT", "(ntile(4) OVER w)::INT"))
def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("before_price"), F.lead("o_totalprice").over(w).alias("after_price"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.ntile(4).over(w).alias("quarter"))


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS place FROM lineitem) WHERE place <= 3")
def top_lines_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.operators.groups import top_rows

    (li,) = _t(spark, sf_dir, "lineitem")
    return top_rows(li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= DATE '2001-01-01') GROUP BY 1")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order since 2001."""
    c, o = _t(spark, sf_dir, "customer", "orders")
    o = o.where("o_orderdate >= DATE '2001-01-01'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_nationkey").agg(_n().alias("customers"))


@query("SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0")
def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _t(spark, sf_dir, "supplier", "customer")
    return s.select(F.col("s_nationkey").alias("nationkey")).intersect(c.where("c_acctbal > 0").select("c_nationkey"))


@query("SELECT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def parts_never_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    """Parts of suppliers that were ordered in quantity and never returned."""
    return li.where("l_quantity > 45").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).subtract(li.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    p = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 2) AS large, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(_n().alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0)), 2).alias("large"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT year(l_shipdate)::INT AS ship_year, round(sum(l_extendedprice * l_discount), 2) AS forgone FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 GROUP BY 1")
def forgone_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).groupBy(F.year("l_shipdate").alias("ship_year")).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("forgone"))
