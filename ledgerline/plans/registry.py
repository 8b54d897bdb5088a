"""Registered queries over the driver tables, each with its DuckDB twin where SQL can say the same.

lineitem and orders span more than 1100 days, so their grain is the quarter. A trailing period is partial below 80 %
of its length and left out of period analyses on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analytics, audit, charts, curves, forecast, insights, kpi, periods, semantics, series, stats, verbs
from ..sources import delimited, staging
from ..streaming import sessions
from . import catalog, packs, sqlbox

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle.strip()
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RETAIL_MAP = {"order_date": "l_shipdate", "revenue": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount", "order_id": "l_orderkey", "product": "l_partkey"}


def _window(table: str, when: str) -> str:
    """CTEs q (rows with their quarter p) and w (current, previous)."""
    return f"""q AS (SELECT *, CAST(date_trunc('quarter', {when}) AS DATE) AS p FROM {table} WHERE {when} IS NOT NULL),
s AS (SELECT max(p) AS lastp, max({when}) AS hi FROM q),
k AS (SELECT CASE WHEN (date_diff('day', lastp, CAST(hi AS DATE)) + 1) / 91.0 < 0.8 THEN lastp ELSE NULL END AS gone FROM s),
c AS (SELECT max(p) AS cur FROM q, k WHERE k.gone IS NULL OR q.p <> k.gone),
w AS (SELECT c.cur, (SELECT max(p) FROM q WHERE p < c.cur) AS prev FROM c)"""


def _money(x: str, when: str = "") -> str:
    """A compensated sum of doubles: another type than the library's, so that it sees what that one loses."""
    f = f" FILTER (WHERE {when})" if when else ""
    return f"round(fsum(CAST({x} AS DOUBLE)){f}, 4)"


def _slices(name: str, f: Callable[[str], str]) -> str:
    return ", ".join(f"{f(by)} AS {name}_{s}" for s, by in (("a", "true"), ("c", "p = cur"), ("b", "p = prev")))


@query(
    f"""WITH {_window('lineitem', 'l_shipdate')},
g AS (SELECT {_slices('rev', lambda b: _money('l_extendedprice', b))}, {_slices('ord', lambda b: f'CAST(count(DISTINCT l_orderkey) FILTER (WHERE {b}) AS DOUBLE)')},
 {_slices('units', lambda b: _money('l_quantity', b))}, {_slices('disc', lambda b: _money('l_discount', b))} FROM q, w),
t AS (SELECT {_money('l_extendedprice')} AS s FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey),
r AS (
SELECT 'total_revenue' AS key, rev_a AS value, rev_b AS previous, 100.0 * (rev_c - rev_b) / abs(rev_b) AS delta_pct FROM g
UNION ALL SELECT 'order_count', ord_a, ord_b, 100.0 * (ord_c - ord_b) / abs(ord_b) FROM g
UNION ALL SELECT 'aov', rev_a / ord_a, rev_b / ord_b, 100.0 * (rev_c / ord_c - rev_b / ord_b) / abs(rev_b / ord_b) FROM g
UNION ALL SELECT 'units_sold', units_a, units_b, 100.0 * (units_c - units_b) / abs(units_b) FROM g
UNION ALL SELECT 'discount_total', disc_a, disc_b, 100.0 * (disc_c - disc_b) / abs(disc_b) FROM g
UNION ALL SELECT 'revenue_growth', 100.0 * (rev_c - rev_b) / abs(rev_b), NULL, NULL FROM g
UNION ALL SELECT 'top_product_share', 100.0 * (SELECT sum(s) FROM (SELECT s FROM t ORDER BY s DESC LIMIT 10)) / (SELECT sum(s) FROM t), NULL, NULL)
SELECT key, round(value, 4) AS value, round(previous, 4) AS previous, round(delta_pct, 4) AS delta_pct FROM r"""
)
def kpi_pack_retail(spark, d):
    out = kpi.pack(read(spark, d, "lineitem"), catalog.RETAIL.kpis, RETAIL_MAP, "l_shipdate")
    return out.select("key", *(F.round(c, 4).alias(c) for c in ("value", "previous", "delta_pct")))


@query(
    f"""WITH a AS (SELECT {_money('c_acctbal')} AS n, {_money('c_acctbal', 'c_acctbal > 0')} AS i, {_money('c_acctbal', 'c_acctbal < 0')} AS o, count(*) AS c FROM customer),
t AS (SELECT CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS s FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey)
SELECT 'net_total' AS key, round(n, 4) AS value FROM a UNION ALL SELECT 'inflows', round(i, 4) FROM a UNION ALL SELECT 'outflows', round(o, 4) FROM a
UNION ALL SELECT 'txn_count', CAST(c AS DOUBLE) FROM a UNION ALL SELECT 'avg_txn', round(n / c, 4) FROM a
UNION ALL SELECT 'top_head_share', round(100.0 * (SELECT sum(s) FROM (SELECT s FROM t ORDER BY s DESC LIMIT 5)) / (SELECT sum(s) FROM t), 4)"""
)
def kpi_pack_finance(spark, d):
    return kpi.pack(read(spark, d, "customer"), catalog.FINANCE.kpis, {"amount": "c_acctbal", "account": "c_nationkey"}, None).select("key", F.round("value", 4).alias("value"))


@query(
    f"""WITH j AS (SELECT o_orderdate, l_shipdate, l_returnflag, l_extendedprice, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, {_money('l_extendedprice')} AS m, {_money('l_quantity')} AS q, {_money('l_extendedprice', 'l_quantity > 30')} AS h,
 CAST(count(*) FILTER (WHERE lower(trim(l_returnflag)) IN ('r', 'returned')) AS DOUBLE) AS r, CAST(count(l_shipdate) AS DOUBLE) AS dated,
 CAST(sum(date_diff('day', o_orderdate, l_shipdate)) FILTER (WHERE l_shipdate >= o_orderdate) AS DOUBLE) / count(*) FILTER (WHERE l_shipdate >= o_orderdate) AS t FROM j)
SELECT 'lines' AS key, n AS value FROM a UNION ALL SELECT 'returned_rate', round(100.0 * r / n, 4) FROM a UNION ALL SELECT 'avg_transit', round(t, 4) FROM a
UNION ALL SELECT 'total_freight', round(m, 4) FROM a UNION ALL SELECT 'cost_per_line', round(m / n, 4) FROM a UNION ALL SELECT 'heavy_share', round(100.0 * h / m, 4) FROM a
UNION ALL SELECT 'cost_per_weight', round(m / q, 4) FROM a UNION ALL SELECT 'dated_share', round(100.0 * dated / n, 4) FROM a"""
)
def kpi_rates_and_durations(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fields = {"ship_date": "o_orderdate", "delivery_date": "l_shipdate", "status": "l_returnflag", "cost": "l_extendedprice", "weight": "l_quantity"}
    return kpi.pack(rows, catalog.LINES, fields, None).select("key", F.round("value", 4).alias("value"))


@query(
    f"""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS s FROM orders)
SELECT {_money('o_totalprice')} AS total, round({_money('o_totalprice')} / count(o_totalprice), 4) AS mean, quantile_cont(o_totalprice, 0.5) AS median, round(stddev_samp(o_totalprice), 2) AS std,
 min(o_totalprice) AS min, max(o_totalprice) AS max, count(o_totalprice) AS count, round(100.0 * count(*) FILTER (WHERE o_totalprice IS NULL) / count(*), 2) AS null_rate,
 round(stddev_samp(o_totalprice) / avg(o_totalprice) * 100, 2) AS cv, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.75) AS p75, round(skewness(o_totalprice), 4) AS skew,
 quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, count(*) FILTER (WHERE abs((o_totalprice - m.a) / m.s) > 3) AS outliers FROM orders, m"""
)
def kpi_universal(spark, d):
    out = kpi.universal(read(spark, d, "orders"), "o_totalprice")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 2), "null_rate": F.col("null_rate").cast("double")})


@query(
    """WITH r AS (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS x, row_number() OVER (ORDER BY o_totalprice DESC) AS k, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL)
SELECT round(100.0 * CAST(sum(x) FILTER (WHERE k <= greatest(1, floor(0.2 * n))) AS DOUBLE) / CAST(sum(x) AS DOUBLE), 1) AS pareto FROM r"""
)
def kpi_pareto(spark, d):
    return kpi.pareto(read(spark, d, "orders"), "o_totalprice")


@query(
    """WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS k FROM orders WHERE o_totalprice IS NOT NULL)
SELECT round(2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 4) AS gini FROM r"""
)
def kpi_gini(spark, d):
    return kpi.gini(read(spark, d, "orders"), "o_totalprice")


_ODD = """SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS gaps,
 l_discount * 1e-9 AS tiny, l_extendedprice * 1e20 AS huge, CASE WHEN l_linenumber = 1 THEN l_extendedprice * 1e9 ELSE l_discount * 1e-3 END AS mixed FROM lineitem"""


@query(
    f"""WITH o AS ({_ODD}), k AS (SELECT *, CASE WHEN NOT isnan(gaps) THEN gaps END AS gap FROM o)
SELECT l_returnflag, round(fsum(gap), 4) AS gaps_sum, round(fsum(gap) / count(gap), 6) AS gaps_mean, count(gap) AS gaps_count, round(quantile_cont(gap, 0.5), 6) AS gaps_median, max(gap) AS gaps_max,
 round(fsum(tiny) * 1e9, 6) AS tiny_sum, round(fsum(huge) / 1e20, 4) AS huge_sum, round(fsum(mixed) / 1e9, 4) AS mixed_sum FROM k GROUP BY l_returnflag"""
)
def sums_of_odd_values(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(_ODD)
    out = verbs.group(rows, ["l_returnflag"], "gaps", ["sum", "mean", "count", "median", "max"])
    for c, unit in (("tiny", 1e-9), ("huge", 1e20), ("mixed", 1e9)):
        out = out.join(verbs.group(rows, ["l_returnflag"], c, ["sum"]).select("l_returnflag", F.round(F.col("sum") / unit, 6 if c == "tiny" else 4).alias(f"{c}_sum")), "l_returnflag")
    return out.select("l_returnflag", F.round("sum", 4).alias("gaps_sum"), F.round("mean", 6).alias("gaps_mean"), F.col("count").alias("gaps_count"), F.round("median", 6).alias("gaps_median"), F.col("max").alias("gaps_max"), "tiny_sum", "huge_sum", "mixed_sum")


@query(
    f"""WITH v AS (SELECT l_returnflag AS segment, l_quantity AS v FROM lineitem WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL),
s AS (SELECT segment, count(*) AS n, min(v) AS lo, max(v) AS hi, 1.059 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349) * count(*) ** -0.2 AS h FROM v GROUP BY 1),
a AS (SELECT segment, n, h, lo - 2 * h AS a, (hi - lo + 4 * h) / {curves.GRID - 1} AS step FROM s),
p AS (SELECT a.segment, (v - a) / step AS p FROM v JOIN a USING (segment)), q AS (SELECT segment, p, least(floor(p), {curves.GRID - 2}) AS i FROM p),
u AS (SELECT segment, i, sum(u) AS u FROM (SELECT segment, i, 1 - (p - i) AS u FROM q UNION ALL SELECT segment, i + 1, p - i FROM q) GROUP BY 1, 2),
g AS (SELECT a.*, k AS g FROM a, range({curves.GRID}) r(k))
SELECT g.segment, CAST(max(n) AS BIGINT) AS n, round(g.a + g.g * g.step, 6) AS "at", round(sum(u.u * exp(-0.5 * ((g.g - u.i) * g.step / g.h) ** 2)) / (max(n) * g.h * sqrt(2 * pi())), 8) AS density
FROM g JOIN u USING (segment) GROUP BY g.segment, g.g, g.a, g.step, g.h"""
)
def chart_violin(spark, d):
    out = charts.marks(read(spark, d, "lineitem"), charts.Chart("violin", "", "l_returnflag", "l_quantity"))
    return out.select("segment", "n", F.round("at", 6).alias("at"), F.round("density", 8).alias("density"))


@query(
    """WITH b AS (SELECT c_mktsegment AS x, CAST(c_nationkey AS VARCHAR) AS y, fsum(c_acctbal) AS v FROM customer GROUP BY 1, 2),
r AS (SELECT x, row_number() OVER (ORDER BY fsum(v) DESC, x) AS r FROM b GROUP BY x), b1 AS (SELECT CASE WHEN r <= 3 THEN x ELSE 'Others' END AS x, CASE WHEN r <= 3 THEN y END AS y, v FROM b JOIN r USING (x)),
s AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY fsum(v) DESC, y) AS r FROM b1 WHERE y IS NOT NULL GROUP BY x, y),
b2 AS (SELECT b1.x, CASE WHEN b1.y IS NULL THEN NULL WHEN s.r <= 3 THEN b1.y ELSE 'Others' END AS y, v FROM b1 LEFT JOIN s ON s.x = b1.x AND s.y = b1.y)
SELECT NULL AS c_mktsegment, NULL AS c_nationkey, 0 AS depth, round(fsum(v), 2) AS total FROM b2 UNION ALL SELECT x, NULL, 1, round(fsum(v), 2) FROM b2 GROUP BY x
UNION ALL SELECT x, y, 2, round(fsum(v), 2) FROM b2 WHERE y IS NOT NULL GROUP BY x, y"""
)
def chart_hierarchy_top(spark, d):
    return verbs.hierarchy_top(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal", 3).withColumn("total", F.round("total", 2))


def _grid(table: str, when: str, entity: str, unit: str) -> str:
    step = f"date_diff('{unit}', cohort, p)" if unit == "month" else "date_diff('day', cohort, p) // 7"
    begins = f"cohort + k * INTERVAL 1 {unit}"
    return f"""WITH e AS (SELECT DISTINCT {entity} AS e, CAST(date_trunc('{unit}', {when}) AS DATE) AS p FROM {table} WHERE {entity} IS NOT NULL AND {when} IS NOT NULL),
f AS (SELECT *, min(p) OVER (PARTITION BY e) AS cohort FROM e), s AS (SELECT cohort, {step} AS k, count(*) AS n FROM f GROUP BY 1, 2),
z AS (SELECT cohort, n AS size FROM s WHERE k = 0 ORDER BY cohort DESC LIMIT 8), h AS (SELECT max({when}) AS hi FROM {table}),
g AS (SELECT cohort, size, k FROM z, range(7) r(k) WHERE k <= (SELECT max(k) FROM s) AND (SELECT count(DISTINCT e) FROM e) >= 30 AND (SELECT max(k) FROM s) >= 1)
SELECT g.cohort, CAST(g.k AS BIGINT) AS "offset", CASE WHEN {begins.replace('cohort', 'g.cohort').replace('k *', 'g.k *')} <= hi THEN coalesce(n, 0) END AS entities,
 CASE WHEN {begins.replace('cohort', 'g.cohort').replace('k *', 'g.k *')} <= hi THEN round(100.0 * coalesce(n, 0) / size, 6) END AS retention_pct FROM g CROSS JOIN h LEFT JOIN s ON s.cohort = g.cohort AND s.k = g.k"""


@query(_grid("orders", "o_orderdate", "o_custkey", "month"))
def cohort_grid_months(spark, d):
    return analytics.cohort_grid(read(spark, d, "orders"), "o_orderdate", "o_custkey")


@query(_grid("events", "ts", "user_id", "week"))
def cohort_grid_weeks(spark, d):
    return analytics.cohort_grid(read(spark, d, "events"), "ts", "user_id")


@query(
    f"""WITH s AS (SELECT date_trunc('year', o_orderdate) AS b, {_money('o_totalprice')} AS s, count(o_totalprice) AS c FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
y AS (SELECT unnest(generate_series((SELECT min(b) FROM s), (SELECT max(b) FROM s), INTERVAL 1 YEAR)) AS b)
SELECT CAST(y.b + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS bucket, coalesce(s, 0.0) AS sum, coalesce(c, 0) AS count FROM y LEFT JOIN s ON s.b = y.b"""
)
def resample_year_ends(spark, d):
    return verbs.resample(read(spark, d, "orders"), "o_orderdate", "o_totalprice", "Y", "end").select("bucket", F.round("sum", 4).alias("sum"), "count")


@query(
    f"""WITH q AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS p FROM orders WHERE o_orderdate IS NOT NULL), h AS (SELECT max(p) AS p, CAST(max(o_orderdate) AS DATE) AS hi FROM q),
w AS (SELECT h.p, date_diff('day', h.p, hi) + 1 AS day, day(last_day(h.p)) AS days, (SELECT max(p) FROM q WHERE q.p < h.p) AS b FROM h),
s AS (SELECT w.p, w.day, w.days, {_money('o_totalprice', 'q.p = w.p')} AS a, {_money('o_totalprice', "q.p = w.b AND date_diff('day', w.b, CAST(o_orderdate AS DATE)) < w.day")} AS c, {_money('o_totalprice', 'q.p = w.b')} AS t FROM q, w GROUP BY 1, 2, 3)
SELECT p AS period, day, days, a AS so_far, c AS previous_same_day, t AS previous_total, round(100.0 * (a - c) / nullif(c, 0), 6) AS pace_pct, round(a / day * days, 4) AS run_rate, round(100.0 * (a / day * days - t) / nullif(t, 0), 6) AS projected_pct FROM s"""
)
def pace_run_rate(spark, d):
    return analytics.pace_summary(read(spark, d, "orders"), "o_orderdate", "o_totalprice", "M")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(fsum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, d):
    return sessions.sessions(read(spark, d, "events"), "ts", "user_id", "value", "2 hours").withColumn("total", F.round("total", 4))


_BIN = "CAST(CASE WHEN {0}1 > {0}0 THEN least(floor(({0} - {0}0) / (({0}1 - {0}0) / 20)), 19) ELSE 0 END AS BIGINT)"


@query(
    f"""WITH r AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, q0, q1, d0, d1, t0, t1 FROM lineitem, (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1, min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem)),
b AS (SELECT {_BIN.format('q')} AS q, {_BIN.format('d')} AS d, {_BIN.format('t')} AS t FROM r)
SELECT 'l_quantity' AS a, 'l_discount' AS b, q AS ba, d AS bb, count(*) AS n FROM b GROUP BY 3, 4 UNION ALL SELECT 'l_quantity', 'l_tax', q, t, count(*) FROM b GROUP BY 3, 4 UNION ALL SELECT 'l_discount', 'l_tax', d, t, count(*) FROM b GROUP BY 3, 4"""
)
def chart_scatter_matrix(spark, d):
    return charts.scatter_matrix(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query(
    f"""WITH r AS (SELECT l_returnflag AS facet, l_quantity AS q, l_discount AS d, q0, q1, d0, d1 FROM lineitem, (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem))
SELECT facet, {_BIN.format('q')} AS bx, {_BIN.format('d')} AS by, count(*) AS n FROM r GROUP BY 1, 2, 3"""
)
def chart_facets(spark, d):
    return charts.facets(read(spark, d, "lineitem"), "l_quantity", "l_discount", "l_returnflag")


@query(
    """WITH r AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_extendedprice, l_tax) AS c, count(*) AS n FROM lineitem)
SELECT k AS "column", n, round(v, 6) AS r, CASE WHEN abs(v) >= 0.6 THEN 'strong' ELSE 'moderate' END AS strength FROM (SELECT 'l_quantity' AS k, a AS v, n FROM r UNION ALL SELECT 'l_discount', b, n FROM r UNION ALL SELECT 'l_tax', c, n FROM r) WHERE n >= 30 AND abs(v) >= 0.3"""
)
def driver_associations(spark, d):
    """Of so many rows an r of 0.3 has no p worth telling from 0; the p of few rows are tested by value."""
    return analytics.drivers(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("column", "n", F.round("r", 6).alias("r"), "strength")


@query()
def chart_lowess(spark, d):
    """A trend line over all rows; tests hold it against plain LOWESS."""
    return curves.lowess(read(spark, d, "orders").select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("x"), "o_totalprice"), "x", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(fsum(l_extendedprice), 4) AS total FROM lineitem GROUP BY 1, 2")
def cached_totals(spark, d):
    """The second of two askings: it reads what the first one settled."""
    ask = lambda: staging.cached(read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(periods.money("l_extendedprice"), 4).alias("total")))
    ask()
    return ask()


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, md5(coalesce(translate(text, chr(32) || chr(9) || chr(10) || chr(13), ''), '')) AS text_md5 FROM documents")
def ingest_quoted_texts(spark, d):
    """Documents saved as delimited text, whose line breaks stand in quotes, and read back by splits."""
    out = staging.staging_path(spark, "quoted")
    delimited.save(read(spark, d, "documents").select("doc_id", "source", "text"), out)
    table, names = delimited.quoted.parsed(delimited._lines(spark, out, {"UTF-8": []}), ",", [])
    rows = table.where("_c0 <> 'doc_id'")
    return rows.select(F.col("_c0").alias("doc_id"), F.col("_c1").alias("source"), F.md5(F.translate(F.coalesce("_c2", F.lit("")), " \t\n\r", "").cast("binary")).alias("text_md5"))


@query(
    f"""WITH s AS (SELECT {_money('c_acctbal')} AS net_total, {_money('c_acctbal', 'c_acctbal > 0')} AS inflows, {_money('c_acctbal', 'c_acctbal < 0')} AS outflows FROM customer)
SELECT *, round(inflows / abs(outflows), 4) AS in_out_ratio FROM s"""
)
def kpi_in_out(spark, d):
    return kpi.flows(read(spark, d, "customer"), "c_acctbal")


_SERIES = f"""{_window('orders', 'o_orderdate')},
ser AS (SELECT p AS period, {_money('o_totalprice')} AS value, count(*) AS n FROM q, k WHERE k.gone IS NULL OR p <> k.gone GROUP BY p)"""


def _series(spark, d, g=None):
    orders = read(spark, d, "orders")
    w = periods.bounds(orders, "o_orderdate", g)
    return periods.series(orders, "o_orderdate", periods.money("o_totalprice"), w.grain, w)


@query(f"WITH {_SERIES} SELECT period, value, n FROM ser")
def period_series(spark, d):
    return _series(spark, d)


@query(
    f"""WITH {_SERIES}, i AS (SELECT CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS i, value FROM ser),
f AS (SELECT count(*) AS n, regr_slope(value, i) AS b, regr_intercept(value, i) AS a, regr_r2(value, i) AS r FROM i)
SELECT n, round(b, 4) AS slope, round(a, 2) AS intercept, round(r, 6) AS r2, round(sign(b) * sqrt(r * (n - 2) / (1 - r)), 4) AS t FROM f"""
)
def trend_stats(spark, d):
    t = analytics.trend(_series(spark, d))
    return t.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("t", 4).alias("t"))


@query(
    f"""WITH {_SERIES}, m AS (SELECT period, value, CASE WHEN count(value) OVER v >= 3 THEN median(value) OVER v END AS med FROM ser WINDOW v AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
z AS (SELECT period, value, (value - med) / stddev_samp(value - med) OVER () AS z FROM m)
SELECT period, value, round(z, 4) AS z, coalesce(abs(z) >= 2.5, false) AS anomaly FROM z"""
)
def anomaly_rolling_median(spark, d):
    return analytics.rolling_anomalies(_series(spark, d)).withColumn("z", F.round("z", 4))


@query(
    f"""WITH {_SERIES}, x AS (SELECT period, value, lag(value) OVER (ORDER BY period) AS l, avg(value) OVER (ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m,
 avg(value) OVER t AS tm, count(value) OVER t AS tn FROM ser WINDOW t AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT period, value, round(100.0 * (value - l) / abs(l), 4) AS change_pct, round(100.0 * (value - m) / abs(m), 4) AS momentum_pct, CASE WHEN tn >= 2 THEN round(tm, 2) END AS trailing_mean FROM x"""
)
def period_change(spark, d):
    return analytics.changes(_series(spark, d)).select("period", "value", F.round("change_pct", 4).alias("change_pct"), F.round("momentum_pct", 4).alias("momentum_pct"), F.round("trailing_mean", 2).alias("trailing_mean"))


@query(
    f"""WITH {_window('orders', 'o_orderdate')},
g AS (SELECT coalesce(o_orderpriority, '(null)') AS segment, coalesce({_money('o_totalprice', 'p = cur')}, 0.0) AS a, coalesce({_money('o_totalprice', 'p = prev')}, 0.0) AS b FROM q, w WHERE p IN (cur, prev) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY abs(a - b) DESC, segment) AS r FROM g)
SELECT CASE WHEN r <= 3 THEN segment ELSE 'Others' END AS segment, round(sum(a), 2) AS current, round(sum(b), 2) AS previous, round(round(sum(a), 2) - round(sum(b), 2), 2) AS delta FROM r GROUP BY 1"""
)
def bridge_segments(spark, d):
    o = read(spark, d, "orders")
    return analytics.bridge(o, "o_orderdate", "o_totalprice", "o_orderpriority", periods.bounds(o, "o_orderdate"), 3)


@query(
    f"""WITH {_window('lineitem', 'l_shipdate')},
g AS (SELECT {_money('l_extendedprice', 'p = cur')} AS m1, {_money('l_extendedprice', 'p = prev')} AS m0, CAST(count(DISTINCT l_orderkey) FILTER (WHERE p = cur) AS DOUBLE) AS v1, CAST(count(DISTINCT l_orderkey) FILTER (WHERE p = prev) AS DOUBLE) AS v0 FROM q, w)
SELECT m1, m0, v1, v0, round(m1 / v1, 4) AS r1, round(m0 / v0, 4) AS r0, round((v1 - v0) * (m0 / v0), 2) AS volume_effect, round((m1 / v1 - m0 / v0) * v1, 2) AS rate_effect FROM g"""
)
def volume_rate(spark, d):
    li = read(spark, d, "lineitem")
    out = analytics.volume_rate(li, "l_shipdate", "l_extendedprice", "l_orderkey", periods.bounds(li, "l_shipdate"))
    return out.withColumns({"r1": F.round("r1", 4), "r0": F.round("r0", 4), "volume_effect": F.round("volume_effect", 2), "rate_effect": F.round("rate_effect", 2)})


@query(
    f"""WITH {_window('orders', 'o_orderdate')},
g AS (SELECT {_money('o_totalprice', 'p = cur')} AS m1, {_money('o_totalprice', 'p = prev')} AS m0, CAST(count(*) FILTER (WHERE p = cur) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE p = prev) AS DOUBLE) AS n0 FROM q, w GROUP BY o_orderpriority),
t AS (SELECT sum(m1) AS m1, sum(m0) AS m0, sum(n1) AS n1, sum(n0) AS n0, sum(m1 / n1 * n0) AS f FROM g WHERE n1 > 0 AND n0 > 0)
SELECT round(100 * (m1 / n1 / (m0 / n0) - 1), 6) AS blended_pct, round(100 * (f / m0 - 1), 6) AS fixed_mix_pct FROM t"""
)
def mix_shift(spark, d):
    o = read(spark, d, "orders")
    return analytics.mix_shift(o, "o_orderdate", "o_totalprice", "o_orderpriority", periods.bounds(o, "o_orderdate"))


@query(
    f"""WITH {_window('orders', 'o_orderdate')},
u AS (SELECT p, o_totalprice AS v, 'o_orderpriority' AS dim, coalesce(o_orderpriority, '(null)') AS segment FROM q UNION ALL SELECT p, o_totalprice, 'o_orderstatus', coalesce(o_orderstatus, '(null)') FROM q),
g AS (SELECT dim, segment, {_money('v')} AS total, {_money('v', 'p = cur')} AS m1, {_money('v', 'p = prev')} AS m0, count(*) FILTER (WHERE p = cur) AS n1, count(*) FILTER (WHERE p = prev) AS n0 FROM u, w GROUP BY 1, 2)
SELECT dim, segment, total, round(100.0 * total / sum(total) OVER (PARTITION BY dim), 6) AS share_pct, CASE WHEN n1 >= 8 AND n0 >= 8 THEN round(100.0 * (m1 - m0) / abs(m0), 6) END AS move_pct FROM g"""
)
def segment_moves(spark, d):
    o = read(spark, d, "orders")
    return analytics.segments(o, "o_orderdate", "o_totalprice", ["o_orderpriority", "o_orderstatus"], periods.bounds(o, "o_orderdate"))


@query(
    f"""WITH s AS (SELECT c_nationkey, {_money('c_acctbal')} AS total FROM customer GROUP BY 1)
SELECT CAST(c_nationkey AS VARCHAR) AS segment, total, round(100.0 * sum(total) OVER (ORDER BY total DESC, c_nationkey ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 6) AS cum_share_pct FROM s"""
)
def pareto_curve(spark, d):
    return analytics.pareto_curve(read(spark, d, "customer"), "c_nationkey", "c_acctbal")


@query(
    f"""WITH s AS (SELECT coalesce(CAST(c_nationkey AS VARCHAR), '(null)') AS segment, {_money('c_acctbal')} AS total FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, segment) AS r FROM s)
SELECT CASE WHEN r <= 8 THEN segment ELSE 'Others' END AS segment, round(sum(total), 2) AS total FROM r GROUP BY 1"""
)
def others_bucket(spark, d):
    return verbs.others(read(spark, d, "customer"), "c_nationkey", "c_acctbal", 8)


@query(
    f"""WITH q AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS p FROM orders), l AS (SELECT DISTINCT p FROM q ORDER BY p DESC LIMIT 2),
g AS (SELECT p, date_diff('day', p, CAST(o_orderdate AS DATE)) + 1 AS day, {_money('o_totalprice')} AS v FROM q WHERE p IN (SELECT p FROM l) GROUP BY 1, 2)
SELECT p AS period, CAST(day AS BIGINT) AS day, round(sum(v) OVER (PARTITION BY p ORDER BY day), 2) AS running FROM g"""
)
def pace_cumulative(spark, d):
    return analytics.pace(read(spark, d, "orders"), "o_orderdate", "o_totalprice")


def _yoy(year: str) -> str:
    return f"""WITH g AS (SELECT CAST({year} AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, {_money('o_totalprice')} AS total FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, lag(total) OVER m AS b, year - lag(year) OVER m AS gap FROM g WINDOW m AS (PARTITION BY month ORDER BY year))
SELECT year, month, total, CASE WHEN gap = 1 THEN round(100.0 * (total - b) / abs(b), 6) END AS change_pct FROM l"""


@query(_yoy("year(o_orderdate)"))
def yoy_calendar(spark, d):
    return analytics.year_over_year(read(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query(_yoy("year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END"))
def yoy_fiscal(spark, d):
    return analytics.year_over_year(read(spark, d, "orders"), "o_orderdate", "o_totalprice", 4)


@query(
    f"""WITH g AS (SELECT CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday, {_money('o_totalprice')} AS total, count(*) AS n FROM orders GROUP BY 1)
SELECT *, round(100.0 * total / sum(total) OVER (), 6) AS share_pct FROM g"""
)
def seasonality_weekday(spark, d):
    return analytics.seasonality(read(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def heat_dow_hour(spark, d):
    return charts.heat(read(spark, d, "events"), "ts")


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), f AS (SELECT *, min(m) OVER (PARTITION BY e) AS cohort FROM e),
g AS (SELECT cohort, CAST(date_diff('month', cohort, m) AS BIGINT) AS "offset", count(*) AS entities FROM f WHERE date_diff('month', cohort, m) <= 6 GROUP BY 1, 2)
SELECT *, round(100.0 * entities / max(CASE WHEN "offset" = 0 THEN entities END) OVER (PARTITION BY cohort), 6) AS retention_pct FROM g"""
)
def cohort_retention(spark, d):
    return analytics.cohorts(read(spark, d, "orders"), "o_orderdate", "o_custkey")


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS e, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT e, date_diff('day', lag(d) OVER (PARTITION BY e ORDER BY d), d) AS gap FROM e),
o AS (SELECT e, count(gap) AS again FROM g GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (WHERE again > 0) AS repeaters, round(100.0 * count(*) FILTER (WHERE again > 0) / count(*), 6) AS repeat_pct, (SELECT CAST(median(gap) AS DOUBLE) FROM g) AS median_gap FROM o"""
)
def cohort_repeat_gap(spark, d):
    return analytics.repeat_gap(read(spark, d, "orders"), "o_orderdate", "o_custkey")


@query(
    f"""WITH {_SERIES.replace("AS value, count(*) AS n", "AS target, CAST(count(*) AS DOUBLE) AS driver")},
l AS (SELECT target, lag(driver, 1) OVER o AS d1, lag(driver, 2) OVER o AS d2, lag(driver, 3) OVER o AS d3, lag(driver, 4) OVER o AS d4 FROM ser WINDOW o AS (ORDER BY period))
SELECT CAST(1 AS BIGINT) AS lag, count(d1) AS n, round(corr(d1, target), 6) AS r FROM l UNION ALL SELECT 2, count(d2), round(corr(d2, target), 6) FROM l
UNION ALL SELECT 3, count(d3), round(corr(d3, target), 6) FROM l UNION ALL SELECT 4, count(d4), round(corr(d4, target), 6) FROM l"""
)
def driver_lag(spark, d):
    return analytics.driver_lags(_series(spark, d).select("period", F.col("value").alias("target"), F.col("n").cast("double").alias("driver")))


_PAIR = "SELECT '{0}' AS a, '{1}' AS b, round(corr(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE)), 6) AS r FROM lineitem"


@query(" UNION ALL ".join(_PAIR.format(a, b) for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def corr_pearson(spark, d):
    return stats.pearson(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS rho FROM r"""
)
def corr_spearman(spark, d):
    return stats.spearman(read(spark, d, "lineitem"), "l_quantity", "l_discount")


@query(
    f"""WITH m AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS s FROM lineitem),
g AS (SELECT count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.5) AS median, {_money('l_extendedprice')} / count(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.9) AS p90, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 skewness(l_extendedprice) AS skew, count(*) FILTER (WHERE abs((l_extendedprice - m.a) / m.s) > 3) AS outliers FROM lineitem, m)
SELECT n, round(median, 4) AS median, round(mean, 4) AS mean, round(p90, 4) AS p90, min, max, round(skew, 4) AS skew, outliers, CASE WHEN skew > 1 THEN 'right-skewed' WHEN skew < -1 THEN 'left-skewed' ELSE 'balanced' END AS shape FROM g"""
)
def distribution_stats(spark, d):
    return analytics.distribution(read(spark, d, "lineitem"), "l_extendedprice").withColumns({c: F.round(c, 4) for c in ("mean", "median", "p90", "skew")})


@query("WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(40, greatest(10, count(o_totalprice) // 15)) AS k FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1) AS BIGINT) AS bin, count(*) AS n FROM orders, r GROUP BY 1")
def histogram_bins(spark, d):
    return verbs.histogram(read(spark, d, "orders"), "o_totalprice")


@query("WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem) SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 10)), 9) AS BIGINT) AS bx, CAST(least(floor((l_discount - y0) / ((y1 - y0) / 10)), 9) AS BIGINT) AS by, count(*) AS n FROM lineitem, r GROUP BY 1, 2")
def density_2d(spark, d):
    return verbs.density(read(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND NOT coalesce(contains(lower(o_orderpriority), 'urgent'), false) AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def filter_ops(spark, d):
    o = verbs.where(verbs.where(read(spark, d, "orders"), "o_totalprice", ">=", "100000"), "o_orderpriority", "not contains", "URGENT")
    return verbs.between_dates(o, "o_orderdate", "1996-01-01", "1996-12-31").select("o_orderkey", "o_totalprice")


@query("WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer) SELECT c_custkey, coalesce(x, (SELECT median(x) FROM n)) AS x FROM n")
def fill_missing(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    return verbs.fill_missing(c, "x", "median")


@query("WITH g AS (SELECT lang, source, text, count(*) AS n FROM documents GROUP BY 1, 2, 3) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates FROM g")
def dedupe(spark, d):
    return verbs.duplicates(read(spark, d, "documents").select("lang", "source", "text"))


@query(
    f"""SELECT l_returnflag, l_linestatus, {_money('l_extendedprice')} AS sum, round({_money('l_extendedprice')} / count(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, max(l_extendedprice) AS max, min(l_extendedprice) AS min,
 count(l_extendedprice) AS count, round(stddev_samp(l_extendedprice), 2) AS std, round(var_samp(l_extendedprice), 0) AS var, count(DISTINCT l_extendedprice) AS nunique, arg_min(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 1000000.0 + l_extendedprice) AS first, arg_max(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 1000000.0 + l_extendedprice) AS last
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2"""
)
def groupby_11(spark, d):
    out = verbs.group(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", ["sum", "mean", "median", "max", "min", "count", "std", "var", "nunique", "first", "last"], (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000.0 + F.col("l_extendedprice"))
    return out.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4), "std": F.round("std", 2), "var": F.round("var", 0)})


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def value_counts(spark, d):
    return verbs.value_counts(read(spark, d, "events"), "event_type", 3)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, d):
    return verbs.crosstab(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


def _resampled(unit: str) -> str:
    return f"""WITH g AS (SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS bucket, {_money('o_totalprice')} AS s, count(o_totalprice) AS c, max(o_totalprice) AS mx, min(o_totalprice) AS mn FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series((SELECT min(bucket) FROM g), (SELECT max(bucket) FROM g), INTERVAL 1 {unit})) AS DATE) AS bucket)
SELECT sp.bucket, coalesce(s, 0.0) AS sum, coalesce(c, 0) AS count, round(s / c, 6) AS mean, mx AS max, mn AS min FROM sp LEFT JOIN g ON sp.bucket = g.bucket"""


@query(_resampled("day"))
def resample_dense(spark, d):
    """All orders by day; small tables have days without orders. Gaps have a test of their own."""
    return verbs.resample(read(spark, d, "orders"), "o_orderdate", "o_totalprice", "D").withColumn("mean", F.round("mean", 6))


@query(_resampled("month"))
def resample_orders(spark, d):
    return verbs.resample(read(spark, d, "orders"), "o_orderdate", "o_totalprice", "M").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_SERIES} SELECT period, value, round(avg(value) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling FROM ser")
def rolling_mean(spark, d):
    return verbs.rolling_mean(_series(spark, d), 7)


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM events")
def forward_fill(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("x"))
    return verbs.forward_fill(e, "x", ["user_id"], "event_id")


@query("SELECT l_returnflag AS flag, 'quantity' AS period, sum(l_quantity) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'lines', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1")
def unpivot_columns(spark, d):
    wide = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    return verbs.unpivot_months(wide, ["flag"], ["quantity", "lines"])


@query("SELECT count(o_totalprice) AS n, round((avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(o_totalprice))), 6) AS t FROM orders")
def ttest_1s(spark, d):
    return stats.t_one_sample(read(spark, d, "orders"), "o_totalprice", 150000)


@query(
    """WITH g AS (SELECT count(*) FILTER (WHERE l_linestatus = 'O') AS n0, count(*) FILTER (WHERE l_linestatus = 'F') AS n1, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS m0, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS m1,
 var_samp(l_quantity) FILTER (WHERE l_linestatus = 'O') AS v0, var_samp(l_quantity) FILTER (WHERE l_linestatus = 'F') AS v1 FROM lineitem)
SELECT n0, n1, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS t FROM g"""
)
def ttest_2s(spark, d):
    return stats.t_two_sample(read(spark, d, "lineitem"), "l_quantity", "l_linestatus", "O", "F")


@query(
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT x, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT y, sum(o) AS k FROM c GROUP BY 1),
t AS (SELECT sum(o) AS t FROM c), g AS (SELECT coalesce(c.o, 0) AS o, CAST(r.r * k.k AS DOUBLE) / t.t AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.x = r.x AND c.y = k.y)
SELECT CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS dof, round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM g"""
)
def chi2(spark, d):
    return stats.chi_square(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g)
SELECT k, CAST(n AS BIGINT) AS n, round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 4) AS f FROM t"""
)
def anova_f(spark, d):
    return stats.anova(read(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_fit(spark, d):
    return stats.ols(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query(
    f"""WITH {_SERIES}, i AS (SELECT period, value, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS i FROM ser),
f AS (SELECT max(period) AS last, count(*) AS n, regr_slope(value, i) AS b, regr_intercept(value, i) AS a, sqrt(var_pop(value) * (1 - regr_r2(value, i))) AS sd FROM i), h AS (SELECT unnest(generate_series(1, 4)) AS step)
SELECT CAST(step AS BIGINT) AS step, CAST(last + CAST(step * 91 AS INTEGER) AS DATE) AS period, round(a + b * (n - 1 + step), 2) AS mean, round(a + b * (n - 1 + step) - 1.96 * sd, 2) AS lower, round(a + b * (n - 1 + step) + 1.96 * sd, 2) AS upper FROM f, h"""
)
def forecast_linear(spark, d):
    return analytics.linear_forecast(_series(spark, d), 4, 91)


_JOIN_SQL = "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM {0} GROUP BY o_orderpriority"


@query(_JOIN_SQL.format("lineitem JOIN orders ON l_orderkey = o_orderkey"))
def sql_box_join(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("box_orders")
    return sqlbox.ask(read(spark, d, "lineitem"), _JOIN_SQL.format("data JOIN box_orders ON l_orderkey = o_orderkey"))


_ROLLUP = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {0} GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@query(_ROLLUP.format("lineitem"))
def sql_box_rollup(spark, d):
    return sqlbox.ask(read(spark, d, "lineitem"), _ROLLUP.format("data"))


_SETS = "SELECT c_nationkey AS k FROM {0} WHERE c_acctbal < 0 EXCEPT SELECT c_nationkey FROM {0} WHERE c_acctbal > 9900"


@query(_SETS.format("customer"))
def sql_box_setops(spark, d):
    return sqlbox.ask(read(spark, d, "customer"), _SETS.format("data"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), g AS (SELECT d, date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM d)
SELECT count(*) AS days, CAST(median(gap) AS DOUBLE) AS median_gap, CAST(max(gap) AS BIGINT) AS longest FROM g"""
)
def audit_gaps(spark, d):
    return audit.day_gaps(read(spark, d, "events"), "ts")


@query("SELECT count(DISTINCT l_shipmode) AS raw, count(DISTINCT lower(trim(l_shipmode))) AS folded, count(*) FILTER (WHERE c_acctbal < 0) AS negatives FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || ' ' ELSE lower(c_mktsegment) END AS l_shipmode, c_acctbal FROM customer)")
def audit_case_fold(spark, d):
    c = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" "))).otherwise(F.lower("c_mktsegment")).alias("s"), "c_acctbal")
    return audit.folding(c, "s").crossJoin(c.agg(F.count_if(F.col("c_acctbal") < 0).alias("negatives")))  # one row each


_PROFILE = {"o_orderkey": "orders", "o_totalprice": "orders", "o_orderstatus": "orders", "o_orderpriority": "orders"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 4) AS ratio FROM {t}" for c, t in _PROFILE.items()))
def profile_columns(spark, d):
    """Four columns; profile_table has every one."""
    return audit.cell_profile(read(spark, d, "orders"), list(_PROFILE))


@query("SELECT col, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS nulls, count(DISTINCT v) AS n_unique, round(count(DISTINCT v) / CAST(count(*) AS DOUBLE), 4) AS ratio FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM orders) UNPIVOT INCLUDE NULLS (v FOR col IN (COLUMNS(*))) GROUP BY col")
def profile_table(spark, d):
    return audit.cell_profile(read(spark, d, "orders"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderstatus, CASE WHEN month(o_orderdate) = 3 THEN NULL ELSE o_orderdate END AS d,
  CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN NULL ELSE o_totalprice END AS x, o_totalprice - 50000 AS q,
  CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE o_orderpriority END AS s, 1 AS k FROM orders),
u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE o_orderstatus = 'P'),
n AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS dup, count(*) FILTER (WHERE x IS NULL) AS miss, count(*) FILTER (WHERE q < 0) AS neg,
  count(DISTINCT s) - count(DISTINCT lower(trim(s))) AS odd FROM u),
g AS (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM (SELECT DISTINCT CAST(d AS DATE) AS d FROM u WHERE d IS NOT NULL)),
b AS (SELECT count(*) AS big FROM g WHERE gap > greatest(7, 6 * (SELECT median(gap) FROM g))),
i AS (SELECT 'duplicates' AS issue, NULL AS field, CASE WHEN dup > 0.05 * n THEN 'high' WHEN dup > 0.01 * n THEN 'medium' WHEN dup > 0 THEN 'low' END AS severity, dup AS affected FROM n
  UNION ALL SELECT 'missing', 'x', CASE WHEN miss > 0.2 * n THEN 'high' WHEN miss > 0.02 * n THEN 'medium' END, miss FROM n
  UNION ALL SELECT 'negative', 'q', CASE WHEN neg > 0 THEN 'medium' END, neg FROM n
  UNION ALL SELECT 'inconsistent', 's', CASE WHEN odd > 0 THEN 'medium' END, odd FROM n
  UNION ALL SELECT 'constant', NULL, 'low', 1
  UNION ALL SELECT 'gap', 'd', CASE WHEN big > 0 THEN 'medium' END, big FROM b)
SELECT issue, field, severity, affected, CAST(greatest(0, 100 - sum(CASE severity WHEN 'high' THEN 18 WHEN 'medium' THEN 8 ELSE 3 END) OVER ()) AS BIGINT) AS score FROM i WHERE severity IS NOT NULL"""
)
def audit_score(spark, d):
    """Orders with what an audit looks for: repeats, empty prices, mixed spelling, a column of one value, months without dates."""
    t = read(spark, d, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.month("o_orderdate") != 3, F.col("o_orderdate")).alias("d"),
        F.when(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.col("o_totalprice")).alias("x"),
        (F.col("o_totalprice") - 50000).alias("q"),
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("s"),
        F.lit(1).alias("k"),
    )
    found = audit.audit(t.unionByName(t.where("o_orderstatus = 'P'")), ["x"], ["q"], "d")
    return found.withColumnsRenamed({"check": "issue", "column": "field"})


@query(
    """SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice - 150000 AS DECIMAL(18,2))) AS DOUBLE) AS total,
CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day FROM orders GROUP BY 1"""
)
def ingest_delimited(spark, d):
    """Orders written as delimited text with day-first dates and bracketed amounts, and read back by the ingest."""
    x = F.col("o_totalprice") - 150000
    money = F.concat(F.lit("$"), F.format_number(F.abs(x), 2))
    text = read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order ID"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Order Date"),
        F.col("o_orderpriority").alias("Priority"),
        F.when(x < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money).alias("Net Amount"),
    )
    path = delimited.staging_path(spark, "orders-text")
    text.write.csv(path, sep=";", header=True)
    got = delimited.load(spark, path).df
    return got.groupBy(F.col("Priority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("Net Amount").cast("decimal(18,2)")).cast("double").alias("total"),
        F.min(F.to_date("Order Date")).cast("string").alias("first_day"),
        F.max(F.to_date("Order Date")).cast("string").alias("last_day"),
    )


@query(
    """WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1),
t AS (SELECT *, (row_number() OVER (ORDER BY period) - 1) % 12 AS phase, CASE WHEN count(*) OVER w = 13 THEN (sum(value) OVER w - 0.5 * (lag(value, 6) OVER (ORDER BY period) + lead(value, 6) OVER (ORDER BY period))) / 12 END AS trend
  FROM m WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
p AS (SELECT phase, avg(value - trend) AS a FROM t GROUP BY 1)
SELECT CAST(period AS VARCHAR) AS period, round(value, 2) AS value, round(trend, 2) AS trend, round(a - (SELECT avg(a) FROM p), 2) AS seasonal, round(value - trend - (a - (SELECT avg(a) FROM p)), 2) AS resid FROM t JOIN p USING (phase)"""
)
def seasonal_decompose(spark, d):
    m = read(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("period")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    s = series.decompose(m, 12)
    return s.select(F.col("period").cast("string").alias("period"), *(F.round(c, 2).alias(c) for c in ("value", "trend", "seasonal", "resid")))


@query("SELECT c_custkey, round(z, 4) AS z FROM (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z FROM customer) WHERE abs(z) > 1.6")
def zscore_outliers(spark, d):
    return series.outliers(read(spark, d, "customer"), "c_acctbal", 1.6).select("c_custkey", F.round("z", 4).alias("z"))


@query()
def kmeans_parts(spark, d):
    """No SQL fits clusters; tested by what must hold of any clustering."""
    return series.kmeans(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 4)


# --- every preset on bound columns of order lines

for _key, _preset in catalog.PRESETS.items():

    def _run(spark, d, preset=_preset):
        return packs.pack(spark, d, preset)

    _run.__name__ = f"preset_{_key}"
    query(packs.oracle(_preset, _window, _money))(_run)


_RETAIL_LINES = "SELECT l_shipdate AS order_date, l_extendedprice AS net_amount, l_quantity AS qty, l_discount AS discount, l_orderkey AS order_id, concat('item ', l_partkey % 40) AS product_name, l_returnflag AS store FROM lineitem"


def _retail_lines(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_RETAIL_LINES)


@query()
def preset_rank(spark, d):
    """Presets by confidence for order lines with speaking names, and what the best one binds."""
    ranked = semantics.rank(semantics.profile(_retail_lines(spark, d)))
    return spark.createDataFrame([(r.preset.key, r.confidence, ", ".join(f"{f}={c}" for f, c in sorted(r.mapping.items()))) for r in ranked], "preset string, confidence int, mapping string")


@query()
def column_roles(spark, d):
    rows = semantics.profile(_retail_lines(spark, d)) + semantics.profile(read(spark, d, "documents")) + semantics.profile(read(spark, d, "customer"))
    return spark.createDataFrame([(c.name, c.role, c.rows, c.nulls) for c in rows], "col string, role string, n_rows long, nulls long")


@query()
def insight_cards(spark, d):
    df = _retail_lines(spark, d)
    bound = semantics.bind(df, "retail")
    kpis = kpi.pack(df, bound.preset.kpis, bound.mapping, semantics.when(bound.preset, bound.mapping)).collect()
    issues = audit.totals(df, ["net_amount"], ["qty"]).collect()
    found = insights.cards(df, bound.preset, bound.mapping, kpis, issues)
    return spark.createDataFrame([(c.kind, c.severity, c.headline, float(c.materiality)) for c in found], "kind string, severity string, headline string, materiality double")


@query()
def forecast_by_segment(spark, d):
    """Months of each order priority, a forecast for each; small series choose other models than long ones."""
    o = read(spark, d, "orders").where("o_orderdate IS NOT NULL")
    months = o.groupBy("o_orderpriority", F.to_date(F.trunc("o_orderdate", "month")).alias("period")).agg(periods.money("o_totalprice").alias("value"))
    return forecast.forecasts(months, 6, ["o_orderpriority"])


@query(
    f"""WITH {_window('lineitem', 'l_shipdate')}, g AS (SELECT {_slices('rev', lambda b: _money('l_extendedprice', b))}, {_slices('disc', lambda b: _money('l_discount', b))} FROM q, w),
r AS (SELECT 'total_revenue' AS key, rev_a AS value, 100.0 * (rev_c - rev_b) / abs(rev_b) AS delta_pct, true AS up FROM g UNION ALL SELECT 'discount_total', disc_a, 100.0 * (disc_c - disc_b) / abs(disc_b), false FROM g)
SELECT key, round(value, 4) AS value, round(delta_pct, 4) AS delta_pct, CASE WHEN abs(delta_pct) < 0.05 THEN 'flat' WHEN delta_pct > 0 THEN 'up' ELSE 'down' END AS direction,
 CASE WHEN abs(delta_pct) < 0.05 THEN 'stable' WHEN (delta_pct > 0) = up THEN 'favourable' ELSE 'adverse' END AS verdict FROM r"""
)
def report_scorecard(spark, d):
    kpis = [k for k in catalog.RETAIL.kpis if k.key in ("total_revenue", "discount_total")]
    out = analytics.scorecard(kpi.pack(read(spark, d, "lineitem"), kpis, RETAIL_MAP, "l_shipdate"))
    return out.withColumns({c: F.round(c, 4) for c in ("value", "delta_pct")})


@query(
    f"""WITH {_SERIES}, g AS (SELECT count(*) AS n, avg(value) AS mean, arg_max(period, value) AS best, arg_min(period, value) AS worst, 100 * stddev_samp(value) / abs(avg(value)) AS cv FROM ser)
SELECT n, round(mean, 2) AS mean, best, worst, round(cv, 4) AS cv, CASE WHEN cv <= 15 THEN 'stable' WHEN cv <= 40 THEN 'moderate' ELSE 'volatile' END AS steadiness FROM g"""
)
def report_trend_bands(spark, d):
    return analytics.trend_bands(_series(spark, d)).withColumns({"mean": F.round("mean", 2), "cv": F.round("cv", 4)})


@query(
    f"""WITH u AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS v, CAST(NULL AS DOUBLE) AS x, o_orderstatus AS s FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, NULL, o_orderpriority FROM orders
 {' '.join(f"UNION ALL SELECT '{c}', NULL, {c}, CAST({c} AS VARCHAR) FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice"))} UNION ALL SELECT 'o_orderdate', NULL, NULL, CAST(o_orderdate AS VARCHAR) FROM orders),
c AS (SELECT col, v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS r FROM c)
SELECT u.col, count(s) AS count, count(DISTINCT s) AS n_unique, (SELECT v FROM t WHERE t.col = u.col AND r = 1) AS top,
 CAST((SELECT n FROM t WHERE t.col = u.col AND r = 1) AS DOUBLE) AS freq, round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 2) AS p25, round(quantile_cont(x, 0.5), 2) AS p50, round(quantile_cont(x, 0.75), 2) AS p75, max(x) AS max
FROM u GROUP BY u.col"""
)
def describe_all(spark, d):
    out = verbs.describe(read(spark, d, "orders"))
    text = F.col("col").isin("o_orderstatus", "o_orderpriority")  # the text of numbers and times differs by engine
    return out.withColumns({"top": F.when(text, F.col("top")), "freq": F.when(text, F.col("freq").cast("double"))} | {c: F.round(c, 2) for c in ("mean", "std", "p25", "p50", "p75")})


@query("SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def slicer_choices(spark, d):
    return verbs.choices(read(spark, d, "lineitem"), "l_partkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE CAST(c_nationkey AS VARCHAR) IN ('1', '7', '24')")
def slicer_rows(spark, d):
    return verbs.among(read(spark, d, "customer"), "c_nationkey", ["1", "7", "24"]).select("c_custkey", "c_nationkey")


@query(
    """WITH k AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING count(*) >= 8 ORDER BY n DESC, c_nationkey LIMIT 12)
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM k)"""
)
def largest_groups(spark, d):
    return verbs.keep_groups(read(spark, d, "customer"), "c_nationkey").select("c_custkey", "c_nationkey")


@query(
    """WITH a AS (SELECT lang, source, text FROM documents), b AS (SELECT DISTINCT * FROM a WHERE source <> 'src0'),
r AS (SELECT 'rows' AS item, (SELECT count(*) FROM a) AS before, (SELECT count(*) FROM b) AS after UNION ALL SELECT 'columns', 3, 3
 UNION ALL SELECT 'missing', (SELECT count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE source IS NULL) + count(*) FILTER (WHERE text IS NULL) FROM a), (SELECT count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE source IS NULL) + count(*) FILTER (WHERE text IS NULL) FROM b)
 UNION ALL SELECT 'duplicates', (SELECT count(*) FROM a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a)), 0)
SELECT item, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(before - after AS BIGINT) AS removed FROM r"""
)
def summary_diff(spark, d):
    a = read(spark, d, "documents").select("lang", "source", "text")
    return verbs.summary_diff(a, a.where("source <> 'src0'").distinct())


@query(
    """WITH s AS (SELECT CAST(ts AS DATE) AS period, CAST(count(*) FILTER (WHERE event_id % 7 < 1 + day(ts) % 5) AS DOUBLE) AS value FROM events GROUP BY 1),
c AS (SELECT *, value / nullif(lag(value) OVER (ORDER BY period), 0) - 1 AS c FROM s), g AS (SELECT count(*) >= 10 AND stddev_samp(c) > 0.4 AS noisy FROM c)
SELECT period, value, CASE WHEN noisy AND count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS smooth FROM c, g WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
)
def smoothed_line(spark, d):
    days = read(spark, d, "events").groupBy(F.to_date("ts").alias("period")).agg(F.count_if(F.col("event_id") % 7 < 1 + F.dayofmonth("ts") % 5).cast("double").alias("value"))
    return verbs.smoothed(days).withColumn("smooth", F.round("smooth", 6))


@query(f"SELECT l_returnflag, l_linestatus, CAST(2 - (grouping(l_returnflag) + grouping(l_linestatus)) AS INTEGER) AS depth, {_money('l_extendedprice')} AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def hierarchy_sums(spark, d):
    return verbs.hierarchy(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("SELECT CAST(month(o_orderdate) AS BIGINT) AS month, " + ", ".join(f"{_money('o_totalprice', f'year(o_orderdate) = {y}')} AS \"{y}\"" for y in range(1995, 2002)) + " FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def pivot_years(spark, d):
    return verbs.pivot_years(read(spark, d, "orders"), "o_orderdate", "o_totalprice", list(range(1995, 2002)))


@query("SELECT o_totalprice, o_orderkey FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def largest_rows(spark, d):
    return verbs.largest(read(spark, d, "orders"), "o_totalprice", ["o_orderkey"])


@query("SELECT o_orderpriority, CAST(sum(CAST(round(o_totalprice * 0.0001, 4) AS DECIMAL(20,4))) AS DOUBLE) AS sum, count(*) AS count, round(var_samp(round(o_totalprice * 0.0001, 4)), 6) AS var FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def sums_of_four_decimals(spark, d):
    """Amounts of four decimals; the twin sums them in a type of its own."""
    o = read(spark, d, "orders").withColumn("x", F.round(F.col("o_totalprice") * 0.0001, 4))
    return verbs.group(o, ["o_orderpriority"], "x", ["sum", "count", "var"]).withColumn("var", F.round("var", 6))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - (b * l_quantity + a), 2) AS resid FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def ols_residuals(spark, d):
    return stats.residuals(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", F.round("resid", 2).alias("resid"))


@query(
    """WITH c AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS n FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1, 2),
d AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x), t AS (SELECT sum(n) AS n FROM c),
tx AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT CAST(t.n AS BIGINT) AS n, round(d.s / sqrt((t.n * (t.n - 1) / 2 - tx.v) * (t.n * (t.n - 1) / 2 - ty.v)), 6) AS tau FROM d, t, tx, ty"""
)
def corr_kendall(spark, d):
    return stats.kendall(read(spark, d, "part"), "p_size", "p_retailprice")


@query(
    f"""WITH u AS ({_ORACLES['kpi_universal']}), p AS ({_ORACLES['kpi_pareto']}),
l AS (UNPIVOT (SELECT total, mean, median, std, min, max, CAST(count AS DOUBLE) AS count, null_rate, cv, p25, p75, skew AS skewness, iqr, CAST(outliers AS DOUBLE) AS outliers FROM u) ON COLUMNS(*) INTO NAME key VALUE value)
SELECT 'universal' AS domain, key, round(value, 2) AS value FROM l UNION ALL SELECT 'sales', 'total_revenue', round(total, 2) FROM u UNION ALL SELECT 'sales', 'aov', round(mean, 2) FROM u
UNION ALL SELECT 'sales', 'rev_std', round(std, 2) FROM u UNION ALL SELECT 'sales', 'pareto', pareto FROM p"""
)
def kpi_selection(spark, d):
    """The column is chosen by its name among the numbers that the profile of orders finds."""
    o = read(spark, d, "orders")
    numbers = [c.name for c in semantics.profile(o) if c.role in ("continuous", "discrete")]
    return kpi.selection(o, kpi.target(numbers, "sales"), "sales").withColumn("value", F.round("value", 2))


@query()
def forecast_outlook(spark, d):
    """Tested against its own parts; SQL fits no such models."""
    return forecast.outlook(read(spark, d, "orders"), "o_orderdate", "o_totalprice")[0]


@query()
def chart_recommended(spark, d):
    found = charts.recommend(semantics.profile(_retail_lines(spark, d)))
    return spark.createDataFrame([(i, c.kind, c.title, c.x, c.y, c.color) for i, c in enumerate(found)], "place int, kind string, title string, x string, y string, color string")


@query(f"WITH {_SERIES} SELECT period, value FROM ser")
def chart_line(spark, d):
    return charts.marks(read(spark, d, "orders"), charts.Chart("line", "", "o_orderdate", "o_totalprice"))


@query(
    f"""WITH {_window('lineitem', 'l_shipdate')},
t AS (SELECT l_suppkey AS g FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY {_money('l_extendedprice')} DESC, CAST(l_suppkey AS VARCHAR) LIMIT 8)
SELECT p AS period, CASE WHEN l_suppkey IN (SELECT g FROM t) THEN CAST(l_suppkey AS VARCHAR) ELSE 'Others' END AS color, {_money('l_extendedprice')} AS value FROM q, k WHERE k.gone IS NULL OR p <> k.gone GROUP BY 1, 2"""
)
def chart_stacked(spark, d):
    return charts.marks(read(spark, d, "lineitem"), charts.Chart("stacked_bar", "", "l_shipdate", "l_extendedprice", "l_suppkey"))


@query("SELECT o_orderpriority AS segment, count(o_totalprice) AS n, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 2) AS p25, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(quantile_cont(o_totalprice, 0.75), 2) AS p75, max(o_totalprice) AS max FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1")
def chart_box(spark, d):
    out = charts.marks(read(spark, d, "orders"), charts.Chart("box", "", "o_orderpriority", "o_totalprice"))
    return out.withColumns({c: F.round(c, 2) for c in ("p25", "median", "p75")})


@query(
    f"""WITH {_window('orders', 'o_orderdate')}, t AS (SELECT o_orderpriority AS g FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY {_money('o_totalprice')} DESC, 1 LIMIT 4)
SELECT o_orderpriority AS segment, p AS period, {_money('o_totalprice')} AS value FROM q, k WHERE (k.gone IS NULL OR p <> k.gone) AND o_orderpriority IN (SELECT g FROM t) GROUP BY 1, 2"""
)
def exhibit_small_multiples(spark, d):
    return charts.small_multiples(read(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority")


@query(
    f"""SELECT key, delta_pct, CASE WHEN abs(delta_pct) < 0.05 THEN false WHEN key = 'discount_total' THEN delta_pct < 0 ELSE delta_pct > 0 END AS favourable FROM ({_ORACLES['kpi_pack_retail']}) WHERE delta_pct IS NOT NULL"""
)
def exhibit_tornado(spark, d):
    return charts.tornado(kpi.pack(read(spark, d, "lineitem"), catalog.RETAIL.kpis, RETAIL_MAP, "l_shipdate")).withColumn("delta_pct", F.round("delta_pct", 4))


@query(
    f"""WITH {_window('orders', 'o_orderdate')},
m AS (SELECT coalesce(o_orderpriority, '(null)') AS s, round(coalesce({_money('o_totalprice', 'p = cur')}, 0), 2) AS c, round(coalesce({_money('o_totalprice', 'p = prev')}, 0), 2) AS b FROM q, w WHERE p IN (cur, prev) GROUP BY 1),
r AS (SELECT s, c - b AS d, row_number() OVER (ORDER BY abs(round(c - b, 2)) DESC, s) AS step FROM m),
e AS (SELECT 0 AS step, 'previous' AS label, sum(b) AS d FROM m UNION ALL SELECT step, s, d FROM r), f AS (SELECT step, label, d, sum(d) OVER (ORDER BY step) AS stop FROM e)
SELECT CAST(step AS INTEGER) AS step, label, round(stop - d, 2) AS start, round(stop, 2) AS stop FROM f UNION ALL SELECT 7, 'current', 0.0, round(sum(c), 2) FROM m"""
)
def exhibit_waterfall(spark, d):
    o = read(spark, d, "orders")
    return charts.waterfall(o, "o_orderdate", "o_totalprice", "o_orderpriority", periods.bounds(o, "o_orderdate"))


@query(
    f"""WITH {_window('orders', 'o_orderdate')}, g AS (SELECT {_slices('m', lambda b: _money('o_totalprice', b))}, {_slices('v', lambda b: f'CAST(count(*) FILTER (WHERE {b}) AS DOUBLE)')} FROM q, w),
h AS (SELECT m_b AS m0, m_c AS m1, m_b + (v_c - v_b) * m_b / v_b AS mid FROM g)
SELECT 0 AS step, 'previous' AS label, 0.0 AS start, round(m0, 2) AS stop FROM h UNION ALL SELECT 1, 'volume', round(m0, 2), round(mid, 2) FROM h UNION ALL SELECT 2, 'rate', round(mid, 2), round(m1, 2) FROM h UNION ALL SELECT 3, 'current', 0.0, round(m1, 2) FROM h"""
)
def exhibit_effects(spark, d):
    o = read(spark, d, "orders")
    return charts.effects(o, "o_orderdate", "o_totalprice", None, periods.bounds(o, "o_orderdate"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def export_delimited(spark, d):
    """The orders written out and read back."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = delimited.staging_path(spark, "export")
    delimited.save(o, path)
    return spark.read.csv(path, header=True, schema=o.schema, escape='"')
