"""Presets bound to columns of order lines, and the SQL that says the same as a preset's KPIs.

The driver's tables have no names that presets would find, so the bindings are explicit. Lines are order lines with a few
columns made by plain expressions, which both engines read from the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpi, semantics
from ..operators.kpi import UNIT_DAYS
from ..sources import staging
from .catalog import Preset

AS_OF = "2002-01-01"
LINES = """SELECT l.*, o.*, l_extendedprice * l_tax AS tax_amount, l_extendedprice - 20000 AS net, date_add(o_orderdate, CAST(7 * l_linenumber AS INT)) AS due,
 CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Delivered' ELSE 'In transit' END AS delivery,
 CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'Open' ELSE 'No-show' END AS stage,
 CASE l_linestatus WHEN 'F' THEN 'monthly' ELSE 'one-time' END AS rhythm,
 CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'cancelled' ELSE 'trialing' END AS state,
 CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS left_on, CASE WHEN l_linestatus = 'F' THEN 'sold' ELSE 'available' END AS sale
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""
# DuckDB adds days to a timestamp in another way.
DUCK_LINES = LINES.replace("date_add(o_orderdate, CAST(7 * l_linenumber AS INT))", "CAST(o_orderdate AS DATE) + CAST(7 * l_linenumber AS INT)")

BINDINGS = {
    "retail": "order_date=l_shipdate revenue=l_extendedprice quantity=l_quantity product=l_partkey order_id=l_orderkey discount=l_discount customer_id=o_custkey store=l_returnflag",
    "sales_crm": "deal_value=l_extendedprice stage=stage created_date=o_orderdate close_date=l_shipdate owner=o_orderpriority account=o_custkey",
    "finance": "txn_date=l_shipdate amount=net account=l_suppkey type=l_linestatus",
    "hr": "employee_id=o_custkey department=o_orderpriority salary=l_extendedprice join_date=o_orderdate exit_date=left_on role=l_returnflag performance=l_quantity",
    "marketing": "date=l_shipdate spend=tax_amount impressions=l_extendedprice clicks=l_quantity conversions=l_linenumber conversion_value=l_extendedprice campaign=o_orderpriority channel=l_returnflag",
    "logistics": "ship_date=o_orderdate status=delivery delivery_date=l_shipdate cost=tax_amount weight=l_quantity destination=o_custkey shipment_id=l_orderkey",
    "manufacturing": "date=l_shipdate output_qty=l_extendedprice planned_qty=o_totalprice defect_qty=tax_amount machine=l_suppkey shift=l_linestatus downtime_min=l_quantity",
    "healthcare": "visit_date=o_orderdate department=o_orderpriority patient_id=o_custkey doctor=l_suppkey revenue=l_extendedprice status=stage discharge_date=l_shipdate",
    "education": "student_id=o_custkey class_group=o_orderpriority score=l_quantity date=l_shipdate attendance=l_discount fee_paid=l_extendedprice fee_due=tax_amount",
    "real_estate": "unit_id=l_orderkey price=l_extendedprice status=sale area_sqft=l_quantity project=o_orderpriority date=l_shipdate",
    "hospitality": "date=l_shipdate revenue=l_extendedprice item=l_partkey order_id=l_orderkey channel=o_orderpriority quantity=l_quantity discount=l_discount",
    "saas": "customer_id=o_custkey mrr_amount=l_extendedprice start_date=o_orderdate cancel_date=left_on plan=o_orderpriority status=state",
    "lending": "loan_id=l_orderkey principal=l_extendedprice disbursal_date=l_shipdate outstanding=tax_amount dpd=l_quantity branch=o_orderpriority emi_due=o_totalprice emi_paid=l_extendedprice",
    "energy": "timestamp=l_shipdate energy_kwh=l_extendedprice site=l_suppkey expected_kwh=o_totalprice cost=tax_amount demand_kw=l_quantity",
    "nonprofit": "date=l_shipdate amount=l_extendedprice donor_id=o_custkey program=o_orderpriority type=rhythm beneficiaries=l_quantity",
}


def mapping(preset: Preset) -> dict[str, str]:
    return dict(pair.split("=") for pair in BINDINGS[preset.key].split())


def pack(spark: SparkSession, sf_dir: str, preset: Preset) -> DataFrame:
    for table in ("lineitem", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    bound = mapping(preset)
    # Orders and lines are read and joined once; periods, sums, values and medians scan what is settled, a column or two each.
    lines = staging.settle(spark.sql(LINES).select(*sorted(set(bound.values()))))
    out = kpi.pack(lines, preset.kpis, bound, semantics.when(preset, bound), F.lit(AS_OF).cast("timestamp_ntz"))
    return out.select("key", *(F.round(c, 4).alias(c) for c in ("value", "previous", "delta_pct")))


def oracle(preset: Preset, window: Callable[[str, str], str], money: Callable[..., str]) -> str:
    """DuckDB SQL of pack(): each KPI of each slice as a column, then a row for each KPI."""
    bound = mapping(preset)
    when = semantics.when(preset, bound)
    specs = {k.key: k for k in preset.kpis}
    columns: list[str] = []

    def value(key: str, s: str) -> str | None:
        k, by = specs[key], {"a": "true", "c": "p = cur", "b": "p = prev"}[s]
        p, x = k.params, bound.get(k.params.get("field", ""))
        n = f"CAST(count(*) FILTER (WHERE {by}) AS DOUBLE)"
        if k.kind in ("sum", "mean", "median", "max"):
            if x is None:
                return None
            keep = by + (f" AND {x} > 0" if p.get("positive_only") else "") + (f" AND {x} < 0" if p.get("negative_only") else "")
            if p.get("where_field") in bound:
                keep += f" AND {hit(bound[p['where_field']], p['where_values'])}"
            f = f"FILTER (WHERE {keep})"
            sql = {"sum": money(x, keep), "mean": f"{money(x, keep)} / nullif(count({x}) {f}, 0)", "median": f"quantile_cont({x}, 0.5) {f}", "max": f"CAST(max({x}) {f} AS DOUBLE)"}[k.kind]
            return f"({sql}) * {p.get('scale', 1.0)!r}"
        if k.kind == "distinct":
            return f"CAST(count(DISTINCT {x}) FILTER (WHERE {by}) AS DOUBLE)" if x else n if p.get("fallback_rows") else None
        if k.kind == "rows":
            return n
        if k.kind == "ratio_fields":
            a, b = bound.get(p["num_field"]), bound.get(p["den_field"])
            return f"{100.0 if p.get('as_percent') else 1.0} * {money(a, by)} / nullif({money(b, by)}, 0)" if a and b else None
        if k.kind in ("rate", "rate_notnull"):
            if x is None:
                return None
            test = hit(x, p["values"]) if k.kind == "rate" else f"{x} IS NOT NULL"
            share = f"100.0 * count(*) FILTER (WHERE {by} AND {test}) / nullif({n}, 0)"
            return f"CASE WHEN count({x}) FILTER (WHERE {by}) > 0 THEN {share} END" if k.kind == "rate" else share
        if k.kind == "date_diff":
            a, b = bound.get(p["start"]), bound.get(p["end"])
            if a is None or b is None and not p.get("open_end"):
                return None
            end = f"coalesce({b}, TIMESTAMP '{AS_OF}')" if b and p.get("open_end") else b or f"TIMESTAMP '{AS_OF}'"
            days = f"date_diff('day', CAST({a} AS DATE), CAST({end} AS DATE))"
            f = f"FILTER (WHERE {by} AND {days} >= 0)"
            return f"CAST(sum({days}) {f} AS DOUBLE) / nullif(count({days}) {f}, 0) / {UNIT_DAYS[p.get('unit', 'days')]!r}"
        if k.kind == "share_where_num":
            v, c = bound.get(p["value_field"]), bound.get(p["cond_field"])
            return f"100.0 * coalesce({money(v, f'{by} AND {c} {p['op']} {p['threshold']}')}, 0) / nullif({money(v, by)}, 0)" if v and c else None
        if k.kind == "ratio":
            top, parts = value(p["num"], s), [value(x, s) for x in p.get("den_sum", [p.get("den")])]
            parts = [f"coalesce({x}, 0)" for x in parts if x]
            return f"{100.0 if p.get('as_percent') else 1.0} * ({top}) / nullif({' + '.join(parts)}, 0)" if top and parts else None
        return None

    def hit(x: str, values: list[str]) -> str:
        listed, words = ", ".join(f"'{v}'" for v in values), "|".join(v.replace("-", "\\-") for v in values)
        return f"coalesce(lower(trim({x})) IN ({listed}) OR regexp_matches(lower(trim({x})), '\\b({words})\\b'), false)"

    rows = []
    for k in preset.kpis:
        if k.kind == "growth":
            a, b = value(k.params["kpi"], "c"), value(k.params["kpi"], "b")
            if a and b:
                columns.append(f"100.0 * (({a}) - ({b})) / abs(nullif({b}, 0)) AS {k.key}_a")
                rows.append(f"SELECT '{k.key}' AS key, {k.key}_a AS value, NULL AS previous, NULL AS delta_pct FROM g")
        elif k.kind == "top_share":
            by, x = bound.get(k.params["by"]), bound.get(k.params["field"])
            if by and x:
                t = f"SELECT {money(f'abs({x})' if k.params.get('absolute') else x)} AS s FROM lines WHERE {by} IS NOT NULL GROUP BY {by}"
                rows.append(f"SELECT '{k.key}', 100.0 * (SELECT sum(s) FROM (SELECT s FROM ({t}) ORDER BY s DESC LIMIT {k.params.get('n', 10)})) / (SELECT sum(s) FROM ({t})), NULL, NULL")
        elif value(k.key, "a"):
            columns += [f"{value(k.key, s)} AS {k.key}_{s}" for s in ("acb" if when else "a")]
            move = f"{k.key}_b, 100.0 * ({k.key}_c - {k.key}_b) / abs(nullif({k.key}_b, 0))" if when else "NULL, NULL"
            rows.append(f"SELECT '{k.key}', {k.key}_a, {move} FROM g")
    rows[0] = rows[0].replace(f"SELECT '{preset.kpis[0].key}', {preset.kpis[0].key}_a, ", f"SELECT '{preset.kpis[0].key}' AS key, {preset.kpis[0].key}_a AS value, ", 1)
    body = " UNION ALL ".join(rows)
    head = f"lines AS ({DUCK_LINES}), {window('lines', when)}, g AS (SELECT {', '.join(columns)} FROM q, w)"
    return f"WITH {head}, r(key, value, previous, delta_pct) AS ({body}) SELECT key, round(value, 4) AS value, round(previous, 4) AS previous, round(delta_pct, 4) AS delta_pct FROM r WHERE value IS NOT NULL"
