"""Insight cards: what stands out in a table under a preset, by materiality.

Each finding comes from aggregates; what the driver sees is one period series, the KPI rows, and the few groups that a
card is about.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.catalog import Preset
from . import analytics, forecast, periods, semantics, stats

MOST, LEAST_GROUP, LEAST_ROWS = 7, 8, 6
UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter"}


@dataclass(frozen=True)
class Card:
    kind: str
    severity: str
    headline: str
    materiality: float
    evidence: dict[str, Any] = field(default_factory=dict)


def period_series(df: DataFrame, preset: Preset, mapping: Mapping[str, str]) -> tuple[DataFrame, periods.Window] | None:
    """The main metric (or the rows) by period without a partial last one; None below LEAST_ROWS dated rows."""
    when = semantics.when(preset, mapping)
    if not when or df.where(F.col(when).isNotNull()).limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None
    w = periods.bounds(df, when)
    value = periods.money(mapping[preset.metric]) if preset.metric in mapping else F.count(F.lit(1)).cast("double")
    return periods.series(df, when, value, w.grain, w), w


def trend_card(y: np.ndarray, grain: str, label: str) -> Card | None:
    """The last ten periods without their season climb or fall by 2 % of their mean a period, at p of 0.05 or less."""
    if len(y) < 5:
        return None
    last = forecast.deseasonalised(y, grain)[-10:]
    at, mean = np.arange(len(last)), last.mean()
    r = np.corrcoef(at, last)[0, 1] if last.std() > 0 else 0.0
    slope = np.polyfit(at, last, 1)[0]
    t = r * np.sqrt((len(last) - 2) / max(1e-300, 1 - r * r))
    p = stats.t_p_value(float(t), len(last) - 2)
    if mean == 0 or p > 0.05 or abs(pct := 100 * slope / abs(mean)) < 2:
        return None
    return Card("trend", "good" if slope > 0 else "warn", f"{label} {'rises' if slope > 0 else 'falls'} by about {abs(pct):.1f} % a {UNIT[grain]}", min(10.0, abs(pct)), {"slope_pct": float(pct), "p": p})


def attribution(df: DataFrame, preset: Preset, mapping: Mapping[str, str], grain: str, period) -> Row | None:
    """dim, segment, share of the segment that holds most of a period's value, over four dimensions at most, in one grouping."""
    dims = [mapping[f.name] for f in preset.fields if f.role == "categorical" and f.name in mapping][:4]
    when = semantics.when(preset, mapping)
    if not dims or preset.metric not in mapping:
        return None
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"`{d}`").cast("string").alias("segment")) for d in dims))
    rows = df.where(periods.within(df, when, period, grain)).select(F.col(mapping[preset.metric]).alias("v"), F.explode(pairs).alias("s")).where("s.segment is not null")
    sums = rows.groupBy("s.dim", "s.segment").agg(F.abs(periods.money("v")).alias("v"))
    total = sums.groupBy("dim").agg(F.sum("v").alias("t"))
    return sums.join(F.broadcast(total), "dim").select("dim", "segment", (F.col("v") / F.nullif("t", F.lit(0.0))).alias("share")).orderBy(F.desc_nulls_last("share"), "dim", "segment").first()


def anomaly_cards(df: DataFrame, series: DataFrame, n: int, preset: Preset, mapping: Mapping[str, str], grain: str, label: str) -> list[Card]:
    """Up to three periods 2.5 deviations or more from the median around them; needs eight periods."""
    if n < 8:
        return []
    out = []
    for r in analytics.rolling_anomalies(series).where("anomaly").orderBy(F.desc(F.abs("z")), "period").limit(3).collect():
        top = attribution(df, preset, mapping, grain, r.period)
        why = f"; '{top.segment}' ({top.dim}) holds {100 * top.share:.0f} % of it" if top and (top.share or 0) > 0.4 else ""
        out.append(Card("anomaly", "warn", f"{'Spike' if r.z > 0 else 'Drop'} of {label} in the {UNIT[grain]} of {r.period}, {abs(r.z):.1f} deviations from its neighbours{why}", min(10.0, 2 * abs(r.z)), {"period": r.period, "z": r.z}))
    return out


def variance_cards(kpis: Sequence[Row]) -> list[Card]:
    """KPIs that moved by 10 % or more; their polarity says whether that is good."""
    out = []
    for k in kpis:
        if k.delta_pct is not None and abs(k.delta_pct) >= 10:
            good = (k.delta_pct > 0) == (k.polarity == "up_good")
            severity = "info" if k.polarity == "neutral" else "good" if good else "risk"
            out.append(Card("variance", severity, f"{k.key} moved by {k.delta_pct:+.1f} % against the period before", min(10.0, abs(k.delta_pct) / 5), {"kpi": k.key, "delta_pct": k.delta_pct}))
    return out


def concentration_card(kpis: Sequence[Row]) -> Card | None:
    """The first KPI with share in its key of 60 % or more."""
    for k in kpis:
        if "share" in k.key and k.value is not None and k.value >= 60:
            return Card("concentration", "warn", f"{k.key} is {k.value:.0f} %", min(10.0, (k.value - 50) / 5), {"kpi": k.key, "share": k.value})
    return None


def leader_card(df: DataFrame, preset: Preset, mapping: Mapping[str, str]) -> Card | None:
    """Best and last group of the first dimension with three groups or more of LEAST_GROUP rows."""
    if preset.metric not in mapping:
        return None
    for dim in (mapping[f.name] for f in preset.fields if f.role == "categorical" and f.name in mapping):
        sums = df.where(F.col(f"`{dim}`").isNotNull()).groupBy(F.col(f"`{dim}`").cast("string").alias("g")).agg(periods.money(mapping[preset.metric]).alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_GROUP)
        s = sums.agg(F.count(F.lit(1)).alias("groups"), F.sum("v").alias("total"), F.max_by("g", F.struct("v", "g")).alias("top"), F.max("v").alias("most"), F.min_by("g", F.struct("v", "g")).alias("bottom")).first()
        if s.groups >= 3 and s.total:
            share = 100 * s.most / s.total
            return Card("leader", "info", f"'{s.top}' leads {dim} with {share:.0f} %", min(8.0, share / 10), {"dimension": dim, "top": s.top, "bottom": s.bottom, "share": share})
    return None


def quality_cards(issues: Sequence[Row]) -> list[Card]:
    return [Card("dq_warning", "risk", f"{i.check}{' in ' + i.column if i.column else ''}: {i.affected} affected", 6.0, {"check": i.check, "column": i.column}) for i in issues if i.severity == "high"]


def context(found: Sequence[Card]) -> str:
    """The cards as lines of text that hold aggregates only, no rows: for whoever writes the story."""
    told = (f"- {c.kind} ({c.severity}, weight {c.materiality:.1f}): {c.headline}" for c in found)
    return "\n".join(["Findings, each past its statistical gate:", *told])


def cards(df: DataFrame, preset: Preset, mapping: Mapping[str, str], kpis: Sequence[Row], issues: Sequence[Row] = (), most: int = MOST) -> list[Card]:
    """The `most` most material cards; of equal ones the earlier. kpis: rows of kpi.pack; issues: rows of audit.audit."""
    out = quality_cards(issues)
    found = period_series(df, preset, mapping)
    if found:
        series, w = found
        y = np.array([r.value for r in series.orderBy("period").collect() if r.value is not None], float)
        out += [c for c in [trend_card(y, w.grain, preset.metric)] if c] + anomaly_cards(df, series, len(y), preset, mapping, w.grain, preset.metric)
    out += variance_cards(kpis)
    out += [c for c in (concentration_card(kpis), leader_card(df, preset, mapping)) if c]
    return sorted(out, key=lambda c: -c.materiality)[:most]
