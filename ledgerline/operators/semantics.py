"""What the columns of a table are: profile, roles, preset fields, preset ranking.

Spark profiles the table in one aggregate and takes one small sample; everything after that works on the profile, a row
for each column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import PRESETS, Field, Preset
from . import memory

#: Cells of a column that vocabularies are held against.
SAMPLE = 200
#: Standard error of the sketches that count distinct values.
SKETCH_ERROR = 0.01
# Words in a column's name that speak for a role, and the roles that a preset's field may take.
ID_WORDS = frozenset("id uuid key code sku serial ref no num idx".split())
TIME_WORDS = frozenset("date time timestamp created updated modified at on year month week day".split())
TEXT_WORDS = frozenset("description notes comment text review feedback summary body message detail remark".split())
FITS = {
    "temporal": {"temporal"},
    "numeric": {"continuous", "discrete", "binary"},
    "categorical": {"categorical", "binary", "text"},
    "identifier": {"identifier", "categorical", "text", "discrete"},
}
#: Lowest confidence at which a preset is detected, and at which the pipeline takes one.
DETECTED, TAKEN = 45, 40


@dataclass(frozen=True)
class Column:
    name: str
    dtype: T.DataType
    rows: int
    nulls: int
    distinct: int
    mean_length: float
    sample: tuple = ()

    @property
    def text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def numeric(self) -> bool:
        return isinstance(self.dtype, (T.NumericType, T.BooleanType))

    @property
    def role(self) -> str:
        return role(self)


def profile(df: DataFrame) -> list[Column]:
    """Rows, nulls, distinct values and mean text length of every column.

    One aggregate with a sketch for each column. Columns whose sketch says few values, or a share of distinct values so
    near to a threshold of the roles (half, nine tenths) that its error could decide, are counted exactly by one grouping
    of their cells; of the others the sketch tells on which side they are.
    """
    if not df.columns:
        return []
    c = lambda name: F.col(f"`{name}`")
    parts = [x for i, n in enumerate(df.columns) for x in (F.count(c(n)).alias(f"n{i}"), F.approx_count_distinct(c(n), SKETCH_ERROR).alias(f"d{i}"), F.avg(F.length(c(n).cast("string"))).alias(f"l{i}"))]
    s = df.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    near = lambda d: any(abs(d - t * s.rows) <= 5 * SKETCH_ERROR * d for t in (0.5, 0.9))
    few = [i for i in range(len(df.columns)) if s[f"d{i}"] <= 400 or near(s[f"d{i}"])]
    exact = {}
    if few:
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), c(df.columns[i]).cast("string").alias("v")) for i in few))).alias("x")).select("x.*")
        exact = {r.i: r.n for r in cells.where("v is not null").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = df.limit(SAMPLE).collect()
    return [
        Column(name, df.schema[i].dataType, s.rows, s.rows - s[f"n{i}"], exact.get(i, 0) if i in few else min(s[f"d{i}"], s[f"n{i}"]), s[f"l{i}"] or 0.0, tuple(r[i] for r in rows if r[i] is not None))
        for i, name in enumerate(df.columns)
    ]


def _dated(x) -> bool:
    """Does a value read as a date? Numbers do, as they may count time."""
    text = str(x).strip()
    return not isinstance(x, str) or bool(re.match(r"^\d{1,4}[-/. ]\w{1,9}([-/. ]\d{1,4})?([ T]\d{1,2}:\d{2}.*)?$", text) or re.match(r"^[A-Za-z]{3,9}[-/. ]\d{2,4}$", text))


def role(c: Column) -> str:
    """The first rule that holds; a name's words are parted by _, -, . and blanks."""
    words = set(re.split(r"[_\s\-.]+", c.name.lower()))
    ratio = c.distinct / c.rows if c.rows else 0.0
    whole = isinstance(c.dtype, (T.IntegralType,))
    if isinstance(c.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if words & TIME_WORDS and all(_dated(x) for x in c.sample[:5]):
        return "temporal"
    if words & ID_WORDS and (ratio > 0.5 or c.text):
        return "identifier"
    if ratio > 0.9 and c.distinct > 20 and not c.numeric:
        return "identifier"
    if c.text and (c.mean_length > 60 or words & TEXT_WORDS):
        return "text"
    if c.distinct == 2:
        return "binary"
    if c.text and c.distinct <= 50 or not c.text and c.distinct <= 15:
        return "categorical"
    return "discrete" if whole else "continuous" if c.numeric else "unknown"


def _plain(name: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", str(name).lower()))


def score(f: Field, c: Column) -> float:
    """How well a column serves a field: 6 for its name, 5 for one of its words, 3 if the column has all parts of one,
    2 if it holds one; 3 more if most sampled cells hold a word of the field's vocabulary. 0 if the role doesn't fit;
    numbers of few values still serve numeric fields."""
    if c.role not in FITS[f.role] and not (f.role == "numeric" and c.numeric):
        return 0.0
    own = _plain(c.name)
    marks = [6.0 if own == _plain(f.name) else 0.0]
    for word in map(_plain, f.words):
        marks.append(5.0 if own == word else 3.0 if set(word.split()) <= set(own.split()) else 2.0 if word in own else 0.0)
    best = max(marks)
    if f.vocabulary and c.role in FITS["categorical"] and c.sample:
        cells = [str(x).strip().lower() for x in c.sample[:SAMPLE]]
        if sum(any(v in x for v in f.vocabulary) for x in cells) > 0.5 * len(cells):
            best += 3.0
    return best


def assign(preset: Preset, columns: Sequence[Column]) -> dict[str, tuple[str, float]]:
    """field -> (column, score): the best pairs first, each field and each column once; ties in order of declaration."""
    pairs = sorted(((score(f, c), i, j) for i, f in enumerate(preset.fields) for j, c in enumerate(columns)), key=lambda p: (-p[0], p[1], p[2]))
    out: dict[str, tuple[str, float]] = {}
    taken: set[int] = set()
    for s, i, j in pairs:
        name = preset.fields[i].name
        if s >= 2.0 and name not in out and j not in taken:
            out[name] = columns[j].name, s
            taken.add(j)
    return out


@dataclass(frozen=True)
class Ranked:
    preset: Preset
    confidence: int
    mapping: dict[str, str] = field(default_factory=dict)


def rank(columns: Sequence[Column], presets: Mapping[str, Preset] = PRESETS) -> list[Ranked]:
    """Presets by confidence: 0.55 of the required and 0.20 of the optional fields found, 0.25 of six triggers named, and
    0.05 for each field found by more than its name."""
    names = " ".join(_plain(c.name) for c in columns)
    out = []
    for p in presets.values():
        got = assign(p, columns)
        share = lambda some: sum(f.name in got for f in some) / len(some) if some else 0.0  # noqa: E731, B023
        named = min(6, sum(t in names for t in p.triggers)) / 6
        raw = 0.55 * share([f for f in p.fields if f.required]) + 0.20 * share([f for f in p.fields if not f.required]) + 0.25 * named
        raw += 0.05 * sum(s >= 6.5 for _, s in got.values())
        out.append(Ranked(p, round(100 * min(0.99, raw)), {f: c for f, (c, _) in got.items()}))
    return sorted(out, key=lambda r: -r.confidence)


def detect(columns: Sequence[Column], least: int = DETECTED) -> Ranked | None:
    best = rank(columns)
    return best[0] if best and best[0].confidence >= least else None


def bind(df: DataFrame, preset: str | None = None, override: Mapping[str, str] | None = None, columns: Sequence[Column] | None = None, remembered: str | None = None, presets: Mapping[str, Preset] = PRESETS) -> Ranked | None:
    """The preset to use with its fields bound: the forced one; else, where nothing is forced or overridden, what the
    folder of memory has for these column names, with confidence 100; else the best of at least TAKEN. An override binds
    a field to a column, taking it from whatever field had it; an empty one unbinds. None means the general view."""
    if remembered and preset is None and not override:
        known = memory.recall(df.sparkSession, remembered, df.columns)
        if known and known.preset in presets:
            return Ranked(presets[known.preset], 100, known.mapping)
    columns = profile(df) if columns is None else columns
    ranked = {r.preset.key: r for r in rank(columns, presets)}
    best = ranked[preset] if preset else max(ranked.values(), key=lambda r: r.confidence)
    if not preset and best.confidence < TAKEN:
        return None
    mapping = dict(best.mapping)
    for name, column in (override or {}).items():
        mapping = {f: c for f, c in mapping.items() if f != name and c != column}
        if column:
            mapping[name] = column
    return Ranked(best.preset, best.confidence, mapping)


def when(preset: Preset, mapping: Mapping[str, str]) -> str | None:
    """The column of the first temporal field that is bound."""
    return next((mapping[f.name] for f in preset.fields if f.role == "temporal" and f.name in mapping), None)


# --- the broad domain of a table, from words in its columns' names

# Domains in order of precedence, with the words of column names that speak for them.
DOMAINS = {
    "sales": "revenue sales sale order orders customer customers product products price prices quantity qty units discount profit margin invoice deal deals pipeline conversion upsell quota target forecast".split(),
    "hr": "employee employees staff worker workers headcount salary salaries wage wages compensation department departments hire hired termination resigned tenure performance rating appraisal leave absence training role position grade band level".split(),
    "finance": "account accounts balance balances transaction transactions debit credit budget budgets expense expenses income cost costs payment payments invoice invoices tax asset assets liability liabilities equity cashflow pnl ebitda roi irr npv ledger journal".split(),
    "marketing": "campaign campaigns impression impressions click clicks conversion conversions lead leads channel channels spend cpc cpm ctr roas roi attribution audience segment segments reach engagement bounce session sessions pageview pageviews subscriber".split(),
    "logistics": "shipment shipments delivery deliveries warehouse inventory stock carrier route routes tracking sku item items dispatch freight parcel weight dimension eta pod return returns lead_time".split(),
}


def domain(columns: Sequence[Column]) -> str:
    """The domain with most points: one for each word that a name has or begins with, two if the column is numeric."""
    points = dict.fromkeys(DOMAINS, 0)
    for c in columns:
        low, numeric = c.name.lower(), c.role in ("continuous", "discrete")
        words = set(re.split(r"[_\s\-.]+", low))
        for name, keys in DOMAINS.items():
            points[name] += sum(2 if numeric else 1 for k in keys if k in words or low.startswith(k))
    best = max(points, key=points.get)
    return best if points[best] else "general"


# Words anywhere in the columns' names that speak for a template, in order of precedence.
TEMPLATES = {
    "sales": "revenue sales order orders customer customers product products price prices quantity qty units discount profit margin invoice".split(),
    "hr": "employee employees staff worker headcount salary salaries wage wages department hire tenure performance leave absence role".split(),
    "finance": "account accounts balance transaction transactions debit credit budget expense expenses income cost payment invoice tax asset liability equity".split(),
}


def template(names: Sequence[str]) -> str | None:
    """The template with most of its words somewhere in the names, of equal ones the first; None if none has any."""
    text = " ".join(names).lower()
    points = {t: sum(w in text for w in words) for t, words in TEMPLATES.items()}
    best = max(points, key=points.get)
    return best if points[best] else None
