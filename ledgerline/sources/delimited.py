"""Delimited text of unknown shape: encoding, separator, header, total rows, numbers and dates are found out.

Choices that the head of a file decides come from its first lines; those about whole columns (width, empty columns,
share of numbers and dates) from one aggregate over all rows, and the encoding of each file from one over all its lines.
Files are read by splits, those with line breaks in quotes too (quoted.py). Several files are read in the order of their
names; where the header stands again at the head of a further file, it is left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verbs
from . import quoted
from .staging import staging_path  # noqa: F401

SEPARATORS, CURRENCIES = (",", ";", "\t", "|"), "₹$€£"
HEAD, SNIFF = 12, 30
# Names of time columns, the shape of a date, the start of a total row.
TIME_NAME = r"(?i)(date|time|day|month|year|period|created|updated|timestamp|doj|dob)"
DATE_SHAPE = r"^\s*\d{1,4}[-/\.\s]\w{1,9}[-/\.\s]\d{1,4}"
TOTAL = r"(?i)^\s*(grand\s+)?(sub\s*)?total\b"
CLOCK = "[ H:m[:s]]"
ORDERS = {"day first": ("d-M-yyyy", "d-MMM-yyyy"), "month first": ("M-d-yyyy", "MMM-d-yyyy")}


@dataclass
class Ingested:
    df: DataFrame
    receipt: list[str] = field(default_factory=list)
    symbols: dict[str, str] = field(default_factory=dict)


def _encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each encoding: UTF-8 if every line's bytes are, else Latin-1 (made cp1252 by _western)."""
    file = F.col("_metadata.file_path").alias("_file")
    found: dict[str, list[str]] = {}
    for r in spark.read.text(path).groupBy(file).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8")).collect():
        found.setdefault("UTF-8" if r.utf8 else "ISO-8859-1", []).append(r._file)
    return found or {"UTF-8": []}


def _read(spark: SparkSession, path: str, files: dict[str, list[str]], schema: str, columns, **options) -> DataFrame:
    """The files under path, each in its encoding. columns: what to select, by encoding."""
    out = []
    for encoding in sorted(files, reverse=True):
        part = spark.read.csv(path, encoding=encoding, schema=schema, **options)
        if len(files) > 1:
            western = F.col("_metadata.file_path").isin(files["ISO-8859-1"])
            part = part.where(western if encoding == "ISO-8859-1" else ~western)
        out.append(part.select(*columns(encoding)))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _lines(spark: SparkSession, path: str, files: dict[str, list[str]]) -> DataFrame:
    """_file, _block, _id and line of every line, blank ones too, in the order of the files' splits."""
    bytes_ = F.col("value").cast("binary")
    western = F.decode(bytes_, "ISO-8859-1")
    line = F.when(F.col("_metadata.file_path").isin(files["ISO-8859-1"]), western).otherwise(F.col("value")) if len(files) > 1 else F.col("value") if "UTF-8" in files else western
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    told = (F.col("_metadata.file_path").isin(files["ISO-8859-1"]) if len(files) > 1 else F.lit("UTF-8" not in files)).alias("_western")
    lines = spark.read.text(path).select(*place, line.alias("line"), told)
    mark = F.when(F.col("_western"), _western("line", "ISO-8859-1")).otherwise(F.col("line"))
    return lines.select("_file", "_block", "_id", F.regexp_replace(mark, "^\ufeff", "").alias("line"))


def _western(c: str, encoding: str) -> Column:
    """What Latin-1 reads as control characters are cp1252's signs; bytes that cp1252 lacks stay."""
    pairs = [(chr(b), sign) for b in range(0x80, 0xA0) if (sign := bytes([b]).decode("cp1252", "ignore"))]
    return F.col(c) if encoding == "UTF-8" else F.translate(c, "".join(x for x, _ in pairs), "".join(y for _, y in pairs))


def _separator(lines: list[str]) -> str:
    """The one that most lines hold equally often; a comma if none."""
    def agree(sep: str) -> tuple[int, int]:
        counts = [n for line in lines if (n := line.count(sep))]
        top = max(set(counts), key=counts.count) if counts else 0
        return counts.count(top), top

    best = max(SEPARATORS, key=agree)
    return best if agree(best)[0] else ","


def _number(c: Column) -> Column:
    """Currency signs, separators and % go; brackets mean negative."""
    bare = F.regexp_replace(c, rf"[,\s%{CURRENCIES}]", "")
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("double")


def _date(c: Column, order: str) -> Column:
    """Year-first dates are what they say; others follow the order."""
    bare = F.regexp_replace(F.trim(c), r"^([^-/. T:]+)[-/. ]([^-/. T:]+)[-/. ]", "$1-$2-")
    bare = F.regexp_replace(bare, r"(\d)T(\d)", "$1 $2")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f + CLOCK)) for f in ("yyyy-M-d", *ORDERS[order])))


def _header(rows: list[list[str | None]], width: int) -> int:
    for i, row in enumerate(rows):
        cells = [x.strip() for x in row if x and x.strip()]
        numbers = sum(not any(ch.isalpha() for ch in x) and any(ch.isdigit() for ch in x) for x in cells)
        if len(cells) >= 2 and 2 * len(cells) >= width and numbers < 0.3 * len(cells) and sorted(map(len, cells))[len(cells) // 2] <= 40:
            return i
    return 0


def _names(cells: list[str | None]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells):
        name = (cell or "").strip() or f"column_{i + 1}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(f"{name}.{k}" if k else name)
    return out


def load(spark: SparkSession, path: str) -> Ingested:
    """The table in a delimited file or folder. A file without a line gives an empty frame and says so."""
    files = _encodings(spark, path)
    whole = _read(spark, path, files, "line string", lambda encoding: [_western("line", encoding).alias("line")], sep="\u0001", quote="")
    lines = [r.line for r in whole.where("line is not null").limit(SNIFF).collect()]
    if not lines:
        return Ingested(spark.createDataFrame([], "column_1 string"), ["empty input"])
    sep = _separator(lines)
    # Quoted separators make this too wide at worst; empty columns go below.
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    width, broken = whole.agg(F.max(F.size(F.split("line", f"\\Q{sep}\\E"))), F.bool_or(quotes % 2 == 1)).first()
    raw = [f"_c{i}" for i in range(width)]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    cells = lambda encoding: [*(F.nullif(F.trim(_western(c, encoding)), F.lit("")).alias(c) for c in raw), *place]
    if broken:  # line breaks in quotes: records are found over all splits
        table, raw = quoted.parsed(_lines(spark, path, files), sep, ["_file", "_block", "_id"])
        width = len(raw)
        table = table.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw), "_file", "_block", "_id")
    else:
        table = _read(spark, path, files, ", ".join(f"{c} string" for c in raw), cells, sep=sep, mode="PERMISSIVE", escape='"')
    order, back = ["_file", "_block", "_id"], [F.desc("_file"), F.desc("_block"), F.desc("_id")]
    head = table.orderBy(*order).limit(HEAD).collect()
    at = _header([[r[c] for c in raw] for r in head], width)
    top, names = head[at], _names([head[at][c] for c in raw])
    encoding = next(iter(files)) if len(files) == 1 else f"{len(files['ISO-8859-1'])} files ISO-8859-1, {len(files['UTF-8'])} UTF-8"
    receipt = [f"encoding {encoding}", f"separator {sep!r}", f"header in row {at + 1}"]

    before = F.struct(*order) <= _place(top)
    again = F.lit(True)
    for c in raw:
        again = again & F.col(c).eqNullSafe(F.lit(top[c]))
    rows = table.where(~before & F.coalesce(*raw).isNotNull())
    if sum(map(len, files.values())) > 1:
        first = table.groupBy("_file").agg(F.min("_id").alias("_first"))
        further = (F.col("_file") != top._file) & (F.col("_id") < F.col("_first") + HEAD)
        rows = rows.join(first, "_file").where(~(further & again)).drop("_first")
    totals = [r for r in rows.orderBy(*back).limit(3).collect() if _is_total(r, raw)]
    for r in totals:
        rows = rows.where(~F.struct(*order).eqNullSafe(_place(r)))
    receipt.append(f"{len(totals)} total rows left out")
    typed, symbols, notes = _typed(rows.select(*(F.col(c).alias(n) for c, n in zip(raw, names, strict=True))))
    long = verbs.unpivot_wide(typed)
    if long.columns != typed.columns:
        notes.append("months as columns, turned into a row for each")
    return Ingested(long, receipt + notes, symbols)


def save(df: DataFrame, path: str) -> None:
    """A new folder of UTF-8 files, each with a header and with quotes doubled, as load reads them; arrays, maps and structs
    become JSON. Null and empty text are one on reading."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    cells = [F.to_json(f"`{c}`").alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns]
    df.select(*cells).write.csv(path, header=True, escape='"', encoding="UTF-8", timestampFormat="yyyy-MM-dd HH:mm:ss", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _place(row) -> Column:
    return F.struct(F.lit(row._file).alias("_file"), F.lit(row._block).cast("long").alias("_block"), F.lit(row._id).cast("long").alias("_id"))


def _is_total(row, raw: list[str]) -> bool:
    return any(re.match(TOTAL, row[c] or "") for c in raw[:2])


def _typed(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Dates before numbers, decided for all columns by one aggregate."""
    if not df.columns:
        return df, {}, []
    parts = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        parts += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(DATE_SHAPE)).alias(f"shape{i}"),
            F.count(_date(c, "day first")).alias(f"day{i}"),
            F.count(_date(c, "month first")).alias(f"month{i}"),
            F.count(_number(c)).alias(f"num{i}"),
            F.count_if(c.rlike(r"\p{L}")).alias(f"alpha{i}"),
            *(F.count_if(c.contains(s)).alias(f"sign{i}_{k}") for k, s in enumerate(CURRENCIES)),
        ]
    s = df.agg(F.count(F.lit(1)).alias("all"), *parts).first()
    columns, symbols, notes = [], {}, []
    for i, name in enumerate(df.columns):
        c, n = F.col(f"`{name}`"), s[f"n{i}"]
        if not n:
            notes.append(f"{name}: empty, left out")
            continue
        dated = max(s[f"day{i}"], s[f"month{i}"])
        order = "day first" if s[f"day{i}"] >= s[f"month{i}"] else "month first"
        if (re.search(TIME_NAME, name) or s[f"shape{i}"] > 0.6 * n) and dated >= 0.8 * s["all"]:
            columns.append(_date(c, order).alias(name))
            notes.append(f"{name}: date, {order}")
        elif n >= 3 and s[f"alpha{i}"] <= 0.2 * n and s[f"num{i}"] >= 0.85 * n:
            columns.append(_number(c).alias(name))
            sign = max(range(len(CURRENCIES)), key=lambda k: s[f"sign{i}_{k}"])
            if s[f"sign{i}_{sign}"] > 0.3 * n:
                symbols[name] = CURRENCIES[sign]
            notes.append(f"{name}: number")
        else:
            columns.append(c.alias(name))
    return df.select(*columns), symbols, notes
