"""Values as short text, and names as fingerprints, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of large amounts, largest first; rupees count in lakh and crore.
WESTERN = ((1e9, "B"), (1e6, "M"), (1e3, "K"))
INDIAN = ((1e7, " Cr"), (1e5, " L"), (1e3, "K"))


def amount(c: Column, symbol: str = "") -> Column:
    """1234567 -> 1.23M, with the sign before the symbol; whole numbers below a thousand without decimals. Null stays null."""
    size = F.abs(c)
    out = F.when(size == F.floor(size), F.format_string("%.0f", size.cast("double"))).otherwise(F.format_string("%.2f", size.cast("double")))
    for unit, name in reversed(INDIAN if symbol == "₹" else WESTERN):
        out = F.when(size >= unit, F.concat(F.format_string("%.2f", (size / unit).cast("double")), F.lit(name))).otherwise(out)
    return F.when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), F.lit(symbol), out))


def percent(c: Column, places: int = 1) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f%%", c.cast("double")))


def shown(c: Column, fmt: str, symbol: str = "") -> Column:
    """A KPI value by its format."""
    if fmt == "currency":
        return amount(c, symbol)
    if fmt == "percent":
        return percent(c)
    if fmt == "ratio":
        return F.when(c.isNotNull(), F.format_string("%.2fx", c.cast("double")))
    if fmt in ("days", "months", "years"):
        return F.when(c.isNotNull(), F.format_string(f"%.1f {fmt}", c.cast("double")))
    return amount(c)


def fingerprint(names: list[str]) -> str:
    """A digest of a set of column names, whatever their order, case and outer blanks."""
    import hashlib

    return hashlib.sha1("|".join(sorted(n.strip().lower() for n in names)).encode()).hexdigest()[:16]
