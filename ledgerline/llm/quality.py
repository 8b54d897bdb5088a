"""Quality rules, and verdicts on hosts from their documents' failures.

Each document is held against rules; failures are summed by host, each host's rate is drawn towards the common one by
a beta prior that is fitted to all hosts by moments, and a document is kept if it passes the base rules and its host is
not rejected. A host is rejected if for some rule its shrunk rate reaches the upper quantile of that rule's prior, that
is, if it stands out among the hosts of this corpus; but never while fewer than LEAST_LIMIT of its documents fail, since
most of what it has is then sound, and always from MOST_LIMIT on.

Words are runs of anything but ASCII white space. Null and empty texts have no words and fail the base rules. A null
host is a host of its own. Repeated rows and rows with a null doc_id count as often as they occur. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import beta_inc
from . import common

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: A host is rejected when its shrunk rate of failures of one rule reaches this quantile of the prior, kept between these.
UPPER, LEAST_LIMIT, MOST_LIMIT = 0.95, 0.5, 0.9
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
}
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1].astype(np.int64)
    _, at, n = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(words),
    )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the metrics and one fail_<rule> column for each rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measure(t) for t in b.text], columns=[m.split()[0] for m in METRICS.split(", ")])
            yield pd.concat([b[["doc_id", "host"]].reset_index(drop=True), out], axis=1)

    # Ids go through as strings: pandas would make floats of those beside a null.
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    out = named.mapInPandas(run, f"doc_id string, host string, {METRICS}").withColumn("doc_id", F.col("doc_id").cast("long"))
    return out.withColumns({f"fail_{name}": F.expr(rule) for name, rule in RULES.items()})


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n_docs, and for each rule shrunk_<rule>, (failures + a) / (documents + a + b) under its prior Beta(a, b), and
    limit_<rule>.

    The prior has the mean of all documents and, by moments, the spread of the hosts' rates beyond what chance makes.
    Sums over hosts alone reach the driver.
    """
    sums = common.settle(rows.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n_docs"), *(F.sum(F.col(f"fail_{r}").cast("double")).alias(r) for r in RULES)))
    moments = sums.agg(
        F.sum("n_docs").alias("n"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_docs") ** 2).alias("n2"),
        *(F.sum(r).alias(f"k_{r}") for r in RULES),
        *(F.sum(F.col(r) ** 2 / F.col("n_docs")).alias(f"q_{r}") for r in RULES),
    ).first()
    out = sums
    for r in RULES:
        a, b = beta_prior(moments["n"] or 0, moments["hosts"], moments["n2"] or 0, moments[f"k_{r}"] or 0, moments[f"q_{r}"] or 0)
        out = out.withColumn(f"shrunk_{r}", (F.col(r) + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))).withColumn(f"limit_{r}", F.lit(host_limit(a, b)))
    return out.drop(*RULES)


def beta_quantile(a: float, b: float, q: float) -> float:
    """Where the beta distribution reaches q, by halving."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_inc(a, b, mid) < q else (low, mid)
    return (low + high) / 2


def host_limit(a: float, b: float) -> float:
    return min(MOST_LIMIT, max(LEAST_LIMIT, beta_quantile(a, b, UPPER)))


def beta_prior(n: float, hosts: int, n2: float, k: float, q: float) -> tuple[float, float]:
    """(a, b) by moments from documents n, hosts, sum of n_h^2, failures k and sum of k_h^2 / n_h."""
    if not n:
        return 1.0, 1.0
    mean = (k + 0.5) / (n + 1)
    between = q - n * (k / n) ** 2  # sum of n_h (rate_h - mean)^2
    scale = mean * (1 - mean)
    spread = (between - (hosts - 1) * scale) / max(n - n2 / n, 1e-9) if hosts > 1 else 0.0
    weight = min(max(scale / spread - 1, 2.0), 1e4) if spread > scale / 1e4 else 1e4
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the metrics, base_failed, host_rejected, kept of every row of docs (doc_id, text, host); and for each
    rule the host's shrunk rate of failures with its limit, shrunk_<rule> and limit_<rule>."""
    common.small_batches(docs.sparkSession)
    rows = common.settle(measured(docs, host))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"shrunk_{r}") >= F.col(f"limit_{r}"))
    rates = [f"{kind}_{r}" for r in RULES for kind in ("shrunk", "limit")]
    verdicts = host_rates(rows).select(F.struct(F.col("host")).alias("_key"), bad.alias("host_rejected"), *rates)
    keyed = rows.withColumn("_key", F.struct("host"))  # a struct is equal to another with a null in the same place
    out = common.join_measured(keyed, verdicts, ["_key"], "left")
    failed = F.col("fail_short") | F.col("fail_repeated")
    return out.select("doc_id", "host", *[m.split()[0] for m in METRICS.split(", ")], failed.alias("base_failed"), "host_rejected", (~failed & ~F.col("host_rejected")).alias("kept"), *rates)
