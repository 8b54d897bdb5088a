"""Mix sources to target weights by subset-sum budget fitting.

Sources, ordered by code point with null last, take the weights of a repeating list and share a budget of words.
A source is taken whole as often as its target allows; for the rest, its documents are counted by exact length, a
bounded knapsack on these counts finds how many documents of each length to take, and a seeded order picks them.

Null texts and texts without words have size 0 and are taken 0 times. Ties of length are broken by the seeded order of
doc_id; repeated rows are separate documents. An empty table gives an empty result. Only totals by source reach the
driver (one row for each source: sources are collections of documents with a weight each, thousands at most, not hosts);
the knapsack of a source sees its counts by length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHTS, BUDGET, MOST_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
#: Width in words of the knapsack's table of reachable sums.
TABLE = 1 << 16


def targets(sizes: Sequence[float], weights: Sequence[float], budget: float, most: Sequence[float]) -> list[float]:
    """Share budget by weight; what would pass a source's most is shared again among the others."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most[i])
        left, open_ = max(0.0, budget - sum(out)), open_ - over
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to budget as they can without passing it.

    First the same share of every length is taken; then, from the longest, single documents that still fit, until what
    is left fits the table; a bounded subset-sum table over the documents left then fills it. Sums are bits of an
    integer, so a length with c documents takes about log2(c) shifts, and the search stops once the budget is met.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int(lengths @ counts)
    if total <= budget:
        return counts.copy()
    if budget <= 0:
        return take
    take = np.minimum(counts, np.array([int(c) * budget // total for c in counts], np.int64))
    left = budget - int(lengths @ take)
    for i in np.argsort(-lengths, kind="stable"):
        if left <= TABLE:
            break
        if n := min(int(counts[i] - take[i]), (left - TABLE) // int(lengths[i])):
            take[i] += n
            left -= n * int(lengths[i])
    # Reachable sums after each step; a step is (length index, how many documents it stands for).
    table, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i in np.argsort(-lengths, kind="stable"):
        free, chunk = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while free > 0 and not table >> left & 1:
            n = min(chunk, free)
            grown = (table | table << (n * int(lengths[i]))) & mask
            if grown != table:
                steps.append((i, n, table))
                table = grown
            free, chunk = free - n, chunk * 2
        if table >> left & 1:
            break
    best = table.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> best & 1:
            take[i] += n
            best -= n * int(lengths[i])
    return take


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most_epochs: float = MOST_EPOCHS, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, text, source), after the columns
    of docs to carry; these also settle ties of doc_id."""
    spark = docs.sparkSession
    sized = common.settle(docs.select(*carry, "doc_id", "source", common.word_count("text").alias("size")))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    by_source = sorted(by_source, key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    sizes = [r.source_size for r in by_source]
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    target = targets(sizes, own, budget * sum(sizes), [most_epochs * s for s in sizes])
    rows = []
    for i, (r, t) in enumerate(zip(by_source, target, strict=True)):
        whole = int(t // r.source_size) if r.source_size else 0
        rows.append((i, r.source, r.source_size, float(t), whole, round(t - whole * r.source_size)))
    known = spark.createDataFrame(rows, "_s int, source string, source_size long, target double, _whole long, _rest long")
    known = F.broadcast(known) if len(rows) <= 200_000 else known
    keyed = sized.alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source"))).select("d.*", "_s", "source_size", "target", "_whole", "_rest")

    def fit(counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("size")
        take = knapsack(counts["size"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), int(counts["_rest"].iloc[0]))
        return pd.DataFrame({"_s": counts["_s"], "size": counts["size"], "_take": take})

    counts = keyed.where("size > 0").groupBy("_s", "size", "_rest").agg(F.count(F.lit(1)).alias("n"))
    fitted = counts.groupBy("_s").applyInPandas(fit, "_s int, size long, _take long")
    largest = counts.agg(F.max("n")).first()[0] or 0
    numbered = common.ordinals(keyed, ["_s", "size"], ["doc_id"], "_j", seed, common.buckets(largest), ties=carry)
    return numbered.join(fitted, ["_s", "size"], "left").select(
        *carry,
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("size") * (F.col("_whole") + (F.col("_j") < F.coalesce("_take", F.lit(0))).cast("long"))).otherwise(F.lit(0)).cast("long").alias("taken"),
    )
