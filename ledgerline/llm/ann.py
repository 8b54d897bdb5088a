"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A table's hash of a unit vector is its nearest signed axis after a fast pseudo-rotation (three rounds of random signs
and a Hadamard transform); with more rows, the nearest axes after two or more rotations, so that the number of buckets
grows with the rows and a bucket does not. Data rows go to one bucket of each table; queries go to the `probes` buckets
whose axes are nearest in sum. Each bucket, cut into blocks of rows and of queries where it is large, ranks its own rows
against its queries by one matrix product, then the best exactly in double precision; the best of all buckets are the
result. With one rotation, tables and probes are fixed values that reach the wanted recall; with more, a bounded sample
of queries is held against a search of all rows in blocks, and probes are doubled until RECALL is reached; where even
MOST_PROBES do not reach it, all queries search all rows in blocks.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id.
Vectors are compared only with those of their own length. Ties of score go to the smaller id. Rows are known by a number
of their own: repeated ids are separate rows, as queries and as candidates, and a query meets every row but its own. A query that found fewer than k rows probes every axis of one table, which is a search of all rows in
blocks; so the result has fewer than k rows only where there are fewer candidates. Empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TABLES, PROBES = 8, 16
#: Data rows and queries of a bucket that one task ranks at once.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
#: Pairs scored exactly in one go, since many may tie.
PAIRS = 50_000
#: Rows that a bucket has at most, on average, before one more rotation is taken; the recall wanted then, and the queries it is measured on.
BUCKET_ROWS, RECALL, SAMPLE, MOST_PROBES = 2_000, 0.95, 50, 4_096
SEED = 101


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(unit: np.ndarray, table: int | tuple[int, int]) -> np.ndarray:
    """How near each unit vector is to each signed axis of a table."""
    width = 1 << max(1, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, *np.atleast_1d(table).tolist()])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], width))
    return np.concatenate([x, -x], 1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two that makes its largest component about 1; cosines stay exactly as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row (a number, written so that it stays), vec_id and embedding of the rows that take part."""
    e = F.col(embedding).cast("array<double>")
    clean = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), e.alias("_e"))
    fine = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("_e", lambda x: x != 0)
    kept = clean.where(F.col("vec_id").isNotNull() & F.col("_e").isNotNull() & F.coalesce(fine & some, F.lit(False))).select("row", "vec_id", F.col("_e").alias("embedding"))
    return common.settle(kept)


def nearest_buckets(unit: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """The buckets of a table nearest to each unit vector, nearest first. A bucket's number has an axis for each rotation."""
    best, score = None, None
    for r in range(rotations):
        near = axes(unit, (table, r))
        width = near.shape[1]
        most = min(probes, width)
        top = near.argmax(1)[:, None] if most == 1 else np.argsort(-near, 1, kind="stable")[:, :most]
        own = np.take_along_axis(near, top, 1)
        if best is None:
            best, score = top.astype(np.int64), own
            continue
        best = (best[:, :, None] * width + top[:, None, :]).reshape(len(unit), -1)
        score = (score[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(-score, 1, kind="stable")[:, :probes]
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
    return best


def hashed(rows: DataFrame, tables: int, probes: int, rotations: int = 1) -> DataFrame:
    """A row for each table and probe: dim, table, bucket, row, vec_id, embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b.embedding.map(len)
            for dim, same in b.groupby(dims):
                v = scaled(np.stack(same.embedding.to_numpy()).astype(float))
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                for t in range(tables):
                    best = nearest_buckets(unit, t, rotations, probes)
                    for p in range(best.shape[1]):
                        yield pd.DataFrame({"dim": dim, "table": t, "bucket": best[:, p], "row": same.row.to_numpy(), "vec_id": same.vec_id.to_numpy(), "embedding": same.embedding.to_numpy()})

    return rows.mapInPandas(run, "dim int, table int, bucket long, row long, vec_id long, embedding array<double>")


def best_in_blocks(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each bucket for each of its queries: query, query_id, row, vec_id, score. Exact in the bucket."""
    keys = ["dim", "table", "bucket"]
    sides = data.select(*keys, F.lit(1).alias("_d"), F.lit(0).alias("_q")).unionByName(queries.select(*keys, F.lit(0).alias("_d"), F.lit(1).alias("_q")))
    counts = sides.groupBy(keys).agg(F.sum("_d").alias("_d"), F.sum("_q").alias("_q")).where("_d > 0 and _q > 0")
    counts = counts.select(*keys, F.ceil(F.col("_d") / BLOCK_ROWS).cast("int").alias("_n"), F.ceil(F.col("_q") / BLOCK_QUERIES).cast("int").alias("_m"))
    counts = common.settle(counts)
    pick = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = F.broadcast(counts) if counts.count() <= 200_000 else counts
    data = data.join(small, keys).withColumn("block", pick("_n")).withColumn("part", every("_m")).drop("_n", "_m")
    queries = queries.join(small, keys).withColumn("part", pick("_m")).withColumn("block", every("_n")).drop("_n", "_m")

    def rank(_, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame(columns=["query", "query_id", "row", "vec_id", "score"])
        rows, ids, v = d.row.to_numpy(), d.vec_id.to_numpy(), scaled(np.stack(d.embedding.to_numpy()))
        own, own_ids, x = q.row.to_numpy(), q.vec_id.to_numpy(), scaled(np.stack(q.embedding.to_numpy()))
        norms, lengths = np.sqrt((v * v).sum(1)), np.sqrt((x * x).sum(1))
        most, found = min(k, len(ids)), []

        def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (v[i] * x[j]).sum(1) / (norms[i] * lengths[j])

        step = max(1, 4_000_000 // len(ids))
        for start in range(0, len(own), step):
            some = slice(start, start + step)
            rough = (x[some] @ v.T) / (lengths[some, None] * norms)
            rough[own[some, None] == rows] = -np.inf
            least = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most, None] - 1e-9
            row, near = np.nonzero((rough >= least) & (rough > -np.inf))
            # The same for a pair in whichever bucket it meets.
            score = np.concatenate([np.zeros(0), *(pairs(near[i : i + PAIRS], row[i : i + PAIRS] + start) for i in range(0, len(row), PAIRS))])
            order = np.lexsort((rows[near], ids[near], -score, row))
            row, near, score = row[order], near[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < most
            row, near, score = row[best], near[best], score[best]
            found.append(pd.DataFrame({"query": own[some][row], "query_id": own_ids[some][row], "row": rows[near], "vec_id": ids[near], "score": score}))
        return pd.concat(found)

    keys = [*keys, "block", "part"]
    return queries.groupBy(keys).cogroup(data.groupBy(keys)).applyInPandas(rank, "query long, query_id long, row long, vec_id long, score double")


def rotations_for(rows: int, dim: int) -> int:
    """Rotations that keep a bucket at BUCKET_ROWS at most on average; one at least."""
    signed_axes = 2 << max(1, dim - 1).bit_length()
    out = 1
    while rows > BUCKET_ROWS * signed_axes**out:
        out += 1
    return out


def search(vectors: DataFrame, is_query: str, k: int = 5, tables: int = TABLES, probes: int = PROBES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where is_query (SQL on vec_id) holds."""
    rows = usable(vectors, vec_id, embedding)
    queries = rows.where(is_query)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dim")).first()
    rotations = rotations_for(shape.n, shape.dim)

    def top(found: DataFrame) -> DataFrame:
        once = found.groupBy("query", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def all_rows(some: DataFrame) -> DataFrame:
        return best_in_blocks(hashed(some, 1, 1 << 30), hashed(rows, 1, 1), k)

    def probed(some: DataFrame, probes: int) -> DataFrame:
        return best_in_blocks(hashed(some, tables, probes, rotations), hashed(rows, tables, 1, rotations), k)

    def reached(sample: DataFrame, want: DataFrame, probes: int) -> bool:
        return top(probed(sample, probes)).join(want, ["query", "row"]).count() >= RECALL * want.count()

    enough = True
    if rotations > 1:
        sample = common.settle(queries.orderBy(F.xxhash64("row"), "row").limit(SAMPLE))
        want = common.settle(top(all_rows(sample)).select("query", "row"))
        while not (enough := reached(sample, want, probes)) and probes < MOST_PROBES:
            probes *= 2
    if not enough:
        return ranked(top(all_rows(queries)))
    found = common.settle(top(probed(queries, probes)))
    full = found.groupBy("query").count().where(F.col("count") >= k).select(F.col("query").alias("row"))
    short = common.settle(queries.join(full, "row", "left_anti"))
    if not short.isEmpty():
        found = top(found.drop("rank").unionByName(all_rows(short)))
    return ranked(found)


def ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
