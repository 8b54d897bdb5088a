"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Best fit places the longest piece first, each in the tightest open sequence that still has room. Which piece of a
length goes where does not matter, so the placement is worked out on the count of pieces by length, a table of at
most `capacity` rows: sequences with the same room are handled together, and a segment tree over the rooms finds the
tightest one in logarithmic time. The result is a short list of rules (length, ordinals) -> (sequence, offset), and
Spark numbers the pieces of each length and joins them with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens


class RoomTree:
    """Counts of open sequences by room, in a segment tree: the smallest room of at least r that has any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, has: bool) -> None:
        i = room + self.size
        self.any[i] = has
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, room: int) -> int | None:
        i = room + self.size
        if self.any[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """counts of pieces by length -> rules (length, first, last, sequence, each, offset).

    The piece of a length with ordinal first <= j <= last goes to sequence + (j - first) // each, at
    offset + (j - first) % each * length. Pieces of one length that follow each other into the same sequence are what
    best fit does one by one: what it has just filled is the tightest while it has room.
    """
    tree, open_by_room = RoomTree(capacity), {}  # room -> list of (first sequence, how many)
    rules, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_by_room.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each, room = capacity // length, capacity
                first, n = made, -(-left // each)
                made += n
            else:
                each = room // length
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    tree.set(room, False)
            full, rest = divmod(left, each)
            full = min(n, full)
            if full:
                rules.append((length, at, at + full * each - 1, first, each, capacity - room))
                put(room - each * length, first, full)
                at, left = at + full * each, left - full * each
            if full < n and left and rest:  # the last one takes fewer
                rules.append((length, at, at + rest - 1, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                at, left, full = at + rest, left - rest, full + 1
            put(room, first + full, n - full)
    return rules


def place(pieces: DataFrame, capacity: int, order: list[str], seed: int = 0) -> DataFrame:
    """pieces (length: int from 1 to capacity, and others) with sequence_id and offset.

    A piece that fills a sequence has one of its own, numbered downwards from -1 by its place in the input, which must
    be a written table. For the others the counts by length, less than `capacity` rows, are all that the driver sees;
    the rules go back as a broadcast of at most a few rows for each length. An empty table stays empty. Input columns
    must not be called sequence_id or offset.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("a piece is empty or longer than a sequence")
    alone = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts.pop(capacity, None)
    rules = spark.createDataFrame(best_fit(counts, capacity), "_length long, _first long, _last long, _base long, _each long, _shift long")
    numbered = common.ordinals(pieces.where(F.col("length") < capacity), ["length"], order, "_j", seed, common.buckets(max(counts.values(), default=0)))
    j = F.col("_j") - F.col("_first")
    placed = numbered.join(F.broadcast(rules), (F.col("length") == F.col("_length")) & F.col("_j").between(F.col("_first"), F.col("_last"))).select(
        *pieces.columns,
        (F.col("_base") + F.floor(j / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_shift") + j % F.col("_each") * F.col("_length")).cast("long").alias("offset"),
    )
    return placed.unionByName(alone)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Cut each document's ids (with the end id) into pieces of `capacity`, the first one shorter if need be.

    Null texts count as empty and give one piece with the end id. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, offsets, ids in tokens.encoded(batches, path, end_id, share=2):
            sizes = np.diff(offsets)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = (sizes - 1) % capacity + 1
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            ends = np.append(offsets[doc] + start, offsets[-1:])
            columns = [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.diff(ends)), pa.array(tokens.crc32s(ids, ends), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    named = docs.select(F.col("doc_id").cast("long"), "text")
    return named.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    common.small_batches(docs.sparkSession)
    pieces = common.settle(token_pieces(docs, path or tokens.tokenizer_path(), capacity, end_id))
    return place(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
