"""Token ids of whole texts, and their Parquet file format.

Ids come from a public tokenizer file of the tokenizers library. A document's ids are those of its text plus an
end id; a null text counts as empty, so it has the end id alone. Strings of special tokens inside a text are
ordinary text. Extra columns of the input are ignored; repeated rows stay repeated.

The file format is Parquet with one row per document in ascending doc_id order: doc_id and n_tokens (plain metadata)
and tokens (a list column). Version-2 pages with dictionaries off give integer columns delta encoding; row groups and
pages have set sizes, and page indexes are written, so a reader of the metadata columns or of a doc_id range skips the
other pages. Where a document starts among all ids is not stored; read_tokens sums the metadata column. Rows with a
null doc_id come first; rows that repeat a doc_id follow each other in the order of the file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words held per worker, about 40 bytes each; when the store is full it starts anew, so a worker's memory is bounded.
MEMO_WORDS = 500_000
#: Words encoded in one string, and bytes of text in one go.
JOINED, BATCH = 256, 4 << 20

#: Estimated input for each token file.
FILE_BYTES = 32 << 20
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids, with a store of words seen.

    The pre-tokenizer always parts two words at a single space between two other characters, and gives the space to
    the right-hand word; a line feed between two other characters is a token of its own. So Arrow cuts a batch of texts
    at spaces and before line feeds, each distinct word is encoded once, and the ids are put together with numpy. Texts
    with other white space next to a cut are encoded whole, as is everything if the pre-tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most = MEMO_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind = made.get("pre_tokenizer") or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made.get("normalizer")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith(("Ġ", "Ċ"))  # a space, a line feed
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: pa.Array) -> None:
        """Add words to the store; those that must not be cut off get the length -1."""
        words = new.to_pylist()
        fine = np.fromiter((bool(w) and (w == "\n" or not (w[-1].isspace() or w[w[0] == "\n"].isspace())) for w in words), bool, len(words))
        good = [w if w[0] == "\n" else " " + w for w, ok in zip(words, fine, strict=True) if ok]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.plain(["".join(good[i : i + JOINED]) for i in range(0, len(good), JOINED)])])
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(good):
            parts = self.plain(good)
            ids, at = np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])[:-1]
        starts, lengths = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int32)
        starts[fine], lengths[fine] = at + len(self.flat), np.diff(np.append(at, len(ids)))
        self.words = pa.concat_arrays([self.words, new])
        self.starts, self.lengths, self.flat = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, ids])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i, with the end id, are ids[offsets[i] : offsets[i + 1]]. Nulls count as empty."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        whole, words = np.arange(n), np.zeros(0, np.int64)
        if self.cuts and n:
            if len(self.words) > self.most:
                self.clear()
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
            words, counts = pc.list_flatten(split), pc.list_value_length(split).to_numpy()
            heads = np.cumsum(counts, dtype=np.int64) - counts
            at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
            at[heads] = 0
            unknown = np.flatnonzero(at < 0)
            if len(unknown):
                met = words.take(pa.array(unknown))
                new = met.unique()
                at[unknown] = pc.index_in(met, new).to_numpy() + len(self.words)
                self.learn(new)
            lengths, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            inner = np.ones(len(at), bool)
            inner[heads] = False
            lengths[inner], starts[inner] = self.lengths[at[inner]], self.starts[at[inner]]
            feed = pc.index(self.words, "\n").as_py()  # two line feeds in a row make one token of another kind
            bad = lengths < 0
            if feed >= 0:
                bad[1:] |= inner[1:] & inner[:-1] & (at[1:] == feed) & (at[:-1] == feed)
            first = words.take(pa.array(heads)).to_pylist()
            odd = np.add.reduceat(bad, heads) > 0
            odd |= np.fromiter((bool(w) and w[-1].isspace() for w in first), bool, n)
            whole = np.flatnonzero(odd)
        some = texts.take(pa.array(whole)).to_pylist()
        if not len(words):
            parts = self.plain(some)
            starts = np.zeros(n, np.int64)
            heads, counts, lengths = np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64)
        else:
            for i, text in zip(whole, some, strict=True):
                first[i] = text
            lengths[np.repeat(odd, counts)] = 0
            parts = self.plain(first)
        # The first words, and the texts encoded whole, stand behind the store for this turn.
        lengths[heads] = np.fromiter(map(len, parts), np.int64, n)
        starts[heads] = len(self.flat) + np.cumsum(lengths[heads]) - lengths[heads]
        flat = np.concatenate([self.flat, *parts])
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1] if n else 0) + np.repeat(starts - ends + lengths, lengths)]
        stops = ends[heads + counts - 1] if n else np.zeros(0, np.int64)
        return np.append(0, stops + np.arange(1, n + 1)), np.insert(ids, stops, np.uint32(end_id))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, share: int = 1) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, offsets, ids) of the rows (doc_id, text) in turns of about BATCH bytes of text, or one longer text.

    A share of 2 takes half of the memory and some more time.
    """
    own, most, held, size = encoder(path), BATCH // share, [], 0
    own.most = MEMO_WORDS // share

    def turn() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        doc_ids, texts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        return doc_ids, *own.encode(texts, end_id)

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1] - before)
            at = to
            if size >= most or at < batch.num_rows:
                yield turn()
                held, size = [], 0
    if held:
        yield turn()


def crc32s(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """crc32 of each piece of ids, as little-endian 32-bit integers; piece i is ids[ends[i] : ends[i + 1]]."""
    data = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    return [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def with_tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, tokens of docs (doc_id, text), as Arrow columns; the lists of a batch share one array of values."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, offsets, ids in encoded(batches, path, end_id):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(offsets)), lists], names=["doc_id", "n_tokens", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Write the token files of docs under out: ranges of doc_id, sorted within, one file for each range.

    The number of files follows the size of the input, so a task's share stays the same however many documents there
    are. An empty table gives a folder with a schema and no rows.
    """
    common.small_batches(docs.sparkSession)
    n = partitions or common.parts(docs, FILE_BYTES)
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    (
        with_tokens(ranged, path, end_id)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.columnindex.truncate.length", 64)
        .parquet(out)
    )


def read_metadata(spark, out: str) -> DataFrame:
    """doc_id and n_tokens alone: the pages of the token lists are not read."""
    return spark.read.parquet(out).select("doc_id", "n_tokens")


def read_range(spark, out: str, first: int, last: int) -> DataFrame:
    """doc_id, n_tokens, tokens of the documents from first to last: files, row groups and pages outside are skipped."""
    return spark.read.parquet(out).where(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "tokens")


def read_tokens(spark, out: str) -> DataFrame:
    """The token files: doc_id, n_tokens, tokens, and where they stand: _file, _at (row in it), _before (ids of all
    files before).

    The sums come from the metadata columns alone. A file holds one range of doc_id, so the first id orders the files.
    """
    files = spark.read.parquet(out).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    sizes = files.groupBy("_file").agg(F.min("doc_id").alias("_first"), F.bool_or(F.col("doc_id").isNull()).alias("_null"), F.sum("n_tokens").alias("_sum"))
    # One row for each file goes to one task here, and back by broadcast: files, not documents.
    order = Window.orderBy(F.desc("_null"), "_first", "_file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_file", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_before"))
    return files.join(F.broadcast(before), "_file").select("doc_id", "n_tokens", "tokens", "_file", "_at", "_before")


def token_digests(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of the files; start counts the ids of all rows before."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint32)
            found = pa.array(crc32s(values, ends), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found, *b.columns[3:]], names=["doc_id", "n_tokens", "ids_crc32", "_file", "_at", "_before"])

    small = read_tokens(spark, out).mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, _file string, _at long, _before long")
    inside = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return small.select("doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32")
