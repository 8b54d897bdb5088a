"""Document fingerprints by Order MinHash, whose likeness follows the edit distance rather than the set of k-mers alone.

A text's k-mers (code points) are numbered by occurrence, so that repeats count as often as they occur. Each of
FUNCTIONS hash functions takes the TUPLE smallest of the numbered k-mers, brings them back into the order of the text and
hashes the tuple; the hashes are the fingerprint, eight hex digits each. Two texts agree in one of them with a
probability that falls when k-mers differ in number, and again when their order does. Likeness is the share of agreeing ones.

Texts shorter than a k-mer are one k-mer, filled up with U+10FFFF; null counts as empty, and all empty texts are alike.
Equal texts have equal fingerprints. A worker holds a batch of texts, about 60 bytes for a code point of its longest.
compare_neighbours also pairs each row with the next one by descending id, null ids last. Rows of one id follow by the
hash of their text; rows alike in both are interchangeable and lie in one task, which reads them as a stream. Extra
columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common

#: Code points of a k-mer, k-mers of a tuple, hash functions.
K, TUPLE, FUNCTIONS = 8, 2, 64
#: K-mers of a text that each function is expected to let through to the choice of the smallest.
THROUGH = 10
#: Code points of the texts that are worked on together; hash functions and k-mers evaluated in one go.
GROUP, ROWS, COLUMNS = 1 << 16, 8, 1 << 14
#: Bytes of text in a partition.
PART = 16 << 20
PAD = "\U0010ffff"
BASE, SEED = 0x100000001B3, 211


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit of the input shows in every bit of the output."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k codes in a row, from those of half as many."""
    if k == 1:
        return codes
    half = windows(codes, k // 2)
    n, factor = len(codes) - k + 1, np.uint64(pow(BASE, k // 2, 1 << 64))
    out = half[: len(half) - k // 2][: n + k % 2] * factor + half[k // 2 :][: n + k % 2]
    return out[:n] * np.uint64(BASE) + codes[k - 1 :] if k % 2 else out


def numbered_kmers(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all k-mers of all texts in order: their text, their hash, and a 32-bit hash of k-mer and occurrence number."""
    padded = [t + PAD * (k - len(t)) for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded])
    counts = sizes - k + 1
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(text)) + (text * (k - 1))
    rolled = windows(codes, k)
    kmer = mixed(rolled[at])
    group = kmer ^ mixed(np.arange(1, len(texts) + 1))[text]
    order = np.argsort(group)
    ranked = group[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    occurrence = np.zeros(len(kmer), np.uint64)
    if len(again):
        run = np.zeros(len(kmer), bool)
        run[again] = run[again - 1] = True
        members = np.flatnonzero(run)
        places, key = order[members], ranked[members]
        stable = np.lexsort((places, key))
        places, key = places[stable], key[stable]
        occurrence[places] = np.arange(len(key)) - np.searchsorted(key, key)
    numbered = mixed(kmer + occurrence * np.uint64(0x9E3779B97F4A7C15))
    return text, kmer, (numbered >> np.uint64(32)).astype(np.uint32)


def chosen(text: np.ndarray, numbered: np.ndarray, texts: int, functions: int, size: int) -> np.ndarray:
    """Places of the `size` smallest k-mers of each text under each function, smallest first; -1 where a text has fewer."""
    draw = np.random.default_rng(SEED)
    masks = draw.integers(0, 1 << 32, functions, np.uint32)
    factors = draw.integers(0, 1 << 31, functions, np.uint32) * np.uint32(2) + np.uint32(1)
    counts = np.bincount(text, minlength=texts)
    out = np.full((texts * functions, size), -1)
    most = np.minimum(THROUGH * 2.0**32 / np.maximum(counts, 1), 2.0**32 - 1)
    places = np.arange(len(text))
    value, below = np.empty((ROWS, COLUMNS), np.uint32), np.empty((ROWS, COLUMNS), bool)
    while len(places):
        found, keys = [], []
        for start in range(0, len(places), COLUMNS):
            here = places[start : start + COLUMNS]
            u, limit, owner = np.zeros(COLUMNS, np.uint32), np.zeros(COLUMNS, np.uint32), text[here]
            u[: len(here)], limit[: len(here)] = numbered[here], most[owner]
            for f in range(0, functions, ROWS):
                n = min(ROWS, functions - f)
                np.bitwise_xor(u[None], masks[f : f + n, None], out=value[:n])
                np.multiply(value[:n], factors[f : f + n, None], out=value[:n])
                np.less_equal(value[:n], limit[None], out=below[:n])
                eight = np.flatnonzero(below[:n].view(np.uint64) != 0)  # eight comparisons at a time
                which, inside = np.nonzero(below[:n].reshape(-1, 8)[eight])
                at = eight[which] * 8 + inside
                row, column = at // COLUMNS, at % COLUMNS
                if len(here) < COLUMNS:
                    real = column < len(here)
                    at, row, column = at[real], row[real], column[real]
                found.append(here[column])
                keys.append(((owner[column] * functions + f + row).astype(np.uint64) << np.uint64(32)) | value.ravel()[at])
        found, keys = np.concatenate(found), np.concatenate(keys)
        order = np.argsort(keys)
        ranked = keys[order]
        if (ranked[1:] == ranked[:-1]).any():
            order = np.argsort(keys, kind="stable")  # of equal values the earlier place
        pair = (ranked >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        ends = np.append(first[1:], len(pair))
        for j in range(size):
            some = first + j < ends
            out[pair[first[some]], j] = found[order[first[some] + j]]
        short = (out.reshape(texts, functions, size)[:, :, -1] < 0).any(1) & (counts >= size) & (most < 2.0**32 - 1)
        most = np.where(short, np.minimum(most * 8, 2.0**32 - 1), most)
        places = np.flatnonzero(short[text])
    return out.reshape(texts, functions, size)


def signatures(texts: Sequence[str], k: int = K, size: int = TUPLE, functions: int = FUNCTIONS) -> np.ndarray:
    """A row of 32-bit hashes for each text."""
    if not len(texts):
        return np.zeros((0, functions), np.uint32)
    out, start = [], 0
    lengths = np.cumsum([max(len(t), k) for t in texts])
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(lengths, (lengths[start - 1] if start else 0) + GROUP, "right")))
        some = texts[start:end]
        text, kmer, numbered = numbered_kmers(some, k)
        places = chosen(text, numbered, len(some), functions, size)
        in_order = np.sort(np.where(places < 0, len(kmer), places), axis=2)
        hashes = np.append(kmer, np.uint64(0))[in_order]
        folded = np.zeros(hashes.shape[:2], np.uint64)
        for i in range(size):
            folded = mixed(folded * np.uint64(0x9E3779B97F4A7C15) + hashes[:, :, i])
        out.append((folded >> np.uint64(32)).astype(np.uint32))
        start = end
    return np.concatenate(out)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


@F.pandas_udf(StringType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([as_text(s) for s in signatures(texts.fillna("").tolist())], dtype=object)


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text."""
    return _fingerprint(text)


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes in which two fingerprints agree."""
    agree = (F.when(F.substring(a, i + 1, 8) == F.substring(b, i + 1, 8), 1).otherwise(0) for i in range(0, 8 * FUNCTIONS, 8))
    return reduce(add, agree) / F.lit(float(FUNCTIONS))


def dealt_in_order(docs: DataFrame) -> DataFrame:
    """Rows by descending id, in parts that follow each other; each part ends with a copy of the row after its last.

    The cuts come from a pass over ids and hashes only: two keys for each part pass the driver.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = common.parts(rows, PART)
    heads = rows.select(key.alias("key")).repartitionByRange(n, F.desc("key")).groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("key"))
    firsts = sorted((tuple(r.key) for r in heads.collect()), reverse=True)
    rising = [tuple(-x for x in (int(f[0]), f[1], f[2])) for f in firsts]

    @F.pandas_udf("array<int>")
    def places(known: pd.Series, id: pd.Series, tie: pd.Series) -> pd.Series:
        """A row's part, and the part before it, as -1 - part, if the row heads its own."""
        found = []
        for one in zip(known, id, tie):
            at = tuple(-int(x) for x in one)
            p = bisect_right(rising, at) - 1
            found.append([p, -1 - (p - 1) % len(rising)] if rising[p] == at else [p])
        return pd.Series(found, dtype=object)

    keyed = rows.withColumn("key", key).withColumn("to", F.explode(places("key.known", "key.id", "key.tie")))
    part, copy = F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")), F.col("to") < 0
    dealt = keyed.select("doc_id", "text", "key", part.alias("part"), copy.alias("copy"))
    return dealt.repartitionById(len(rising) or 1, "part").sortWithinPartitions("part", "copy", F.desc("key"))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint; the digest and fingerprint of the text whose second half is the next row's beginning;
    likeness to that text and to the next row's."""
    common.small_batches(docs.sparkSession)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the row whose next one is to come: id, text, signature
        part = None
        for batch in batches:
            out = []
            signs = signatures(batch.text.tolist())
            pairs = []
            for doc_id, text, p, copy, sign in zip(*(batch[c] for c in ("doc_id", "text", "part", "copy")), signs):
                if held and p == part:
                    pairs.append((*held.pop(), text, sign))
                part = p
                if not copy:
                    held = [(doc_id, text, sign)]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in pairs]
            for (doc_id, text, sign, _, following), new, other in zip(pairs, edited, signatures(edited)):
                out.append((doc_id, len(text), sha256(new.encode()).hexdigest(), as_text(sign), as_text(other), (sign == other).mean(), (sign == following).mean()))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # ids travel as text: pandas would turn them to doubles where some are null
    rows = dealt_in_order(docs).select(F.col("doc_id").cast("string"), "text", "part", "copy")
    return rows.mapInPandas(compare, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
