"""Language identification by rank-order profiles.

A profile is the ranked list of the most frequent letter n-grams (1 to 3, words padded with a space) of a language;
a document's own list is compared with each profile by out-of-place distance, and the nearest language wins. A list's
ties are broken by n-gram code, so reruns agree; a tie of languages goes to the first by name.

Profiles are counted over all training rows: (doc_id, text, language) rows with a text and a language. Texts that are
null or hold no letter get `und` and score 0, and so does everything if there are no training rows. Texts are read
whole. Repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: N-grams in a profile, and in a document's list.
PROFILE, LISTED = 600, 400
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, and a space for anything else."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text and their counts. A code holds up to three code points of 21 bits."""
    cps = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    cps = np.concatenate([[32], cps, [32]])
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32)  # one space between words
    c = cps[keep]
    letter = c != 32
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = ((two[:-1] << 21) | c[2:])[letter[1:-1]]
    return np.unique(np.concatenate([c[letter], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:most]]


def profiles(train: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Ranked n-gram codes of each language of train (text, lang), counted over all rows.

    Each task sums its counts before the shuffle; the driver gets `most` codes for each language. Languages are the
    distinct labels of the training rows: profiles are meant for tens or hundreds of them, and go to every task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0

        def summed() -> pd.DataFrame:
            out = []
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                out.append(pd.DataFrame({"lang": lang, "code": codes, "n": np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)}))
            return pd.concat(out)

        for b in batches:
            for lang, text in zip(b.lang, b.text, strict=True):
                held.setdefault(lang, []).append(part := ngrams(text))
                size += len(part[0])
                if size > 2_000_000:
                    done = summed()
                    held = {x: [(g.code.to_numpy(), g.n.to_numpy())] for x, g in done.groupby("lang")}
                    if (size := len(done)) > 1_000_000:
                        yield done
                        held, size = {}, 0
        if held:
            yield summed()

    common.small_batches(train.sparkSession)
    grams = train.where("text is not null and lang is not null").select("lang", "text").mapInPandas(count, "lang string, code long, n long")
    sums = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Best of 64 hashed parts of a language first, so no language's n-grams meet in one task.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(64))).orderBy(F.desc("n"), "code")
    some = sums.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most)
    best = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("_r") <= most)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "code", "_r").collect():
        out.setdefault(r.lang, []).append((r._r, r.code))
    return {lang: np.array([c for _, c in sorted(pairs)], np.int64) for lang, pairs in sorted(out.items())}


def nearest(own: np.ndarray, tables: list[tuple[str, np.ndarray, np.ndarray, int]]) -> tuple[str, float]:
    """The language with the least out-of-place distance, and how far from the worst possible it is, from 0 to 1."""
    if not len(own) or not tables:
        return UNKNOWN, 0.0
    place = np.arange(len(own))
    best, least = UNKNOWN, np.inf
    for lang, codes, ranks, worst in tables:
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        away = np.where(codes[at] == own, np.abs(ranks[at] - place), worst).sum() / (worst * len(own))
        if away < least:
            best, least = lang, away
    return best, float(min(1.0, max(0.0, 1.0 - least)))


def identify(docs: DataFrame, known: dict[str, np.ndarray], most: int = LISTED) -> DataFrame:
    """All columns of docs (with a text) and lang_pred, score, which replace columns of these names. Only the text is used."""
    worst = max([PROFILE, *map(len, known.values())])
    tables = [(lang, codes[o], o.astype(np.int64), worst) for lang, codes in sorted(known.items()) if len(codes) for o in [np.argsort(codes)]]

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(ranked(*ngrams(t), most), tables) if t else (UNKNOWN, 0.0) for t in texts], columns=["lang_pred", "score"])

    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), run("text").alias("_found"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*kept, "_found.lang_pred", "_found.score")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no profile learns from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    return profiles(docs.where(~held_out()).select("text", "lang"))
