"""N-gram Jaccard join by T-occurrence search, and the groups that its links make.

A document's set holds its distinct word shingles; two documents link when their sets' Jaccard similarity reaches a
threshold. Links are exact: none is lost and none is added but by a collision of 64-bit hashes.

1. Texts with the same set are one class from the start (128-bit digests, summed before the shuffle).
2. Two sets that may link differ in at most D shingles. Cut by hash range into more than D segments, they agree on one
   segment at least; so classes that share a segment go to one family (connected components over segment digests), and
   no link leaves a family. A task sends one row for each segment digest it met, however many copies it read.
   Shingles that many documents hold, as a sample shows, are left out of the segments, so that documents which share no
   more than a passage do not meet; sets with too few others send their rarest shingles instead, one at least of which
   two sets that link share. The sample decides how many meet, never who links.
   Large families are first cut by sketches that show which documents cannot link.
3. Each family is searched by DivideSkip over inverted lists, without the documents of which too few shingles occur in
   any other. Of a query's lists, the L longest are set aside, L growing
   with the overlap T that a link needs at least and shrinking with the longest list; a heap merges the others, skipping
   documents on fewer than T - L of them, or they are counted where they are so dense that hardly any would be skipped;
   the documents so found are probed for in the long lists by binary search, or these are counted where that is less, and
   those that reach the overlap link. The family's central document queries first. A document that its turn finds in the
   central one's group need not query: what it links with is in that group, or has queried or will. Large families are
   searched in pairs of blocks.
4. Links, at most one for each document and task, give the groups.

Words are runs of anything but ASCII white space, with A-Z in lower case. A text of fewer words than a shingle has is
one shingle. Texts without words and null texts have no shingle and link with nothing, not even with each other. Rows
that repeat a doc_id count as one document. Rows with a null doc_id link with nothing; they get their n_shingles and a
null component_id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Segment digests that a map task holds before it sends them on, and that a bucket of the exchange takes.
HELD, BUCKET, LEAST_BUCKETS = 600_000, 1_000_000, 256
#: Shingles in a block of a large family, and in a bucket of families.
BLOCK, GROUPED = 2_000_000, 2_000_000
#: Least cells of a sketch, and documents and cells in a block of sketches.
CELLS, PAIRED, SKETCHED = 128, 3_000, 4_000_000
#: How fast the number of long lists shrinks as the longest of them grows.
MU = 0.001
#: About how many sets at most are sampled for common shingles, in how many of them a common one is, and how many such a
#: task holds at most.
SAMPLED, COMMON, MOST_COMMON = 40_000, 3, 500_000
MEMO_WORDS = 100_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


_words = WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(w) < width:
        h = np.uint64(len(w)) * np.ones(1, np.uint64)
        for x in w:
            h = mix((h ^ x) * _M1)
        return h
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = mix((h ^ w[k : len(w) - width + 1 + k]) * _M1)
    return np.unique(h)


#: Sorted hashes of common shingles, and how often each is in the sample.
Common = tuple[np.ndarray, np.ndarray]
NONE: Common = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def times(h: np.ndarray, often: Common) -> np.ndarray:
    """How often each hash is in the sample, 0 if it is not common."""
    hashes, n = often
    if not len(hashes):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, n[at], 0)


class Segments:
    """Which segment digests a set needs at a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds, self.cuts = num, den, [1], {}

    def scheme(self, n: int) -> int:
        """Sizes bounds[s] to bounds[s + 1] - 1 use scheme s."""
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, self.bounds[-1] * self.den // self.num))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def schemes(self, n: int) -> range:
        """Those of all sizes, from n on, that a set of n can link with; the larger set of a pair gives the scheme."""
        return range(self.scheme(n), self.scheme(n * self.den // self.num) + 1)

    def cut(self, s: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Most differences of two sets in scheme s, where its segments begin, and a salt for each."""
        if s not in self.cuts:
            largest = self.bounds[s + 1] - 1
            most = 2 * largest * (self.den - self.num) // (self.den + self.num)
            k = most + 1 + -(-most * 15 // 100)  # some more, so that empty segments need not count as agreement
            starts = np.array([-(-(i << 64) // k) for i in range(k)], np.uint64)
            salts = mix(np.arange(k, dtype=np.uint64) + np.uint64(s << 32) + _M1)
            self.cuts[s] = most, starts, salts
        return self.cuts[s]

    def count(self, n: int) -> int:
        """About how many digests a set of n gives."""
        return sum(len(starts) for s in self.schemes(n) for most, starts, _ in [self.cut(s)] if most) if n else 0

    def digests(self, h: np.ndarray, often: Common = NONE) -> np.ndarray:
        """Two linking, differing sets of one scheme differ in at most `most` of k segments, with or without the common
        hashes, so agree on k - most. If one has fewer empty segments than that, they agree on one that is not empty; if
        not, both send their rarest hashes, which leave too few to link without one of them."""
        rest = h[times(h, often) == 0]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(rest + _M1), dtype=np.uint64)])
        out, rarest = [], None
        for s in self.schemes(len(h)) if len(h) else ():
            most, starts, salts = self.cut(s)
            if not most:  # only equal sets link
                continue
            at = np.append(np.searchsorted(rest, starts), len(rest))
            empty = at[1:] == at[:-1]
            out.append(mix((sums[at[1:]] - sums[at[:-1]]) ^ salts)[~empty])
            if empty.sum() >= len(starts) - most:
                if rarest is None:
                    least = -(-self.num * len(h) // self.den)  # what links shares at least so many
                    rarest = h[np.argsort(times(h, often), kind="stable")[: len(h) - least + 1]]
                out.append(mix(rarest ^ mix(salts[:1] ^ _M3)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a digest of the set) and n_digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule = Segments(num, den)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                h = shingles(text, width)
                s = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(h ^ _M2), mix(h ^ _M3))]
                rows.append((doc_id, len(h), *s, rule.count(len(h))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "s1", "s2", "n_digests"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, s1 long, s2 long, n_digests long")


def common_shingles(docs: DataFrame, rows: DataFrame, width: int) -> Common:
    """Shingles that several sampled sets hold. The sample is drawn by the digest of the set, so that copies count once."""
    sets = rows.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    step = max(1, -(-rows.count() // SAMPLED))
    some = sets.where(F.pmod(F.xxhash64("s1", "s2"), F.lit(step)) == 0).select("doc_id")

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, width).view(np.int64))

    each = common.join_measured(docs.select("doc_id", "text"), some, ["doc_id"], "inner").select(F.explode(hashes("text")).alias("h"))
    most = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    h, n = most.h.to_numpy(np.int64).view(np.uint64), most.n.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def stars(digests: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first document of each digest, and the distinct links of it with the others: (digests, docs, a, b)."""
    order = np.lexsort((docs, digests))
    digests, docs = digests[order], docs[order]
    first = np.ones(len(digests), bool)
    first[1:] = digests[1:] != digests[:-1]
    head = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = head != docs
    pairs = np.unique(np.stack([head[other], docs[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return digests[first], docs[first], pairs[:, 0], pairs[:, 1]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what (a, b) join, one for each document but the smallest of its group: (smallest, document)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(ids))], np.int64)
    other = roots != np.arange(len(ids))
    return ids[roots[other]], ids[other]


def family_links(docs: DataFrame, width: int, num: int, den: int, buckets: int, often: Common = NONE) -> DataFrame:
    """Links (a, b) that join the documents that share a segment.

    A map task joins its own documents first and sends the digests of a group under the group's smallest document, so
    a hot group counts once for each task; an exchange bucket then joins what the tasks sent.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, held, size = Segments(num, den), [], 0

        def flush() -> pd.DataFrame:
            ids = np.repeat(np.array([d for d, _ in held], np.int64), [len(x) for _, x in held])
            digests, firsts, a, b = stars(np.concatenate([x for _, x in held]), ids)
            a, b = forest(a, b)
            if len(a):  # b is sorted
                at = np.minimum(np.searchsorted(b, firsts), len(b) - 1)
                firsts = np.where(b[at] == firsts, a[at], firsts)
            to = (digests % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [(k, True, digests[p].tobytes(), firsts[p].tobytes()) for k in range(buckets) if len(p := order[ends[k] : ends[k + 1]])]
            if len(a):
                rows.append((int(a[0]) % buckets, False, a.tobytes(), b.tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "open", "x", "y"])

        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                digests = rule.digests(shingles(text, width), often)
                if len(digests):
                    held.append((doc_id, digests))
                    size += len(digests)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        links = [(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(b.x[~b.open], b.y[~b.open], strict=True)]
        if b.open.any():
            digests, firsts = (b"".join(b[c][b.open]) for c in "xy")
            links.append(stars(np.frombuffer(digests, np.uint64), np.frombuffer(firsts, np.int64))[2:])
        a, b = forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
        return pd.DataFrame({"a": a, "b": b})

    sent = docs.select("doc_id", "text").mapInPandas(send, "bucket int, open boolean, x binary, y binary")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long")


def merge_skip(key: array, lists: list[tuple[int, int, int]], least: int) -> tuple[list[int], list[int]]:
    """The documents on at least `least` of the lists, ascending, and on how many each is.

    A list (begin, end, base) holds key[begin:end], base more than its documents. A heap has the next document of each.
    If too few lists stand at the first one, `least - 1` lists jump to what then is first: no document before it can be
    on enough of them.
    """
    at = [begin for begin, _, _ in lists]
    heap = [(key[begin] - base, i) for i, (begin, _, base) in enumerate(lists)]
    heapq.heapify(heap)
    docs, counts = [], []
    while len(heap) >= least:
        doc, moved = heap[0][0], []
        while heap and heap[0][0] == doc:
            moved.append(heapq.heappop(heap)[1])
        if len(moved) >= least:
            docs.append(doc)
            counts.append(len(moved))
            to = doc + 1
        else:
            while len(moved) < least - 1:
                moved.append(heapq.heappop(heap)[1])
            to = heap[0][0]
        for i in moved:
            _, end, base = lists[i]
            if key[at[i]] < to + base:
                at[i] = bisect_left(key, to + base, at[i] + 1, end)
            if at[i] < end:
                heapq.heappush(heap, (key[at[i]] - base, i))
    return docs, counts


def search(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) that join all linked sets of a family; of links that would close a ring, none is needed."""
    ids, sizes = np.arange(len(sets)), np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(ids, sizes)
    while True:
        _, rank, n = np.unique(every, return_inverse=True, return_counts=True)
        able = den * np.bincount(owner, n[rank] > 1, len(ids)) >= num * sizes
        if able.all():
            break
        # What no other document can share enough with links with nothing, nor do its shingles count for the others.
        every, owner, ids, sizes = every[able[owner]], (np.cumsum(able) - 1)[owner[able[owner]]], ids[able], sizes[able]
        if not len(ids):
            return []
    m = len(ids)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    key = np.sort(rank.astype(np.int64) * m + owner)  # the inverted lists, one after the other
    plain, docs = array("q", key.tobytes()), key % m
    begins = np.concatenate([[0], np.cumsum(n)])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    central = int(np.argmax(np.add.reduceat(n[rank], offsets[:-1]) / sizes))
    out = []

    def counted(lists: np.ndarray) -> np.ndarray:
        """On how many of the lists each document is."""
        return np.bincount(np.concatenate([docs[begins[r] : begins[r + 1]] for r in lists]), minlength=m) if len(lists) else np.zeros(m, np.int64)

    def query(q: int) -> None:
        own = rank[offsets[q] : offsets[q + 1]]
        own = own[np.argsort(n[own], kind="stable")]
        least = -(-num * len(own) // den)  # T: whatever links with q shares at least so many of its shingles
        apart = min(least - 1, int(least / (MU * math.log2(int(n[own[-1]]) + 1) + 1)))  # L
        short, long_ = own[: len(own) - apart], own[len(own) - apart :]
        if n[short].sum() > m // 8:
            found = np.flatnonzero((held := counted(short)) >= least - apart)
            counts = held[found]
        else:
            merged = merge_skip(plain, [(int(begins[r]), int(begins[r + 1]), int(r) * m) for r in short], least - apart)
            found, counts = (np.array(x, np.int64) for x in merged)
        mine = root(q)
        near = den * np.minimum(sizes[found], sizes[q]) >= num * np.maximum(sizes[found], sizes[q])
        keep = [k for k in np.flatnonzero(near).tolist() if root(int(found[k])) != mine]
        found, counts = found[keep], counts[keep]
        if len(found) and n[long_].sum() < 8 * len(found) * len(long_):
            counts, long_ = counts + counted(long_)[found], long_[:0]
        step = max(1, 1_000_000 // max(1, len(long_)))
        for k in range(0, len(found), step):
            some = found[k : k + step]
            probe = long_[:, None] * m + some
            at = np.minimum(np.searchsorted(key, probe), len(key) - 1)
            overlap = counts[k : k + step] + (key[at] == probe).sum(0)
            for d in some[den * overlap >= num * (sizes[q] + sizes[some] - overlap)]:
                if (a := root(q)) != (b := root(int(d))):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(ids[q]), int(ids[d])))

    # Those most like the central document come first: they carry its group on, so that fewer are left to query.
    shared = np.add.reduceat(np.isin(rank, rank[offsets[central] : offsets[central + 1]]).astype(np.int64), offsets[:-1])
    query(central)
    for q in np.argsort(-shared / (sizes + sizes[central] - shared), kind="stable").tolist():
        if root(q) != root(central):
            query(q)
    return out


def sketch(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of equal ranges, up to 255; one range for 4 to 8 hashes, CELLS at least."""
    bits = max(CELLS, len(h) // 4).bit_length() - 1
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(sketches: list[bytes], sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all documents whose sketches allow a link: counts of two linking sets differ by at most
    (den - num) / (den + num) of their sizes' sum, so no link is lost. Of two sketches the finer is folded to the other."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    width = np.array([len(sketches[i]) for i in order])
    a, b = [], []
    for cells in np.unique(width):
        start, end = np.searchsorted(width, [cells, cells + 1])
        stop = int(np.searchsorted(sizes, sizes[end - 1] * den // num, side="right"))  # up to twice the cells
        counts = np.zeros((stop - start, cells), np.int16)
        for row, i in enumerate(order[start:stop]):
            counts[row] = np.frombuffer(sketches[i], np.uint8).reshape(cells, -1).sum(1)
        k = start
        while k < end:
            last = int(np.searchsorted(sizes, sizes[k] * den // num, side="right"))
            own = np.arange(k, min(k + max(1, min(16, 8_000_000 // ((last - k) * cells))), end))
            last = int(np.searchsorted(sizes, sizes[own[-1]] * den // num, side="right"))
            away = np.abs(counts[own - start, None, :] - counts[None, k - start : last - start, :]).sum(2, dtype=np.int64)
            near = away * (den + num) <= (den - num) * (sizes[own, None] + sizes[None, k:last])
            first = near.argmax(0)  # each document joins the first of own that it may link with, and those join
            x, y = np.nonzero(near)
            met = np.unique(np.stack([first[y], x], 1), axis=0)
            hit = np.flatnonzero(near.any(0))
            a += [own[first[hit]], own[met[:, 0]]]
            b += [hit + k, own[met[:, 1]]]
            k = int(own[-1]) + 1
            if sum(map(len, a)) > 2_000_000:
                one = forest(np.concatenate(a), np.concatenate(b))
                a, b = [one[0]], [one[1]]
    a, b = forest(np.concatenate(a), np.concatenate(b))
    return order[a], order[b]


def refined(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """members with large families cut into those that sketches can tell apart.

    Documents that share a long passage may share a segment by chance and so make a large family; their sets differ by
    far more than links allow, which a sketch shows if its cells grow with the set. Sketches meet in bands of sizes
    that may link, a family's band in pairs of blocks.
    """
    sums = members.groupBy("family").agg(F.sum("n_shingles").alias("_sum")).where(F.col("_sum") > BLOCK)
    big = common.settle(members.join(sums.select("family"), "family").select("doc_id", "family", "n_shingles"))
    if big.isEmpty():
        return members

    @F.pandas_udf("binary")
    def sketched(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch(shingles(t, width)))

    # Sizes that may link lie in one band or in two neighbours; a band is a little wider than they can be apart.
    band = F.floor(F.ln("n_shingles") / F.lit(math.log(1.01 * den / num))).cast("int")
    rows = common.settle(common.join_measured(docs.select("doc_id", "text"), big, ["doc_id"], "inner").select("doc_id", "family", "n_shingles", sketched("text").alias("h")))
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1)))
    bands = rows.groupBy("family", "band").agg(F.count(F.lit(1)).alias("_docs"), F.sum(F.length("h")).alias("_cells")).where("_docs > 1")
    bands = common.settle(bands.select("family", "band", F.ceil(F.greatest(F.col("_docs") / PAIRED, F.col("_cells") / SKETCHED)).cast("int").alias("_blocks")))
    total = bands.agg(F.sum(F.col("_blocks") * F.col("_blocks"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in b.groupby(["family", "band", "i", "j"]):
            ids = one.doc_id.to_numpy()
            x, y = may_link(list(one.h), one.n_shingles.to_numpy(np.int64), num, den)
            out.append(pd.DataFrame({"a": ids[x], "b": ids[y]}))
        return pd.concat(out)

    met = paired(common.join_measured(rows, bands, ["family", "band"], "inner"), "n_shingles", "band")
    near = met.withColumn("bucket", F.pmod(F.xxhash64("family", "band", "i", "j"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, "a long, b long")
    cut = common.components(near).withColumnRenamed("node", "doc_id")
    new = big.select("doc_id", "n_shingles").join(cut, "doc_id").select("doc_id", F.col("component").alias("family"), "n_shingles")
    return members.join(big.select("family").distinct(), "family", "left_anti").select("doc_id", "family", "n_shingles").unionByName(new)


def paired(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, family, i, j, h: a row for each pair of its family's blocks (_blocks) that a document takes part in."""
    mine = F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_blocks") - 1, F.lit(0))), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    pairs = F.when(F.col("_blocks") > 1, F.filter(others, lambda p: p["i"] < p["j"])).otherwise(others)
    return rows.select("doc_id", "family", *more, "h", F.explode(pairs).alias("p")).select("doc_id", "family", *more, "p.i", "p.j", "h")


def links(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within families. members: doc_id, family, n_shingles of one document for each class and family."""
    spark = docs.sparkSession
    sums = members.groupBy("family").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n_shingles").alias("_sum")).where("_docs > 1")
    found = common.settle(members.join(sums, "family").withColumn("_blocks", F.ceil(F.col("_sum") / BLOCK).cast("int")).select("doc_id", "family", "n_shingles", "_blocks"))
    total = found.agg(F.sum(F.col("n_shingles") * F.col("_blocks"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUPED))
    rows = common.join_measured(docs.select("doc_id", "text"), found.select("doc_id", "family", "_blocks"), ["doc_id"], "inner")

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, width).tobytes())

    dealt = paired(rows.select("doc_id", "family", "_blocks", hashes("text").alias("h"))).withColumn("bucket", F.pmod(F.xxhash64("family", "i", "j"), F.lit(buckets)))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in b.groupby(["family", "i", "j"]):
            one = one.sort_values("doc_id", kind="stable")
            sets = [np.frombuffer(h, np.uint64) for h in one.h]
            ids = one.doc_id.to_numpy()
            out += [(ids[x], ids[y]) for x, y in search(sets, num, den)] if len(ids) > 1 else []
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("bucket").applyInPandas(run, "a long, b long")


def groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): the smallest doc_id reachable by links."""
    common.small_batches(docs.sparkSession)
    # pandas would hand the ids of a batch with a null over as floats, which lose digits.
    docs, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(shingles(t, width))).astype("int64")

    apart = nameless.select(F.lit(None).cast("long").alias("doc_id"), counted("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    rows = common.settle(signed(docs, width, num, den))
    total = rows.agg(F.sum("n_digests")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET))
    families = common.components(family_links(docs, width, num, den, buckets, common_shingles(docs, rows, width)))
    some = rows.where("n_shingles > 0")
    key = ["s1", "s2", "n_shingles"]
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("head"))
    member = families.join(some.withColumnRenamed("doc_id", "node"), "node").groupBy("component", *key).agg(F.min("node").alias("doc_id"))
    # A class has one family, and the family's copies include its head: all copies give the same digests.
    member = common.settle(member.select("doc_id", F.col("component").alias("family"), "n_shingles"))
    found = links(docs, refined(docs, member, width, num, den), width, num, den)
    linked = common.components(found)
    classes = classes.join(linked.withColumnRenamed("node", "head"), "head", "left").select(*key, F.coalesce("component", "head").alias("component_id"))
    return rows.join(classes, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(apart)
