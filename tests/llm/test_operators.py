"""Each operator against a plain recomputation, on fixtures with nulls, empties, ties, repeats and odd texts."""

import hashlib
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann, chat, common, html, jaccard, langid, mixing, packing, pii, quality, queries, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    n = len(texts)
    lang, source = more.get("lang", ["en"] * n), more.get("source", ["s"] * n)
    ids = more.get("ids", range(n))
    return spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b in zip(ids, texts, lang, source)], DOCS)


def prose(rng, n, vocabulary=300):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


ODD = [None, "", "   \n ", "one", "two words", "Ärger 😀 naïve", "a  b \n c", "x" * 3000, "tab\tand\x0bmore", "7 7 7 7 7 7 7 7"]


# --- packing and tokens


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 12), 40]) for _ in range(300)]
    rules = packing.best_fit(Counter(lengths), 40)
    bins = defaultdict(list)
    for length, n in Counter(lengths).items():
        for j in range(n):
            own = [r for r in rules if r[0] == length and r[1] <= j <= r[2]]
            assert len(own) == 1
            _, first, _, base, each, shift = own[0]
            bins[base + (j - first) // each].append((shift + (j - first) % each * length, length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 40
    room = []  # best fit decreasing, piece by piece
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(40 - x)
    assert len(bins) == len(room)
    assert sorted(40 - sum(n for _, n in items) for items in bins.values()) == sorted(room)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + [prose(rng, 80) for _ in range(20)]
    texts += ["".join(rng.choice(list(" \n\tab'sé1!\xa0\u2003")) for _ in range(60)) for _ in range(300)] + ["<|endoftext|> a <|endoftext|>"]
    texts += ["a\n\nb", "\n\na b", "a\n b", " \nfoo", "foo\n\n", "foo bar\n\n baz", "a\r\nb c", "it's don't\nI'll 's", "a\t\nb c", "a \n\nb", None]
    for own in (tokens.Encoder(path), tokens.Encoder(path)):
        own.clear()
        for _ in range(2):  # with words unknown, then known
            offsets, ids = own.encode(pa.array(texts), 0)
            for i, text in enumerate(texts):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 0], text
    own.cuts = False
    assert own.encode(pa.array(texts), 0)[1].tolist() == ids.tolist()
    assert own.encode(pa.array([], pa.string()), 0)[0].tolist() == [0]


def library_ids(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    ids = list(range(0, 3 * len(texts), 3))
    out = str(tmp_path / "t")
    tokens.write_tokens(docs(spark, texts, ids=ids).repartition(3), out, tokens.tokenizer_path())
    got = sorted(map(tuple, tokens.token_digests(spark, out).collect()))
    want, at = [], 0
    for i, t in zip(ids, texts):
        own = library_ids(t, 0)
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert got == want
    meta = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    column = meta.column(meta.num_columns - 1)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    texts, ids = ["b c", "a", None, "d e f", "a"], [5, None, 5, 2, None]
    out = str(tmp_path / "t")
    tokens.write_tokens(docs(spark, texts, ids=ids).repartition(2), out, tokens.tokenizer_path(), partitions=3)
    held = [r for f in sorted((tmp_path / "t").glob("*.parquet")) for r in pq.read_table(f).to_pylist()]
    rows = sorted(tokens.token_digests(spark, out).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids_crc32) for r in rows] == [(r["doc_id"], crc(r["tokens"])) for r in held]
    assert [r.doc_id for r in rows] == [None, None, 2, 5, 5]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(5)]


def test_token_files_read_in_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PAGE_ROWS", 20)
    out = str(tmp_path / "t")
    tokens.write_tokens(docs(spark, [f"word {i}" for i in range(1000)]), out, tokens.tokenizer_path(), partitions=1)
    some = tokens.read_range(spark, out, 300, 309)
    assert sorted(r.doc_id for r in some.collect()) == list(range(300, 310))
    leaf = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() <= 60  # of 1000: the other pages are skipped
    assert tokens.read_metadata(spark, out).columns == ["doc_id", "n_tokens"]


def test_token_files_empty(spark, tmp_path):
    out = str(tmp_path / "t")
    tokens.write_tokens(docs(spark, []), out, tokens.tokenizer_path())
    assert tokens.token_digests(spark, out).count() == 0


def test_packing(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, rng.choice([5, 50, 400, 1500])) for _ in range(60)] + ["same text"] * 5
    ids = [i if i < 75 else 75 for i in range(len(texts))]  # repeated ids
    rows = packing.pack(docs(spark, texts, ids=ids), capacity=256).collect()
    want = []
    for i, t in zip(ids, texts):
        own = library_ids(t, 2)
        first = (len(own) - 1) % 256 + 1
        cuts = [0, *range(first, len(own) + 1, 256)]
        want += [(i, p, a, b - a, crc(own[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs(spark, [])).count() == 0


# --- mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1], 45, [20, 20, 20]) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.targets([], [], 0, []) == []


@pytest.mark.parametrize("seed", range(6))
def test_knapsack(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 30))
    counts = rng.integers(1, 20, len(lengths))
    total = int(lengths @ counts)
    for budget in (0, 1, 7, total // 3, total - 1, total, total + 5):
        take = mixing.knapsack(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and lengths @ take <= budget
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            if total > 4000:
                break
            reach |= {r + k * n for r in reach for k in range(c + 1)}
        if total <= 4000:
            assert lengths @ take == max(r for r in reach if r <= budget)
        elif 400 < budget <= total - 400:
            assert budget - lengths @ take <= 1


def test_mix(spark):
    rng = random.Random(4)
    texts = ODD + [prose(rng, rng.randrange(1, 60)) for _ in range(300)] + ["a b c"] * 50
    sources = [rng.choice(["b", "a", None, "é", "big", "big", "big"]) for _ in texts]
    df = docs(spark, texts, source=sources)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORDS.findall(texts[r.doc_id] or ""))
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), [2 * size[s] for s in order])
    for s, t in zip(order, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 2, s
        assert all(r.source_size == size[s] for r in rows if r.source == s)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, " "])).collect()] == [0, 0]


# --- near duplicates


def word_sets(texts, width):
    out = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORDS.findall(t or "")]
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_groups(ids, texts, width, num, den):
    sets = word_sets(texts, width)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if sets[x] and sets[y]:
                shared = len(sets[x] & sets[y])
                if den * shared >= num * (len(sets[x]) + len(sets[y]) - shared):
                    a, b = sorted((root(ids[x]), root(ids[y])))
                    parent[b] = a
    return [(i, len(s), root(i)) for i, s in zip(ids, sets)]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.choice([0, 1, 1])] = [] if rng.random() < 0.3 and len(w) > 5 else ["e%d" % rng.randrange(10**6)]
    return " ".join(w)


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, width, num, monkeypatch):
    rng = random.Random(width)
    texts = list(ODD) + ["One", "ONE", "two WORDS", "É"]
    for n in (6, 12, 25, 60, 150, 400):
        for _ in range(4):
            base = prose(rng, n, 10**4)
            texts += [base, base.upper()] + [edited(rng, base, rng.randrange(0, 1 + n // 12)) for _ in range(12)]
    hot, passage = prose(rng, 120, 10**4), prose(rng, 60, 10**4)
    texts += [passage + " " + prose(rng, 60, 10**4) for _ in range(60)]  # no near copies of each other
    texts += [edited(rng, hot, rng.randrange(0, 6)) for _ in range(120)]
    rng.shuffle(texts)
    ids = [7 * i + 3 for i in range(len(texts))]
    df = docs(spark, texts, ids=ids).repartition(4)
    want = brute_groups(ids, texts, width, num, 100)
    assert len({c for *_, c in want}) < len(texts) - 100
    assert sorted(map(tuple, jaccard.groups(df, width, num, 100).collect())) == sorted(want)
    monkeypatch.setattr(jaccard, "BLOCK", 4_000)  # large families, many blocks
    monkeypatch.setattr(jaccard, "PAIRED", 30)
    assert sorted(map(tuple, jaccard.groups(df, width, num, 100).collect())) == sorted(want)


def test_groups_small(spark):
    assert jaccard.groups(docs(spark, [])).count() == 0
    got = jaccard.groups(docs(spark, ["a b c d e f", "a b c d e f", None, None], ids=[5, 5, 9, 4])).collect()
    assert sorted(map(tuple, got)) == [(4, 0, 4), (5, 2, 5), (5, 2, 5), (9, 0, 9)]


def test_groups_of_null_ids(spark):
    big = 2**53 + 1  # not a float
    got = jaccard.groups(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "x", "a b c d e f"], ids=[None, big + 2, big, None, None, None]).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(big, 2, big), (big + 2, 2, big), (None, 2, None), (None, 2, None), (None, 0, None), (None, 1, None)], key=str)


def test_divide_skip_finds_every_link():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.01, 0.05, 0.2]), rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(25)]
        links = {(a, b) for a in range(25) for b in range(a) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - k)}

        def classes(pairs):
            p = list(range(25))
            r = lambda i: i if p[i] == i else r(p[i])
            for a, b in pairs:
                p[max(r(a), r(b))] = min(r(a), r(b))
            return [r(i) for i in range(25)]

        assert classes(links) == classes(jaccard.search(sets, 80, 100))


def test_divide_skip_on_a_large_family():
    """Thousands of near copies, in chains that the central document doesn't reach, take a few queries."""
    rng = np.random.default_rng(55)
    one = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets, way = [], one.copy()
    for k in range(3000):
        if k % 10 == 0:
            way[rng.integers(0, 200)] = rng.integers(0, 2**63)
        own = way.copy()
        own[rng.integers(0, 200, 4)] = rng.integers(0, 2**63, 4)
        sets.append(np.unique(own))
    start = time.time()
    links = jaccard.search(sets, 80, 100)
    assert time.time() - start < 60 and len(links) == 2999


def test_segments_without_common_shingles_lose_no_link():
    rng = np.random.default_rng(57)
    hot = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    common = hot, rng.integers(3, 90, 300)
    for num in (80, 90):
        rule, linked = jaccard.Segments(num, 100), 0
        for _ in range(600):
            n = int(rng.integers(3, 90))
            base = np.unique(np.where(rng.random(n) < rng.choice([0, 0.3, 0.9, 1]), rng.choice(hot, n), rng.integers(0, 2**64, n, dtype=np.uint64)))
            pair = [np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.03, 0.08]), rng.choice([hot, np.arange(9, dtype=np.uint64)][rng.integers(2)], len(base)), base)) for _ in "ab"]
            shared = len(np.intersect1d(*pair))
            if len(np.union1d(*pair)) > shared and 100 * shared >= num * len(np.union1d(*pair)):
                linked += 1
                assert len(np.intersect1d(*(rule.digests(h, common) for h in pair)))
        assert linked > 60


def test_documents_that_share_a_passage_meet_in_no_family(spark, monkeypatch):
    """Else a family grows with the table, and the pairs of its sketches with its square."""
    rng = random.Random(58)
    passages = [prose(rng, 30, 10**4) for _ in range(3)]
    texts = [p + " " + prose(rng, rng.randrange(1, 150), 10**6) for p in passages for _ in range(250)]
    texts += [edited(rng, t, 1) for t in texts[::10]] + [edited(rng, p, 1) for p in passages for _ in range(4)]
    ids = list(range(len(texts)))
    largest, before = [], jaccard.refined

    def seen(docs, members, *rest):
        largest.append(max(r["count"] for r in members.groupBy("family").count().collect()))
        return before(docs, members, *rest)

    monkeypatch.setattr(jaccard, "refined", seen)
    got = jaccard.groups(docs(spark, texts, ids=ids).repartition(4), 5, 80, 100)
    assert sorted(map(tuple, got.collect())) == sorted(brute_groups(ids, texts, 5, 80, 100))
    assert largest[0] < 60


def test_divide_skip_on_near_copies_that_do_not_link():
    """Many that share most shingles, but too few to link with the central document, take a count of lists each."""
    rng = np.random.default_rng(59)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    one, sets = fresh(400), []
    for k in range(2400):
        own = sets[rng.integers(0, k)] if k and rng.random() < 0.1 else one
        sets.append(np.unique(np.where(rng.random(len(own)) < rng.choice([0.02, 0.08, 0.15, 0.25]), fresh(len(own)), own)))
    start = time.time()
    links = jaccard.search(sets, 90, 100)
    assert time.time() - start < 20
    _, rank, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    column = np.cumsum(n > 1) - 1
    shared = np.zeros((len(sets), column[-1] + 1), np.float32)
    shared[np.repeat(np.arange(len(sets)), sizes)[n[rank] > 1], column[rank[n[rank] > 1]]] = 1
    overlap = shared @ shared.T
    a, b = np.nonzero(np.triu(100 * overlap >= 90 * (sizes[:, None] + sizes - overlap), 1))
    assert all(100 * overlap[x, y] >= 90 * (sizes[x] + sizes[y] - overlap[x, y]) for x, y in links)
    want, got = (sorted(zip(*(x.tolist() for x in jaccard.forest(*pairs)))) for pairs in ((a, b), np.array(links).T))
    assert want == got and 300 < len(want) < 2000


def test_merge_skip_equals_counting():
    rng = random.Random(56)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 12))]
        key, spans = array("q"), []
        for k, own in enumerate(lists):
            spans.append((len(key), len(key) + len(own), 1000 * k))
            key.extend(x + 1000 * k for x in own)
        least = rng.randrange(1, len(lists) + 1)
        count = Counter(x for own in lists for x in own)
        want = sorted((d, n) for d, n in count.items() if n >= least)
        assert list(zip(*jaccard.merge_skip(key, spans, least), strict=True)) == want


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    p = {x: x for pair in pairs for x in pair}

    def r(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        p[max(r(a), r(b))] = min(r(a), r(b))
    assert got == {x: r(x) for a, b in pairs if a != b for x in (a, b)}


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 24)).astype(np.float32)
    v[37] = v[11]
    v[300:400] = v[300] + rng.normal(size=(100, 24)) * 1e-3
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(9000, None, 0), (9050, [0.0] * 24, 0), (9100, [float("nan")] * 24, 0), (9150, [None] * 24, 0), (9200, [], 0), (9250, [1.0, 2.0], 0), (9300, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    u = v.astype(float)
    n = np.sqrt((u * u).sum(1))
    hits = 0
    for q in range(0, 600, 50):
        score = (u * u[q]).sum(1) / (n * n[q])
        score[q] = -9
        best = np.lexsort((np.arange(600), -score))[:5]
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in got[q])
        hits += len(set(best) & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 50))


def recall(spark, table, **how):
    rows = table.select("vec_id", "embedding").collect()
    v, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    unit, hits = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    got = defaultdict(set)
    for r in ann.search(table, "vec_id % 50 = 0", **how).collect():
        got[r.query_id].add(r.vec_id)
    queries = np.flatnonzero(ids % 50 == 0)
    for q in queries:
        score = unit @ unit[q]
        score[q] = -9
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    return hits / (5 * len(queries))


def test_neighbours_of_the_registered_table(spark):
    assert recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


def test_neighbours_with_more_rotations(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 2)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(57)
    centre = rng.normal(size=(40, 16))
    v = np.repeat(centre, 20, 0) + rng.normal(size=(800, 16)) * 0.2
    assert ann.rotations_for(800, 16) == 2 and ann.rotations_for(10**10, 64) == 5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert recall(spark, df, probes=4) >= 0.9


def test_neighbours_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], schema)
    got = [(r["rank"], r.vec_id) for r in ann.search(df, "vec_id % 50 = 0").orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_neighbours_of_repeated_ids(spark):
    """A query meets every row but its own; rows of one id count each for itself."""
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], schema).repartition(2)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, "vec_id % 50 = 0", k=4).collect())
    assert got == sorted([(0, i + 1, v) for v_all in ([0, 1, 1, 2], [0, 1, 1, 2]) for i, v in enumerate(v_all)])


def test_neighbours_where_probes_do_not_suffice(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 1)
    monkeypatch.setattr(ann, "MOST_PROBES", 1)
    rng = np.random.default_rng(58)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(500, 12)))], "vec_id long, embedding array<double>")
    assert recall(spark, df, tables=1, probes=1) == 1.0


# --- PII


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


BASE_RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE_RULES) for m in p.finditer(text or "") if ok(m[0])]
    return sorted(found)


def test_pii_base(spark):
    rng = random.Random(8)
    texts = ODD + ["mail a@b.c@d.e x.@y.z a@b..c q@-.-. me@x.org. +1 (771) 555-1655, 4111 1111 1111 1111; 4111-1111-1111-1112 1.2.3.4.5.6.7.8 300.1.1.1 000255.0.0.1 é@x.com"]
    texts += ["".join(rng.choice(list("0123456789  -.+()@ab%é")) for _ in range(120)) for _ in range(400)]
    texts += ["".join(rng.choice(["a", "@", ".", "b-", "%", " ", "1", "."]) for _ in range(80)) for _ in range(400)]
    texts += [t.replace("|", c) for c in "\x01\x02" for t in ("+1|415|555|0100", "+1 415 555 0100|+1 415 555 0101", "4111|1111|1111|1111", "4111 1111 1111 1111|2", "1.2.3|.4", "9|1.2.3.4|5", "a|b@c.de|f.g", "x@y|.org", "|a@b.c|")]
    texts += ["".join(rng.choice(list("0123456789 -.+()@ab") + ["\x01", "\x01", "\x02"]) for _ in range(120)) for _ in range(200)]
    texts += ["4242424242424242 " * 50, "1 " * 20_000, "a@b" + ".c" * 20_000, "9" * 50_000, "x" * 60_000, "1.2" * 9_000]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.base] for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_spans(t), t and t[:200]


def test_pii_adds_secrets_and_redacts(spark):
    rng = random.Random(9)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'say token = "{secret()}" and {prose(rng, 20)}' for _ in range(30)] + [prose(rng, 30) for _ in range(30)] + ["ask x@y.com now", None, "été a@b.org é"]
    df = docs(spark, texts)
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(df).collect()}
    assert all(kinds[i] == [4] for i in range(30)) and all(kinds[i] == [] for i in range(30, 60))
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[60] == "ask [EMAIL] now" and out[61] is None and out[62] == "été [EMAIL] é" and out[31] == texts[31] and "[SECRET]" in out[0]
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_redacts_overlaps(spark):
    texts = ["from 10.0.0.4 4111 1111 1111 1117 ok", "+1 415 555 0100@example.com", "call +1 415 555 0100@example.com or 10.0.0.4 ok", "4111111111111111@example.com"]
    assert [base_spans(t) for t in texts[:2]] == [[(5, 1, 13), (12, 2, 33)], [(0, 3, 15), (11, 0, 27)]]
    out = [r.text for r in pii.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert out == ["from [IP][CARD] ok", "[PHONE][EMAIL]", "call [PHONE][EMAIL] or [IP] ok", "[EMAIL]"]


def direct_em(votes, rounds=50):
    """The same model, one candidate at a time."""
    start = (0.9, 0.75, 0.7)
    hit, miss, share = list(start), list(start), 0.5
    clip = lambda x: min(0.99, max(0.55, x))
    for _ in range(rounds):
        belief = []
        for v in votes:
            p, q = share, 1 - share
            for i, x in enumerate(v):
                if x:
                    p, q = p * (hit[i] if x > 0 else 1 - hit[i]), q * (1 - miss[i] if x > 0 else miss[i])
            belief.append(p / (p + q))
        for i in range(3):
            cast = [(v[i], p) for v, p in zip(votes, belief) if v[i]]
            hit[i] = clip((sum(p for x, p in cast if x > 0) + 2 * start[i]) / (sum(p for _, p in cast) + 2))
            miss[i] = clip((sum(1 - p for x, p in cast if x < 0) + 2 * start[i]) / (sum(1 - p for _, p in cast) + 2))
        share = min(0.95, max(0.05, (sum(belief) + 1) / (len(votes) + 2)))
    return belief


def test_pii_reliabilities_equal_direct_em():
    rng = random.Random(31)
    truth = [rng.random() < 0.4 for _ in range(500)]
    votes = [tuple(0 if rng.random() < gap else (1 if t == (rng.random() < right) else -1) for gap, right in ((0, 0.95), (0.1, 0.8), (0.5, 0.9))) for t in truth]
    beliefs, known = pii.reliabilities([(2, v, n) for v, n in Counter(votes).items()])
    want = direct_em(votes)
    assert all(abs(beliefs[2, v] - p) < 1e-9 for v, p in zip(votes, want))
    assert sum((p > 0.5) == t for p, t in zip(want, truth)) > 450 and known[2, "regex"][0] > 0.85


def test_pii_classifier_on_held_out_spans(spark):
    """Keys that context names are learnt on half of the texts and found on the other half; plain codes are left alone."""
    rng = random.Random(32)
    code = lambda: "".join(rng.choice("abcdefXYZ0123456789") for _ in range(28)) + "aB1x2"
    rows = [(f"api key: {code()} {prose(rng, 15)}", True) for _ in range(60)] + [(f"see version {'v' + code().lower()[:23] + '0a'} {prose(rng, 15)}", False) for _ in range(60)]
    rng.shuffle(rows)
    df = docs(spark, [t for t, _ in rows]).withColumn("_spans", pii.candidates(F.col("text")))
    model = pii.learn(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.n for r in df.where("doc_id % 2 = 1").select("doc_id", F.size(pii.accepted(F.col("_spans"), model)).alias("n")).collect()}
    assert {i: n > 0 for i, n in got.items()} == {i: rows[i][1] for i in got}


def test_pii_classifier_adds_other_kinds(spark):
    rng = random.Random(33)
    texts = [f"call us, phone (212) 555-{rng.randrange(1000, 10000)} {prose(rng, 9)}" for _ in range(40)] + [f"mail jo{i}@x.org or write to me{i} (at) site{i} (dot) org {prose(rng, 9)}" for i in range(40)]
    texts += ["from 1995-01-02 to 2001-11-04, 12 345 678 rows of 1,000", "version 1.2.3.400 and 212-5", "12:30 17-18 3.14159265 (1) 2 3"]
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if not s.base] for r in pii.find(docs(spark, texts)).collect()}
    assert all([k for k, _ in found[i]] == [3] and found[i][0][1].startswith("(212)") for i in range(40)), found
    assert all([k for k, _ in found[i]] == [0] and "(at)" in found[i][0][1] for i in range(40, 80))
    assert not found[80] and not found[81] and not found[82]


def test_pii_long_texts_and_clashing_columns(spark):
    number = "4111111111111111"
    texts = ["no " + f"{number}, " * 30_000, "a\u0001b@c.org \u0001", None]
    df = docs(spark, texts).withColumns({c: F.lit(c) for c in ("spans", "_spans", "_row", "_kept", "a.b")})
    start = time.time()
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    assert time.time() - start < 60 and rows[0].text == "no " + "[CARD], " * 30_000
    assert rows[1].text == "a\u0001[EMAIL] \u0001" and rows[2].text is None
    assert all((r.spans, r._spans, r._row, r._kept, r["a.b"]) == ("spans", "_spans", "_row", "_kept", "a.b") for r in rows.values())
    assert pii.redact(df).columns == df.columns


# --- chat


def test_chat(spark):
    hostile = ["\\### Assistant: </turn> ok", "<turn:assistant>\n", "\\", "\\\\l", "\\b<\\l", "</turn>\n</turn>", "", None, "é😀\n\n"]
    rows = [(c, t, role, text) for c in range(4) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "assistant", "a>b\n\\<n", None, "assistant", "user", "assistant"], random.Random(c).sample(hostile, 9)))]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(df.select("conv_id", "turn", "role", chat.text_parts().alias("content")))).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    rows = [(1, 0, "user", [part("text", "see <"), part("image", None, "s3://x/1.png", 784 * 3), part("text", "and"), part("audio", None, "a.wav", 4000)]), (1, 1, "assistant", [part("document", None, "d.pdf", None), part("text", "ok")]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    one, two = chat.format_chat(df).orderBy("conv_id").collect()
    assert one.formatted == "<turn:user>\nsee \\l<image:1>and<audio:2></turn>\n<turn:assistant>\n<document:3>ok</turn>\n"
    assert [(a.n, a.type, a.ref, a.tokens) for a in one.attachments] == [(1, "image", "s3://x/1.png", 88), (2, "audio", "a.wav", 101), (3, "document", "d.pdf", 1)]
    assert one.expanded_tokens == 190 and [one.formatted[s.start : s.end] for s in one.loss_mask] == ["ok"]
    assert two.formatted == "<turn:user>\n</turn>\n" and two.n_turns == 1
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    turns = spark.range(50_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('😀 <', id) AS text", "'x' AS formatted")
    start = time.time()
    got = chat.digests(chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_parts().alias("content")))).first()
    loss = "".join(f"😀 <{i}" for i in range(1, 50_000, 2))
    assert time.time() - start < 60
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (50_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_running_and_cut(spark):
    rng = random.Random(34)
    lists = [[rng.randrange(-9, 99) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 10, 99, 100, 101)]
    df = spark.createDataFrame([(x,) for x in lists], "v array<int>")
    add, top = lambda a, b: a + b, F.greatest
    for r in df.select("v", common.running(F.col("v"), add, F.lit(0)).alias("s"), common.running(F.col("v"), top, F.lit(-99)).alias("m")).collect():
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.m == [max(r.v[: i + 1]) for i in range(len(r.v))]
    text = "".join(rng.choice("aé😀\n") for _ in range(9000))
    spans = [(0, 0), (0, 9000), (4095, 4097), (4096, 8192), (5, 4096), (8999, 9000)]
    some = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int").select(common.cut(common.blocks(F.col("t")), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in some] == [text[a:b] for a, b in spans]


# --- language


def test_language(spark):
    rng = random.Random(10)
    pools = {"aa": ["the", "and", "thing", "with"], "bb": ["und", "der", "schön", "ich"], "cc": ["él", "que", "niño", "los"]}
    lang = [rng.choice(list(pools)) for _ in range(200)]
    texts = [" ".join(rng.choice(pools[x]) + rng.choice(["", "s", "e"]) for _ in range(rng.randrange(3, 40))) for x in lang]
    texts += [None, "", "123 !!"]
    df = docs(spark, texts, lang=lang + [None, "aa", None])
    known = langid.learn(df)
    counts = defaultdict(Counter)
    for i, (t, x) in enumerate(zip(texts, lang)):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for word in re.findall(r"[^\W\d_]+", t.lower()):
                w = f" {word} "
                counts[x].update(g for n in (1, 2, 3) for k in range(len(w) - n + 1) for g in [w[k : k + n]] if g.strip() and (n < 3 or g[1] != " "))
    for x, own in known.items():
        decoded = ["".join(chr(c >> 21 * k & 0x1FFFFF) for k in (2, 1, 0) if c >> 21 * k) for c in own.tolist()]
        want = {g: n for g, n in counts[x].items()}
        assert set(decoded) == set(want) and [want[g] for g in decoded] == sorted(want.values(), reverse=True)
    rows = langid.identify(df, known).collect()
    assert rows[0].asDict().keys() >= {"doc_id", "text", "lang_pred", "score"}
    held = [r for r in rows if r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert [(r.lang_pred, r.score) for r in rows if r.doc_id >= 200] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(docs(spark, ["abc"]), {}).first().lang_pred == "und"
    assert langid.learn(docs(spark, [])) == {}
    clash = docs(spark, ["the thing"]).withColumns({c: F.lit("x") for c in ("lang_pred", "_row", "_found")})
    assert langid.identify(clash, known).select("lang_pred", "_row", "_found").collect() == [("aa", "x", "x")]


# --- quality


def test_quality(spark):
    rng = random.Random(11)
    texts = ODD + [prose(rng, rng.randrange(1, 120), rng.choice([4, 30, 900])) for _ in range(200)] + ["a b\nc # d\n\n \na b\nc # d\na b", "l\n" * 80]
    sources = [rng.choice(["x", "y", None]) for _ in texts]
    for t in range(len(texts)):
        if sources[t] == "y":
            texts[t] = "bad"
    rows = {r.doc_id: r for r in quality.judge(docs(spark, texts, source=sources)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORDS.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)), t[:80]
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert r.kept == (not r.base_failed and sources[i] != "y")
    assert quality.judge(docs(spark, [])).count() == 0


def test_quality_hosts_by_direct_arithmetic(spark):
    """Shrunk rates and limits from the definitions, over hosts of very different sizes."""
    rng = random.Random(42)
    share = {f"h{i}": (rng.choice([0.02, 0.1, 0.2]), rng.choice([1, 3, 40])) for i in range(60)} | {"bad": (0.97, 80), "half": (0.4, 80), "one": (1.0, 1), None: (0.1, 30)}
    rows = [(h, "bad" if rng.random() < p else prose(rng, 60, 10**5)) for h, (p, n) in share.items() for _ in range(n)]
    df = docs(spark, [t for _, t in rows], source=[h for h, _ in rows], ids=[None, 2**60 + 1, *range(len(rows) - 2)])
    count, fails = Counter(h for h, _ in rows), Counter(h for h, t in rows if t == "bad")
    n, k, hosts = len(rows), sum(fails.values()), len(count)
    mean = (k + 0.5) / (n + 1)
    spread = (sum(c * (fails[h] / c - k / n) ** 2 for h, c in count.items()) - (hosts - 1) * mean * (1 - mean)) / (n - sum(c * c for c in count.values()) / n)
    weight = max(mean * (1 - mean) / spread - 1, 2.0)
    draws = np.random.default_rng(1).beta(mean * weight, (1 - mean) * weight, 400_000)
    limit = min(0.9, max(0.5, np.quantile(draws, 0.95)))
    rates = {r.host: r for r in quality.host_rates(quality.measured(df)).collect()}
    for h, c in count.items():
        assert rates[h].shrunk_short == pytest.approx((fails[h] + mean * weight) / (c + weight)) and rates[h].limit_short == pytest.approx(limit, abs=0.01)
    got = quality.judge(df).collect()
    assert {r.host for r in got if r.host_rejected} == {h for h, c in count.items() if (fails[h] + mean * weight) / (c + weight) >= limit} == {"bad"}
    assert any(r.base_failed is False and not r.kept for r in got) and {None, 2**60 + 1} <= {r.doc_id for r in got}


# --- HTML


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_html_rules(spark):
    page = """<!DOCTYPE html><html class="no-sidebar"><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
    <header class="site"><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div>
    <main><article><h1>A &amp;amp; title</h1><p>First  <b>bo</b>ld&nbsp;word<p>Second<br>line &eacute;<!-- no <p>x</p> --><div class="ad">Buy</div>
    <blockquote>Quote</blockquote><ul><li>one<li>two</ul><form><input value=x><label>Mail</label></form><footer>by me</footer></article>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section></main><aside>side</aside><footer>&copy;</footer></body>"""
    rows = [("http://a.example/x", page), ("http://a.example/y", None), (None, ""), ("x", "just text"), ("http://b/", "<p>unclosed <i>it<p>next"), ("http://b/", "<div><p>a < b &lt; c</p></div><script>never closed")]
    got = [r.text for r in html.extract(pages(spark, rows)).orderBy("page_id").collect()]
    assert got == ["A &amp; title First bold word Second line é Quote one two", "", "", "just text", "unclosed it next", "a < b < c"]
    assert html.extract(pages(spark, [])).count() == 0


def test_html_templates(spark):
    rng = random.Random(12)
    rows = []
    for k in range(30):
        own = prose(rng, 20, 10**5)
        menu = "".join(f"<li><a href=/{k}>{prose(rng, 1)}</a>" for _ in range(4))
        rows.append(("http://h.example/%d" % k, f"<body><div class=top7><ul>{menu}</ul></div><div class=box>All rights kept here</div><div class=txt><p>{own}</p><p>{own[:9]} tail</p></div></body>"))
    rows += [("http://h2.example/%d" % k, f"<article><p>The same copy</p><div class=z>Read our book now</div><p>own {k}</p></article>") for k in range(30)]
    got = html.extract(pages(spark, rows)).orderBy("page_id").collect()
    for r, (_, h) in zip(got[:30], rows):
        assert r.text == " ".join(re.findall("<p>(.*?)</p>", h)) and r.n_chars == len(r.text)
    assert [r.text for r in got[30:]] == [f"The same copy own {k}" for k in range(30)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recurrence_acts_on_the_registered_pages(spark, sf):
    """Recurrence comes first: on every page of a host with a template it takes characters, whatever the lists would take."""
    d = f"/root/testdata/{sf}"
    raw = {r.page_id: r.html or "" for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    hosts = Counter(re.sub("^https?://([^/]*).*", r"\1", r.url or "") for r in spark.read.parquet(f"{d}/pages.parquet").collect())
    got = queries.op1_html_extraction(spark, d).collect()
    assert len(got) == len(raw)
    framed = [r for r in got if re.search("<(nav|footer)[ >]", raw[r.page_id]) and hosts[re.sub("^https?://([^/]*).*", r"\1", r.url or "")] >= 4 * html.LEAST_PAGES]
    assert framed and all(r.n_template > 0 for r in framed)


def test_template_goes_before_the_lists():
    page = "<body><nav>Menu one <b>two</b></nav><div class=box>Rights kept</div><p>own words</p><aside>note</aside></body>"
    top = html.parse(page)
    every = {n.tag: h for n, h, _ in html.removable(top, html.main_parts(top))}
    assert html.main_text(page, frozenset({every["nav"], every["div"]})) == ("own words", 20)
    assert html.main_text(page, frozenset()) == ("Rights kept own words", 0)
    assert html.main_text(page, None) == ("Rights kept own words", 0)


def chrome_pages(rng, n=24):
    """Pages whose template names itself nowhere: only recurrence tells it from the text. (host, html, own text)."""
    out = []
    for host in ("one.example", "two.example"):
        box, foot = prose(rng, 6), prose(rng, 8)
        for k in range(n):
            own = prose(rng, 25, 10**5)
            links = "".join(f"<div class=k><a href=/{rng.random()}>{prose(rng, 2, 10**5)}</a></div>" for _ in range(5))
            extra = f"<div class=z1>{foot} again</div>" if k % 3 == 0 else ""
            out.append((host, f"<body><div class=a1><div class=a2>{links}</div></div><div class=b7>{box}</div><div class=c3><div>{own}</div>{extra}<div>tail {k}</div></div><div class=d4><span>{foot}</span></div></body>", f"{own} tail {k}"))
        copy = prose(rng, 30, 10**5)  # one page, copied often: its own text stays
        out += [(host, f"<body><div class=b7>{box}</div><div class=c3><div>{copy}</div></div><div class=d4><span>{foot}</span></div></body>", copy)] * n
    out += [("small.example", f"<body><div class=b7>box</div><article><p>words {k}</p></article></body>", f"words {k}") for k in range(4)]
    return out


def test_html_recurrence_alone(spark, monkeypatch):
    rows = chrome_pages(random.Random(41))
    df = pages(spark, [(f"http://{h}/{i}", t) for i, (h, t, _) in enumerate(rows)]).repartition(3).withColumns({c: F.lit(c) for c in ("gone", "_host", "_row", "host", "text")})
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert all(got[i].text == own for i, (*_, own) in enumerate(rows))
    assert got[0].gone == "gone" and got[0]._row == "_row" and len(html.extract(df).columns) == len(df.columns) + 2
    assert all((got[i].n_template > 0) == (h != "small.example") for i, (h, *_) in enumerate(rows))

    # A plain count of distinct pages on each host says what the template is.
    want = defaultdict(set)
    for host in {h for h, *_ in rows}:
        distinct = {t for h, t, _ in rows if h == host}
        counts = Counter(x for t in distinct for top in [html.parse(t)] for x in {h for _, h, _ in html.removable(top, html.main_parts(top))})
        if len(distinct) >= html.LEAST_PAGES:
            want[host] = {x for x, n in counts.items() if n >= html.LEAST_PAGES and n >= html.LEAST_SHARE * len(distinct)}
    for h, t, own in rows:
        assert html.main_text(t, frozenset(want[h]) if h in want else None)[0] == own
    monkeypatch.setattr(html, "LEAST_SHARE", 2)  # the method switched off
    off = {r.page_id: r.text for r in html.extract(df).collect()}
    assert sum(off[i] != own for i, (*_, own) in enumerate(rows)) == len(rows) - 4


def test_sketches_lose_no_link_and_tell_long_sets_apart():
    rng = np.random.default_rng(6)
    fresh = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    sets = []
    for n in (30, 120, 900, 1023, 1100, 3000, 5000):
        base = fresh(n)
        sets += [base, np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], fresh(n // 12)])), fresh(n)]
    sizes = np.array([len(s) for s in sets])
    a, b = jaccard.may_link([jaccard.sketch(s) for s in sets], sizes, 80, 100)
    joined = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    linked = set()
    for x in range(len(sets)):
        for y in range(x):
            shared = len(np.intersect1d(sets[x], sets[y]))
            if 100 * shared >= 80 * (sizes[x] + sizes[y] - shared):
                linked.add((y, x))
    assert linked and linked <= joined
    assert not any(sizes[x] > 2000 and (x, y) not in linked for x, y in joined)


def test_quality_shows_the_rates_it_judges_by(spark):
    rng = random.Random(77)
    texts = [prose(rng, 80) for _ in range(30)] + ["short"] * 30 + [prose(rng, 80) for _ in range(4)]
    hosts = ["good"] * 30 + ["bad"] * 30 + [None] * 4
    rows = quality.judge(docs(spark, texts, source=hosts)).collect()
    for r in rows:
        over = [r[f"shrunk_{rule}"] >= r[f"limit_{rule}"] for rule in quality.RULES]
        assert r.host_rejected == any(over) and r.kept == (not r.base_failed and not r.host_rejected)
        assert all(0 < r[f"shrunk_{rule}"] < 1 and quality.LEAST_LIMIT <= r[f"limit_{rule}"] <= quality.MOST_LIMIT for rule in quality.RULES)
    rate = {r.host: r.shrunk_short for r in rows}
    assert rate["good"] < rate[None] < rate["bad"]  # few documents are drawn to the mean of all
    assert {r.host for r in rows if r.host_rejected} == {"bad"}
