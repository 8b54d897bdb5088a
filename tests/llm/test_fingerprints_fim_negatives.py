"""Order MinHash, fill-in-the-middle and hard negatives against plain recomputations."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fim, omh, queries, rtree

DOCS = "doc_id long, text string, part int, copy string, key string, row string"
ODD = [None, "", "a", "ab", "abcdefgh", "abcdefghi", "x" * 3000, "ab" * 900, "Ärger 😀 naïve", "a <S> b", "<P", "<", "one two three", "one two three", "\x00\x01 \n"]


def some_docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "c", "k", "r") for i, t in zip(ids, texts)], DOCS)


def prose(rng, n):
    return " ".join("w%d" % rng.randrange(200) for _ in range(n))


# --- Order MinHash


def plain_signature(text, k=omh.K, size=omh.TUPLE, functions=omh.FUNCTIONS):
    full = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & full
        return x ^ (x >> 31)

    text += omh.PAD * (k - len(text))
    seen, kmers = defaultdict(int), []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * omh.BASE + ord(c)) & full
        h = mix(h)
        kmers.append((h, mix((h + seen[h] * 0x9E3779B97F4A7C15) & full) >> 32))
        seen[h] += 1
    draw, out = np.random.default_rng(omh.SEED), []
    masks = draw.integers(0, 1 << 32, functions, np.uint32).tolist()
    factors = (draw.integers(0, 1 << 31, functions, np.uint32) * np.uint32(2) + np.uint32(1)).tolist()
    for mask, factor in zip(masks, factors):
        least = sorted((((u ^ mask) * factor) & 0xFFFFFFFF, i) for i, (_, u) in enumerate(kmers))[:size]
        x = 0
        for h in [kmers[i][0] for i in sorted(i for _, i in least)] + [0] * (size - len(least)):
            x = mix((x * 0x9E3779B97F4A7C15 + h) & full)
        out.append(x >> 32)
    return out


@pytest.mark.parametrize("k, size, functions", [(omh.K, omh.TUPLE, omh.FUNCTIONS), (5, 3, 20), (3, 1, 7), (1, 4, 9)])
def test_signatures_equal_the_plain_rule(k, size, functions):
    rng = random.Random(k)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 500))) for _ in range(25)]
    got = omh.signatures(texts, k, size, functions)
    assert [g.tolist() for g in got] == [plain_signature(t, k, size, functions) for t in texts]


def test_long_text_and_groups_do_not_show():
    rng = random.Random(5)
    long = prose(rng, 40_000)
    few = [prose(rng, 50), long, prose(rng, 900)]
    together = omh.signatures(few * 2)
    for i, t in enumerate(few):
        assert (omh.signatures([t])[0] == together[i]).all() and (together[i] == together[i + 3]).all()


def test_likeness_follows_order():
    rng = random.Random(6)
    kept, swapped, halves = [], [], []
    for _ in range(40):
        a, b, c = (prose(rng, 150) for _ in range(3))
        x, few, turned, other = omh.signatures([a + " " + b, a + " " + b.replace("w1", "v1", 3), b + " " + a, a + " " + c])
        kept.append((x == few).mean())
        swapped.append((x == turned).mean())
        halves.append((x == other).mean())
    assert np.mean(kept) > 0.75 > np.mean(swapped) + 0.1  # the same k-mers, half of the pairs in another order
    assert 0.05 < np.mean(halves) < np.mean(swapped)


@pytest.mark.parametrize("part", [omh.PART, 1])
def test_neighbours_compared(spark, monkeypatch, part):
    monkeypatch.setattr(omh, "PART", part)
    rng = random.Random(8)
    texts = ODD + [prose(rng, rng.randint(1, 60)) for _ in range(120)]
    ids = [i * 3 for i in range(len(texts) - 4)] + [2**60 + 1, None, -5, None]
    rows = omh.compare_neighbours(some_docs(spark, texts, ids)).collect()
    want, order = {}, sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(rows) == len(texts)
    known = [r for r in order if r[0] is not None]
    for (i, t), (_, after) in zip(known, known[1:]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), omh.signatures([t, edited, after]))
    for r in rows:
        if r.doc_id in want:
            n, digest, (own, other, after) = want[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, digest)
            assert (r.fingerprint, r.edited_fingerprint) == (omh.as_text(own), omh.as_text(other))
            assert (r.near_edited, r.near_next) == ((own == other).mean(), (own == after).mean())
    # The last row, of null id, is followed by the first.
    nulls = [texts[-3] or "", texts[-1] or ""]
    ends = {hashlib.sha256((t[: len(t) - len(t) // 2] + texts[-4][: len(t) // 2]).encode()).hexdigest() for t in nulls}
    assert sum(r.edited_sha256 in ends for r in rows if r.doc_id is None) == 1


def test_one_row_repeated_rows_and_none(spark):
    assert omh.compare_neighbours(some_docs(spark, [])).count() == 0
    (one,) = omh.compare_neighbours(some_docs(spark, ["abcd"])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    rows = omh.compare_neighbours(some_docs(spark, ["same text here"] * 9, [4] * 9)).collect()
    assert len(rows) == 9 and {(r.near_next, r.n_chars) for r in rows} == {(1.0, 14)}


def test_likeness_of_columns(spark):
    df = spark.createDataFrame([("one two three four", "one two three five"), ("", None)], "a string, b string")
    got = [r[0] for r in df.select(omh.likeness(omh.fingerprint("a"), omh.fingerprint("b"))).collect()]
    a, b = omh.signatures(["one two three four", "one two three five"])
    assert got == [(a == b).mean(), 1.0]


# --- fill in the middle


def plain_form(doc_id, text):
    n, digest = len(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("part", [fim.PART, 500])
def test_fill_in_middle(spark, monkeypatch, part):
    monkeypatch.setattr(fim, "PART", part)
    rng = random.Random(12)
    texts = ODD + [prose(rng, rng.randint(1, 80)) for _ in range(150)] + [prose(rng, 60_000)]
    made = fim.assemble(some_docs(spark, texts).repartition(3))
    got = {r.doc_id: r for r in fim.digests(made).collect()}
    outputs = {r.doc_id: (r.form, r.output) for r in fim.texts(made).collect()}
    assert len(got) == len(outputs) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        form, prefix, middle, output = plain_form(i, t)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (len(t), form, prefix, middle)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(t))
        assert outputs[i] == (form, output)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_pieces_of_any_size(monkeypatch):
    rng = random.Random(13)
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(fim, "CHUNK", chunk)
        for i in range(120):
            text = "".join(rng.choice("<PSM> ä") for _ in range(rng.randint(0, 25)))
            made = list(fim.pieces(9, i, text))
            form, *_, output = plain_form(i, text)
            assert [p[:2] for p in made] == [(9, j) for j in range(len(made))]
            assert "".join(p[3] for p in made) == output and max(len(p[3]) for p in made) <= chunk + 3
            for cuts in (1, 2, 5, 100):  # the marks are found wherever the stream is cut
                stream = [output[j : j + cuts] for j in range(0, len(output), cuts)]
                back = sorted(fim.unmarked(form, stream), key=lambda p: p[0])
                assert "".join(p for _, p in back) == text


def test_fill_in_middle_repeats_nulls_and_none(spark):
    assert fim.digests(fim.assemble(some_docs(spark, []))).count() == 0
    rows = fim.digests(fim.assemble(some_docs(spark, ["one two three"] * 4 + ["other text"] * 2, [5, 5, 5, None, None, 6]))).collect()
    assert len(rows) == 6 and sum(r.doc_id is None for r in rows) == 2
    assert sorted(r.restored_sha256 for r in rows) == sorted([sha("one two three")] * 4 + [sha("other text")] * 2)


# --- hard negatives


def plain_negatives(rows, is_anchor, k=5, m=3, low=50, high=95):
    """rows: (row number, id, label, integer vector)."""
    out = []
    for n, i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = [(-int(v @ w), j, o) for o, j, _, w in rows if o != n and len(w) == len(v)]
        labels = {o: lab for o, _, lab, _ in rows}
        scored.sort()
        for s, j, _ in [x for x in scored if labels[x[2]] == label][:k]:
            fit = [x for x in scored if labels[x[2]] != label and low * -s <= 100 * -x[0] <= high * -s][:m]
            out += [(i, j, place + 1, x[1], -s, -x[0]) for place, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("tile, anchors", [(rtree.TILE_ROWS, rtree.BLOCK_ANCHORS), (40, 3)])
def test_hard_negatives(spark, monkeypatch, tile, anchors):
    monkeypatch.setattr(rtree, "TILE_ROWS", tile)
    monkeypatch.setattr(rtree, "BLOCK_ANCHORS", anchors)
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(6, 8))
    v = np.repeat(centres, 60, 0) + rng.normal(size=(360, 8)) * 0.4
    v[100:220] = v[100]  # a third of all rows are the same
    labels = rng.integers(0, 4, 360)
    ids = list(range(350)) + [50] * 5 + [7] * 5  # repeated ids, an anchor's among them
    table = [(i, x.tolist(), int(lab), 1, "t") for i, x, lab in zip(ids, v, labels)]
    nan = float("nan")
    odd = [(900, None, 1, 1, "t"), (950, [0.0] * 8, None, 1, "t"), (1000, [nan] * 8, 1, 1, "t"), (1050, [None] * 8, 1, 1, "t"), (1100, [], 1, 1, "t"), (None, [1.0] * 8, 1, 1, "t"), (1150, [1.0, 2.0], 1, 1, "t"), (1151, [1.0, 2.5], 1, 1, "t"), (1152, [1.0, 1.0], 2, 1, "t"), (1153, [float("inf")] * 8, 2, 1, "t")]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, label int, row int, tile string").repartition(3)
    whole = [(n, i, lab, np.floor(256 * np.array(x)).astype(int)) for n, (i, x, lab, *_) in enumerate(table + odd[6:9])]
    got = sorted(tuple(r) for r in rtree.mine(df, "vec_id % 50 = 0").collect())
    assert got == plain_negatives(whole, lambda i: i % 50 == 0) and got


def test_hard_negatives_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert rtree.mine(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0
    assert rtree.mine(spark.createDataFrame([(0, [1.0], 1)], schema), "vec_id % 50 = 0").count() == 0
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (3, [0.25], 2)], schema)
    assert [tuple(r) for r in rtree.mine(df, "vec_id % 50 = 0").collect()] == [(0, 1, 1, 2, 65536, 49152)]
    with pytest.raises(Exception, match="too large"):
        rtree.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], schema), "vec_id % 50 = 0").count()


def test_boxes_prune():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.uniform(-1, 1, size=(200_000, 2)))
    order = rtree.str_order(v)
    v = v[order]
    tree = rtree.Tree(order, order, np.zeros(len(v), int), v, rtree.boxes(v))
    every, leaves = np.ones(len(v), bool), len(tree.levels[0][0])
    for anchor in v[:50]:
        score = v @ anchor
        best = rtree.Best(5)
        read = rtree.best_first(tree, anchor, every, [best])
        assert sorted(-s for s, *_ in best.held) == sorted(-score)[:5] and read < leaves / 10
        high = float(np.floor(score.max() * 0.6))
        window = rtree.Best(3, high / 2, high)
        read = rtree.best_first(tree, anchor, every, [window])
        inside = score[(score >= high / 2) & (score <= high)]
        assert sorted((s for s, *_ in window.held), reverse=True) == sorted(inside, reverse=True)[:3] and read < leaves / 2


def test_registered_hard_negatives_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    whole = [(n, r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).astype(int)) for n, r in enumerate(rows)]
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, d).collect())
    assert got == plain_negatives(whole, lambda i: i % 50 == 0)


def test_registered_fingerprints(spark):
    """Edited texts are nearer than unrelated ones, and copies are alike."""
    d = "/root/testdata/sf0.01"
    rows = queries.op11_order_minhash(spark, d).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    longer = [r for r in rows if r.n_chars >= 200]
    assert np.mean([r.near_edited for r in longer]) > 0.08 and np.mean([r.near_next for r in longer]) < 0.05


def test_columns_of_other_names(spark):
    df = some_docs(spark, ["one two"]).withColumn("form", F.lit(1)).withColumn("n", F.lit(2)).withColumn("fingerprint", F.lit(3))
    assert fim.digests(fim.assemble(df)).count() == 1 and omh.compare_neighbours(df).count() == 1
