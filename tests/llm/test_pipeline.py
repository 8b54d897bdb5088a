"""The pipeline's stages, one after the other, against plain recomputations, with repeated, null and large ids."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_operators import WORDS, base_spans, brute_groups, docs, edited, prose

import corpus_pipeline
from ledgerline.llm import common, langid, mixing

BIG = 2**53 + 1  # not a float


def fixture(spark):
    rng = random.Random(21)
    rows = []
    for k in range(40):
        text = prose(rng, rng.randrange(20, 90), 10**4)
        rows.append((k, text))
        if k % 4 == 0:
            rows += [(k, text), (None, text)]  # the same row again, and without its id
        if k % 4 == 1:
            rows.append((k, prose(rng, 40, 10**4)))  # one id, another text
        if k % 4 == 2:
            rows += [(BIG + 2 * k, edited(rng, text, 1)), (100 + k, text), (100 + k, prose(rng, 30, 10**4))]
    rows += [(None, prose(rng, 25, 10**4)) for _ in range(12)] + [(None, "card 4111 1111 1111 1111 at me@x.org " + prose(rng, 20, 10**4)), (None, None), (7, ""), (8, "12 34")]
    rng.shuffle(rows)
    ids, texts = zip(*rows)
    return docs(spark, texts, ids=ids, source=[rng.choice(["a", "b", None]) for _ in rows]).repartition(3)


def written(df):
    return common.settle(df)


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_equal_brute_force(spark):
    df = written(fixture(spark))
    known = langid.identify(df, langid.learn(df)).where(F.col("lang_pred") != langid.UNKNOWN)
    language = written(corpus_pipeline.identify_language(spark, df, ""))
    assert Counter(plain(language)) == Counter(plain(known)) and language.count() == df.count() - 3
    assert language.select(corpus_pipeline.ROW).distinct().count() == language.count()

    unique = written(corpus_pipeline.drop_near_duplicates(spark, language, ""))
    rows = sorted(plain(language), key=lambda r: (r[0] is None, r[0] or 0))  # the least of a group comes first
    groups = brute_groups(list(range(len(rows))), [t for _, t, _ in rows], 5, 80, 100)
    want = [rows[i] for i, _, first in groups if i == first]
    assert Counter(r[:2] for r in plain(unique)) == Counter(r[:2] for r in want)
    assert len({i for i, *_ in want}) < len(want) < len(rows) - 30 and any(i is None for i, *_ in want)

    clean = written(corpus_pipeline.redact_personal_data(spark, unique, ""))
    before, after = {r[corpus_pipeline.ROW]: r for r in unique.collect()}, {r[corpus_pipeline.ROW]: r for r in clean.collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert r.doc_id == before[k].doc_id and r.n_chars == len(r.text)
        assert r.text == before[k].text or base_spans(before[k].text) and not base_spans(r.text)
    assert any("[CARD] at [EMAIL]" in r.text for r in after.values())

    # Every document of its own, known by a number in place of its id: the same totals by source.
    mixed = written(corpus_pipeline.mix_sources(spark, clean, ""))
    count, size = Counter(plain(clean)), lambda t: len(WORDS.findall(t))
    took, total, got = Counter(), Counter(), Counter(plain(mixed))
    for (i, text, source), n in count.items():
        total[source] += n * size(text)
    for (i, text, source), n in got.items():
        assert n <= 2 * count[i, text, source]
        took[source] += n * size(text)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    targets = mixing.targets([total[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(total.values()), [2 * total[s] for s in order])
    assert all(abs(took[s] - t) <= 2 for s, t in zip(order, targets)), (took, targets)
    assert any(i is None for i, *_ in got) and mixed.columns == df.columns

    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024


def test_stages_without_numbers(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "u v w x y z", "u v w x y z"], ids=[5, 5, None, None, None])
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(plain(got), key=str) == sorted([(5, "a b c d e f", "s"), (None, "u v w x y z", "s")], key=str)
    assert corpus_pipeline.mix_sources(spark, df, "").count() == 7  # 30 words, target 45: two of five twice


def test_run_on_clashing_columns_and_an_empty_table(spark, tmp_path):
    names = ("_row", "row", "spans", "_spans", "_copies", "_k", "component_id", "lang_pred", "score", "size", "_j", "taken", "family", "a.b")
    df = docs(spark, ["one two three four five six", "one two three four five six", "me@x.org and a b c d e f", None], ids=[1, 1, 2, 3])
    df = df.withColumns({c: F.lit(c) for c in names})
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.redact_personal_data, corpus_pipeline.mix_sources):
        df = written(stage(spark, df, ""))
        assert [c for c in df.columns if c != corpus_pipeline.ROW] == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert all(r[c] == c for r in df.collect() for c in names)
    assert {r.text for r in df.collect()} == {"one two three four five six", "[EMAIL] and a b c d e f"}
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
