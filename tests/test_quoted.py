"""Line breaks in quotes: reading by splits equals reading each file by one task."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import delimited, quoted


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rng):
    kind = rng.random()
    if kind < 0.15:
        return "\n".join("".join(rng.choice("ab, ;\"") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(2, 6)))
    if kind < 0.2:
        return "x" * rng.randint(200, 900) + "\n" + "\n" * rng.randint(0, 3) + "y"
    return rng.choice(["", "word", "a,b", 'say "so"', "äö😀", "12.5", " lead", '"', "''"])


def written(path, rng, rows, sep):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]))
        out.writerow(["k", "a", "b", "c"])
        for i in range(rows):
            out.writerow([i, cell(rng), cell(rng), cell(rng)])


@pytest.mark.parametrize("seed, sep", [(1, ","), (2, ";"), (3, "\t"), (4, "|")])
def test_splits_equal_one_task(spark, small_splits, tmp_path, seed, sep):
    rng = random.Random(seed)
    for n, rows in enumerate((150, 1, 40)):
        written(tmp_path / f"f{n}.csv", rng, rows, sep)
    lines = delimited._lines(spark, str(tmp_path), {"UTF-8": []})
    assert lines.rdd.getNumPartitions() > 20
    got, names = quoted.parsed(lines, sep, ["_file", "_block", "_id"])
    names = names[:4]
    ordered = [[r[c] for c in names] for r in got.orderBy("_file", "_block", "_id").collect()]
    whole = spark.read.csv(str(tmp_path), sep=sep, escape='"', multiLine=True, schema="_c0 string, _c1 string, _c2 string, _c3 string")
    one = [tuple(r) for r in whole.collect()]
    assert sorted(map(tuple, ordered), key=str) == sorted(one, key=str)
    assert [r[0] for r in ordered if r[0] != "k"] == [str(i) for rows in (150, 1, 40) for i in range(rows)]


@pytest.mark.parametrize("seed", [5, 6])
def test_effects_compose(seed):
    rng = random.Random(seed)
    for _ in range(300):
        lines = ["".join(rng.choice('ab,""') for _ in range(rng.randint(0, 12))) for _ in range(6)]
        for state in (False, True):
            whole, step = state, state
            for line in lines:
                step = quoted.after(line, step, ",")
            text = "\n".join(lines)
            at, start = 0, not whole
            while at < len(text):  # letter by letter over all lines
                c = text[at]
                if whole:
                    if c == '"':
                        if text[at + 1 : at + 2] == '"':
                            at += 1
                        else:
                            whole = False
                elif c == '"' and start:
                    whole = True
                    start = False
                    at += 1
                    continue
                start = c in ",\n" and not whole
                at += 1
            assert step == whole, (lines, state)


def test_load_reads_broken_lines_by_splits(spark, small_splits, tmp_path):
    rng = random.Random(9)
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["name", "note", "amount"])
        for i in range(200):
            out.writerow([f"n{i}", f"first line {i}\n\nsecond, \"line\" {'z' * rng.randint(0, 200)}" if i % 3 == 0 else "plain", i * 1.5])
    got = delimited.load(spark, str(tmp_path / "t.csv")).df
    assert got.columns == ["name", "note", "amount"] and got.count() == 200
    r = got.where("name = 'n3'").first()
    assert r.note.startswith('first line 3\n\nsecond, "line" z') and r.amount == 4.5
    assert got.agg(F.sum("amount")).first()[0] == 1.5 * 199 * 100


def test_unclosed_quote_and_nothing(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"open\n2,x\n\n3,y', encoding="utf-8")
    (tmp_path / "b.csv").write_text("k,v\n7,z\n", encoding="utf-8")
    lines = delimited._lines(spark, str(tmp_path), {"UTF-8": []})
    got = [r.record for r in quoted.records(lines, ",").orderBy("_file", "_block", "_id").collect()]
    assert got == ["k,v", '1,"open\n2,x\n\n3,y', "k,v", "7,z"]
    assert quoted.records(lines.limit(0), ",").count() == 0


def test_header_goes_at_the_head_of_further_files_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount\nx,1\nname,amount\ny,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("name,amount\nz,3\n", encoding="utf-8")
    got = sorted(r.name for r in delimited.load(spark, str(tmp_path)).df.collect())
    assert got == ["name", "x", "y", "z"]


@pytest.mark.parametrize("seed", [7, 8])
def test_width_counts_separators_outside_quotes_only(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        for i in range(120):
            out.writerow([i, ",\n" * rng.randint(0, 80) + '",",' * rng.randint(0, 9), "z", *["w"] * (i == 70 + seed)])
    (tmp_path / "b.csv").write_text('x,"a,b\n,,\n' + ",\n" * 400, encoding="utf-8")  # no quote closes the last record
    got, names = quoted.parsed(delimited._lines(spark, str(tmp_path), {"UTF-8": []}), ",", [])
    assert names == ["_c0", "_c1", "_c2", "_c3"]
    rows = {r[0]: tuple(r) for r in got.collect()}
    assert len(rows) == 121 and rows[str(70 + seed)][3] == "w" and all(r[2] == "z" for k, r in rows.items() if k != "x")
    assert rows["x"][1].rstrip("\n").startswith("a,b\n,,\n,")
    text = 'p,"' + "q\n" * 500 + '",r,s,t,u\n'  # the widest record begins and ends in other splits
    (tmp_path / "b.csv").write_text(text, encoding="utf-8")
    assert len(quoted.parsed(delimited._lines(spark, str(tmp_path), {"UTF-8": []}), ",", [])[1]) == 6
