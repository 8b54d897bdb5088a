"""The delimited ingest on small odd files, the audit on degenerate tables, and what holds of any clustering."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit, series
from ledgerline.plans import registry
from ledgerline.sources import delimited

SF = "/root/testdata/sf0.001"
MESSY = """Sales export,,,,
Made today,,,,
Bill Date,Item Name,Qty,Net Amount,Store
05-01-2024,Tea,2,"₹1,200.50",North
06-01-2024,Milk,1,"₹300",North
17-01-2024,Rice,4,"(₹300)",South
18-01-2024,Oil,1,₹250,South
19-01-2024,Salt,1,₹20,North
Grand Total,,9,"₹1,470.50",
"""


def at(tmp_path, data):
    path = tmp_path / "in.csv"
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_messy_file(spark, tmp_path):
    got = delimited.load(spark, at(tmp_path, MESSY))
    rows = got.df.collect()
    assert got.df.columns == ["Bill Date", "Item Name", "Qty", "Net Amount", "Store"]
    assert len(rows) == 5 and min(r["Net Amount"] for r in rows) == -300 and rows[0]["Bill Date"] == datetime.datetime(2024, 1, 5)
    assert got.symbols == {"Net Amount": "₹"}


@pytest.mark.parametrize(("data", "columns", "n"), [("", 1, 0), ("a;b;c\n1;x;2\n3;y;4\n", 3, 2), ("店,円\n東京,¥5\n", 2, 1), ("name,price\ncafé,€5\n".encode("cp1252"), 2, 1), ("a,b,a\nx,y,z\n\nu,v\n", 3, 2)])
def test_odd_files(spark, tmp_path, data, columns, n):
    df = delimited.load(spark, at(tmp_path, data)).df
    assert len(df.columns) == columns and df.count() == n


def test_cp1252_signs(spark, tmp_path):
    got = delimited.load(spark, at(tmp_path, "name,price\ncafé,€5\nthé,€6\nlait,€7\n".encode("cp1252")))
    assert got.symbols == {"price": "€"} and {r.name for r in got.df.collect()} == {"café", "thé", "lait"}


def test_encoding_of_late_accents(spark, tmp_path):
    plain = "".join(f"tea{i},{i}\n" for i in range(200))
    got = delimited.load(spark, at(tmp_path, ("name,price\n" + plain + "café €,7\n").encode("cp1252"))).df
    assert got.count() == 201 and got.where("name = 'café €'").count() == 1
    got = delimited.load(spark, at(tmp_path, "name,price\n" + plain + "caf\ufffd é,7\n")).df  # UTF-8 that holds the sign itself
    assert got.where("name = 'caf\ufffd é'").count() == 1


def test_encoding_by_file(spark, tmp_path):
    for name, text, encoding in (("a 1.csv", "thé", "utf-8"), ("b.csv", "café", "cp1252"), ("c.csv", "crème €", "utf-8"), ("d.csv", "pâté €", "cp1252")):
        (tmp_path / name).write_bytes(f"name,price\n{text},1\nlait {name[0]},2\n".encode(encoding))
    got = delimited.load(spark, str(tmp_path))
    assert got.df.columns == ["name", "price"] and got.receipt[0] == "encoding 2 files ISO-8859-1, 2 UTF-8"
    assert sorted(r.name for r in got.df.collect()) == sorted(["thé", "café", "crème €", "pâté €", "lait a", "lait b", "lait c", "lait d"])


@pytest.mark.parametrize(("text", "month"), [("03-04-2024", 4), ("2024-03-04", 3)])
def test_dates_of_two_readings(spark, tmp_path, text, month):
    df = delimited.load(spark, at(tmp_path, f"date,item\n{text},tea\n{text},oil\n")).df
    assert {r.date.month for r in df.collect()} == {month}


def test_audit_of_degenerate_tables(spark):
    o = registry.read(spark, SF, "orders")
    assert audit.audit(o.limit(0), ["o_totalprice"], when="o_orderdate").select("check", "score").collect() == [("empty", 0)]
    one = spark.createDataFrame([(None, None)], "a string, b double")
    assert {r.check for r in audit.audit(one, ["b"], ["b"]).collect()} == {"missing", "constant"}
    late = audit.audit(o, when="o_orderdate", as_of=F.lit(o.agg(F.max("o_orderdate")).first()[0].date().replace(day=5)))
    assert [(r.check, r.score) for r in late.collect()] == [("partial", 97)]


def test_kmeans_covers_rows(spark):
    x = spark.createDataFrame([(float(i % 3) * 100 + i % 5, 1.0) for i in range(90)] + [(None, 1.0)], "a double, b double")
    rows = series.kmeans(x, ["a", "b"], 3).collect()
    assert [r.n for r in rows] == [30, 30, 30] and [r.mean_a for r in rows] == pytest.approx([2, 102, 202])


def test_kmeans_fits_all_rows_in_bounded_parts(spark, monkeypatch):
    fit, seen = series.KMeans.fit, []

    def watched(self, points):
        seen.append([r["count"] for r in points.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, points)

    monkeypatch.setattr(series.KMeans, "fit", watched)
    monkeypatch.setattr(series, "HELD", 16_800, raising=False)  # 100 rows of two columns
    x = spark.range(0, 900, 1, 1).select(((F.col("id") % 3) * 100 + F.col("id") % 5).cast("double").alias("a"), F.lit(1.0).alias("b"))
    rows = series.kmeans(x, ["a", "b"], 3).collect()
    assert [r.n for r in rows] == [300, 300, 300] and [r.mean_a for r in rows] == pytest.approx([2, 102, 202])
    costs = series.elbow(x, ["a", "b"], 3)
    assert [k for k, _ in costs] == [2, 3] and costs[1][1] < costs[0][1]
    assert len(seen) == 3 and all(sum(counts) == 900 and max(counts) <= 100 for counts in seen)


def test_outliers_of_one_value(spark):
    assert series.outliers(spark.createDataFrame([(1.0,)] * 3 + [(None,)], "a double"), "a", 1.5).count() == 0
