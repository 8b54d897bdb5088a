"""The SQL box refuses what reaches the machine, however it is spelled or nested, and takes plain queries."""

import itertools

import pytest

from ledgerline.plans import sqlbox

BAD_QUERIES = {
    "transform": "SELECT TRANSFORM(a) USING 'cat' AS (b STRING) FROM data",
    "reflect": "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS b FROM data",
    "back quotes": "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') AS b FROM data",
    "comment": "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.home') AS b FROM data",
    "line": "SELECT reflect -- (\n ('java.lang.System', 'getProperty', 'user.home') AS b FROM data",
    "java_method": "SELECT JAVA_METHOD('java.lang.System', 'getProperty', 'user.home') AS b FROM data",
    "try_reflect": "SELECT coalesce(a, Try_Reflect('java.lang.System', 'getProperty', 'x')) AS b FROM data",
    "qualified": "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'x') AS b FROM data",
    "file": "SELECT a AS b FROM parquet.`/etc/passwd`",
    "text file": "SELECT value AS b FROM `text`.`file:///etc/passwd`",
    "no table": "SELECT a AS b FROM nowhere.at_all",
    "tvf": "SELECT id AS b FROM range(5)",
    "identifier": "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'x') AS b FROM data",
    "identifier table": "SELECT a AS b FROM IDENTIFIER('parquet.`/etc/passwd`')",
    "where it is": "SELECT input_file_name() AS b FROM data",
}
NESTINGS = {
    "as it is": "{0}",
    "cte": "WITH t AS ({0}) SELECT * FROM t",
    "cte of a cte": "WITH u AS (WITH t AS ({0}) SELECT * FROM t) SELECT * FROM u",
    "derived": "SELECT b FROM ({0}) x",
    "in": "SELECT a FROM data WHERE a IN (SELECT b FROM ({0}) x)",
    "exists": "SELECT a FROM data WHERE EXISTS (SELECT 1 FROM ({0}) x WHERE x.b = data.a)",
    "scalar": "SELECT (SELECT max(b) FROM ({0}) x) AS m FROM data",
    "in a function": "SELECT sum(coalesce(a, (SELECT max(b) FROM ({0}) x))) AS m FROM data",
    "order": "SELECT a FROM data ORDER BY (SELECT max(b) FROM ({0}) x)",
    "having": "SELECT a FROM data GROUP BY a HAVING count(*) > (SELECT count(b) FROM ({0}) x)",
    "join": "SELECT data.a FROM data JOIN ({0}) x ON x.b = data.a",
    "on": "SELECT d.a FROM data d JOIN data e ON d.a = (SELECT max(b) FROM ({0}) x)",
    "union": "SELECT a FROM data UNION ALL ({0})",
    "lateral": "SELECT a FROM data, LATERAL ({0}) x",
    "case": "SELECT CASE WHEN a > 1 THEN (SELECT max(b) FROM ({0}) x) ELSE 0 END AS c FROM data",
    "window": "SELECT sum(a) OVER (PARTITION BY (SELECT max(b) FROM ({0}) x)) AS s FROM data",
}


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(1, "u"), (2, "v")], "a int, s string")


def refused(spark, text):
    with pytest.raises(sqlbox.Refused):
        sqlbox.check(spark, text)


@pytest.mark.parametrize("bad", BAD_QUERIES)
def test_refused_wherever_it_stands(spark, data, bad):
    for frame in NESTINGS.values():
        refused(spark, frame.format(BAD_QUERIES[bad]))
    for outer, inner in itertools.islice(itertools.product(NESTINGS.values(), NESTINGS.values()), 3, None, 45):
        refused(spark, outer.format(inner.replace("SELECT a FROM", "SELECT a AS b FROM").format(BAD_QUERIES[bad])))


def test_nestings_of_a_plain_query_are_taken(spark, data):
    for frame in NESTINGS.values():
        sqlbox.check(spark, frame.format("SELECT a AS b FROM data"))


@pytest.mark.parametrize("text", ["DROP TABLE data", "INSERT INTO data SELECT * FROM data", "CREATE TABLE x AS SELECT 1", "SET a = b", "CACHE TABLE data", "ADD JAR '/x.jar'", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE data", "USE x", "CALL p()", "TRUNCATE TABLE data", "BEGIN SELECT 1; END", "WITH t AS (SELECT 1) INSERT INTO data SELECT * FROM t", "SELECT 1; SELECT 2", "", ";", "no query"])
def test_only_queries(spark, text):
    refused(spark, text)


@pytest.mark.parametrize("text", ["SELECT 'reflect(1)' AS x FROM data", "SELECT a AS reflect FROM data -- reflect(", "SELECT s AS `parquet.``x```, 'DROP TABLE data' AS y FROM data", "SELECT explode(array(a, 2)) AS x FROM data", "SELECT x FROM data LATERAL VIEW explode(array(a)) t AS x", "SELECT transform(array(a), v -> v + 1) AS x FROM data", "VALUES (1), (2)", "SELECT a, count(*) AS n FROM data GROUP BY ROLLUP (a);"])
def test_plain_queries_run(data, text):
    assert sqlbox.ask(data, text).count() > 0


def test_session_stays_as_it_was(spark, data):
    key = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(key)
    sqlbox.ask(data, "SELECT a FROM data").collect()
    assert spark.conf.get(key) == before


def test_qualified_tables_of_the_catalog(spark, data):
    data.createOrReplaceTempView("other_data")
    assert sqlbox.ask(data, "SELECT count(*) AS n FROM data JOIN other_data USING (a)").first().n == 2
    assert sqlbox.ask(data, "SELECT a FROM data ORDER BY a", rows=1).collect() == [(1,)]
