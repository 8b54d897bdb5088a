"""Guarded read-only SQL over a table called data.

Spark's own parser says what a text is; the guard then walks everything that hangs on the parsed plan: inputs, common
table expressions, subqueries inside expressions, whatever holds them. It refuses commands, script transformations,
functions that call into the machine (by the class behind the name, so no spelling hides one), table-valued functions,
names that are only known when the query runs, and tables that are not in the catalog, such as paths to files. Strings,
comments and column names can say what they like.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

_LOGICAL, _ANALYSIS = "org.apache.spark.sql.catalyst.plans.logical.", "org.apache.spark.sql.catalyst.analysis."
#: What a plan must not hold, and why.
REFUSED = {
    _LOGICAL + "Command": "a command, not a query",
    _LOGICAL + "ParsedStatement": "a statement, not a query",
    _LOGICAL + "Call": "a procedure, not a query",
    _LOGICAL + "ScriptTransformation": "runs a program",
    _ANALYSIS + "UnresolvedTableValuedFunction": "a table-valued function",
    _ANALYSIS + "UnresolvedTVFAliases": "a table-valued function",
    _ANALYSIS + "PlanWithUnresolvedIdentifier": "a name known only when it runs",
    _ANALYSIS + "ExpressionWithUnresolvedIdentifier": "a name known only when it runs",
}
#: Classes, by a part of their name, of functions that call methods of the machine.
REACHING = ("Reflect", "Invoke", "PythonUDF", "Load")
#: Functions that say what the machine, the session or its files are.
TELLING = frozenset("input_file_name input_file_block_start input_file_block_length java_method reflect try_reflect read_files".split())
ROWS = 200


class Refused(ValueError):
    """The text is not one read-only query."""


#: What is known of a class of the parser's tree: why it is refused, and how its parts are read.
_known: dict[str, tuple[str | None, str | None]] = {}


def _nature(gateway, value: JavaObject, kind: str) -> tuple[str | None, str | None]:
    if kind not in _known:
        why = next((w for refused, w in REFUSED.items() if is_instance_of(gateway, value, refused)), None)
        held = next((h for h in ("scala.collection.Iterable", "scala.Product") if is_instance_of(gateway, value, h)), None)
        _known[kind] = why, held
    return _known[kind]


def _parts(value: JavaObject, held: str | None) -> list[object]:
    """What a node, a list, an option or a tuple of the parser's tree holds."""
    if held == "scala.collection.Iterable":
        them = value.toSeq()
        return [them.apply(i) for i in range(them.size())]
    return [value.productElement(i) for i in range(value.productArity())] if held else []


def _names(value: JavaObject) -> list[str]:
    return [value.apply(i) for i in range(value.size())]


def _check_function(spark: SparkSession, names: list[str]) -> None:
    name = names[-1].lower()
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    behind = found.get().getClassName().rsplit(".", 1)[-1] if found.isDefined() else ""
    if name in TELLING or any(part in behind for part in REACHING):
        raise Refused(f"function {name} is not allowed")


def check(spark: SparkSession, text: str) -> None:
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";"))
    except Exception as error:
        raise Refused("not one query") from error
    gateway, stack = spark.sparkContext._gateway, [plan]
    while stack:
        node = stack.pop()
        if not isinstance(node, JavaObject):
            continue
        full = node.getClass().getName()
        kind = full.rsplit(".", 1)[-1]
        why, held = _nature(gateway, node, full)
        if why:
            raise Refused(f"{kind}: {why}")
        if kind == "UnresolvedFunction":
            _check_function(spark, _names(node.nameParts()))
        elif kind == "UnresolvedGenerator":
            _check_function(spark, [node.name().funcName()])
        elif kind == "UnresolvedRelation":
            names = _names(node.multipartIdentifier())
            quoted = ".".join("`" + n.replace("`", "``") + "`" for n in names)
            if len(names) > 1 and not spark.catalog.tableExists(quoted):  # a file's format and path looks like this
                raise Refused(f"no table {quoted}")
        stack.extend(_parts(node, held))


def ask(df: DataFrame, text: str, rows: int | None = ROWS) -> DataFrame:
    """Run a query over df as `data`. Without an order of its own, which rows of a longer answer are shown is open."""
    spark = df.sparkSession
    check(spark, text)
    df.createOrReplaceTempView("data")
    out = spark.sql(text.strip().rstrip(";"))
    return out.limit(rows) if rows else out
