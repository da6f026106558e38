"""Guarded SELECT: what a statement may read and call, told from its parsed and its analysed plan.

Two walks over Catalyst's trees. Before analysis, which may look at files, the parsed plan must be a query whose
relations are registered views or names it defines itself, and whose functions are of the allowed groups. After it,
every operator must be a known one, every leaf must stand below the view of a registered name, and no expression may
be one of the refused functions or user code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Groups of built-in functions that a statement may call, and single functions of other groups.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs",
    "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs",
    "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "window_funcs",
}
FURTHER_FUNCTIONS = {"typeof"}
#: Operators of an analysed query. Relations stand below a view and are not looked at.
OPERATORS = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
    "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot",
    "Project", "ResolvedHint", "Sort", "SubqueryAlias", "Union", "Unpivot", "View", "Window", "WithCTE",
}
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Parts of names of expressions that run code from outside.
FOREIGN = re.compile("UDF|UDAF|UDTF|UserDefined|Reflect|Invoke")


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1].rstrip("$")


def plans(plan, stop_at_views: bool) -> Iterator:
    """All operators of a plan, those of CTEs and subqueries too."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        if not (stop_at_views and _kind(node) == "View"):
            waiting += [*_items(node.children()), *_items(node.innerChildren())]


def expressions(plan) -> Iterator:
    """All expressions of one operator."""
    waiting = list(_items(plan.expressions()))
    while waiting:
        node = waiting.pop()
        yield node
        waiting += _items(node.children())


@cache
def _functions(spark: SparkSession) -> tuple[frozenset[str], frozenset[str]]:
    """Names of the functions allowed, and classes of the built-in ones that are not."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    allowed, kept, refused, names = set(FURTHER_FUNCTIONS), set(), set(), registry.listFunction().iterator()
    while names.hasNext():
        identifier = names.next()
        info = registry.lookupFunction(identifier).get()
        if info.getGroup() in FUNCTION_GROUPS or identifier.funcName() in FURTHER_FUNCTIONS:
            allowed.add(identifier.funcName().lower())
            kept.add(info.getClassName())
        else:
            refused.add(info.getClassName())
    return frozenset(allowed), frozenset(refused - kept)


def registered(spark: SparkSession) -> set[str]:
    """Names of the temporary views of the session."""
    return {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}


def check_parsed(spark: SparkSession, plan) -> None:
    """Refuse relations and functions by name, before anything is looked up."""
    views, own, asked = registered(spark), set(), []
    functions, _ = _functions(spark)
    for node in plans(plan, stop_at_views=False):
        kind = _kind(node)
        if kind == "UnresolvedWith":
            own |= {pair._1().lower() for pair in _items(node.cteRelations())}
        elif kind == "UnresolvedRelation":
            asked.append(".".join(_items(node.multipartIdentifier())))
        elif kind == "UnresolvedTableValuedFunction":
            asked.append(".".join(_items(node.name())) + "()")
        elif kind == "PlanWithUnresolvedIdentifier":
            raise ValueError("not a registered view: IDENTIFIER")
        elif kind.endswith(("Command", "Statement")):
            raise ValueError("only SELECT is allowed")
        for expression in expressions(node):
            name = _kind(expression)
            if name == "ExpressionWithUnresolvedIdentifier":
                raise ValueError("function not allowed: IDENTIFIER")
            if name == "UnresolvedFunction":
                called = ".".join(_items(expression.nameParts())).lower()
                if called not in functions:
                    raise ValueError(f"function not allowed: {called}")
    for name in asked:
        if name.lower() not in views | own:
            raise ValueError(f"not a registered view: {name}")


def check_analysed(spark: SparkSession, plan) -> None:
    """Refuse operators, relations and expressions that are not known to be harmless."""
    views, (_, refused) = registered(spark), _functions(spark)
    for node in plans(plan, stop_at_views=True):
        kind = _kind(node)
        if kind not in OPERATORS:
            raise ValueError(f"not a registered view: {kind}")
        if kind == "View" and not (node.isTempView() and node.desc().identifier().table().lower() in views):
            raise ValueError(f"not a registered view: {node.desc().identifier().table()}")
        for expression in expressions(node):
            name = expression.getClass().getName()
            if not name.startswith(EXPRESSIONS) or name in refused or FOREIGN.search(_kind(expression)):
                raise ValueError(f"function not allowed: {_kind(expression)}")


def guarded(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """The query of one SELECT over registered views; anything else raises ValueError or Spark's own error."""
    check_parsed(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    found = spark.sql(text, args or {})
    check_analysed(spark, found._jdf.queryExecution().analyzed())
    return found
