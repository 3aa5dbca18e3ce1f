"""Read-only SQL over the session's own temporary views, decided by what is allowed.

A text passes two gates. Its parsed plan may hold only the classes listed here; whatever else the parser knows (commands, identifiers that
are computed, statements in strings, scripts, calls, hints, and what later versions add) is refused before anything is looked up. Then
the analysed plan, in which every name is resolved in its own scope, may rest on nothing but temporary views, rows in the query
itself and number ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

ROWS = 200
#: Classes of a parsed query, by package of Spark's parser.
PARSED = {
    "analysis": "UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedHaving UnresolvedInlineTable "
    "UnresolvedOrdinal UnresolvedRegex UnresolvedRelation UnresolvedStar UnresolvedStarExcept UnresolvedStarExceptOrReplace UnresolvedSubqueryColumnAliases "
    "UnresolvedTVFAliases UnresolvedTableValuedFunction",
    "expressions": "Add Alias And AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Concat CreateNamedStruct CreateStruct Cube "
    "CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction "
    "LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup "
    "ScalarSubquery SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimBoth StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive "
    "UnboundedFollowing$ UnboundedPreceding$ UnresolvedNamedLambdaVariable UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition",
    "plans.logical": "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project "
    "Sample Sort SubqueryAlias Union Unpivot UnresolvedWith WithWindowDefinition",
}
_CATALYST = "org.apache.spark.sql.catalyst."
_ALLOWED = frozenset(f"{_CATALYST}{package}.{name}" for package, names in PARSED.items() for name in names.split())
#: Functions that may stand where a table does; what an analysed plan may rest on.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
LEAVES = frozenset("CTERelationRef LocalRelation OneRowRelation OuterReference Range UnionLoopRef".split())
#: Expressions that run code given by name or from outside.
CODE = frozenset("CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF UnresolvedPythonUDTF ScalaAggregator ScalaUDAF".split())


def _list(scala: Any) -> list[Any]:
    it, out = scala.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _nodes(spark: SparkSession, plan: Any) -> Iterator[tuple[str, Any]]:
    """(class name, node) of every plan and expression in plan, those of subqueries and common table expressions among them; not what
    a view is made of."""
    jvm = spark._jvm
    kind = lambda name: jvm.java.lang.Class.forName(name)
    tree, product, many = kind(f"{_CATALYST}trees.TreeNode"), kind("scala.Product"), kind("scala.collection.Iterable")
    todo = [plan]
    while todo:
        x = todo.pop()
        if x is None or isinstance(x, (str, int, float, bool)):
            continue
        if tree.isInstance(x):
            name = x.getClass().getName()
            yield name, x
            if name == f"{_CATALYST}plans.logical.View":
                continue
        if many.isInstance(x):
            todo += _list(x)
        elif product.isInstance(x):
            it = x.productIterator()
            while it.hasNext():
                todo.append(it.next())


def _parsed(spark: SparkSession, text: str, views: set[str]) -> None:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    registry, ident = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin(), spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    relations, own = [], set()
    for name, node in _nodes(spark, plan):
        short = name.rpartition(".")[2]
        if name not in _ALLOWED:
            raise ValueError(f"only read-only queries are allowed ({short.rstrip('$')})")
        if short == "UnresolvedRelation":
            relations.append([str(p) for p in _list(node.multipartIdentifier())])
        elif short == "UnresolvedWith":
            own |= {str(r.productElement(0)).lower() for r in _list(node.cteRelations())}
        elif short in ("UnresolvedTableValuedFunction", "UnresolvedFunction"):
            table = short == "UnresolvedTableValuedFunction"
            parts = [str(p).lower() for p in _list(node.name() if table else node.nameParts())]
            if len(parts) != 1 or (parts[0] not in TABLE_FUNCTIONS if table else not registry.functionExists(ident(parts[0]))):
                raise ValueError(f"{'table ' * table}function {'.'.join(parts)} is not allowed")
    for parts in relations:  # before anything is looked up; scopes are told apart afterwards
        if len(parts) != 1 or parts[0].lower() not in views | own:
            raise ValueError(f"{'.'.join(parts)} is not a registered view")


def _analysed(spark: SparkSession, plan: Any, views: set[str]) -> None:
    logical = spark._jvm.java.lang.Class.forName(f"{_CATALYST}plans.logical.LogicalPlan")
    for name, node in _nodes(spark, plan):
        short = name.rpartition(".")[2]
        if short == "View":
            if not node.isTempView() or str(node.desc().identifier().table()).lower() not in views:
                raise ValueError(f"{node.desc().identifier().table()} is not a registered view")
        elif short in CODE or not name.startswith(_CATALYST):
            raise ValueError(f"{short} is not allowed")
        elif logical.isInstance(node) and node.children().isEmpty() and short not in LEAVES:
            raise ValueError(f"{short} is not a registered view")


def guarded_sql(spark: SparkSession, text: str, rows: int = ROWS) -> DataFrame:
    """At most rows + 1 rows (one more tells that some were cut); ValueError for anything but a query over the session's temporary views.

    Neither files nor catalog tables can be read, however they are spelled, and only built-in functions that don't run code by name can be
    called. Names of common table expressions hold where they are in scope and nowhere else.
    """
    if not text or not text.strip():
        raise ValueError("empty query")
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    _parsed(spark, text, views)
    found = spark.sql(text)
    _analysed(spark, found._jdf.queryExecution().analyzed(), views)
    return found.limit(rows + 1)
