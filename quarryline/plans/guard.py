"""What a statement touches, read off the plan that Spark's parser makes of it, against what it may touch.

Statements run inside the driver, with its rights. So functions must be known ones that compute from their arguments,
relations must be tables that were handed in or that the catalog knows, and the parts of the plan must be of known kinds.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

# The groups of Spark's own functions whose members compute from their arguments alone, and those members of
# the group of all others that do.
FUNCTION_GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs "
    "generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs st_funcs string_funcs "
    "struct_funcs url_funcs variant_funcs window_funcs xml_funcs".split()
)
OTHER_FUNCTIONS = frozenset(
    "aes_decrypt aes_encrypt assert_true bitmap_bit_position bitmap_bucket_number bitmap_count current_catalog "
    "current_database current_schema current_user hll_sketch_estimate hll_union monotonically_increasing_id raise_error "
    "session_user theta_difference theta_intersection theta_sketch_estimate theta_union try_aes_decrypt typeof user uuid "
    "version".split()
)
TABLE_FUNCTIONS = frozenset(
    "explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack variant_explode "
    "variant_explode_outer".split()
)
# The kinds of plan that a query is made of, and commands that only tell something.
QUERY_PARTS = frozenset(
    "Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join "
    "LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range RebalancePartitions Repartition "
    "RepartitionByExpression Sample Sort SubqueryAlias Tail Union UnionLoop UnresolvedHaving UnresolvedHint "
    "UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases "
    "UnresolvedTableValuedFunction UnresolvedTranspose UnresolvedWith Unpivot Window WithCTE WithWindowDefinition PipeOperator "
    "RelationTimeTravel".split()
)
TELLING = frozenset(
    "CurrentNamespace DescribeColumn DescribeFunction DescribeNamespace DescribeQueryCommand DescribeRelation ExplainCommand "
    "SetCatalogAndNamespace SetCatalogCommand SetNamespaceCommand ShowCatalogsCommand ShowColumns ShowCreateTable "
    "ShowCurrentNamespaceCommand ShowFunctions ShowNamespaces ShowPartitions ShowTableExtended ShowTableProperties ShowTables "
    "ShowTablesCommand ShowViews UnresolvedNamespace UnresolvedTableOrView".split()
)
# Commands that change tables of the catalog.
CHANGING = frozenset(
    "AddColumns AlterColumns AlterViewAs CreateNamespace CreateTable CreateTableAsSelect CreateView CreateViewCommand "
    "DeleteFromTable DropColumns DropNamespace DropTable DropTempViewCommand DropView InsertIntoStatement MergeIntoTable "
    "RenameColumn RenameTable ReplaceColumns ReplaceTable ReplaceTableAsSelect SetTableProperties SetViewProperties TruncateTable "
    "UnresolvedIdentifier UnresolvedTable UnresolvedView UnsetTableProperties UnsetViewProperties UpdateTable".split()
)

_CATALYST = "org.apache.spark.sql.catalyst"


class _Plan:
    """A parsed statement as lists of what stands in it, at any depth: plans inside commands and subqueries, expressions inside
    plans, and what they hold in options, sequences and pairs."""

    def __init__(self, spark: SparkSession, sql: str):
        jvm = spark._jvm
        named = jvm.java.lang.Class.forName
        self._tree, self._logical = named(f"{_CATALYST}.trees.TreeNode"), named(f"{_CATALYST}.plans.logical.LogicalPlan")
        self._held = [named(f"scala.{name}") for name in ("collection.Iterable", "Option", "Product")]
        self.nodes: list[tuple[str, JavaObject, bool]] = []
        self.names_given: set[str] = set()
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
        while todo:
            value = todo.pop()
            if not isinstance(value, JavaObject):
                continue
            if self._tree.isInstance(value):
                kind = value.getClass().getSimpleName().rstrip("$")
                self.nodes.append((kind, value, self._logical.isInstance(value)))
                if kind == "UnresolvedWith":
                    self.names_given |= {relation._1().lower() for relation in _items(value.cteRelations())}
                todo += _drained(value.productIterator())
            elif self._held[0].isInstance(value) or self._held[1].isInstance(value):
                todo += _items(value)
            elif self._held[2].isInstance(value) and value.getClass().getName().startswith(("scala.Tuple", _CATALYST)):
                todo += _drained(value.productIterator())


def _drained(iterator: JavaObject) -> list:
    out = []
    while iterator.hasNext():
        out.append(iterator.next())
    return out


def _items(found: JavaObject) -> list:
    return _drained(found.iterator())


def _function_allowed(spark: SparkSession, parts: list[str], more: Collection[str]) -> bool:
    name = parts[-1].lower()
    if ".".join(parts).lower() in more:
        return True
    if [p.lower() for p in parts[:-1]] not in ([], ["builtin"], ["system", "builtin"]):
        return False
    registry = spark._jsparkSession.sessionState().functionRegistry()
    known = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    if known.isEmpty() or not known.get().getClassName().startswith(_CATALYST):  # not there, or somebody's own under this name
        return False
    return known.get().getGroup() in FUNCTION_GROUPS or name in OTHER_FUNCTIONS


def _table_allowed(spark: SparkSession, parts: list[str], tables: Collection[str], given: set[str], only_given: bool) -> bool:
    name = ".".join(parts).lower()
    if name in tables or (len(parts) == 1 and name in given):
        return True
    return not only_given and spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts))


def objections(
    spark: SparkSession, sql: str, tables: Collection[str] = (), read: bool = True, functions: Collection[str] = ()
) -> Iterator[str]:
    """Everything in one statement that is not allowed, in words; nothing if all is.

    Queries take their rows from ``tables`` when any are named, else from what the catalog knows; never from a path. What
    changes tables may name those the catalog knows as well. Functions are Spark's own, of the groups above, and those named
    in ``functions``. A text that Spark cannot parse raises its error.
    """
    plan = _Plan(spark, sql)
    tables, functions = {t.lower() for t in tables}, {f.lower() for f in functions}
    for kind, node, is_plan in plan.nodes:
        if "UnresolvedIdentifier" in kind and kind != "UnresolvedIdentifier":
            yield "a name that is put together as the statement runs"
        elif is_plan and kind not in QUERY_PARTS and kind not in TELLING and (read or kind not in CHANGING):
            yield f"a part of the kind {kind}"
        if kind == "UnresolvedFunction":
            parts = _items(node.nameParts())
            if not _function_allowed(spark, parts, functions):
                yield f'the function "{".".join(parts)}"'
        elif kind == "UnresolvedTableValuedFunction":
            parts = _items(node.name())
            if parts[-1].lower() not in TABLE_FUNCTIONS or len(parts) > 1:
                yield f'the table function "{".".join(parts)}"'
        elif kind in ("UnresolvedRelation", "UnresolvedTableOrView"):
            parts = _items(node.multipartIdentifier())
            if not _table_allowed(spark, parts, tables, plan.names_given, read and bool(tables)):
                yield f'the table "{".".join(parts)}"'
        elif kind == "UnresolvedTableSpec" and node.location().isDefined():
            yield "a table in a place of its own"
        elif kind == "OptionList" and any(option._1().lower() in ("path", "paths") for option in _items(node.options())):
            yield "a table in a place of its own"
