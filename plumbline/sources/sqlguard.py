"""What a SQL text would read and call, from the plan the parser makes of it.

The parser alone knows what is a table, a name of the text's own ``WITH``, a literal or
a comment; nothing is looked up or run. Operators that are not known to only read are
refused, so a statement kind that is new to the parser is refused as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..functions import vocabulary as V


class RefusedStatement(ValueError):
    """The text is not a plain read of the registered tables."""


#: Operators of a parsed query that only read.
READING = frozenset((
    "Aggregate", "AsOfJoin", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Transpose", "Union",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedPivot", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedTranspose", "UnresolvedWith", "UnionLoop", "Unpivot", "Window", "WithWindowDefinition",
))
#: Functions in place of a table that make rows of their arguments.
TABLE_FUNCTIONS = frozenset((
    "explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack", "variant_explode",
    "variant_explode_outer",
))


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def parsed(spark: SparkSession, text: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except PySparkException as error:
        raise RefusedStatement(f"not a query: {str(error).splitlines()[0]}") from None


class _Reads:
    """Walks a plan and notes tables and calls; names of ``WITH`` hold only where they can be seen."""

    def __init__(self):
        self.tables: set[tuple[str, ...]] = set()
        self.functions: set[str] = set()

    def plan(self, node, own: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in READING:
            raise RefusedStatement(f"only queries are permitted, not {kind}")
        if kind == "UnresolvedRelation":
            name = tuple(str(p) for p in _each(node.multipartIdentifier()))
            if len(name) > 1 or name[0].lower() not in own:
                self.tables.add(name)
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(str(p) for p in _each(node.name())).lower()
            if name not in TABLE_FUNCTIONS:
                raise RefusedStatement(f"not permitted: {name}()")
        elif kind == "UnresolvedWith":
            for pair in _each(node.cteRelations()):
                name = str(pair._1()).lower()
                # its own name is the table of before, unless the clause is recursive
                self.plan(pair._2(), own | {name} if node.allowRecursion() else own)
                own |= {name}
        elif kind == "WithWindowDefinition":  # a map, which is not among the node's expressions
            for window in _each(node.windowDefinitions().values().toSeq()):
                self.expression(window, own)
        for child in _each(node.children()):
            self.plan(child, own)
        for expression in _each(node.expressions()):
            self.expression(expression, own)

    def expression(self, e, own: frozenset[str]) -> None:
        kind = _kind(e)
        if kind == "UnresolvedFunction":
            self.functions.add(str(e.nameParts().last()).lower())
        elif kind == "ExpressionWithUnresolvedIdentifier":
            raise RefusedStatement("functions must be named in the text")
        if _has_plan(e.getClass()):
            self.plan(e.plan(), own)
        for child in _each(e.children()):
            self.expression(child, own)


def _has_plan(kind) -> bool:
    """Whether expressions of a class hold a query: those in IN, EXISTS, LATERAL, scalar subqueries, TABLE arguments."""
    return any(m.getName() == "plan" and m.getParameterCount() == 0 for m in kind.getMethods())


def reads(spark: SparkSession, text: str) -> tuple[set[tuple[str, ...]], set[str]]:
    """(name parts of the tables, lower-case names of the functions) of a query."""
    found = _Reads()
    found.plan(parsed(spark, text), frozenset())
    return found.tables, found.functions


def guard(spark: SparkSession, text: str | None, tables: Iterable[str] | None = None) -> str:
    """The text, if it only reads: tables of the session, or of ``tables`` if given, with no
    files and no calls into the host; else ``RefusedStatement``."""
    text = (text or "").strip().rstrip(";").rstrip()
    if not text:
        raise RefusedStatement("only queries are permitted")
    named, functions = reads(spark, text)
    if foreign := functions & set(V.FOREIGN_CALLS):
        raise RefusedStatement(f"calls into the host system are not permitted: {sorted(foreign)}")
    if files := [".".join(n) for n in named if any(c in n[-1] for c in "/\\:") or len(n) == 2 and n[0].lower() in V.FILE_FORMATS]:
        raise RefusedStatement(f"only registered tables may be read, no files: {files}")
    if tables is not None:
        known = {t.lower() for t in tables}
        if unknown := sorted(".".join(n) for n in named if len(n) > 1 or n[0].lower() not in known):
            raise RefusedStatement(f"not registered: {unknown}")
    return text
