"""Guarded SQL: one SELECT over allowed tables and functions, a hundred rows at most, within a time limit, checked on Catalyst's own
parse tree."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.java_gateway import is_instance_of
from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

MOST_ROWS, SECONDS = 100, 30
#: The log of attempts.
AUDIT = "at timestamp, who string, query string, attempt int, outcome string, error string, n_rows int, seconds double"
#: Functions that a query may call; none of them reads anything but its arguments.
FUNCTIONS = frozenset(
    "abs avg between bool_or cast ceil ceiling char_length coalesce concat concat_ws contains count count_if date_add date_diff date_format date_sub date_trunc datediff "
    "day dayofmonth dayofweek dense_rank endswith extract first_value floor greatest if ifnull ilike isnotnull isnull lag last_value lead least left length ln log lower lpad "
    "ltrim max max_by mean median min min_by month nullif nvl percentile percentile_approx power quarter rank regexp_extract regexp_replace replace right round "
    "row_number rpad rtrim sign split sqrt startswith stddev substr substring sum to_date to_timestamp trim trunc upper var_samp variance weekofyear year".split()
)


class Refused(ValueError):
    pass


class TookTooLong(RuntimeError):
    pass


# Classes of Catalyst's parse tree that a query may be made of. Whatever isn't named here is refused, so that an identifier made at
# run time, a statement run from a text, a hint, a sample, a table function, a script or a version of a table never gets as far as analysis.
PARSED_PLANS = frozenset(
    "Aggregate CTERelationDef Deduplicate Distinct Except Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset OneRowRelation OrderBy Project Sort SubqueryAlias Union "
    "UnresolvedHaving UnresolvedInlineTable UnresolvedOrderBy UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition".split()
)
PARSED_EXPRESSIONS = frozenset(
    "Add Alias And AttributeReference BitwiseAnd BitwiseOr CaseWhen Cast CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual In InSubquery IntegralDivide IsNotNull IsNull "
    "LessThan LessThanOrEqual Like ListQuery Literal LateralColumnAliasReference Multiply Not Or Remainder RLike ScalarSubquery SortOrder SpecifiedWindowFrame Subtract TryCast "
    "UnaryMinus UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedFunction UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame$ "
    "WindowExpression WindowSpecDefinition ILike Between Extract Ceil Floor Substring SubstringIndex StringTrim StringTrimLeft StringTrimRight Overlay Coalesce Concat".split()
)
# What analysis makes of them, besides the functions of the list.
ANALYSED_PLANS = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias Union Window WithCTE".split()
)
ANALYSED_EXPRESSIONS = frozenset(
    "Add AggregateExpression Alias And AttributeReference BitwiseAnd BitwiseOr CaseWhen Cast CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual In InSubquery "
    "IntegralDivide IsNotNull IsNull LessThan LessThanOrEqual Like ListQuery Literal Multiply Not Or OuterReference Remainder RLike ScalarSubquery SortOrder SpecifiedWindowFrame Subtract "
    "UnaryMinus UnboundedFollowing$ UnboundedPreceding$ UnspecifiedFrame$ WindowExpression WindowSpecDefinition "
    "EulerNumber RoundCeil RoundFloor StringLPad StringRPad".split()
)


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _subquery(node):
    return node.plan() if _kind(node) in ("ScalarSubquery", "Exists", "ListQuery") else None


def _parsed(spark: SparkSession, text: str, tables: frozenset[str], functions: frozenset[str]) -> None:
    """Every node of the parse tree is of an allowed class, and every name in scope or in the lists.

    A name is a CTE's only where that CTE is in scope: in what its WITH clause belongs to, and in CTEs that come after it. The body of
    a CTE doesn't see its own name, nor does a table of the same name elsewhere become allowed by it.
    """
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise Refused(f"not one SQL query: {str(error)[:200]}") from None
    todo: list[tuple] = [(root, True, frozenset())]
    while todo:
        node, is_plan, scope = todo.pop()
        kind = _kind(node)
        if kind not in (PARSED_PLANS if is_plan else PARSED_EXPRESSIONS):
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            name = ".".join(_each(node.multipartIdentifier())).lower()
            if name not in tables | scope or not node.options().isEmpty() or node.isStreaming():
                raise Refused(f"not allowed: {name}")
        if kind == "UnresolvedFunction" and (name := ".".join(_each(node.nameParts())).lower()) not in functions:
            raise Refused(f"not allowed: {name}()")
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise Refused("recursion is not allowed")
            for cte in _each(node.cteRelations()):
                todo.append((cte._2(), True, scope))
                scope = scope | {cte._1().lower()}
        todo += [(x, is_plan, scope) for x in _each(node.children())]
        if is_plan:
            todo += [(x, False, scope) for x in _each(node.expressions())]
        elif (inner := _subquery(node)) is not None:
            todo.append((inner, True, scope))


def _classes(spark: SparkSession, functions: frozenset[str]) -> set[str]:
    """The classes behind the names of the functions that come with Spark, so that a function of the session that took a name is none of them."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    found = set()
    for name in functions:
        info = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if info.isDefined():
            found.add(info.get().getClassName().rpartition(".")[2].removesuffix("$").removesuffix("ExpressionBuilder"))
    return found


def _relation(node) -> str | None:
    """The full name of the table or view that a leaf of the analysed plan stands for; None for other nodes, '' for one without a name."""
    kind = _kind(node)
    if kind == "View":
        return node.desc().identifier().unquotedString().lower()
    if kind in ("LogicalRelation", "HiveTableRelation"):
        table = node.catalogTable() if kind == "LogicalRelation" else None
        found = table.get() if table is not None and table.isDefined() else node.tableMeta() if table is None else None
        return found.identifier().unquotedString().lower() if found is not None else ""
    if _each(node.children()) or kind in ANALYSED_PLANS:
        return None
    return ""


def _analysed(spark: SparkSession, text: str, tables: frozenset[str], functions: frozenset[str]) -> DataFrame:
    """The query, if what analysis has made of it has no leaf but the tables and no expression but the allowed.

    What stands within a view that is allowed was put there by whoever made the view, and isn't looked into.
    """
    try:
        frame = spark.sql(text)  # of the classes above, which analysis alone doesn't run
    except AnalysisException as error:
        raise Refused(f"not one SQL query: {str(error)[:200]}") from None
    allowed, gateway = ANALYSED_EXPRESSIONS | _classes(spark, functions), spark.sparkContext._gateway
    ends = {t.split(".")[-1]: t for t in tables}
    todo: list[tuple] = [(frame._jdf.queryExecution().analyzed(), True, False)]
    while todo:
        node, is_plan, inside = todo.pop()
        kind = _kind(node)
        if is_plan:
            if (name := _relation(node)) is not None:
                # the catalog and database that a name of the list leaves out are those of the session
                if not name or name not in tables and not name.endswith(f".{ends.get(name.split('.')[-1], '?')}"):
                    raise Refused(f"not allowed: {name or kind}")
                continue
            if kind not in ANALYSED_PLANS:
                raise Refused(f"{kind} is not allowed")
        elif kind not in allowed and not inside:
            raise Refused(f"{kind} is not allowed")
        # an allowed function may be made of classes that have no name of their own
        inside = not is_plan and (inside or is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.expressions.RuntimeReplaceable"))
        todo += [(x, is_plan, inside) for x in _each(node.children())]
        if is_plan:
            todo += [(x, False, False) for x in _each(node.expressions())]
        elif (inner := _subquery(node)) is not None:
            todo.append((inner, True, False))
    return frame


def check(spark: SparkSession, text: str, allowed: set[str], functions: frozenset[str] = FUNCTIONS) -> DataFrame:
    """The query, planned; Refused unless the text is one query over allowed tables and functions.

    Looked at twice: as it was parsed, where anything but plain queries is refused before analysis could run it, and as it was analysed,
    where names have become relations and functions. Both times only what is listed passes.
    """
    tables = frozenset(a.lower() for a in allowed)
    _parsed(spark, text, tables, functions)
    return _analysed(spark, text, tables, functions)


def run(spark: SparkSession, text: str, allowed: set[str], rows: int = MOST_ROWS) -> DataFrame:
    """The query's first rows; Refused if it is no SELECT or names another table or function."""
    return check(spark, text, allowed).limit(rows)


def answer(spark: SparkSession, text: str, allowed: set[str], rows: int = MOST_ROWS, seconds: float = SECONDS) -> list[Row]:
    """The rows themselves; the query's jobs are cancelled and TookTooLong is raised when the time is over."""
    found, tag = run(spark, text, allowed, rows), f"guard-{uuid.uuid4().hex}"
    done: dict = {}

    def collect() -> None:
        spark.addTag(tag)
        try:
            done["rows"] = found.collect()
        except Exception as error:  # noqa: BLE001  raised again below
            done["error"] = error
        finally:
            spark.removeTag(tag)

    worker = InheritableThread(target=collect, session=spark)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        spark.interruptTag(tag)
        raise TookTooLong(f"not done within {seconds} seconds")
    if "error" in done:
        raise done["error"]
    return done["rows"]


@dataclass
class Answer:
    """rows: what was found, cut to the limit; is_partial: the time was over before all of it was; outcome: answered, partial, refused or failed."""

    rows: list[Row]
    is_partial: bool
    outcome: str
    error: str | None
    attempts: int


def _gathered(spark: SparkSession, found: DataFrame, seconds: float) -> tuple[list[Row], bool]:
    """Rows as they come, and whether the time was over before the last; the jobs behind them are cancelled then."""
    tag, rows, done = f"guard-{uuid.uuid4().hex}", [], {}

    def gather() -> None:
        spark.addTag(tag)
        try:
            for row in found.toLocalIterator():
                rows.append(row)
            done["all"] = True
        except Exception as error:  # noqa: BLE001  raised again below
            done["error"] = error
        finally:
            spark.removeTag(tag)

    worker = InheritableThread(target=gather, session=spark)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        spark.interruptTag(tag)
        return list(rows), True
    if "error" in done:
        raise done["error"]
    return rows, False


def ask(
    spark: SparkSession, text: str, allowed: set[str], log: str, correct: Callable[[str, str], str] | None = None, rows: int = MOST_ROWS, seconds: float = SECONDS, who: str | None = None
) -> Answer:
    """An answer to someone's SQL, whatever it is: nothing is raised, and every attempt is a row of the log.

    A query that is refused or fails may be corrected once: ``correct`` gets it with its error and gives another, which is looked at like any other. What
    takes too long gives what has come by then.
    """
    asked, answer = text, Answer([], False, "refused", None, 0)
    for attempt in (1, 2):
        began, answer = time.monotonic(), Answer([], False, "refused", None, attempt)
        try:
            answer.rows, answer.is_partial = _gathered(spark, run(spark, asked, allowed, rows), seconds)
            answer.outcome = "partial" if answer.is_partial else "answered"
        except Refused as error:
            answer.error = str(error)[:500]
        except Exception as error:  # noqa: BLE001  a query that fails is an outcome
            answer.outcome, answer.error = "failed", f"{type(error).__name__}: {str(error)[:500]}"
        entry = (datetime.now(timezone.utc), who, asked, attempt, answer.outcome, answer.error, len(answer.rows), round(time.monotonic() - began, 3))
        spark.createDataFrame([entry], AUDIT).coalesce(1).write.mode("append").parquet(log)
        if answer.error is None or correct is None:
            break
        asked = correct(asked, answer.error)
    return answer
