"""The line notation of questions, read into actions, and the guard for SQL of the user's own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Action:
    """What a line asks for: ``kind`` and its arguments."""

    kind: str
    args: tuple[str, ...] = ()
    scope: str | None = None

    def describe(self) -> str:
        """The question in plain words."""
        where = f" in {self.scope}" if self.scope else ""
        texts = {
            "word": "the word {0}", "pair": "{0} and {1} near each other", "phrase": "the phrase {0}", "book": "the book {0}", "chapter": "chapter {1} of {0}", "verse": "{0} {1}:{2}", "compare": "{0} against {1}",
            "kin": "verses akin to {0} {1}", "testament": "the testament {0}", "passage": "the passage {0}", "section": "the section {0}", "theme": "the theme {0}",
        }
        return texts[self.kind].format(*self.args) + where


def parse(line: str) -> Action:
    """Read a line.

    ``'day'`` a word, ``"day of"`` a phrase, ``'day' + 'night'`` two words; a scope may follow in brackets. ``Book``, ``Book 3``,
    ``Book 3:4``, ``kin Book 3``, ``Book ~ Book``, ``@passage``, ``#theme``, ``testament OT``, ``section name``. ValueError on anything else.
    """
    s = line.strip()
    scope = None
    if m := re.search(r"\s*\[([^\[\]]+)\]$", s):
        scope, s = m[1].strip(), s[: m.start()].strip()
    if m := re.fullmatch(r"'([^']+)'\s*\+\s*'([^']+)'", s):
        return Action("pair", (m[1].strip(), m[2].strip()), scope)
    if m := re.fullmatch(r"'([^']+)'", s):
        return Action("word", (m[1].strip(),), scope)
    if m := re.fullmatch(r'"([^"]+)"', s):
        return Action("phrase", (" ".join(m[1].split()),), scope)
    for sign, kind in (("@", "passage"), ("#", "theme")):
        if s.startswith(sign) and s[1:].strip():
            return Action(kind, (s[1:].strip(),), scope)
    if m := re.fullmatch(r"(testament|section)\s+(.+)", s):
        return Action(m[1], (m[2],), scope)
    if m := re.fullmatch(r"(.+?)\s*~\s*(.+)", s):
        return Action("compare", (m[1], m[2]), scope)
    if m := re.fullmatch(r"kin\s+(.+?)\s+(\d+(?::\d+(?:-\d+)?)?)", s):
        return Action("kin", (m[1], m[2]), scope)
    if m := re.fullmatch(r"(.+?)\s+(\d+):(\d+)", s):
        return Action("verse", (m[1], m[2], m[3]), scope)
    if m := re.fullmatch(r"(.*[^\d\s].*?)\s+(\d+)", s):
        return Action("chapter", (m[1], m[2]), scope)
    if re.fullmatch(r"[^'\"\[\]]+", s):
        return Action("book", (s,), scope)
    raise ValueError(f"not understood: {line!r}")


#: Functions that reach outside the query: into the JVM, the files, the session.
DENIED = frozenset(("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "version", "python_worker_logs"))


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan, is_a: Callable[[object, str], bool]) -> Iterator:
    """All nodes and expressions of a parsed plan, those of subqueries and common table expressions too."""
    todo = [plan]
    while todo:
        n = todo.pop()
        yield n
        todo += _items(n.children())
        if is_a(n, "plans.QueryPlan"):
            todo += _items(n.expressions())
        if is_a(n, "expressions.PlanExpression"):
            todo.append(n.plan())
        if n.getClass().getSimpleName() == "UnresolvedWith":
            todo += [t._2() for t in _items(n.cteRelations())]


def guarded_sql(spark: SparkSession, query: str, limit: int = 1000) -> DataFrame:
    """Run one SELECT or WITH statement of the user's own over the session's views, and return its first ``limit`` rows; ValueError on any other.

    The statement is judged by its parsed plan, before anything of it is looked up or run: no commands, no relation but a view or a common
    table expression of one plain name, no function of ``DENIED``.
    """
    from py4j.java_gateway import is_instance_of

    is_a = lambda n, c: is_instance_of(spark.sparkContext._gateway, n, f"org.apache.spark.sql.catalyst.{c}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:  # the parser's own errors come as different classes
        raise ValueError("only one SELECT or WITH statement is allowed") from e
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    nodes = list(_nodes(plan, is_a))
    views |= {t._1().lower() for n in nodes if n.getClass().getSimpleName() == "UnresolvedWith" for t in _items(n.cteRelations())}
    for n in nodes:
        name = n.getClass().getSimpleName()
        if is_a(n, "plans.logical.Command") or is_a(n, "plans.logical.ParsedStatement"):
            raise ValueError("only one SELECT or WITH statement is allowed")
        if name == "UnresolvedRelation":
            parts = _items(n.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in views:
                raise ValueError(f"not a view of this session: {'.'.join(parts)}")
        elif name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = [p.lower() for p in _items(n.nameParts() if name == "UnresolvedFunction" else n.name())]
            if parts[-1] in DENIED or len(parts) > 1 or not spark.catalog.functionExists(parts[-1]):
                raise ValueError(f"not allowed: {'.'.join(parts)}")
        elif name.startswith("Unresolved") and "Generator" not in name and name not in ("UnresolvedAttribute", "UnresolvedAlias", "UnresolvedStar", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "UnresolvedExtractValue", "UnresolvedOrdinal", "UnresolvedNamedLambdaVariable", "UnresolvedWindowExpression", "UnresolvedRegex", "UnresolvedStarExceptOrReplace"):
            raise ValueError(f"not allowed: {name}")
    return spark.sql(query).limit(limit)
