"""Guarded read-only SQL: a statement runs in a session of its own, as a subquery, that knows the listed tables and no others.

What isn't a query can't be a subquery, so nothing else is ever run; what isn't listed isn't there to be read. Functions
and clauses that reach beyond tables are refused by name, and so are tables of the catalog, which sessions share.
When in doubt a statement is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Functions that run code, read files or build names.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length", "identifier", "python_worker_logs"}
STRINGS = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
COMMENTS = r"--[^\n]*|/\*.*?\*/"


@dataclass
class Verdict:
    allowed: bool
    reason: str
    tables: tuple[str, ...] = ()


def without_comments(sql: str) -> str:
    """The statement with a blank for each comment; what looks like one in a string stays."""
    return re.sub(f"({STRINGS})|{COMMENTS}", lambda m: m[1] or " ", sql, flags=re.DOTALL)


def skeleton(sql: str) -> str:
    """The statement without comments, its strings empty, its names without quotes, and no semicolons behind it."""
    return re.sub(STRINGS, "''", without_comments(sql), flags=re.DOTALL).replace("`", "").strip().rstrip("; \n\t")


def has_limit(sql: str) -> bool:
    """Whether the outermost query ends in a limit; one in a subquery doesn't count."""
    bare, inner = skeleton(sql), None
    while inner != bare:
        inner, bare = bare, re.sub(r"\([^()]*\)", " ", bare)
    return re.search(r"(?i)\blimit\s+(\d+|all)(\s+offset\s+\d+)?\s*$", bare) is not None


def restricted(spark: SparkSession, tables: dict[str, str]) -> SparkSession:
    """A session that knows the Parquet tables at some paths by name."""
    session = spark.newSession()
    for key, value in {"spark.sql.runSQLOnFiles": "false", "spark.sql.parser.escapedStringLiterals": "false", "spark.sql.ansi.doubleQuotedIdentifiers": "false"}.items():
        session.conf.set(key, value)
    for name, path in tables.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    return session


def refused(session: SparkSession, bare: str, tables: dict[str, str], most_joins: int) -> str:
    """Why a statement (its skeleton) isn't run; '' if nothing speaks against trying."""
    words = {w.lower() for w in re.findall(r"\w+", bare)}
    if not bare:
        return "empty"
    if ";" in bare:
        return "more than one statement"
    if bad := next(iter(sorted({f.lower() for f in re.findall(r"(\w+)\s*\(", bare)} & FORBIDDEN_FUNCTIONS)), None):
        return f"forbidden function: {bad}"
    if re.search(r"(?i)\busing\s*''", bare):
        return "forbidden clause: a script"
    if re.search(r"(?i)\br''", bare):
        return "raw strings aren't read"
    known = {t.lower() for t in tables}
    for word in sorted(words - known):
        if session.catalog.tableExists(f"`{word}`"):
            return f"unknown table: {word}"
    for schema, name in re.findall(r"(\w+)\s*\.\s*(\w+)", bare):
        if schema.lower() not in known and (schema.lower() in ("spark_catalog", "global_temp", "system") or session.catalog.databaseExists(f"`{schema}`")):
            return f"unknown table: {schema}.{name}"
    if len(re.findall(r"(?i)\bjoin\b", bare)) > most_joins:
        return "too many joins"
    return ""


def prepared(spark: SparkSession, sql: str, tables: dict[str, str], most_joins: int = 6) -> tuple[Verdict, DataFrame | None]:
    """The verdict, and the rows of an allowed statement, not yet computed."""
    session, bare = restricted(spark, tables), skeleton(sql)
    if reason := refused(session, bare, tables, most_joins):
        return Verdict(False, reason), None
    body = without_comments(sql).strip().rstrip("; \n\t")
    try:
        rows = session.sql(f"SELECT * FROM (\n{body}\n)")
    except ParseException as e:
        return Verdict(False, "not a query: " + str(e).strip().split("\n")[0][:120]), None
    except AnalysisException as e:
        return Verdict(False, str(e).strip().split("\n")[0][:200]), None
    words = {w.lower() for w in re.findall(r"\w+", bare)}
    return Verdict(True, "", tuple(sorted(t for t in tables if t.lower() in words))), rows


def check(spark: SparkSession, sql: str, tables: dict[str, str], most_joins: int = 6) -> Verdict:
    """Whether a statement is one query over listed tables (name to path), with a bounded number of joins, that Spark understands."""
    return prepared(spark, sql, tables, most_joins)[0]


def run(spark: SparkSession, sql: str, tables: dict[str, str], most_rows: int = 200) -> tuple[list, bool]:
    """Rows of an allowed statement, most_rows at most, and whether there were more."""
    verdict, rows = prepared(spark, sql, tables)
    if rows is None:
        raise PermissionError(verdict.reason)
    some = rows.limit(most_rows + 1).collect()
    return some[:most_rows], len(some) > most_rows


def repairable(error: Exception) -> bool:
    """Whether another wording could help: unknown columns and syntax, but not permissions."""
    return isinstance(error, (AnalysisException, ParseException)) and not isinstance(error, PermissionError)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality of two results."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
