"""Questions as SQL: a caller's translator writes the statement, a gate lets only bounded reads through."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BLOCKED = ("INSERT ", "UPDATE ", "DELETE ", "DROP ", "ALTER ", "TRUNCATE ", "CREATE ", "GRANT ", "REVOKE ", "EXECUTE ", "COPY ")
MOST_ROWS = 100
TIMEOUT_S = 10


class Refused(ValueError):
    """The statement is not a bounded read."""


def unfenced(text: str) -> str:
    """The statement out of a code fence, without the final semicolon."""
    x = text.strip()
    if m := re.match(r"^```(?:sql)?\s*\n?(.*?)\n?```$", x, re.DOTALL | re.IGNORECASE):
        x = m[1].strip()
    return x.removesuffix(";").strip()


def check(sql: str) -> None:
    """Raises ``Refused`` unless the statement starts as a read, is one statement, changes nothing and has a LIMIT."""
    upper = sql.strip().upper()
    if not upper.startswith(("SELECT", "WITH")):
        raise Refused("not a SELECT")
    if ";" in sql:
        raise Refused("more than one statement")
    if word := next((b for b in BLOCKED if b in upper), None):
        raise Refused(f"blocked keyword {word.strip()}")
    if "LIMIT" not in upper:
        raise Refused("no LIMIT")


def is_read_plan(spark: SparkSession, sql: str) -> bool:
    """The parsed plan holds no command."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    return "Command" not in plan.getClass().getSimpleName() and "InsertInto" not in plan.toString()


def query(spark: SparkSession, question: str, translate: Callable[[str], str]) -> DataFrame:
    """At most ``MOST_ROWS`` rows of what ``translate`` makes of the question, over the registered views. The caller runs it in
    a job group and cancels that after ``TIMEOUT_S`` seconds."""
    sql = unfenced(translate(question))
    check(sql)
    if not is_read_plan(spark, sql):
        raise Refused("not a read")
    return spark.sql(sql).limit(MOST_ROWS)
