"""Statements and code out of a model's reply, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns, most telling first: of the first kind that occurs, the last occurrence counts.
STATEMENTS = (
    r"(?is)(\bCREATE\s+TABLE\b.*?\bAS\b.*?;)",
    r"(?is)(\bWITH\b .*?;)",
    r"(?is)(\bSELECT\b .*?;)",
)
FENCES = (r"(?is)```sql\s*\n(.*?)```", r"(?is)```(.*?)```")
FIRST_QUERY = r"(?is)((?:select|with)\b.*?(?:;|```|\z))"
CODE = r"(?i)```[\w\s]*python\n([\s\S]*?)```|```([\s\S]*?)```"


def statement(reply: Column) -> Column:
    """The last statement of a reply; else its last fenced block, trimmed; else the reply itself."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(reply, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(*map(last, STATEMENTS), *(F.trim(last(p), F.lit(" \t\r\n")) for p in FENCES), reply)


def first_query(reply: Column) -> Column:
    """From the first SELECT or WITH to a semicolon, a fence or the end, without backslashes and fences."""
    plain = F.replace(reply, F.lit("\\"), F.lit(""))
    found = F.regexp_extract(plain, FIRST_QUERY, 1)
    return F.when(found == "", plain).otherwise(F.replace(found, F.lit("```"), F.lit("")))


def python_code(reply: Column) -> Column:
    """The first fenced block, trimmed; the trimmed reply without one."""
    body = F.trim(reply, F.lit(" \t\r\n"))
    tagged, plain = F.regexp_extract(body, CODE, 1), F.regexp_extract(body, CODE, 2)
    return F.when(body.rlike(CODE), F.trim(F.when(tagged != "", tagged).otherwise(plain), F.lit(" \t\r\n"))).otherwise(body)
