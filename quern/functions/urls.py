"""What an address tells of a lesson; series and types by the rules in `rules`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import rules as R


def number(url: Column, pattern: str) -> Column:
    """The pattern's first group as a number, or null."""
    return F.regexp_extract(url, pattern, 1).try_cast("int")


def lesson(url: Column, types: R.Rules) -> dict[str, Column]:
    """page, grade, volume, article, series and content type of a lesson's address."""
    return {
        "page": number(url, "(?i)trang[_-]([0-9]+)"),
        "grade": number(url, "(?i)lop[_-]([0-9]+)"),
        "volume": number(url, "(?i)tap[_-]([0-9]+)"),
        "article": F.nullif(F.regexp_extract(url, r"-a([0-9]+)\.html$", 1), F.lit("")),
        "series": R.first_rule(url, R.SERIES, None),
        "content_type": R.first_rule(F.lower(url), types, "unknown"),
    }


def lesson_sql(url: str, types: R.Rules) -> str:
    """The same for SQL."""
    take = lambda p: f"TRY_CAST(regexp_extract({url}, '(?i){p}[_-]([0-9]+)', 1) AS INTEGER)"
    return f"{take('trang')} AS page, {take('lop')} AS grade, {take('tap')} AS volume, nullif(regexp_extract({url}, '-a([0-9]+)[.]html$', 1), '') AS article, {R.sql_first_rule(url, R.SERIES, None)} AS series, {R.sql_first_rule(f'lower({url})', types, 'unknown')} AS content_type"


def science_grade(url: Column) -> Column:
    """The first of the grades 6 to 9 that stands in the address, or null."""
    return F.coalesce(*(F.when(F.contains(url, F.lit(f"-{g}-")) | F.contains(url, F.lit(f"lop-{g}")), F.lit(g)) for g in range(6, 10)))


SCIENCE_GRADE_SQL = "CASE " + " ".join(f"WHEN contains({{u}}, '-{g}-') OR contains({{u}}, 'lop-{g}') THEN {g}" for g in range(6, 10)) + " END"


def listing_grade(url: Column) -> Column:
    """The grade of a listing's address: behind `lop-`, else between two hyphens."""
    return F.coalesce(number(url, "lop-([0-9]+)"), number(url, "-([0-9]+)-"))


def has_any(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts stands in the text, letter by letter."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def any_sql(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {R.quoted(p)})" for p in parts) + ")"
