"""String expressions and helpers on names and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_fields(*columns, sep: str = " ") -> Column:
    """The fields that aren't null, joined; null where all are."""
    parts = [_c(c).cast("string") for c in columns]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(sep, *parts))


def class_and_probability(text) -> tuple[Column, Column]:
    """``class--0.4`` as class and number, cut at the last ``--``; null where the text isn't of that form."""
    found = lambda k: F.regexp_extract(_c(text), r"^(.*)--(\d+\.\d+)$", k)
    return F.when(found(2) != "", found(1)), F.nullif(found(2), F.lit("")).try_cast("double")


def short_number(value) -> Column:
    """From 1000 on (either sign) in scientific notation, else with two places."""
    x = _c(value).cast("double")
    return F.when(F.abs(x) >= 1000, F.format_string("%.2e", x)).when(x.isNotNull(), F.format_string("%.2f", x))


def short_year(text) -> Column:
    """The two digits behind the first 20 of a text, null where there are none."""
    return F.nullif(F.regexp_extract(_c(text), r"(?<=20)\d\d", 0), F.lit(""))


def with_year(path: str, level: int, year: int) -> str:
    """The path with the number of four digits in one of its parts replaced; level 0 is the last part. An error if the part has no such number."""
    parts = path.split("/")
    at = len(parts) - 1 - level
    changed, n = re.subn(r"\d{4}", str(year), parts[at]) if 0 <= at else ("", 0)
    if not n:
        raise ValueError(f"{path}: no year at level {level}")
    return "/".join([*parts[:at], changed, *parts[at + 1 :]])


def year_replaced(path, year) -> Column:
    """:func:`with_year` for the last part of a path in a column; null where it has no year."""
    x = _c(path)
    last = F.regexp_extract(x, r"([^/]*)$", 1)
    head = F.substring(x, F.lit(1), F.length(x) - F.length(last))
    return F.when(last.rlike(r"\d{4}"), F.concat(head, F.regexp_replace(last, F.lit(r"\d{4}"), F.lit(year).cast("string") if isinstance(year, int) else _c(year).cast("string"))))


def natural_parts(token) -> tuple[Column, Column]:
    """What orders tokens naturally: the text before the last number, and the number (-1 without one)."""
    number = F.regexp_extract(_c(token), r"(\d+)$", 1)
    return F.regexp_replace(_c(token), r"\d+$", ""), F.coalesce(number.try_cast("bigint"), F.lit(-1))
