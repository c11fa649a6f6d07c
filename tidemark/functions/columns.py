"""Column expressions shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 4294967295


def u32(text: Column) -> Column:
    """An unsigned 32-bit number written in digits only; null for anything else, blanks and signs included."""
    number = F.when(text.rlike("^[0-9]{1,20}$"), text).try_cast("bigint")  # null beyond 64 bits
    return F.when(number <= U32_MAX, number)


def strip_q(value: Column) -> Column:
    """42 from 'Q42'; null where what follows the first character is no number."""
    return F.substr(value, F.lit(2)).try_cast("bigint")


def q_label(qid: Column) -> Column:
    return F.concat(F.lit("Q"), qid.cast("string"))


def edition_code(domain: Column, hyphens: bool = True) -> Column:
    """Edition from a domain: en.wikipedia -> enwiki. With ``hyphens``, zh-min-nan.wikipedia -> zh_min_nanwiki."""
    code = F.replace(domain, F.lit(".wikipedia"), F.lit("wiki"))
    return F.replace(code, F.lit("-"), F.lit("_")) if hyphens else code


def access_code(method: Column) -> Column:
    """desktop 0, mobile-web 1, anything else -1."""
    return F.when(method == "desktop", 0).when(method == "mobile-web", 1).otherwise(-1).cast("tinyint")


def day(text: Column, strict: bool = True) -> Column:
    """A date written as yyyy-MM-dd; a bad one raises, or is null unless ``strict``."""
    return F.to_date(text, "yyyy-MM-dd") if strict else F.try_to_date(text, "yyyy-MM-dd")


def days(start: Column, end: Column) -> Column:
    """All days from start to end, both included; none where the end lies before the start."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def month_days(date: Column) -> Column:
    """All days of the month of a date."""
    return days(F.trunc(date, "month").cast("date"), F.last_day(date))


def default_range(today: Column, span: int = 30) -> tuple[Column, Column]:
    """The last ``span`` days up to today; today is an argument so that results can be repeated."""
    return F.date_sub(today, span), today


def period_label(start: Column, end: Column) -> Column:
    return F.concat_ws(" to ", start.cast("string"), end.cast("string"))


def delta_percentage(baseline: Column, impact: Column) -> Column:
    """Change in percent; from nothing it is 100 where there is an impact, else 0."""
    grown = (impact - baseline).cast("double") / F.nullif(baseline, F.lit(0)) * 100.0
    return F.when(baseline == 0, F.when(impact > 0, 100.0).otherwise(0.0)).otherwise(grown)


def to_underscores(title: Column) -> Column:
    return F.translate(title, " ", "_")


def to_spaces(title: Column) -> Column:
    return F.translate(title, "_", " ")


def strip_namespace(title: Column) -> Column:
    """Drops all up to the last colon and the blanks after it."""
    return F.regexp_replace(title, r"^.*:\s*", "")


def lossy_text(data: Column) -> Column:
    """UTF-8 text from bytes, with replacement characters for what is not valid."""
    return F.make_valid_utf8(data.cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
