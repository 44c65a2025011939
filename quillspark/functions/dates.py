"""Date expressions: what reads as a date in a text, as ISO strings. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.base import constant_map, let
from quillspark.functions.text import canonical, stripped

NUMERIC, ALPHA = 69, 30  # two-digit years below these are 20xx, in numeric dates and in those with month names
#: Names of months.
MONTHS = {
    "JAN": 1, "JANUARY": 1, "FEB": 2, "FEBRUARY": 2, "MAR": 3, "MARCH": 3, "APR": 4, "APRIL": 4, "MAY": 5, "JUN": 6, "JUNE": 6, "JUL": 7,
    "JULY": 7, "AUG": 8, "AUGUST": 8, "SEP": 9, "SEPT": 9, "SEPTEMBER": 9, "OCT": 10, "OCTOBER": 10, "NOV": 11, "NOVEMBER": 11, "DEC": 12, "DECEMBER": 12,
}


def iso(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd of numbers, null unless there is such a day."""
    year = let(year, lambda y: F.when(y.between(1, 9999), y))
    return F.date_format(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0.0)), "yyyy-MM-dd")


def with_century(year: Column, pivot: int) -> Column:
    return let(year, lambda y: F.when(y < 100, y + F.when(y < pivot, 2000).otherwise(1900)).otherwise(y))


SLASHED = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$"


def day_first(c: Column) -> Column:
    """ISO of d/m/Y, d-m-Y and the same with two-digit years, as a whole; else null."""

    def read(v):
        part = lambda k: F.regexp_extract(v, SLASHED, k).try_cast("int")
        year = F.when(F.length(F.regexp_extract(v, SLASHED, 4)) == 2, with_century(part(4), NUMERIC)).otherwise(part(4))
        return iso(year, part(3), part(1))

    return let(c, lambda v: F.when(v.rlike(SLASHED), read(v)))


def normalized(c: Column) -> Column:
    """ISO where the whole text is a day-first date, else the text itself."""
    return let(c, lambda v: F.coalesce(day_first(v), v))


def output_date(c: Column) -> Column:
    """Blank to empty, ISO as it is, day-first dates to ISO, other text as it is."""
    c = stripped(F.coalesce(c, F.lit("")))
    return let(c, lambda v: F.when((v == "") | v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).otherwise(normalized(v)))


ALPHA_DATE = r"\b(\d{1,2}) ([A-Z]{3,9}) (\d{2,4})\b"


def month_named(c: Column) -> Column:
    """ISO of the first 'day MONTH year' in the canonical text; else null."""
    months = constant_map(MONTHS)

    def read(v):
        month = F.try_element_at(months, F.regexp_extract(v, ALPHA_DATE, 2))
        year = with_century(F.regexp_extract(v, ALPHA_DATE, 3).try_cast("int"), ALPHA)
        return iso(year, month, F.regexp_extract(v, ALPHA_DATE, 1).try_cast("int"))

    return let(canonical(c), lambda v: F.when(v.rlike(ALPHA_DATE), read(v)))


#: An ASCII letter, or what may become one: without, no month is named.
LETTER = r"[A-Za-z]|[^\x00-\x7F]"


def full_date(c: Column) -> Column:
    """ISO of a text that is a day-first or ISO date, or that has one with a month's name; else null."""
    return let(c, lambda v: F.coalesce(day_first(v), F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v), F.when(v.rlike(LETTER), month_named(v))))


def _either(c: Column) -> list[Column]:
    """The text with points as slashes, and the same without spaces."""
    c = F.replace(stripped(c), F.lit("."), F.lit("/"))
    return [c, F.when(c.contains(" "), F.replace(c, F.lit(" "), F.lit("")))]


def digit_groups(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))


def any_date(c: Column) -> Column:
    """The first date that any of the readings finds, as ISO; else empty.

    In order: the text as a whole, with and without its spaces; its first numeric date; a date with a
    month's name; its first three groups of digits (year first if the first has four digits)."""
    return let(stripped(F.coalesce(c, F.lit(""))), _any_date)


def _any_date(c: Column) -> Column:
    inner = F.regexp_extract(c, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0)

    def grouped(g):
        first, second, third = (F.get(g, F.lit(k)) for k in range(3))
        turned = F.when(F.length(first) == 4, F.concat_ws("/", third, second, first)).otherwise(F.concat_ws("/", first, second, third))
        return F.when(F.size(g) >= 3, full_date(turned))

    readings = [full_date(x) for x in _either(c)] + [full_date(inner), month_named(c), let(digit_groups(c), grouped)]
    return F.coalesce(*readings, F.lit(""))


SIGNATURE = "struct<year:int,month:int,day:int>"


def signature(c: Column) -> Column:
    """(year, month, day) of a date, (year, month, null) of a year and month; else null."""
    return let(stripped(F.coalesce(c, F.lit(""))), _signature)


def _signature(c: Column) -> Column:
    none = F.lit(None).cast("int")
    made = lambda y, m, d: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"))

    def partial(dashed):
        pattern = r"\b(\d{4})-(\d{1,2})\b"
        year, month = (F.regexp_extract(dashed, pattern, k).try_cast("int") for k in (1, 2))
        return F.when(month.between(1, 12), made(year, month, none))

    def grouped(g):
        first, second = F.get(g, F.lit(0)), F.get(g, F.lit(1)).try_cast("int")
        return F.when((F.length(first) == 4) & second.between(1, 12), made(first.try_cast("int"), second, none))

    day = F.try_to_date(F.coalesce(*[full_date(x) for x in _either(c)]), "yyyy-MM-dd")
    whole = let(day, lambda d: F.when(d.isNotNull(), made(F.year(d), F.month(d), F.day(d))))
    return F.coalesce(whole, let(F.replace(canonical(c), F.lit(" "), F.lit("-")), partial), let(digit_groups(c), grouped))


def looks_like_date(c: Column) -> Column:
    def read(v):
        named = lambda n: F.arrays_overlap(F.split(n, " "), F.map_keys(constant_map(MONTHS)))
        by_name = let(canonical(v), lambda n: F.when(named(n), n.rlike(r"\b\d{2,4}\b")))
        return signature(v).isNotNull() | F.coalesce(by_name, F.size(digit_groups(v)) >= 2)

    return let(c, read)


def written_forms(day: Column) -> Column:
    """Of a date: ISO, compact, d/m/Y, d-m-Y, dmY, ymd."""
    return F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy", "dd-MM-yyyy", "ddMMyyyy", "yyMMdd")])


def variants(c: Column) -> Column:
    """All ways to write the date, or year and month, that a text has; an array of distinct strings."""
    return let(stripped(F.coalesce(c, F.lit(""))), _variants)


def _variants(c: Column) -> Column:
    def months(s):
        year, month = F.lpad(s["year"].cast("string"), 4, "0"), F.lpad(s["month"].cast("string"), 2, "0")
        return F.when(s.isNotNull(), F.array(F.concat(year, F.lit("-"), month), F.concat(year, month), F.concat(month, F.lit("-"), year), F.concat(month, F.lit("/"), year)))

    parts = [let(F.try_to_date(full_date(x), "yyyy-MM-dd"), lambda d: F.when(d.isNotNull(), written_forms(d))) for x in _either(c)]
    parts += [let(F.array_join(digit_groups(c), ""), lambda j: F.when(j.rlike(r"^\d{8}$"), F.array(j))), let(signature(c), months)]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(p, none) for p in parts])))


def label_forms(c: Column) -> Column:
    """The five forms under which a field's date is looked for; the text itself if it is no date."""
    day = F.try_to_date(F.coalesce(F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c), day_first(c)), "yyyy-M-d")
    forms = F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "ddMMyyyy", "yyMMdd")])
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(day.isNotNull(), forms).otherwise(F.array(c))
