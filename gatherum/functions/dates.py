"""Dates: finding them in text, the day of a register, comparison of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatherum.functions.text import let

YEARS = (1848, 2099)
#: Two-digit years below this are of this century.
PIVOT = 40
NEAR_DAYS = 7
# Names and short names of the months, without marks.
MONTHS = [
    "januar jan janner janvier janv gennaio genn gen", "februar feb febr fevrier fevr fev febbraio febb", "marz maerz mrz mars marzo mar", "april apr avril avr aprile",
    "mai maggio mag", "juni jun juin giugno giu", "juli jul juillet juil luglio lug", "august aug aout agosto ago", "september sept sep septembre settembre sett set",
    "oktober okt octobre oct ottobre ott", "november nov novembre", "dezember dez decembre dec dicembre dic",
]
#: Blanks of any kind, and what may stand unseen within a word.
_SPACE = r"[\s\u00a0\u2007\u2009\u202f]"
_GAP, _UNSEEN = _SPACE + "*", "[\u00ad\u200b-\u200d\ufeff\u0300-\u036f]*"
_MARKED_LETTERS = {"a": "aàáâä", "e": "eèéêë", "i": "iìíî", "o": "oòóôö", "u": "uùúûü", "c": "cç"}


def _spelt(name: str) -> str:
    """A month's name in a pattern: each letter with or without marks."""
    return _UNSEEN.join(f"[{_MARKED_LETTERS[c]}]" if c in _MARKED_LETTERS else c for c in name) + _UNSEEN


def _month_pattern(names: str) -> str:
    return "(?:" + "|".join(_spelt(n) for n in sorted(names.split(), key=len, reverse=True)) + ")"


#: Dates as day, mark, month, the same mark, year; as year-month-day; with the month's name.
_FORMS = {
    "numeric": rf"(?<![\d.,/-])\d{{1,2}}{_GAP}(?:\.{_GAP}\d{{1,2}}{_GAP}\.{_GAP}(?:\d{{4}}|\d{{2}})|/{_GAP}\d{{1,2}}{_GAP}/{_GAP}(?:\d{{4}}|\d{{2}})|-{_GAP}\d{{1,2}}{_GAP}-{_GAP}\d{{4}})(?!\d)(?!\.\d)",
    "iso": r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "month_name": rf"(?<![\d.,/])\d{{1,2}}(?:\.{_GAP}|(?:er|o)?{_SPACE}+|°{_GAP}){_month_pattern(' '.join(MONTHS))}(?![\p{{L}}\p{{N}}_])\.?{_GAP}\d{{4}}(?!\d)",
}
_ANY_FORM = "(?iu)" + "|".join(f"(?:{form})" for form in _FORMS.values())


def real_day(year: Column, month: Column, day: Column) -> Column:
    """The day as a date; null unless there is such a day in the years that count."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.between(*YEARS), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _read(match: Column) -> Column:
    """(day, form) of a piece of text that has one of the forms; a null day if there is no such day."""
    numbers = F.transform(F.regexp_extract_all(match, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    iso, numeric = match.rlike(r"^\d{4}-"), F.size(numbers) == 3
    month = F.lit(None).cast("int")
    for k, names in enumerate(MONTHS, 1):
        month = F.when(match.rlike(rf"(?iu)(?<!\p{{L}}){_month_pattern(names)}(?!\p{{L}})"), k).otherwise(month)
    short = match.rlike(r"(?<!\d)\d{2}$")

    def of(n: Column) -> Column:
        last = F.element_at(n, -1)
        year = F.when(~numeric | ~short, last).otherwise(last + F.when(last < PIVOT, 2000).otherwise(1900))
        found = F.when(iso, real_day(F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.get(n, F.lit(2)))).when(numeric, real_day(year, F.get(n, F.lit(1)), F.get(n, F.lit(0)))).otherwise(real_day(last, month, F.get(n, F.lit(0))))
        return F.struct(found.cast("string").alias("day"), F.when(iso, "iso").when(numeric, "numeric").otherwise("month_name").alias("form"))

    return let(numbers, of)


def find_dates(text: Column) -> Column:
    """The dates of a text in reading order: an array of (day, start, stop, form), offsets in code points. JVM only.

    A text is cut at everything that has one of the forms; the lengths of the pieces give the places. What is no real day is no date.
    The cut goes by a mark that no form holds and that no text has by then: ``split`` would compile the long pattern anew for each text.
    """
    def placed(pieces: Column, matches: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,match:string>>").alias("out"))

        def step(acc: Column, k: Column) -> Column:
            match = F.get(matches, k)
            start = acc["at"] + F.length(F.get(pieces, k))
            stop = start + F.length(match)
            return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"), match.alias("match"))).alias("out"))

        return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), first, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,stop:int,match:string>>"))

    source = F.coalesce(text, F.lit(""))
    found = F.when(source.rlike(r"\d"), let(F.regexp_extract_all(source, F.lit(_ANY_FORM), F.lit(0)), lambda m: let(F.split(F.regexp_replace(F.replace(source, F.lit("\0"), F.lit("\1")), _ANY_FORM, "\0"), "\0", -1), lambda p: placed(p, m)))).otherwise(F.array().cast("array<struct<start:int,stop:int,match:string>>"))
    read = F.transform(found, lambda x: let(_read(x["match"]), lambda r: F.struct(r["day"].alias("day"), x["start"].alias("start"), x["stop"].alias("stop"), r["form"].alias("form"))))
    return F.filter(read, lambda x: x["day"].isNotNull())


def register_day(c: Column) -> Column:
    """The day of a register's date: its first ten characters, a real day, not of 1900 (which stands for no value)."""
    day = F.left(F.trim(c), F.lit(10))
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~day.startswith("1900"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def register_day_reason(c: Column) -> Column:
    """Why there is no register day: empty, day_1900 or bad_form; null if there is one."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(register_day(c).isNotNull(), None).when(F.trim(c).startswith("1900"), "day_1900").otherwise("bad_form")


def reader_day(c: Column) -> Column:
    """A reader's day: the whole text is a real day."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def days_to_nearest(day: Column, days: Column) -> Column:
    """Least distance in days to a set of days; null without either."""
    return F.array_min(F.transform(days, lambda d: F.abs(F.date_diff(day, d))))


def compare_days(day: Column, days: Column) -> Column:
    near = days_to_nearest(day, days)
    return F.struct(F.coalesce(near == 0, F.lit(False)).alias("equal"), F.coalesce(near <= NEAR_DAYS, F.lit(False)).alias("within_7_days"), near.alias("days"))
