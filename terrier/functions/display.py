"""How values are shown: texts out of columns, source text where it is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrier.functions.values import let, number, round_half_up

#: What woods are called, by field, in the order in which they are told.
WOODS = (("soft_acres", "ac softwood"), ("mixed_acres", "ac mixed wood"), ("hard_acres", "ac hardwood"))
ACRE_PLACES = 4


def _or_text(text: Column, show) -> Column:
    """What `show` makes of the number in a text; the text itself if there is none, null for an empty one."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(show(number(text)), text))


def currency(text: Column) -> Column:
    """Whole dollars, with a sign in front if below zero."""
    return _or_text(text, lambda x: F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), F.format_string("$%,d", F.floor(F.abs(x) + 0.5).cast("long")))))


def acres_shown(text: Column) -> Column:
    """To four places at most."""
    places = lambda x: F.regexp_replace(F.format_string(f"%,.{ACRE_PLACES}f", x), r"\.?0+$", "")
    return _or_text(text, lambda x: F.when(x.isNotNull(), F.concat(places(x), F.lit(" ac"))))


def ordinal(value: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ..., 11th, ... of a rounded number."""

    def text(n: Column) -> Column:
        last = F.pmod(n, F.lit(10))
        end = F.when(F.pmod(n, F.lit(100)).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
        return F.concat(n.cast("string"), end)

    return F.when(value.isNotNull(), let(round_half_up(value).cast("long"), text))


def mail_lines(address: Column) -> Column:
    """The parts of an address, as an array; none for null."""
    return F.coalesce(F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != ""), F.array().cast("array<string>"))


def woods_text(forest: Column, enrolled: Column) -> Column:
    """Which woods are enrolled; that they are, where no acres are known; null where nothing is."""
    acres = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    each = F.array_compact(F.array(*[F.when(forest[c] > 0, F.concat_ws(" ", acres(forest[c]), F.lit(name))) for c, name in WOODS]))
    return F.when(F.size(each) > 0, F.array_join(each, ", ")).when(enrolled, "Enrolled (acreage not parsed)")


def is_county_account(account: Column) -> Column:
    return F.coalesce(F.trim(account).rlike(r"^\d{4}-\d{4}$"), F.lit(False))
