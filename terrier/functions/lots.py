"""Lot codes: normal forms, keys, and the ladder of codes to try in a join."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrier.functions.values import let

#: Fixed value: endings that mark a unit on a lot.
UNIT_ENDING = r"(?i)-(?:00[A-Z]|UIL|UI2|UI3|UB|MHL|PAR|BOL|MH)(?:-\d+)?$"


def normalize_lot(raw: Column) -> Column:
    t = F.regexp_replace(F.upper(raw), r"\s+", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.", "-"), "-+", "-"), "^-|-$", "")

    def lettered(x: Column) -> Column:
        pattern = r"^([RU])(\d{1,2})-(.+)$"
        letter, digits, rest = (F.regexp_extract(x, pattern, i) for i in (1, 2, 3))
        sheet = F.when(F.length(digits) == 1, F.concat(F.lit("0"), letter, digits)).when(digits.startswith("0"), F.concat(F.lit("0"), letter, F.substring(digits, 2, 9))).otherwise(F.concat(letter, digits))
        parts = F.array_join(F.transform(F.split(rest, "-"), lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < 3), F.lpad(p, 3, "0")).otherwise(p)), "-")
        return F.when(x.rlike(pattern), F.concat(sheet, F.lit("-"), parts)).otherwise(x)

    return F.nullif(F.regexp_replace(let(t, lettered), "-000$", ""), F.lit(""))


def padded(code: Column) -> Column:
    """Two to four parts, all digits, each of three places; else null."""
    parts = F.split(code, "-")
    return F.when(F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.rlike(r"^\d+$")), F.array_join(F.transform(parts, lambda p: F.when(F.length(p) < 3, F.lpad(p, 3, "0")).otherwise(p)), "-"))


def _with_ending(code: Column) -> Column:
    pattern = r"(?i)^(\d{1,3})-(\d{1,3})-([A-Z0-9]+)$"
    base = F.concat_ws("-", F.lpad(F.regexp_extract(code, pattern, 1), 3, "0"), F.lpad(F.regexp_extract(code, pattern, 2), 3, "0"))
    end = F.upper(F.regexp_extract(code, pattern, 3))
    letter = end.rlike("^[A-Z]$")
    each = lambda *p: F.when(letter, F.concat(base, *p))
    out = F.array(base, F.concat(base, F.lit("-000")), F.concat(base, F.lit("-"), end), each(F.lit("-00"), end), each(end), each(end, F.lit("-000")))
    return F.when(code.rlike(pattern), out).otherwise(F.array().cast("array<string>"))


def _on_grid(code: Column) -> Column:
    pattern = r"(?i)^([A-G])-(\d{3,4})(?:-.*)?$"
    letter, digits = F.upper(F.regexp_extract(code, pattern, 1)), F.regexp_extract(code, pattern, 2)
    last = F.substring(digits, -3, 3)
    short = F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0"))
    out = F.array(digits, short, F.concat(F.lit("00"), letter, F.lit("-"), last), F.concat(F.lit("00"), letter, F.lit("-"), last, F.lit("-000")), F.concat_ws("-", letter, last), F.when(F.length(digits) == 4, F.concat(F.lit("00"), letter, F.lit("-"), F.substring(digits, 2, 9))))
    return F.when(code.rlike(pattern), out).otherwise(F.array().cast("array<string>"))


def lot_candidates(raw: Column) -> Column:
    """The codes under which a lot may be filed, the likeliest first, each once: itself, padded, with its ending spelt otherwise, on the letter grid, without unit endings, and its parents. Null text has none."""

    def ladder(code: Column) -> Column:
        wide = padded(code)
        first = F.array(code, wide, F.when(F.size(F.split(wide, "-")) == 2, F.concat(wide, F.lit("-000"))))
        steps = F.sequence(F.lit(1), F.size(F.split(code, "-")))  # an ending is one part at least
        # Unit endings go first, one at a time; then the last part, again and again.
        plain = F.aggregate(steps, F.array(code), lambda s, _: let(F.regexp_replace(F.element_at(s, -1), UNIT_ENDING, ""), lambda n: F.when((n == "") | (n == F.element_at(s, -1)), s).otherwise(F.concat(s, F.array(n)))))

        def parents(stripped: Column) -> Column:
            last = F.element_at(stripped, -1)
            parts = F.split(last, "-")
            up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "-"))
            up = F.when(F.size(parts) > 1, F.filter(up, lambda p: p != "")).otherwise(F.array().cast("array<string>"))
            return F.concat(F.slice(stripped, F.lit(2), F.size(stripped)), F.flatten(F.transform(up, lambda p: F.array(p, padded(p)))))

        every = F.concat(first, _with_ending(code), _on_grid(code), let(plain, parents))
        return F.array_distinct(F.filter(every, lambda c: c.isNotNull()))

    return F.coalesce(let(normalize_lot(raw), lambda c: F.when(c.isNotNull(), ladder(c))), F.array().cast("array<string>"))


def lot_key(geocode: Column, candidate: Column) -> Column:
    """The key of one of a lot's candidates, as it stands: cutting another -000 off would take lot 000 of a map for the map, under which all its lots are filed."""
    return F.upper(F.concat(geocode, F.lit("|"), candidate))


def is_suffix_parent(geometry: Column, tax: Column) -> Column:
    """Whether the geometry's lot is the tax lot with more parts, so a unit on it and no sibling."""
    return F.coalesce(F.startswith(normalize_lot(geometry), F.concat(normalize_lot(tax), F.lit("-"))), F.lit(False))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


#: Latin letters with marks, by the letter that is left without them.
_MARKED = {chr(c): base for c in range(0xC0, 0x1F00) if (base := unicodedata.normalize("NFD", chr(c).lower())[0]).isascii() and base.isalpha() and not chr(c).isascii()}


def normalize_place(text: Column) -> Column:
    """Lower case without marks on Latin letters, signs as blanks, single blanks. Marks that stand as characters of their own are dropped, too."""
    t = F.regexp_replace(F.translate(F.lower(text), "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def wide(digits: Column, places: int = 3) -> Column:
    """Digits with zeros in front up to so many places; longer ones stay."""
    return F.when(F.length(digits) < places, F.lpad(digits, places, "0")).otherwise(digits)


def plan_lot_key(plan: Column, lot: Column) -> Column:
    """plan-lot, the plan of two places at least, the lot in lower case without blanks."""
    return F.concat(wide(plan, 2), F.lit("-"), F.lower(F.regexp_replace(lot, r"\s+", "")))


def index_lot_key(map_: Column, lot: Column) -> Column:
    """The lot code of an entry of an owner index: maps of figures have three places, lettered ones two before the letter; a lot's letter is a part of its own (67A is 067-00A), as is what follows a hyphen. Null for lots that begin with no figure."""
    sheet, code = F.upper(F.trim(map_)), F.upper(F.regexp_replace(lot, r"\s+", ""))
    lettered = r"^(\d+)([A-Z]+)$"
    map_part = F.when(sheet.rlike(r"^\d+$"), wide(sheet)).when(sheet.rlike(lettered), F.concat(wide(F.regexp_extract(sheet, lettered, 1), 2), F.regexp_extract(sheet, lettered, 2))).otherwise(sheet)
    head, tail = F.regexp_extract(code, r"^(\d+)-?(.*)$", 1), F.regexp_extract(code, r"^(\d+)-?(.*)$", 2)
    rest = F.when(code.rlike(r"^\d+-\d+$"), wide(tail)).when(tail.rlike("^[A-Z]+$"), F.concat(F.lit("00"), tail)).otherwise(tail)
    lot_part = F.when(code.rlike(r"^\d+$"), wide(code)).when(code.rlike(r"^\d+(-\d+|[A-Z0-9]+)$"), F.concat(wide(head), F.lit("-"), rest))
    return normalize_lot(F.concat(F.nullif(map_part, F.lit("")), F.lit("-"), lot_part))


def squeeze_code(text: Column) -> Column:
    """Upper case without blanks, signs kept; null for nothing."""
    return F.nullif(F.upper(F.regexp_replace(text, r"\s+", "")), F.lit(""))
