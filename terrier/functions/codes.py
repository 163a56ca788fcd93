"""Codes of map sheets and plats, hints at municipalities in mail addresses, consistency of assessments, colours of coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrier.functions.lots import plan_lot_key, slug
from terrier.functions.values import let, number

#: How codes of plats begin, and their families.
PLAT_FAMILIES = (("PEP", "pe_plat"), ("PE0", "pe_plat"), ("HA", "ha_plat"), ("ARP", "arp_plat"))
MAP_CODE, WAP_CODE = r"^WA(\d{3})(\d{2})(.+)$", r"^WAP(\d{2})(\d{2})(.+)$"

#: Words that end the name of a place when read backwards.
STREET_WORDS = ("LN", "RD", "ST", "AVE", "DR", "ROUTE", "RTE", "HWY", "HIGHWAY", "CT", "CIR", "WAY", "PKWY")
PLACE_WORDS, LONGEST_PLACE = ("PLT", "TWP"), 4
GRID_PLACES = (r"\bT\d+\s+[A-Z]+\s+BPP\b", r"\bT\d+\s+R\d+\s+NBPP\b")
UNORGANIZED = r"(?i)\b(Twp|BPP|Plt|NBPP)\b"

#: Bounds of what an assessment may look like.
MOST_TOTAL, PART_RATIO, TOTAL_ABOVE = 5_000_000, 1.25, 10_000

#: Fill and line by what a parcel shows, plain and where its join is weak.
COLOURS = {
    "full": ("#c9a227", "#8a7020", "#a68b2a", "#6d5a1a"),
    "exempt": ("#f2845c", "#d46540", "#d97050", "#b05838"),
    "tree_growth": ("#4d6b4a", "#354a32", "#3f563d", "#2b3a28"),
    "owner": ("#5a9a8c", "#3d6b62", "#4a8075", "#325a52"),
    "none": ("#8aa4b0", "#4a6a72", "#8aa4b0", "#4a6a72"),
}


def decode_tpl(code: Column, plan_lot: Column) -> Column:
    """struct(family, tpl, map_key, plat_code, plan_lot) of a code of township, plan and lot; null for none."""
    part = lambda t, pattern, i: F.regexp_extract(t, pattern, i)

    def read(t: Column) -> Column:
        mapped, wap = t.rlike(MAP_CODE), t.rlike(WAP_CODE)
        family = F.when(mapped, "wa_map").when(wap, "wap_plat")
        for prefix, name in PLAT_FAMILIES:
            family = family.when(t.startswith(prefix), name)
        family = family.otherwise("unknown")
        key = F.concat(F.lit("WA"), part(t, MAP_CODE, 1), F.lit("|"), plan_lot_key(part(t, MAP_CODE, 2), part(t, MAP_CODE, 3)))
        plat = F.when(wap, F.substring(t, 1, 5)).when(~mapped & (family != "unknown"), F.substring(t, 1, 4))
        lot = F.when(wap, F.coalesce(plan_lot, F.concat_ws("-", part(t, WAP_CODE, 2), part(t, WAP_CODE, 3)))).otherwise(plan_lot)
        return F.struct(family.alias("family"), t.alias("tpl"), F.when(mapped, key).alias("map_key"), plat.alias("plat_code"), lot.alias("plan_lot"))

    return F.when(F.nullif(code, F.lit("")).isNotNull(), let(F.upper(F.trim(code)), read))


def map_sheet(code: Column, plan_lot: Column) -> Column:
    """The map that a code's key begins with, or else its plat."""
    return let(decode_tpl(code, plan_lot), lambda d: F.when(d["map_key"].isNotNull(), F.get(F.split(d["map_key"], r"\|"), F.lit(0))).otherwise(d["plat_code"]))


def scoped_lot_key(municipality: Column, plan: Column, lot: Column) -> Column:
    return F.concat(municipality, F.lit("|"), plan_lot_key(plan, lot))


def _named_place(kind: str) -> Callable[[Column], Column]:
    """Finds, in words, those before the last `kind`, four at most and none up to a number or street word; null for none."""

    def name(b: Column) -> Column:
        stop = F.coalesce(F.array_max(F.transform(b, lambda w, i: F.when(w.rlike(r"^\d") | w.isin(*STREET_WORDS), i + 1))), F.lit(0))
        return F.slice(b, stop + 1, F.size(b) - stop)

    def find(words: Column) -> Column:
        last = F.array_max(F.transform(words, lambda w, i: F.when(w == kind, i)))  # as many words come before it
        before = F.slice(words, F.greatest(F.lit(1), last - LONGEST_PLACE + 1), F.least(last, F.lit(LONGEST_PLACE)))
        found = let(before, name)
        return F.when((last > 0) & (F.size(found) > 0), slug(F.concat_ws(" ", found, F.lit(kind))))

    return find


def mail_hint(address: Column) -> Column:
    """The id of the plantation, township or grid place that an address names; null for none."""
    text = F.translate(F.upper(address), ",", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    grids = [slug(F.nullif(F.regexp_extract(text, g, 0), F.lit(""))) for g in GRID_PLACES]
    return F.coalesce(*[let(words, _named_place(kind)) for kind in PLACE_WORDS], *grids)


def division_id(name: Column) -> Column:
    """The id of a division by its name, townships and plantations in their short form."""
    n = F.trim(name)
    return slug(F.regexp_replace(F.regexp_replace(n, r"(?i)\s+Township$", " Twp"), r"(?i)\s+Plantation$", " Plt"))


def is_unorganized(name: Column) -> Column:
    return F.coalesce(name.rlike(UNORGANIZED), F.lit(False))


def municipality_of(address: Column, sheet_ids: Column, division: Column) -> Column:
    """The municipality of a tax row: by its mail, else the first of its map sheet, else its division."""
    short = slug(F.regexp_replace(division, r"(?i)\s+Township$", " Twp"))
    return F.coalesce(mail_hint(address), F.nullif(F.get(sheet_ids, 0), F.lit("")), F.nullif(short, F.lit("")))


def assessment_consistent(land: Column, building: Column, total: Column) -> Column:
    """Whether land, building and total of one assessment can stand together. A missing total or missing parts say nothing against it."""
    t, n, b = number(total), F.coalesce(number(land), F.lit(0.0)), F.coalesce(number(building), F.lit(0.0))
    odd = ((b > t * PART_RATIO) & (n > t)) | ((n > t * PART_RATIO) & (b > t)) | (t > n + b + TOTAL_ABOVE)
    return F.when(F.nullif(total, F.lit("")).isNull(), True).when(t.isNull() | (t > MOST_TOTAL), False).otherwise(~((n > 0) & (b > 0) & (t > 0) & odd))


def coverage_colours(program: Column, tier: Column, weak: Column) -> Column:
    """struct(fill, line): the programme's colours, else those of the tier, muted where the join is weak."""
    shows = F.when(program == 2, "tree_growth").when(program == 1, "exempt").when(tier == 2, "full").when(tier == 1, "owner").otherwise("none")
    pick = lambda i: F.create_map(*[F.lit(x) for k, c in COLOURS.items() for x in (k, c[i])])[shows]
    return F.struct(F.when(weak, pick(2)).otherwise(pick(0)).alias("fill"), F.when(weak, pick(3)).otherwise(pick(1)).alias("line"))
