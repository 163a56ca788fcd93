"""Commitment books: a town's accounts, each a header and the lines below it, as one row per lot.

Lines are rows, and what a line belongs to is worked out in two levels of sessions. A block is a header and the lines up
to the next header or piece of page chrome. Within a block a span is a lot line and the lines up to the next one; span 0
holds the lines before the first lot. A lot's values come from its own span, its tax, acres and forest lines from that
and the lines between it and the lot before, and only what is printed once for the account holds for all its lots.

All windows and groups are by document, which one shuffle brings together: a book is as large as one document's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions.codes import assessment_consistent
from terrier.functions.lots import normalize_lot
from terrier.functions.owners import ENTITIES, is_owner, land_column, sanitize_owner
from terrier.functions.values import bare, exemption, is_money
from terrier.operators.parsers import any_of, group, squeezed

# How sure a record is by what was found.
SURE, FROM_HEADER, FROM_MAIL, FROM_ENTITY, IN_PART, NOTHING, ODD = 0.9, 0.5, 0.85, 0.88, 0.3, 0.2, 0.15
# Printed labels. Lines of a book that belong to no account; what a partnership's name goes on with; what no mail line begins with.
CHROME = ("PAGE TOTALS:", "TAX RATE", "COMMITMENT BOOK")
CHROME_LINES = ("LAND BUILDING EXEMPT TOTAL TAX", "LAND", "BUILDING", "EXEMPT", "TOTAL", "TAX", "SUBTOTAL", "SUBTOTALS", "PAGE TOTALS")
CHROME_STARTS = ("SUBTOTALS:", "ACCOUNT NAME & ADDRESS")
PARTNER_WORDS = ("MARKETPLACE", "LIMITED", "PARTNERSHIP")
MAIL_LABELS = ("ACRES", "SOFT", "MIXED", "HARD")
WOODS = ("soft", "mixed", "hard")
#: Money that columns of figures are made of, at least.
LEAST_FIGURE = 1000

_TAX, _AMOUNT = r"\d{1,3}(?:,\d{3})*\.\d{2}", r"[\d,]+"
#: A zip of the state, which stands where a total might.
_ZIP = r"^0\d{4}$"
#: Forms of a lot alone on its line: sheets and lots of figures, sheets with R or U, letters of a grid and its squares; a plus adds lots.
_LOT_FORMS = (r"\d{2,3}-\d{1,3}(?:-\d{1,3}){0,2}(?:-[A-Z][A-Z0-9-]*)?", r"[RU]\d{1,2}(?:-\d{1,3}){1,2}(?:-[A-Z])?", r"[A-G]-\d{3,4}(?:-[A-Z0-9]+)?", r"[A-Z]\d-0[A-Z]\d-[A-Z0-9]+(?:/[A-Z0-9]+)?")
_LOT = rf"(?i)^(?:{'|'.join(_LOT_FORMS)})(?:\+\d+[A-Z]?(?:-[A-Z0-9]+)?)*$"
#: The rest of a header: a name, three numbers or more, perhaps a tax, perhaps a mail address.
_TOLD = rf"^(\S.*?)\s+({_AMOUNT}\s+{_AMOUNT}\s+{_AMOUNT}(?:\s[\d,\s]*)?)(?=\s|$)\s*(.*)$"
_ROW = rf"^{_AMOUNT}\s+{_AMOUNT}\s+{_AMOUNT}(?:\s+{_AMOUNT})?(?:\s+{_TAX})?$"
#: Acres: behind the word, or in front of it, or of a note on a homestead.
_ACRES = (r"(?i)\bacres\b[\t :]+([\d,]*\.?\d+)", r"(?i)^([\d,]*\.?\d+)[\t ]+(?:\d+[\t ]+)?homestead", r"(?i)^([\d,]*\.?\d+)[\t ].*\bacres\b")


def is_chrome(line: Column) -> Column:
    """Whether a line belongs to the page and to no account: titles, totals, page numbers."""
    plain = squeezed(line)
    said = any_of([F.contains(plain, F.lit(x)) for x in CHROME] + [F.startswith(plain, F.lit(x)) for x in CHROME_STARTS])
    return said | plain.isin(*CHROME_LINES) | plain.rlike(r"^\d+ PAGE$") | plain.rlike(r"-- ?\d+ OF \d+ ?--")


def expand_lots(raw: Column) -> Column:
    """A lot with additions as its lots: what follows a plus is another lot of the same sheet, or on a letter grid of the same square."""
    parts = F.filter(F.split(raw, r"\+"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    stem = F.coalesce(group(first, r"^([A-G]-\d{3,4})"), F.get(F.split(first, "-"), F.lit(0)))
    return F.transform(parts, lambda p, i: F.when((i == 0) | F.contains(p, F.lit("-")), p).otherwise(F.concat_ws("-", stem, p)))


def _headers(lines: DataFrame, by_name: bool) -> DataFrame:
    """lines with `owned`, whether a line is the header of an account, and what it says: lot or land value in front, account, name, figures, tax and mail behind.

    In front stands a lot, or the land value, or neither. A line that begins with two numbers begins with land, unless the
    first has no comma, is no smaller than the second, and what follows it makes an owner by itself. A row of three
    figures counts only behind a land value. `clean` is the owner that a header's name or another line makes."""
    line = F.col("line")
    two = r"^([\d,]+)\s+([1-9]\d{0,3})\s+"
    front, second = F.regexp_extract(line, two, 1), F.regexp_extract(line, two, 2)
    # Behind land and account stands a name, not a number, unless a word follows that.
    land = line.rlike(rf"{two}(?!{_AMOUNT}(?:\s+[^A-Z]|$))[A-Z0-9]")
    alone = land & front.rlike(r"^[1-9]\d{0,3}$") & (front.try_cast("int") >= second.try_cast("int")) & is_owner(F.regexp_extract(line, r"^\S+\s+(.*)$", 1))
    lot = line.rlike(r"^\d{2}-\d{2,3}(?:-\d{1,3})*\s+[1-9]\d{0,3}\s+[A-Z]")
    kind = F.when(F.col("chrome"), None).when(lot, "lot").when(land & ~alone, "land").when(line.rlike(r"^[1-9]\d{0,3}\s+[A-Z0-9]"), "account")
    out = lines.withColumn("kind", kind)
    word = lambda i: F.regexp_extract(line, r"^(\S+)\s+(\S+)", i)
    rest = F.when(F.col("kind") == "account", F.regexp_extract(line, r"^\S+\s+(.*)$", 1)).when(F.col("kind").isNotNull(), F.regexp_extract(line, r"^\S+\s+\S+\s+(.*)$", 1))
    out = out.withColumns({"rest": rest, "front": F.when(F.col("kind") != "account", word(1)), "account": F.when(F.col("kind") == "account", word(1)).when(F.col("kind").isNotNull(), word(2))})
    told = F.when(F.col("rest").rlike(_TOLD), F.split(F.trim(F.regexp_extract("rest", _TOLD, 2)), r"\s+"))
    out = out.withColumn("told", told).withColumn("told", F.when((F.size("told") > 3) | (F.col("kind") == "land"), F.col("told")))
    name = F.when(F.col("told").isNotNull(), F.regexp_extract("rest", _TOLD, 1)).otherwise(F.col("rest"))
    behind = F.when(F.col("told").isNotNull(), F.regexp_extract("rest", _TOLD, 3))
    out = out.withColumns({"name": name, "head_tax": F.nullif(F.regexp_extract(behind, rf"^({_TAX})(?=\s|$)", 1), F.lit("")), "head_mail": F.nullif(F.trim(F.regexp_replace(behind, rf"^{_TAX}(?=\s|$)", "")), F.lit(""))})
    partner = F.col("name").rlike(r"(?i)^W/S\s+[A-Z]")
    if by_name:
        out = out.withColumn("clean", sanitize_owner(F.col("name")))
        owned = partner | F.col("clean.name").isNotNull()
    else:
        # The owner is a line below; a number in front of it is an account's.
        owned = F.col("name").rlike("[A-Z]{2}")
        plain = F.trim(F.regexp_replace(line, r"^\d{3,}\s+(?=[A-Z])", ""))
        entity = plain.rlike(rf"(?i)(?:^|[^A-Z0-9])(?:{'|'.join(ENTITIES)})(?:[^A-Z0-9]|$)")
        person = F.contains(plain, F.lit(",")) | plain.rlike(r"\(JT\)|\bJT\b")
        out = out.withColumns({"plain": plain, "entity": entity}).withColumn("clean", sanitize_owner(F.when(F.col("kind").isNotNull() & owned, F.col("name")).when(F.col("entity") | person, F.col("plain"))))
    # Figures over several lots leave each the land value among them, which stands with the name or at the header's end.
    land = F.coalesce(F.when(F.col("told").isNull(), F.col("clean.land")), land_column(F.col("rest")))
    out = out.withColumn("tail", F.when(F.col("kind").isNotNull() & ~partner, land))
    return out.withColumn("partner_head", partner & F.col("kind").isNotNull()).withColumn("owned", F.coalesce(F.col("kind").isNotNull() & owned, F.lit(False)))


def _blocks(lines: DataFrame) -> DataFrame:
    """The lines of open blocks: `block` is the header's number, `at` the order within. A lot line right before the header of a partnership that begins with its land value is the first line of that block."""
    w = Window.partitionBy("doc_id").orderBy("n")
    mark = F.when(F.col("chrome"), -1).when(F.col("owned"), F.col("n"))
    follows = F.lead(F.when(F.col("owned") & (F.col("kind") == "land") & F.col("partner_head"), F.col("n"))).over(w)
    out = lines.withColumns({"block": F.last(mark, ignorenulls=True).over(w), "next_head": follows}).where("block >= 0")
    moved = F.col("is_lot") & F.col("next_head").isNotNull()
    return out.withColumns({"at": F.when(moved, 2 * F.col("next_head") + 1).otherwise(2 * F.col("n")), "block": F.when(moved, F.col("next_head")).otherwise(F.col("block"))}).drop("next_head")


def _signed(lines: DataFrame) -> DataFrame:
    """lines with what each shows: a lot, a row of figures, acres, a tax, woods, mail."""
    line, upper = F.col("line"), F.upper("line")
    numbers = line.rlike(rf"^(?:{_AMOUNT}|{_TAX})(?:\s+(?:{_AMOUNT}|{_TAX}))*$")
    acres = F.coalesce(*(group(line, p) for p in _ACRES))
    label = any_of([F.startswith(upper, F.lit(m)) for m in MAIL_LABELS]) | F.contains(upper, F.lit("HOMESTEAD")) | upper.rlike(r"^B\d")
    out = lines.withColumns({"numbers": numbers, "acres": acres, "tax": group(line, rf"(?:^|\s)({_TAX})(?=\s|$)"), "label": label, "homestead": F.contains(upper, F.lit("HOMESTEAD"))})
    told_acres = F.col("acres").isNotNull() | upper.rlike(r"\bACRES\b")
    mail = ~F.col("is_lot") & ~F.col("numbers") & ~F.col("label") & ~F.contains(upper, F.lit("ACRES")) & ~F.col("owned")
    # What a binding of acres to the next lot sees: acres bind, another account's line doesn't.
    event = F.when(F.col("is_lot"), "lot").when(told_acres, "acres").when(line.rlike(r"^\d{1,4}\s+[A-Z]") & ~F.col("owned"), "other")
    woods = {k: F.when(line.rlike(rf"(?i)^{k}\s*:\s*[\d,.]+\s+[\d,.]+"), F.struct("at", bare(group(line, r":\s*([\d,.]+)")).try_cast("double").alias("acres"), bare(group(line, r":\s*[\d,.]+\s+([\d,.]+)")).try_cast("double").alias("value"))) for k in WOODS}
    partner = any_of([F.startswith(upper, F.lit(p)) for p in PARTNER_WORDS])
    return out.withColumns({"mail": mail, "event": event, "partner": partner, **woods})


def _with_spans(lines: DataFrame) -> DataFrame:
    """lines with `span`, their lot's number within the block, and what depends on the lines before."""
    w = Window.partitionBy("doc_id", "block").orderBy("at")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = lines.withColumns({
        "span": F.count_if("is_lot").over(so_far),
        "bound": F.last("event", ignorenulls=True).over(before) == "acres",
        "first_body": F.count_if(~F.col("mail") & ~F.col("owned")).over(so_far) == 1,
        "goes_on": F.col("partner") & (F.count_if(~F.col("partner") & ~F.col("is_lot") & ~F.col("owned")).over(so_far) == 0),
        "head_land": F.first(F.when(F.size("told") > 3, bare(F.element_at("told", -4))).when(F.col("kind") == "land", bare("front"))).over(w),
    })
    t = F.split("line", r"\s+")
    cell = lambda i: bare(F.get(t, F.lit(i)))
    numbers = F.size(t) - F.when(F.col("tax").isNotNull(), 1).otherwise(0)
    four = F.struct("at", cell(0).alias("land"), cell(1).alias("building"), cell(2).alias("exempt"), cell(3).alias("total"), bare("tax").alias("tax"))
    three = F.struct("at", F.col("head_land").alias("land"), cell(0).alias("building"), cell(1).alias("exempt"), cell(2).alias("total"), bare("tax").alias("tax"))
    row = F.when(F.col("line").rlike(_ROW) & ~F.col("owned"), F.when((numbers == 4) & any_of([is_money(cell(i)) for i in (0, 1, 3)]), four).when((numbers == 3) & F.col("head_land").isNotNull() & (is_money(cell(0)) | is_money(cell(2))), three))
    alone = F.when(F.col("line").rlike(rf"^0\s+{_AMOUNT}$") & is_money(cell(1)), F.struct("at", cell(1).alias("total")))
    amounts = F.filter(F.transform(t, lambda x: F.when(x.rlike(rf"^{_AMOUNT}$") & is_money(x), bare(x))), lambda m: m.isNotNull() & (m.cast("double") >= LEAST_FIGURE))
    # Figures one below the other: whatever amounts a line shows that is no label, no deed and no tax.
    large = F.when(~F.col("label") & ~F.col("owned") & ~F.col("is_lot") & F.col("line").rlike(r"\d{3}"), amounts)
    return out.withColumns({"row": row, "alone": alone, "amounts": large}).withColumn("large", F.when(F.size("amounts") > 0, F.struct("at", "amounts")))


def _spans(lines: DataFrame, by_name: bool) -> DataFrame:
    """One row per span, with what is found in it, around it, and in its block: header, owner, mail."""
    body = ~F.col("owned") & (~F.col("mail") | (F.col("span") > 0))
    mail = F.col("mail") & (F.col("span") == 0)
    first = lambda value, where=None: F.min(F.when(value.isNotNull() if where is None else value.isNotNull() & where, F.struct("at", value.alias("v"))))
    listed = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("at", "line")))), lambda x: x["line"])
    head = ("kind", "front", "account", "name", "told", "head_tax", "head_mail", "partner_head", "clean", "tail")
    of_span = {"lot": F.min(F.when(F.col("is_lot"), F.struct("at", F.upper("line").alias("lot"), "bound", "first_body"))), "row": F.min("row"), "alone": F.min("alone"), "large": F.array_sort(F.collect_list("large")), "own_tax": first(F.col("tax"), body), "own_acres": first(F.col("acres"), body), "last_at": F.max("at"), **{k: F.max(k) for k in WOODS}}
    of_block = {"h": F.min(F.when(F.col("owned"), F.struct("at", *head))), "block_tax": first(F.col("tax")), "block_acres": first(F.col("acres"))}
    if not by_name:
        name, plain = F.col("clean.name"), F.col("plain")
        firm = F.contains(plain, F.lit("&")) & ~F.col("entity") & ~F.contains(plain, F.lit(",")) & plain.rlike("^[A-Z]") & ~plain.rlike(r"\d{5}$")
        of_block |= {"body_name": first(plain, mail & firm), "firm": first(name, mail & F.col("entity")), "person": first(name, mail & ~F.col("entity"))}
    found = {**of_span, **of_block, "mail_lines": listed(mail), "partners": listed(F.col("goes_on")), "homestead": F.max("homestead")}
    spans = lines.groupBy("doc_id", "block", "span").agg(*(v.alias(k) for k, v in found.items()))
    w = Window.partitionBy("doc_id", "block").orderBy("span")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.withColumns({
        **{k: F.min(k).over(whole) for k in of_block},
        "mail_lines": F.first("mail_lines").over(whole),
        "partners": F.flatten(F.collect_list("partners").over(whole)),
        "homestead": F.max("homestead").over(whole),
        "row_before": F.first("row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "last_at": F.max("last_at").over(whole),
        "near_tax": F.coalesce(F.lag("own_tax").over(w), F.col("own_tax"))["v"],
        "near_acres": F.coalesce(F.lag("own_acres").over(w), F.col("own_acres"))["v"],
        **{f"near_{k}": F.coalesce(F.col(k), F.lag(k).over(w)) for k in WOODS},
    })
    # Before a lot in front of the account stands nothing; all but the block's last line counts instead.
    return spans.withColumn("row_inner", F.min(F.when(F.col("row.at") < F.col("last_at"), F.col("row"))).over(whole))


def _with_account(spans: DataFrame, by_name: bool) -> DataFrame:
    """spans with what their block's header says: owner, mail, place, values."""
    named = lambda c, source: F.when(c.isNotNull(), F.struct(c.alias("name"), F.lit(source).alias("source")))
    header = named(F.col("h.clean.name"), "header")
    if by_name:
        whole = F.when(F.col("h.partner_head"), F.array_join(F.concat(F.array("h.name"), "partners"), " "))
        owner = F.coalesce(named(whole, "partnership"), header)
    else:
        owner = F.coalesce(named(F.coalesce("body_name.v", "firm.v"), "entity-line"), named(F.col("person.v"), "mail-line"), header)
    four = F.slice("h.told", F.greatest(F.size("h.told") - 3, F.lit(1)), F.lit(4))
    cell = lambda i: bare(F.get(four, F.lit(i) - F.when(F.size(four) < 4, 1).otherwise(0)))
    land = F.when(F.size(four) == 4, cell(0)).when(F.col("h.kind") == "land", bare(F.col("h.front")))
    values = F.struct(land.alias("land"), cell(1).alias("building"), cell(2).alias("exempt"), cell(3).alias("total"), bare(F.col("h.head_tax")).alias("tax"), F.lit("header").alias("source"))
    mail = F.nullif(F.concat_ws(", ", "h.head_mail", F.nullif(F.array_join("mail_lines", ", "), F.lit(""))), F.lit(""))
    out = spans.withColumns({"o": owner, "mail_text": mail, "header": F.when(F.col("h.told").isNotNull() & is_money(cell(3)), values), "head_lot": F.when(F.col("h.kind") == "lot", F.col("h.front"))})
    # Where the owner is a line below, the header names the place.
    return out.withColumn("situs", F.when(F.lit(not by_name) & F.coalesce(F.col("o.source") != "header", F.lit(True)), F.col("h.name")))


def _chosen(spans: DataFrame) -> DataFrame:
    """The lots of each block, one row each, with `lots`, how many it has: those that acres are bound to and one that opens the block; where no acres are bound, all of one sheet, or of several sheets the first."""
    # A lot in front of the account has span 0.
    raw = F.when(F.col("span") == 0, F.col("head_lot")).otherwise(F.col("lot.lot"))
    each = spans.where(raw.isNotNull()).select("*", F.posexplode(expand_lots(raw)).alias("piece", "lot_raw")).withColumn("code", normalize_lot(F.col("lot_raw"))).where("code is not null")
    block = Window.partitionBy("doc_id", "block")
    bound = F.coalesce(F.col("lot.bound"), F.lit(False)) & (F.col("span") > 0)
    opens = (F.col("span") == 1) & F.coalesce(F.col("lot.first_body"), F.lit(False))
    sheet = F.get(F.split("code", "-"), F.lit(0))
    each = each.withColumns({"bound": bound, "many": F.count(F.lit(1)).over(block) > 1, "any_bound": F.max(bound).over(block), "sheets": F.min(sheet).over(block) != F.max(sheet).over(block), "turn": F.row_number().over(block.orderBy("span", "piece"))})
    kept = F.when(~F.col("many"), True).when(F.col("any_bound"), F.col("bound") | opens).when(F.col("sheets"), F.col("turn") == 1).otherwise(True)
    once = F.row_number().over(Window.partitionBy("doc_id", "block", "code").orderBy(F.desc("bound"), "turn"))
    return each.where(kept).withColumn("again", once).where(~F.col("any_bound") | (F.col("again") == 1) | ~F.col("many")).withColumn("lots", F.count(F.lit(1)).over(block))


def _values() -> Column:
    """Of a lot: the header's if it is the block's only one; a row of figures in its span, or before it; figures one below the other, or the land value in the header's name, unless the header has a total."""
    nothing = F.lit(None).cast("string")
    of = lambda land, building, exempt, total, tax, source: F.struct(land.alias("land"), building.alias("building"), exempt.alias("exempt"), total.alias("total"), tax.alias("tax"), F.lit(source).alias("source"))
    row = F.coalesce("row", F.when(F.col("span") == 0, F.col("row_inner")).otherwise(F.col("row_before")))
    figures = F.array_distinct(F.flatten(F.transform("large", lambda x: x["amounts"])))
    one, two, three = (F.get(figures, F.lit(i)) for i in range(3))
    both = F.coalesce(three, (one.cast("long") + two.cast("long")).cast("string"))
    zero = F.lit("0")
    return F.coalesce(
        F.when(F.col("lots") == 1, F.col("header")),
        F.when(row.isNotNull(), of(row["land"], row["building"], row["exempt"], row["total"], row["tax"], "row")),
        F.when(F.col("header").isNull() & F.col("alone").isNotNull(), of(nothing, nothing, zero, F.col("alone.total"), nothing, "assessment_only")),
        F.when(F.col("header").isNull() & two.isNotNull() & ~both.rlike(_ZIP), of(one, two, zero, both, nothing, "columnar")),
        F.when(F.col("header").isNull() & one.isNotNull() & two.isNull() & ~one.rlike(_ZIP), of(one, zero, zero, one, nothing, "columnar_single")),
        F.when(is_money(F.col("h.tail")), of(F.col("h.tail"), zero, zero, F.col("h.tail"), nothing, "land_tail")),
    )


def parse_commitment_book(docs: DataFrame, layout: str = "by_name") -> DataFrame:
    """One row per lot of each account of documents (doc_id, text): account, owner, where it stood, mail, place, values and where they stood, tax, acres, forest lines, lot and confidence.

    layout: "by_name", headers with the owner, or "map_lot", headers with the place, the owner in the lines below. A total
    that looks like a zip leaves a lot without values. Of rows with one lot the surest stays, of equals the first. Null and
    empty texts have no rows."""
    by_name = layout == "by_name"
    # A fixed number of partitions: books are small in bytes next to the work that their lines make.
    docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line != ''").withColumn("chrome", is_chrome(F.col("line")))
    lines = _with_spans(_signed(_blocks(_headers(lines, by_name).withColumn("is_lot", F.col("line").rlike(_LOT) & ~F.col("owned")))))
    lots = _chosen(_with_account(_spans(lines, by_name), by_name)).withColumn("v", _values())
    sound_total = ~F.coalesce(F.col("v.total").rlike(_ZIP), F.lit(False))
    value = lambda c: F.when(sound_total, F.col(f"v.{c}")).alias(c)
    full = lots.select(
        "doc_id", "block", "span", "piece", F.col("h.account").alias("account"), F.col("o.name").alias("owner"), F.col("o.source").alias("owner_source"), F.col("mail_text").alias("mail"), "situs",
        value("land"), value("building"), exemption(F.col("v.exempt")).alias("exemption"), value("total"), F.col("v.source").alias("value_source"),
        bare(F.coalesce("v.tax", "near_tax", "h.head_tax", "block_tax.v")).alias("tax"), bare(F.coalesce("near_acres", "block_acres.v")).alias("acres"), "homestead",
        F.struct(*(F.col(f"near_{k}.{c}").alias(f"{k}_{c}") for k in WOODS for c in ("acres", "value"))).alias("forest"), F.col("code").alias("lot"),
    )
    level = F.when(F.lit(by_name), SURE).when(F.col("owner_source") == "header", FROM_HEADER).when(F.col("owner_source") == "mail-line", FROM_MAIL).otherwise(FROM_ENTITY)
    sound = assessment_consistent(F.col("land"), F.col("building"), F.col("total"))
    sure = F.when(F.col("owner").isNull() & F.col("total").isNull(), NOTHING).when(F.col("owner").isNull() | ~F.coalesce(is_money(F.col("total")), F.lit(False)), IN_PART).otherwise(F.greatest(F.lit(NOTHING), level - F.when(sound, 0.0).otherwise(ODD)))
    best = F.row_number().over(Window.partitionBy("doc_id", "lot").orderBy(F.desc("confidence"), "block", "span", "piece"))
    return full.withColumn("confidence", F.round(sure, 4)).withColumn("best", best).where("best = 1").drop("best", "block", "span", "piece")
