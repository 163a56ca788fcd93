"""Secret scans by corpus-wide ownership frequency, with DataFrame operations only.

Patterns find candidate values. Over the corpus, each value's digest is counted by distinct repositories (documents) and
distinct owners (sources): a value that several owners or many repositories have is a widely copied example; one that a
single owner has in few repositories and that looks random is a live-looking credential. Each candidate gets a span of its value under one of those two kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import row_key, written

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A match is a whole run, so a bound on its length in the pattern finds the same spans as one checked afterwards.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Kinds of base spans in their order, then those that the ownership counts add.
KINDS = ("assign", "access", "hex", "copied", "live")
MIN_VALUE = 8
#: From so many owners on, or so many repositories within one owner, a value counts as a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 2, 10
#: A live-looking value has so many characters, and so many distinct ones, at least.
LIVE_LENGTH, LIVE_DISTINCT = 16, 8


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Structs of kind, start, end (code points) and the match, leftmost first. Between matches lies what split() returns."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        stop = start + F.length(pair["match"])
        return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), pair["match"].alias("match")))).alias("spans"))

    none = F.expr("cast(array() as array<struct<kind:int,start:int,stop:int,match:string>>)")
    pairs = F.transform(found, lambda m, i: F.struct(m.alias("match"), F.get(gaps, i).alias("gap")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def candidate_spans(text: Column) -> Column:
    """All base spans of a text (null: none), structs of kind (place in KINDS), start, stop, value."""
    value = lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["match"], ASSIGN, 2)).otherwise(s["match"])
    assign = F.filter(_matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_VALUE)
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS, 1)).otherwise(F.expr("cast(array() as array<struct<kind:int,start:int,stop:int,match:string>>)"))
    spans = F.concat(assign, access, _matches(text, HEX, 2))
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), value(s).alias("value")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per row of docs: the id (bigint), spans, an array of structs (start, kind, stop) in order of start, kind
    and stop, kind a place in KINDS, candidates, the number of base spans, and spread, an array of structs (start, stop,
    owners, repositories) with the counts of each candidate's value.

    A null text has no spans; a null owner is an owner of its own; copies of a row count as one repository. Base spans
    are never dropped. Only the values that patterns find are shuffled, distinct owners and repositories by partial
    sums. An empty table gives an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(*row_key(F.col(id_col), text), F.col(id_col).isNull().alias("null_id"), F.coalesce(F.concat(F.lit("s"), F.col(owner_col).cast("string")), F.lit("n")).alias("owner"), candidate_spans(text).alias("spans"))
    found = written(found.withColumn("spans", F.transform("spans", lambda s: s.withField("digest", F.sha2(s["value"], 256)).withField("random", (F.length(s["value"]) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(s["value"], ""))) >= LIVE_DISTINCT) & s["value"].rlike("[0-9]")).withField("length", F.length(s["value"])).dropFields("value"))), "candidates")

    each = found.where(F.size("spans") > 0).select("k_id", "k_text", "owner", F.explode("spans").alias("span")).select("k_id", "k_text", "owner", "span.*")
    owners = each.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("owners"))
    repositories = each.select("digest", "k_id").distinct().groupBy("digest").agg(F.count("*").alias("repositories"))
    spread = owners.join(repositories, "digest")
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    live = ~copied & F.col("random")
    place = (F.col("stop") - F.col("length")).alias("start")
    added = each.join(spread, "digest").select("k_id", "k_text", F.struct(place, "stop", "owners", "repositories").alias("counts"), F.struct(place, F.when(copied, KINDS.index("copied")).when(live, KINDS.index("live")).alias("kind"), F.col("stop").alias("stop")).alias("extra"))
    per_row = added.groupBy("k_id", "k_text").agg(F.collect_set(F.when(F.col("extra.kind").isNotNull(), F.col("extra"))).alias("extra"), F.collect_set("counts").alias("spread"))  # bounded by the matches in one text
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    out = found.join(per_row, ["k_id", "k_text"], "left")
    spans = F.array_sort(F.concat(base, F.coalesce("extra", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)"))))
    return out.select(F.when(~F.col("null_id"), F.col("k_id")).alias(id_col), spans.alias("spans"), F.size("spans").alias("candidates"), F.array_sort(F.coalesce("spread", F.expr("cast(array() as array<struct<start:int,stop:int,owners:bigint,repositories:bigint>>)"))).alias("spread"))


def span_text(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, joined by commas."""
    kept = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
