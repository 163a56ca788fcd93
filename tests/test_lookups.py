"""Lookups, write-backs, replaced partitions, inventories, and names that may be similar."""

import random

import pytest
from pyspark.sql import functions as F

from terrier.functions import names
from terrier.operators import linkage, lookup, ownership
from terrier.sources import inventory, replace


def test_lookup_with_fallbacks(spark):
    parcels = spark.createDataFrame([("a", "m", "x", "s1", None, "g"), ("b", None, "m", "s2", "s1", None), ("c", "m", None, None, None, "s2"), ("d", "m", "m", "s1", "zz", "s1")], "parcel_id string, municipality_id string, tax_municipality_id string, source_id string, tax_source_id string, geometry_source_id string")
    towns = spark.createDataFrame([("m", "Elm"), ("m", "Oak")], "id string, name string")
    tax, other = (spark.createDataFrame(r, "id string, name string") for r in ([("s1", "Book")], [("s1", "Old"), ("s2", "Map")]))
    got = {r.parcel_id: (r.municipality_name, r.tax_municipality_name, r.tax_source and tuple(r.tax_source), tuple(r.geometry_source)) for r in lookup.enriched(parcels, towns, tax, other).collect()}
    assert got == {"a": ("Elm", None, ("s1", "Book"), ("g", None)), "b": (None, "Elm", ("s1", "Book"), (lookup.GEOMETRY_SOURCE, None)), "c": ("Elm", None, None, ("s2", "Map")), "d": ("Elm", "Elm", None, ("s1", "Book"))}
    rows = spark.createDataFrame([("a", 2, "later"), ("a", 1, "first"), ("b", 1, "b"), (None, 1, "none")], "id string, n int, v string")
    asked = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "id string")
    assert [r.v for r in lookup.by_id(rows, asked, "id", "n").collect()] == ["first"]
    dates = lambda *rows: spark.createDataFrame(list(rows), "source_id string, as_of string")
    out = lookup.as_of(dates(("p", None), ("q", None), ("r", None)).select("source_id"), "1970", dates(("p", "1"), ("q", None)), dates(("p", "2"), ("q", "3")))
    assert {r.source_id: r.as_of for r in out.collect()} == {"p": "1", "q": "3", "r": "1970"}


def test_the_last_match_is_written_back(spark):
    tax = spark.createDataFrame([(1, "old"), (2, "old"), (3, None)], "tax_id long, geometry_id string")
    matches = spark.createDataFrame([(1, "g1", 1), (1, "g2", 5), (1, "g3", 3), (3, "g4", 1), (None, "g5", 9), (8, "g6", 1)], "tax_id long, geometry_id string, ordinal int")
    assert {r.tax_id: r.geometry_id for r in linkage.write_back(tax, matches).collect()} == {1: "g2", 2: None, 3: "g4"}
    manifest = {r.town: tuple(r)[1:] for r in linkage.coverage_manifest(spark.createDataFrame([("x", True), ("x", None), (None, False)], "town string, ok boolean"), "town", ok=F.col("ok")).collect()}
    assert manifest == {"x": (2, 1, 0.5), "_none": (1, 0, 0.0), "*": (3, 1, pytest.approx(1 / 3, abs=1e-6))}


def test_a_partition_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, town string").write.partitionBy("town").parquet(path)
    read = lambda: sorted(map(tuple, spark.read.parquet(path).collect()))
    new = spark.createDataFrame([(7, "b"), (8, "b")], "v int, town string")
    for _ in range(2):
        replace.replace_partition(new, path, "town", "b")
        assert read() == [(1, "a"), (7, "b"), (8, "b")]
    replace.replace_partition(new, path, "town", "c")
    assert len(read()) == 5
    fails = new.withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        replace.replace_partition(fails, path, "town", "b")
    assert len(read()) == 5 and sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith((".", "_SUCCESS"))) == ["town=a", "town=b", "town=c"]


def test_inventory_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_bytes("é\f".encode() * 60)
    (tmp_path / "in/b.txt").write_bytes(b"  x")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(b"\0" * 5)
    files = inventory.read_files(spark, str(tmp_path), "*.txt")
    sizes = files.select("doc_id", "bytes")
    assert sorted(r.bytes for r in sizes.collect()) == [3, 180]
    assert "content" not in sizes._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    docs = files.select("doc_id", F.decode("content", "UTF-8").alias("text")).unionByName(spark.createDataFrame([("n", None), ("s", " " * 500)], "doc_id string, text string"))
    got = {r.doc_id.rpartition("/")[2]: (r.bytes, r.pages, r.chars, r.text_present) for r in inventory.inspect(docs).collect()}
    assert got == {"a.txt": (180, 61, 119, True), "b.txt": (3, 1, 1, False), "n": (0, 0, 0, False), "s": (500, 1, 0, False)}


def test_pairs_that_are_ruled_out_are_not_similar(spark):
    r = random.Random(4)
    words = ["DOE", "ROE", "SMITH", "SMYTHE", "ANN", "ANNA", "JOHN", "JON", "LLC", "ELM", "A", "BB"]
    some = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(90)]
    pairs = [(a, b) for a in some for b in some[:40]]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(2)
    rows = df.select(names.can_reach(F.col("a"), F.col("b"), 0.92).alias("may"), names.jaro_winkler(F.col("a"), F.col("b")).alias("score")).collect()
    assert all(x.may for x in rows if x.score >= 0.92) and sum(x.may for x in rows) < len(rows) / 2
    flagged = df.where("a < b").distinct().select("a", "b", F.lit(True).alias("same_town"), F.lit(False).alias("same_mail"), F.lit(False).alias("adjacent"))
    got = {(x.a, x.b) for x in ownership.similar_edges(flagged).collect()}
    sort = lambda t: " ".join(sorted(t.split()))

    def score(a, b):
        j, p = names.jaro_of(a, b), next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        return j + p * 0.1 * (1 - j)

    assert got == {(a, b) for a, b in pairs if a < b and score(sort(a), sort(b)) >= 0.92}
