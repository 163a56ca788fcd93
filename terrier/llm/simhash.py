"""SimHash near-dedup: meet-in-the-middle ball hashing.

Two fingerprints within the radius r have a common neighbour within r/2 of both. So each distinct fingerprint emits all
its variants within r/2 bits, and fingerprints that meet on a variant are at most r apart. Copies fold into one
fingerprint beforehand; a variant is met by at most as many fingerprints as it has variants itself, so no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import row_key, written
from terrier.operators.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of the words of a text, A-Z lower-cased: bit i is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    join = b" ".join
    return majority(np.array([xxh64_intdigest(join(s), seed) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column("body")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), batch.column("null_id"), pa.array(prints)], ["k_id", "k_text", "null_id", "print"])

    return run


def link_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (print): distinct fingerprints. Returns links (print, least) that connect just what all links within the radius connect: on each variant, every fingerprint is linked to the least one that meets there, which is within the radius of it."""
    if radius % 2:
        raise ValueError("the radius must be even, so that its half is whole")
    masks = [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k)]
    signed = np.array([0, *masks], np.uint64).view(np.int64).tolist()
    variants = prints.select("print", F.explode(F.array(*[F.col("print").bitwiseXOR(F.lit(m)) for m in signed])).alias("variant"))
    met = variants.withColumn("least", F.min("print").over(Window.partitionBy("variant"))).where("print != least")
    pairs = met.select("print", "least").distinct()
    return pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("least"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: k_id, k_text (see row_key), null_id, print (bigint), root (struct of null_id, and the smallest k_id and k_text in its component).

    Null and empty texts have print 0, which is linked like any other; a row without an id is a root only where no row of its component has one. Components are
    those of the links between fingerprints that differ in at most `radius` bits. An empty table gives an empty one."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*row_key(F.col(id_col), body), F.col(id_col).isNull().alias("null_id"), body.cast("binary").alias("body"))
    rows = written(texts.mapInArrow(_fingerprints(shingle), "k_id long, k_text long, null_id boolean, print long"), "prints")
    prints = rows.groupBy("print").agg(F.min(F.struct("null_id", "k_id", "k_text")).alias("root"))
    labels = connected_components(link_prints(prints.select("print"), radius), "print", "least").withColumnRenamed("node", "print")
    labelled = prints.join(labels, "print", "left").withColumn("component", F.coalesce("component", "print"))
    roots = labelled.groupBy("component").agg(F.min("root").alias("root"))
    of_print = labelled.select("print", "component").join(roots, "component").select("print", "root")
    return rows.join(of_print, "print")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that are near copies of another: of each component the row with the smallest id stays. Rows that agree in id and text are one document and stay together."""
    rows = near_duplicates(docs, id_col, text_col, **how)
    gone = rows.where("k_id != root.k_id or k_text != root.k_text").select("k_id", "k_text").distinct()
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k_id, k_text = row_key(F.col(id_col), body)
    return docs.join(gone, (k_id == gone.k_id) & (k_text == gone.k_text), "left_anti")
