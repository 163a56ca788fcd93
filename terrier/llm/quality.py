"""Quality classifier: a weak-label model.

Heuristic labellers vote on each document: good, bad, or no vote. Expectation-maximisation over the counts of all vote
patterns estimates how each labeller votes on good and on bad documents; the posterior of a pattern labels the documents
that show it. There are two such models, of form and of abuse, and a document is to be rejected if either says so. The
posterior labels of a bounded sample train a linear scorer on hashed features, which then judges every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import row_key, written
from terrier.llm.mixing import unit_hash

#: Documents that the scorer is trained on, about, at most.
SAMPLE = 20_000
FEATURES = 1 << 14
THRESHOLD = 0.5
NONE, GOOD, BAD = 0, 1, 2

#: Function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    (
        "the of and to in is it that was for on with as be at by this are from or an he she not but they have had has you we which their "
        "le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce il elle ne se son sa "
        "der die das und von zu den dem mit auf ist im ein eine nicht sich auch als war ich "
        "el los las del y con por su lo como al no más o"
    ).split()
)
#: Common English terms of abuse of persons.
ABUSE = frozenset("idiot idiots idiotic moron morons moronic stupid dumb imbecile cretin fool fools loser losers scum scumbag trash garbage filth filthy worthless pathetic disgusting clown clowns pig pigs rat rats vermin bastard bastards bitch slut whore asshole jerk creep freak retard retarded subhuman degenerate parasite".split())

_WORD = re.compile(r"[^\W\d_]+")
_STRIP = ".,;:!?\"'()[]#$%&*|"
FORM = ("symbols", "bars", "capitals", "one_word", "variety", "stop_words", "word_length", "lines", "shouting")


def measures(text: str) -> dict[str, float]:
    words = text.split()
    n = max(1, len(words))
    bare = [w.strip(_STRIP).lower() for w in words]
    counts = Counter(bare)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = _WORD.findall(text)
    letters = sum(map(len, runs))
    capitals = sum(len(x) for x in re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))
    signs = len(re.findall(r"[#$%&*|!^~=<>{}\\@+]", text))
    abuse = Counter(filter(ABUSE.__contains__, map(str.lower, runs)))
    return {
        "words": len(words), "symbols": signs / max(1, len(text)), "bars": text.count("|") / n, "capitals": capitals / max(1, letters),
        "one_word": counts.most_common(1)[0][1] / n if words else 0.0, "variety": len(counts) / n, "stop_words": sum(w.rstrip(".,").lower() in STOP_WORDS for w in words) / n,
        "word_length": sum(map(len, bare)) / n, "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0, "shouting": text.count("!") / n,
        "abuse": sum(abuse.values()), "abuse_distinct": len(abuse), "abuse_words": abuse,
    }


def votes(m: dict) -> tuple[list[int], list[int]]:
    """The votes of the labellers of form and of abuse. Most look for one kind of fault and cast no vote where they don't find it; the last two of form find merits."""
    n, bad, good = m["words"], lambda x: BAD if x else NONE, lambda x: GOOD if x else NONE
    enough = n >= 20
    form = [
        bad(m["symbols"] > 0.04),
        bad(m["bars"] > 0.1),
        bad(m["capitals"] > 0.4 and n >= 5),
        bad(enough and m["one_word"] > 0.25),
        bad(enough and m["variety"] < min(0.35, 6 / math.log(n + 3) ** 2)),
        bad(enough and not 2.5 < m["word_length"] < 12),
        bad(m["lines"] > 0.6),
        bad(m["shouting"] > 0.3 and n >= 5),
        good(m["stop_words"] > 0.08),
        good(m["variety"] > 0.5),
    ]
    abusive = [bad(m["abuse"] > 0), bad(m["abuse"] > 1), bad(m["abuse_distinct"] > 1), bad(m["abuse"] * 200 > n), good(m["abuse"] == 0)]
    return form, abusive


def features(m: dict) -> dict[int, float]:
    """Hashed features: the bin of each measure, and each term of abuse."""
    names = ["bias"]
    for k in (*FORM, "words"):
        value = m[k]
        step = 0 if value <= 0 else 1 + min(40, int(math.log2(1 + value * 64) * 3))
        names += [f"{k}:{step}", f"{k}>{step // 4}"]
    names += [f"abuse:{w}" for w in m["abuse_words"]] + [f"abuse:{min(3, m['abuse'])}"]
    out: dict[int, float] = {}
    for name in names:
        i = zlib.crc32(name.encode()) % FEATURES
        out[i] = out.get(i, 0.0) + 1.0
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation with two classes: the posterior probability of bad for each pattern of votes (one row each). A labeller casts each vote, or none, with a rate of its own on either class. Begins with a pattern being bad if any labeller says so; pseudo-documents, more of them for votes that agree with the class, keep all rates off 0 and 1."""
    any_bad = (patterns == BAD).any(axis=1)
    p = np.where(any_bad, 0.95, 0.02)
    for _ in range(rounds):
        prior = (counts @ p + 1) / (counts.sum() + 2)
        logs = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(patterns.shape[1]):
            for v in (NONE, GOOD, BAD):
                at = patterns[:, j] == v
                if at.any():
                    on_bad = ((counts * p)[at].sum() + (1 if v == BAD else 0.5)) / (counts @ p + 2)
                    on_good = ((counts * (1 - p))[at].sum() + (0.02 if v == BAD else 1)) / (counts @ (1 - p) + 2.02)
                    logs[at] += np.log(on_bad / on_good)
        p = 1 / (1 + np.exp(-np.clip(logs, -40, 40)))
    return p


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for body in batch.column("body"):
            form, abusive = votes(measures(body.as_py()))
            made.append(("".join(map(str, form)), "".join(map(str, abusive))))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made]), pa.array([b for _, b in made])], ["form", "abusive"])


def _examples(posterior: dict[str, dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column("body"):
                m = measures(body.as_py())
                form, abusive = ("".join(map(str, v)) for v in votes(m))
                f = features(m)
                rows.append((list(f), list(f.values()), 1 - (1 - posterior["form"].get(form, 0.0)) * (1 - posterior["abusive"].get(abusive, 0.0))))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.list_(pa.float64())), pa.array(columns[2], pa.float64())], ["at", "x", "y"])

    return run


def train(at: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch adaptive gradients."""
    w, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(y)), -30, 30)))
        slope = np.bincount(at, (p - y)[row] * x, FEATURES) / max(1, len(y)) + decay * w
        squares += slope**2
        w -= 0.5 * slope / np.sqrt(squares)
    return w


def _judge(weights: np.ndarray, posterior: dict[str, dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, labels = [], []
            for body in batch.column("body"):
                m = measures(body.as_py())
                form, abusive = ("".join(map(str, v)) for v in votes(m))
                labels.append(1 - (1 - posterior["form"].get(form, 0.0)) * (1 - posterior["abusive"].get(abusive, 0.0)))
                z = sum(weights[i] * v for i, v in features(m).items())
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if m["words"] else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), batch.column("null_id"), pa.array(scores, pa.float64()), pa.array(labels, pa.float64())], ["k_id", "k_text", "null_id", "score", "posterior"])

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: k_id, k_text (see row_key), null_id, score (the scorer's probability that the document is to be rejected), posterior (the weak-label model's) and kept.

    A text without words, null or empty, has score 1. Labellers see whole texts; patterns of votes are counted over all
    documents; at most 3 to the power of the labellers' number, they reach the driver as counts. An empty table gives an
    empty one."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*row_key(F.col(id_col), body), F.col(id_col).isNull().alias("null_id"), body.alias("body"))
    counts = texts.select("body").mapInArrow(_patterns, "form string, abusive string").groupBy("form", "abusive").agg(F.count("*").alias("n")).collect()
    posterior: dict[str, dict[str, float]] = {}
    for kind in ("form", "abusive"):
        tally: Counter[str] = Counter()
        for r in counts:
            tally[r[kind]] += r["n"]
        keys = sorted(tally)
        p = estimate(np.array([[int(c) for c in k] for k in keys]), np.array([tally[k] for k in keys], float)) if keys else []
        posterior[kind] = dict(zip(keys, map(float, p), strict=True))
    total = sum(r["n"] for r in counts)
    chosen = texts.where(unit_hash(F.col("k_id"), "quality") < sample / max(total, 1))
    rows = chosen.select("body").mapInArrow(_examples(posterior), "at array<int>, x array<double>, y double").toArrow()
    lengths = np.array([len(v) for v in rows["at"].to_pylist()], np.int64)
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    weights = train(flat("at"), flat("x"), np.repeat(np.arange(len(lengths)), lengths), rows["y"].to_numpy()) if len(lengths) else np.zeros(FEATURES)
    out = texts.mapInArrow(_judge(weights, posterior), "k_id long, k_text long, null_id boolean, score double, posterior double")
    return out.withColumn("kept", F.col("score") < threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that judge() rejects."""
    judged = written(judge(docs, id_col, text_col, **how).where("not kept").select("k_id", "k_text").distinct(), "rejected")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k_id, k_text = row_key(F.col(id_col), body)
    return docs.join(judged, (k_id == judged.k_id) & (k_text == judged.k_text), "left_anti")
