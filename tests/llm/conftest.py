import random

import pytest

SCHEMA = "doc_id long, text string, source string, body string, k_id long, k_text string, rate double, spans string, SIZE int"


def make(spark, rows):
    """Documents from (id, text, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "b", 1, "k", 0.5, "s", 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages, other letters and signs."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["é́", "İx", "ſ", "don't", "A", "B", "<|endoftext|>", "ÄÖ", "x" * 300]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    out = [(i, text(r.randint(0, 120)), f"s{i % 3}") for i in range(40)]
    out += [(100 + i, f"{text(20)} {passage}\n{text(15)}", "hot") for i in range(25)]
    base = text(200)
    out += [(200 + i, base if i % 2 else base.upper().lower(), None) for i in range(10)]
    out += [(300 + i, base.replace("w17", f"v{i}", 1), "s1") for i in range(5)]
    out += [(400, None, None), (401, "", "s2"), (402, "  \t\n ", "s2"), (403, "ONE", "s0"), (404, "one", "s0"), (405, text(9000), "s0"), (406, "ab " * 500, "s1")]
    out += [(500, "row that repeats " * 20, "s1")] * 3 + [(None, "no id", "s1"), (None, text(50), "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
