"""The manifest, the address filter and the ranked search against brute force, on rows with all that is odd about rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.llm import merkle, ranked_search, url_filter
from terrier.llm import queries as registered
from tests.test_queries import ordered

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_log", "op12_url_automaton", "op13_best_position"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registered.QUERIES[name](spark, SF)
    result = con.execute(registered.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(result.fetchall(), columns)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves):
    """Levels from the leaves to the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    """Siblings of a leaf, level by level: (is it on the left, digest or nothing)."""
    out = []
    for nodes in levels[:-1]:
        out.append((bool(i & 1), nodes[i ^ 1] if i ^ 1 < len(nodes) else ""))
        i >>= 1
    return out


def fold(node, steps):
    for left, sibling in steps:
        node = H(sibling, node) if left else H(node, sibling)
    return node


def manifest_rows(rows, change):
    """Brute force: rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names]
    top = tree([t[-1][0] for t in trees])
    for k, (name, levels) in enumerate(zip(names, trees)):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            steps = way(levels, i) + way(top, k)
            root = fold(leaf_of(*change(r)), steps)
            yield r[0], leaf, levels[-1][0], top[-1][0], H(*(s for _, s in steps)), root, root == top[-1][0]


def manifest_docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx int, TREE string").repartition(3)


def document(i, r):
    return (i, r.choice(["a", "b", None]), r.choice(["en", "de", "é", None, "zz"]), r.choice([None, i]), r.choice([None, "", "té" * (i % 5), f"text {i}"]))


@pytest.mark.parametrize("span", [1, 2, 10])
def test_manifest(spark, span):
    r = random.Random(span)
    rows = [document(i, r) for i in range(90)]
    rows += [(500, "hot", "en", 3, "same row")] * 40 + [(None, None, None, None, None)] * 2 + [(501, None, "en", 1, "a"), (501, None, "en", 1, "b"), (502, "s", "only one", 1, "long " * 50000)]
    change = lambda x: x if x[0] is None or x[3] is None or zlib.crc32(str(x[0]).encode()) % 7 else (*x[:3], x[3] + 1, x[4])
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(manifest_docs(spark, rows), span=span, tampered={"n_chars": altered}).withColumn("proof", merkle.siblings_digest(F.col("path")))
    got = Counter(tuple(x) for x in out.select("id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect())
    assert got == Counter(manifest_rows(rows, change))
    assert any(not x[-1] for x in got) and any(x[-1] for x in got)


def test_manifest_edges(spark):
    assert merkle.manifest(manifest_docs(spark, [])).count() == 0
    (one,) = merkle.manifest(manifest_docs(spark, [(1, "s", "en", 2, "t")])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf_of(1, "s", "en", 2, "t") and one.verified and one.path == ""


def test_postorder_log(spark):
    """The log of all segments is that of one builder which appends each node when it is complete, and positions need no look at it."""
    for n in (1, 2, 3, 7, 8, 13, 64, 100):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        log = merkle.append_log(leaves, merkle.height(n))
        levels = tree([x.hex() for x in leaves])
        assert len(log) == sum(map(len, levels))
        for h, nodes in enumerate(levels):
            assert len(nodes) == merkle.nodes_at(h, n)
            for i, node in enumerate(nodes):
                at = merkle.position(h, i, n)
                assert log[at].hex() == node
                if h:
                    assert merkle.position(h - 1, min(2 * i + 1, len(levels[h - 1]) - 1), n) == at - 1
                    if 2 * i + 1 < len(levels[h - 1]):
                        assert merkle.position(h - 1, 2 * i, n) == at - 1 - merkle.subtree_size(h - 1, 2 * i + 1, n)
        if n in (7, 64, 100):
            df = spark.createDataFrame([("t", i, n, x.hex()) for i, x in enumerate(leaves)], "tree string, idx long, n long, digest string")
            rows = sorted((r.position, r.digest) for r in merkle.log_rows(merkle.build(df, 2), 2).collect())
            assert rows == [(i, x.hex()) for i, x in enumerate(log)]


def glob_regex(glob):
    return re.compile("".join({"*": "[^/?]*", "**": ".*"}.get(p) or re.escape(p) for p in re.split(r"(\*+)", glob)), re.S)


def test_automaton_runs_all_globs_at_once():
    r = random.Random(3)
    letters = "ab/?."
    globs = ["".join(r.choice([*letters, "*", "**", "b"]) for _ in range(r.randint(0, 7))) for _ in range(150)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs] + ["x" * 200, "", "*", "**", "é*/ü", "x" * 63 + "**", "y" * 62 + "/*"]
    urls = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(300)]
    urls += ["x" * 200, "x" * 199, "éa/ü", "éa?/ü", "x" * 64, "y" * 62 + "/z", "", "ab" * 3000]
    automaton = url_filter.compile_globs(globs)
    assert automaton.start.shape[0] > 3
    got = url_filter.run_all(automaton, [u.encode() for u in urls])
    want = np.array([[bool(glob_regex(g).fullmatch(u)) for g in globs] for u in urls])
    assert (got == want).all()
    assert url_filter.run_all(automaton, []).shape == (0, len(globs))


def judged(url):
    rest = url.split("://", 1)[1].split("#", 1)[0] if url and "://" in url else ""
    host, path, query = re.fullmatch(r"(?s)([^/?]*)([^?]*)(.*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), v, r) for v, r in url_filter.HOST_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        return host, path, *max(fits)[:0:-1]
    globs = [(len(g.replace("*", "")), v == "block", v) for v, g in url_filter.GLOB_RULES if glob_regex(g).fullmatch(host + path + query)]
    return host, path, None, max(globs)[2] if globs else "allow"


def test_url_filter(spark):
    urls = ["http://example.com/en/1", "https://WWW.Example.COM/en/x?y#z", "http://a.www.example.com/en/", "http://m.example.com/de/", "http://com/", "http://com", "http://xcom/", "http://.com/", "http://evil.org/x.example.com/en/",
            "http://net/es/", "http://x.net/es", "http://x.net/es/?a", "http://x.net?/es/", "http://x.net#/es/", "http://x.net/fr/é", "http://x.net:80/fr/", "no scheme", "a://b://c.com/", "", None, "://", "x://", "http://x.net/EN/",
            "http://o.org/a.zip", "http://o.org/a.zip?", "http://o.org/robots.txt", "http://o.org/x/robots.txt", "http://o.org/?sessionid=4", "http://o.org/sessionid=4", "http://o.org/cart/1", "http://o.org/login", "http://o.org/a\nb/login", "http://ÉA.org/İ", "http://b.com/" + "é/" * 20000, "http://x.net/es/" + "q" * 30000]
    urls += urls[:5]
    pages = spark.createDataFrame([(i, u, "<p>", "h", "r") for i, u in enumerate(urls)] + [(None, urls[0], None, "h", "r")], "page_id long, url string, html string, host string, RULE string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages).collect()}
    assert got == {**{i: judged(u) for i, u in enumerate(urls)}, None: judged(urls[0])}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    mine = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, (("block", "com/"), ("allow", "com/")), (), "block").collect()}
    assert mine[0] == ("com/", "block") and mine[9] == (None, "block")
    assert {r.verdict for r in url_filter.filter_urls(pages, (), (("allow", "**"),), "block").collect()} == {"allow"}


def ranked(docs, items, top):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split = [(i, find(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(find(t))
    out = set()
    for item, ts in asked.items():
        found = []
        for i, w in split:
            tf, m = Counter(w), 50 + 50 * len(w) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in ts if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out |= {(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])}
    return out


def search_case():
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(words[min(int(r.expovariate(0.08)), 59)] for _ in range(n))
    docs = [(i, pick(r.randint(0, 60))) for i in range(200)]
    docs += [(300, "W1-w2_W3 w1"), (301, "w1 w2 w3 w1"), (299, "w1\x00w2\x7fw3 w1"), (302, None), (303, ""), (304, "!?\n"), (None, "w1 w2 w3 w1"), (305, "É é ſ " + "q" * 90), (306, "x" * 64), (307, pick(20000)), (2**63 - 1, "w1 w2 w3 w1")]
    docs += [(400, "w59 w58 w57")] * 7
    items = [(1, pick(12)), (2, "w1 w2 w3"), (3, "É ſ " + "Q" * 90), (4, None), (5, "nowhere"), (6, ""), (2, "w3 w40"), (None, "w5 w6"), (7, "w59"), (8, "x" * 64), (9, pick(300))]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"top": 3, "chunk": 60}, {"top": 500}, {"pairs": 20, "chunk": 700}])
def test_ranked_search(spark, how):
    docs, items = search_case()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, NUMBERS string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = ranked_search.search(frame, asked, **how).collect()
    got = {tuple(r) for r in rows}
    assert got == ranked(docs, items, how.get("top", 50))


def test_ranked_search_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.limit(0), items).count() == 0


def test_search_stops_at_best_positions():
    """Where few documents hold all of an item's terms, most of the lists is never read."""
    r = np.random.default_rng(2)
    n, k = 20000, 8
    held = r.random((n, k)) < 0.3
    held[:60] = True
    counts = np.where(held, r.integers(1, 3, (n, k)), 0)
    counts[:60] = 40
    begins = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    lists = ranked_search.Lists(list(range(n)), np.full(n, 100), begins, np.nonzero(held)[1].astype(np.int32), counts[held].astype(np.int64), n, 100 * n, k)
    best, slots = [], np.full(k, -1, np.int32)
    looked = ranked_search.best_positions(lists, np.arange(k), np.full(k, 900), best, 50, slots)
    assert sorted(-d for _, d in best) == list(range(50)) and looked < n // 4
    assert (slots == -1).all()
