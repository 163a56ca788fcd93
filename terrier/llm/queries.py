"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.llm.chat_format import format_conversations, read_back, with_escape_case
from terrier.llm.common import read_table
from terrier.llm.exact_dedup import exact_groups
from terrier.llm.lattice_lm import score_texts
from terrier.llm.merkle import manifest, siblings_digest
from terrier.llm.mixing import plan_mix
from terrier.llm.packing import pack
from terrier.llm.posting_ann import nearest
from terrier.llm.quality import judge
from terrier.llm.ranked_search import search
from terrier.llm.secret_scan import scan_secrets, span_text
from terrier.llm.simhash import near_duplicates
from terrier.llm.substring_dedup import dedup_passages
from terrier.llm.url_filter import filter_urls


def _id(column: str = "k_id"):
    """A k_id as the id that it stands for, in rows that tell whether it is missing."""
    return F.when(~F.col("null_id") | (F.col(column) != -(2**63)), F.col(column))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under recurring windows of 35 words are removed; of the rest, a digest."""
    out = dedup_passages(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of sources weighing 3, 1, 2 takes."""
    out = plan_mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all texts, learned from six of seven folds; the pieces are those of a public 32k vocabulary."""
    return score_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back."""
    return read_back(format_conversations(with_escape_case(read_table(spark, sf_dir, "conversations"))))


def op5_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest, by inner product, of every vector whose id is divisible by 20."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of candidate secrets, and of their values as widely copied or owner-specific."""
    out = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.col("spans"), base_only=True), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens of a public 49k vocabulary."""
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and their components at 2 bits."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(_id().alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(~F.col("root.null_id"), F.col("root.k_id")).alias("component_id"))


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a scorer trained on weak labels keeps."""
    return judge(read_table(spark, sf_dir, "documents")).select(_id().alias("doc_id"), "score", "posterior", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for the case of A-Z."""
    out = exact_groups(read_table(spark, sf_dir, "documents"))
    return out.select(_id().alias("doc_id"), _id("keep").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; where 7 divides an id's crc32 the row is one character longer than it was."""
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(read_table(spark, sf_dir, "documents"), tampered={"n_chars": altered})
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule fits each page's address, and what it says."""
    return filter_urls(read_table(spark, sf_dir, "pages"))


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, the 50 that score highest for each benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_mix_sources, op3_lattice_lm, op4_chat_format, op5_posting_ann, op6_secret_scan, op7_nnls_packing, op8_simhash, op9_weak_labels, op10_exact_dedup, op11_merkle_log, op12_url_automaton, op13_best_position)}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
            FROM d GROUP BY source
        ), fill AS (
            SELECT 0 AS step, source, source_size, weight, FALSE AS stopped, 1.5 * sum(source_size) OVER () AS rest FROM s
            UNION ALL
            SELECT step + 1, source, source_size, weight, stopped OR over_,
                   1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN stopped OR over_ THEN 2.0 * source_size END) OVER (), 0)
            FROM (SELECT *, rest * weight / nullif(sum(CASE WHEN NOT stopped THEN weight ELSE 0 END) OVER (), 0) > 2.0 * source_size AS over_ FROM fill)
            WHERE step < (SELECT count(*) FROM s)
        ), t AS (
            SELECT source, source_size,
                   (CASE WHEN stopped THEN 2.0 * source_size ELSE rest * weight / nullif(sum(CASE WHEN NOT stopped THEN weight ELSE 0 END) OVER (), 0) END)::DOUBLE AS target
            FROM fill WHERE step = (SELECT count(*) FROM s)
        ), r AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM r""",
    "op4_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS shown,
                   length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) + length(role) AS role_shown FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(shown + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 16 + role_shown END)::BIGINT AS formatted_chars,
               regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)*u?') AS valid
        FROM e GROUP BY conv_id""",
    "op10_exact_dedup": """
        WITH n AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_merkle_log": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail,
                   list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce(range(8)::BIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295) AS crc
            FROM documents
        ), l AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS altered FROM d
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
        ), nodes AS (
            SELECT tree, 0 AS h, i, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM p
            UNION ALL
            SELECT tree, h + 1, i >> 1, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) >> 1 FROM nodes WHERE n > 1 GROUP BY tree, h, i >> 1
        ), s AS (
            SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS h, i, subroot AS digest, count(*) OVER () AS n FROM s
            UNION ALL
            SELECT h + 1, i >> 1, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) >> 1 FROM tops WHERE n > 1 GROUP BY h, i >> 1
        ), level AS (
            SELECT p.tree, p.doc_id, p.leaf, p.altered, p.i AS leaf_i, t.h, (t.i & 1) AS odd, b.digest AS sibling
            FROM p JOIN nodes t ON t.tree = p.tree AND t.i = p.i >> t.h AND t.n > 1 LEFT JOIN nodes b ON b.tree = t.tree AND b.h = t.h AND b.i = xor(t.i, 1)
            UNION ALL
            SELECT p.tree, p.doc_id, p.leaf, p.altered, p.i, 1000 + t.h, (t.i & 1), b.digest
            FROM p JOIN s ON s.tree = p.tree JOIN tops t ON t.i = s.i >> t.h AND t.n > 1 LEFT JOIN tops b ON b.h = t.h AND b.i = xor(t.i, 1)
        ), ways AS (
            SELECT tree, leaf_i, sha256(coalesce(string_agg(sibling, '' ORDER BY h), '')) AS proof_sha256,
                   list({'odd': odd, 'sibling': sibling} ORDER BY h) AS way FROM level GROUP BY tree, leaf_i
        ), folds AS (
            SELECT p.tree, p.i, coalesce(p.altered, p.leaf) AS node, w.way, 1 AS k FROM p JOIN ways w ON w.tree = p.tree AND w.leaf_i = p.i
            UNION ALL
            SELECT tree, i, sha256(CASE WHEN way[k].odd = 1 THEN way[k].sibling || node ELSE node || coalesce(way[k].sibling, '') END), way, k + 1 FROM folds WHERE k <= len(way)
        )
        SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256,
               coalesce(f.node, p.altered, p.leaf) AS folded_root, coalesce(f.node, p.altered, p.leaf) = r.digest AS verified
        FROM p JOIN s ON s.tree = p.tree JOIN (SELECT digest FROM tops WHERE n = 1) r ON TRUE
             LEFT JOIN ways w ON w.tree = p.tree AND w.leaf_i = p.i LEFT JOIN folds f ON f.tree = p.tree AND f.i = p.i AND f.k = len(w.way) + 1""",
    "op12_url_automaton": r"""
        WITH r AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(substr(url, strpos(url, '://') + 3), '#', 1) ELSE '' END AS rest FROM pages
        ), u AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?]*(.*)', 1) AS query FROM r
        ), k AS (
            SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN regexp_matches(host || path || query, '^[^/?]*/robots[.]txt$') THEN 'allow'
                    WHEN regexp_matches(host || path || query, '(?s)[.](zip|exe)$|/login$|/cart/|[?].*sessionid=') THEN 'block'
                    ELSE 'allow' END AS verdict FROM k""",
    "op13_best_position": r"""
        WITH t AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), f AS (
            SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, unnest(terms) AS term FROM t) GROUP BY ALL
        ), s AS (
            SELECT count_if(len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM t
        ), w AS (
            SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term
        ), m AS (
            SELECT row, 50 + (50 * len(terms) * docs) // total AS m FROM t, s WHERE len(terms) > 0
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), x AS (
            SELECT item_id, f.row, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.row = f.row GROUP BY ALL
        )
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50""",
}
