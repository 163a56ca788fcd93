"""LM scoring: subword lattice likelihood.

The pieces of a public vocabulary, with its existing scores, weight all segmentations of each word: the probability that
a word is spelled is the sum, over every way to cut it into pieces, of the product of their unigram probabilities, found
by a forward recursion in log space. The vocabulary is one of merges, whose scores are ranks (minus the number of the
merge), so a fixed law turns a score into a weight; neither pieces nor their scores are trained. What is learned from the
corpus are words: a training word is, whole, one more arc of its lattice at its discounted count over all tokens, while
the discounts weigh the spelled arcs. A word begins with a marked piece and a text ends with an end token, so that the
probabilities of all texts sum to one.

Words are scored once each, not once per occurrence. Very common words, a bounded number, are looked up where the text
is read; all others go, many texts in a row, to the bucket of their hash, where their counts lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import small_batches, written

HELD_OUT, FOLDS = 2, 7
#: Words that are looked up without a shuffle, the commonest; bounds what each task is sent.
COMMON_WORDS = 150_000
#: Bytes of words, occurrences and counts in one bucket of the others, about; but as many buckets as this at least, so that what a text sends does not depend on the corpus before it is large.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
#: Bytes of text that are dealt to the buckets in one row each.
SLICE = 8 << 20
END = ""
#: Of what the discounts leave, the share that goes to the end token; the rest is spelled.
END_SHARE = 0.01
#: A piece of score -r weighs (r + SHIFT) ** -POWER; single bytes that are no pieces, and the mark of a word's beginning, weigh as given.
SHIFT, POWER = 10, 1.3
BYTE_WEIGHT, MARK_WEIGHT, CONTROL_WEIGHT = 1e-6, 1e-4, 1e-7


def piece_scores(model: str) -> dict[bytes, float]:
    """Pieces (as bytes, a leading space marking a word's beginning) of a sentencepiece model, with natural logarithms of probabilities by its scores; every single byte, with and without the mark, is among them."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
    weights: dict[bytes, float] = {b" ": MARK_WEIGHT} | {bytes([b]): BYTE_WEIGHT for b in range(33, 256)}
    for i in range(vocabulary.get_piece_size()):
        if vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i):
            continue
        piece = vocabulary.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            weights[piece] = max(weights.get(piece, 0.0), (SHIFT - vocabulary.get_score(i)) ** -POWER)
    for b in (*range(9), *range(14, 32)):
        weights.setdefault(bytes([b]), CONTROL_WEIGHT)
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in sorted(weights.items())}


class Lattice:
    """Forward sums over all segmentations of words, for many words at a time."""

    def __init__(self, scores: dict[bytes, float]):
        inner = sorted({p[:k] for p in scores for k in range(len(p))})  # what further bytes can make a piece of
        outer = sorted(set(scores) - set(inner))
        self.place = {p: i for i, p in enumerate([*inner, *outer])}
        self.inner, dead = len(inner), len(self.place)
        self.follow = np.full((len(inner), 256), dead, np.int32)
        self.gain = np.full(dead + 1, -np.inf)
        for p, i in self.place.items():
            if p:
                self.follow[self.place[p[:-1]], p[-1]] = i
            if p in scores:
                self.gain[i] = scores[p]

    def _forward(self, words: list[bytes]) -> np.ndarray:
        """For words of one length, with the mark in front: the logarithm of the sum over all ways to get to the end."""
        size = len(words[0]) + 1
        codes = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).reshape(len(words), size).T.copy()
        forward = np.full((size + 1, len(words)), -np.inf)
        forward[0] = 0
        for a in range(size):
            rows, at = np.arange(len(words)), self.follow[self.place[b""], codes[a]]
            for b in range(a + 1, size + 1):
                gain = self.gain[at]
                whole = np.flatnonzero(gain > -np.inf)
                some = rows[whole]
                forward[b, some] = np.logaddexp(forward[b, some], forward[a, some] + gain[whole])
                alive = np.flatnonzero(at < self.inner)
                if b == size or not len(alive):
                    break
                rows = rows[alive]
                at = self.follow[at[alive], codes[b, rows]]
        return forward[size]

    @staticmethod
    def _by_length(words: list[bytes], cells: int = 400_000) -> Iterator[np.ndarray]:
        """Places of words of equal length, in groups of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, edges) if len(order) else []:
            most = max(1, cells // (int(sizes[group[0]]) + 1))
            yield from (group[a : a + most] for a in range(0, len(group), most))

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the marginal probabilities of the words; a word far longer than all pieces runs in steps of the same recursion."""
        out = np.zeros(len(words))
        for group in self._by_length(words):
            some = [words[i] for i in group.tolist()]
            out[group] = [self._long(w) for w in some] if len(some[0]) > 512 else self._forward(some)
        return out

    def _long(self, word: bytes) -> float:
        """The same for one word, holding only as many sums as the longest piece reaches ahead."""
        text, root = b" " + word, self.place[b""]
        ahead: dict[int, float] = {0: 0.0}
        for a in range(len(text)):
            here, at = ahead.pop(a, -math.inf), root
            for b in range(a, len(text)):
                at = int(self.follow[at, text[b]])
                gain = float(self.gain[at])
                if gain > -math.inf and here > -math.inf:
                    old = ahead.get(b + 1, -math.inf)
                    top = max(old, here + gain)
                    ahead[b + 1] = top + math.log(math.exp(old - top) + math.exp(here + gain - top))
                if at >= self.inner:
                    break
        return ahead.get(len(text), -math.inf)


def _lattice(scores: dict[bytes, float], kept: dict = {}) -> Lattice:  # noqa: B006  one a worker
    key = hash(tuple(scores.values()))
    if key not in kept:
        kept.clear()
        kept[key] = Lattice(scores)
    return kept[key]


class Mixture:
    """Probabilities of tokens: discounted counts, and what the discounts leave, spelled."""

    def __init__(self, total: int, distinct: int, once: int, twice: int):
        self.total = total
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.spelled = self.discount * distinct / total if total else 1.0

    def _log10(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.logaddexp(spelled + math.log(self.spelled), np.log(np.maximum(counts - self.discount, 0) / max(self.total, 1))) / math.log(10)

    def words(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """spelled: natural logarithms of the words' spelled probabilities."""
        return self._log10(counts, spelled + math.log(1 - END_SHARE))

    def end(self, count: int) -> float:
        return float(self._log10(np.array([float(count)]), np.array([math.log(END_SHARE)]))[0])


def _occurrences(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased) of some texts, and for each occurrence the place of its word and of its text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    which, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()  # where spaces begin or end a text
    if blank >= 0:
        which, text = which[which != blank], text[which != blank]
    return coded.dictionary, which, text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts, counted within each slice."""
    for part in small_batches(batches, "body", 2 * SLICE):
        words, which, _ = _occurrences(part.column("body"))
        n = np.bincount(which, minlength=len(words))
        met = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.filter(met), pa.array([END], words.type)]), pa.array([*n[n > 0].tolist(), part.num_rows], pa.int64())], ["word", "n"])


def _buckets_of(words: pa.StringArray, buckets: int) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.fromiter((xxh32_intdigest(w) % buckets for w in words.to_pylist()), np.int64, len(words))


# Rows that go to the buckets. Kind 0: words and their counts in `times`. Kind 1: rare words of many texts; `times` is how often word word_no occurs in text text_no. Kind 2: sums over the common words of many texts.
_COUNTS, _RARE, _TEXTS = range(3)
_LISTS = {"times": pa.int64(), "word_no": pa.int32(), "text_no": pa.int32(), "k_ids": pa.int64(), "k_texts": pa.int64(), "tokens": pa.int64(), "known": pa.int64(), "logs": pa.float64(), "scores": pa.float64()}
_DEALT = "bucket int, kind byte, words string, times array<long>, word_no array<int>, text_no array<int>, k_ids array<long>, k_texts array<long>, tokens array<long>, known array<long>, logs array<double>, scores array<double>"


def _lists(values: np.ndarray | pa.Array, edges: np.ndarray) -> pa.ListArray:
    """The values between each edge and the next."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _dealt_rows(kind: int, buckets: np.ndarray, words: pa.ListArray | None, **lists: pa.ListArray) -> pa.RecordBatch:
    n = len(buckets)
    joined = pc.binary_join(words, " ") if words is not None else pa.nulls(n, pa.string())
    columns = [lists[k].cast(pa.list_(t)) if k in lists else pa.nulls(n, pa.list_(t)) for k, t in _LISTS.items()]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.full(n, kind), pa.int8()), joined.cast(pa.string()), *columns], ["bucket", "kind", "words", *_LISTS])


def _deal_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _buckets_of(batch.column("word"), buckets)
            order = np.argsort(made, kind="stable")
            firsts = np.flatnonzero(np.diff(made[order], prepend=-1))
            edges = np.append(firsts, len(order))
            yield _dealt_rows(_COUNTS, made[order][firsts], _lists(batch.column("word").take(pa.array(order)), edges), times=_lists(batch.column("n").take(pa.array(order)), edges))

    return run


def _deal_texts(common: dict, buckets: int):
    """Per slice: the sums over the common words of its texts, and the rest of its words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(common["words"])
        for part in small_batches(batches, "body", SLICE):
            words, which, text = _occurrences(part.column("body"))
            texts = part.num_rows
            place = pc.index_in(words, value_set=listed).fill_null(-1).to_numpy()
            at = place[which]
            mine = at >= 0
            tokens = np.bincount(text, minlength=texts) + 1
            known = np.bincount(text[mine], minlength=texts) + (common["end"][0] > 0)
            logs, scores = (np.bincount(text[mine], common[k][at[mine]], texts) + common["end"][i] for i, k in enumerate(("logs", "scores")))
            edges = np.array([0, texts])
            k_ids, k_texts = part.column("k_id").to_numpy(), part.column("k_text").to_numpy()
            yield _dealt_rows(_TEXTS, np.array([int(k_texts[0]) % buckets]), None, **{k: _lists(v, edges) for k, v in {"k_ids": k_ids, "k_texts": k_texts, "tokens": tokens, "known": known, "logs": logs, "scores": scores}.items()})

            rare = np.flatnonzero(place < 0)
            made = _buckets_of(words.take(pa.array(rare)), buckets)
            order = np.argsort(made, kind="stable")
            rare, made = rare[order], made[order]  # by bucket
            number = np.full(len(words), -1)
            number[rare] = np.arange(len(rare))
            pairs, times = np.unique(number[which[~mine]] * texts + text[~mine], return_counts=True)
            if not len(pairs):
                continue
            word_no, text_no = np.divmod(pairs, texts)
            firsts = np.flatnonzero(np.diff(made[word_no], prepend=-1))
            begin = word_no[firsts]  # of each bucket, its first word
            pair_edges, word_edges = np.append(firsts, len(pairs)), np.append(begin, len(rare))
            row = np.repeat(np.arange(len(firsts)), np.diff(pair_edges))
            # Texts are numbered within each row.
            mentioned, short = np.unique(row * texts + text_no, return_inverse=True)
            text_edges = np.searchsorted(mentioned, np.arange(len(firsts) + 1) * texts)
            who = mentioned % texts
            yield _dealt_rows(
                _RARE,
                made[begin],
                _lists(words.take(pa.array(rare)), word_edges),
                times=_lists(times, pair_edges),
                word_no=_lists((word_no - begin[row]).astype(np.int32), pair_edges),
                text_no=_lists((short - text_edges[row]).astype(np.int32), pair_edges),
                k_ids=_lists(k_ids[who], text_edges),
                k_texts=_lists(k_texts[who], text_edges),
            )

    return run


_SUMS = ["k_id", "k_text", "n_tokens", "n_known", "counts", "score", "n"]
_SUMMED = "k_id long, k_text long, n_tokens long, n_known long, counts double, score double, n long"


class _Bucket:
    """The words of one bucket that have counts, with what they add to a text."""

    def __init__(self, lattice: Lattice, mixture: Mixture):
        self.lattice, self.mixture, self.parts, self.ready = lattice, mixture, [], False

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((pc.split_pattern(rows.column("words"), " ").flatten(), rows.column("times").flatten().to_numpy()))

    def _value(self, words: pa.StringArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelled = self.lattice.log_probabilities([w.encode() for w in words.to_pylist()])
        return np.log10(counts + 1), self.mixture.words(counts, spelled)

    def sums(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        if not self.ready:
            self.ready = True
            self.words = pa.concat_arrays([w for w, _ in self.parts]) if self.parts else pa.array([], pa.string())
            self.logs, self.scores = self._value(self.words, np.concatenate([n for _, n in self.parts]) if self.parts else np.zeros(0))
        split = pc.split_pattern(rows.column("words"), " ")
        words = split.flatten()
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        known, logs, scores = place >= 0, np.zeros(len(words)), np.zeros(len(words))
        logs[known], scores[known] = self.logs[place[known]], self.scores[place[known]]
        new = words.filter(pa.array(~known)).dictionary_encode()
        scores[~known] = self._value(new.dictionary, np.zeros(len(new.dictionary)))[1][new.indices.to_numpy()]

        def placed(number: str, owners: pa.ListArray) -> np.ndarray:
            """Numbers within rows as places among all rows here."""
            column = rows.column(number)
            offsets = owners.offsets.to_numpy()
            return column.flatten().to_numpy() + np.repeat(offsets[:-1] - offsets[0], pc.list_value_length(column).to_numpy())

        word, text, times = placed("word_no", split), placed("text_no", rows.column("k_ids")), rows.column("times").flatten().to_numpy()
        k_ids = rows.column("k_ids").flatten()
        n_known, counts, score = (np.bincount(text, x[word] * times, len(k_ids)) for x in (known, logs, scores))
        none = np.zeros(len(k_ids), np.int64)
        return pa.RecordBatch.from_arrays([k_ids, rows.column("k_texts").flatten(), pa.array(none), pa.array(np.rint(n_known).astype(np.int64)), pa.array(counts), pa.array(score), pa.array(none)], _SUMS)


def _score_buckets(scores: dict[bytes, float], mixture: Mixture):
    """Rows sorted by bucket and kind, so the counts of its words come first: sums for each text and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, now, bucket = _lattice(scores), None, None
        for batch in batches:
            which, kinds = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(which)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if which[a] != now:
                    now, bucket = which[a], _Bucket(lattice, mixture)
                if kinds[a] == _COUNTS:
                    bucket.add(rows)
                elif kinds[a] == _RARE:
                    yield bucket.sums(rows)
                else:
                    lists = [rows.column(c).flatten() for c in ("k_ids", "k_texts", "tokens", "known", "logs", "scores")]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array(np.ones(len(lists[0]), np.int64))], _SUMS)

    return run


def score_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT, folds: int = FOLDS, common_words: int = COMMON_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: the id (bigint), held_out, n_tokens, n_known, train_tokens, base_score and score.

    model: path of a sentencepiece model whose pieces make the lattice. Texts whose crc32(id as text) mod `folds` is
    `held_out` (null id: that of an empty text, 0) are not learned from. score is the decimal logarithm of the text's
    probability under the lattice, base_score that of a unigram model of words with one added to each count. A null
    text is an empty one, with just its end. An empty table gives an empty one; without training texts all counts are
    zero and every word is spelled."""
    id_, body = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fold = F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    # A row's key: its id and a hash of its text, of which the last bit says whether the id is missing.
    k_text = F.xxhash64(body).bitwiseAND(F.lit(-2)).bitwiseOR(id_.isNull().cast("long"))
    texts = docs.select(F.coalesce(id_.cast("long"), F.lit(0)).alias("k_id"), k_text.alias("k_text"), (fold == held_out).alias("held_out"), body.alias("body"))
    counts = written(texts.where(~F.col("held_out")).select("body").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    is_end = F.col("word") == END
    total, distinct, once, twice, size, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)), F.coalesce(F.max(F.when(is_end, F.col("n"))), F.lit(0))).first()
    scores, mixture = piece_scores(model), Mixture(total, distinct, once, twice)

    # The commonest words, by levels of their counts: whole levels from the top as long as they hold common_words at most.
    level = F.floor(F.log2("n") * 64)
    held, lowest = 0, math.inf
    for row in sorted(counts.where(~is_end).groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        if (held := held + row["words"]) > common_words:
            break
        lowest = row["level"]
    top = counts.where(~is_end & (level >= lowest)).toArrow()
    words, n = top["word"].to_pylist(), top["n"].to_numpy()
    common = {"words": words, "logs": np.log10(n + 1), "scores": mixture.words(n, Lattice(scores).log_probabilities([w.encode() for w in words])), "end": (math.log10(ends + 1), mixture.end(ends))}

    # An occurrence of another word takes some 30 bytes on its way; training texts hold all but one of the folds.
    occurrences = (total - ends - int(n.sum())) * folds / max(folds - 1, 1)
    buckets = max(LEAST_BUCKETS, math.ceil((size + 30 * occurrences + 8 * distinct) / bucket_bytes))
    shared = docs.sparkSession.sparkContext.broadcast((common, scores))  # at most common_words words, and the vocabulary
    dealt = texts.select("k_id", "k_text", "body").mapInArrow(lambda b: _deal_texts(shared.value[0], buckets)(b), _DEALT)
    counted = counts.where(~is_end).mapInArrow(_deal_counts(buckets), _DEALT)
    rows = dealt.unionByName(counted).repartition("bucket").sortWithinPartitions("bucket", "kind")
    sums = rows.mapInArrow(lambda b: _score_buckets(shared.value[1], mixture)(b), _SUMMED).groupBy("k_id", "k_text").agg(*[F.sum(c).alias(c) for c in _SUMS[2:]])
    # Copies of a row have summed as one; each gets its share, and a row of its own.
    each = sums.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    id_ = F.when(F.col("k_text").bitwiseAND(F.lit(1)) == 0, F.col("k_id"))
    fold = F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    tokens = F.expr("n_tokens div n")
    return each.select(
        id_.alias(id_col),
        (fold == held_out).alias("held_out"),
        tokens.alias("n_tokens"),
        F.expr("n_known div n").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counts") / F.col("n") - tokens * math.log10(total + 1 * (distinct + 1))).alias("base_score"),
        (F.col("score") / F.col("n")).alias("score"),
    )
