"""Packing by non-negative least squares.

Documents are tokenised once; ids beyond a window are cut off in whole windows, and what is left of each document is a
remainder shorter than a window. The histogram of remainders, in bins, is all that the driver sees. It enumerates the
combinations of up to three bins that fill a window, solves how often each is to be repeated against the histogram,
rounds, and solves again for what is left until that places little more. As most documents are short, the same is then
done for half a window, of which a sequence holds two, for a quarter, and so on. What remains is packed greedily, the
longest that fits next. Remainders are dealt to the places of the combinations by their rank within their bin.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import small_batches, written

WINDOW = 4096
END_ID = 2
#: Width of a bin of lengths.
BIN = 8
#: Steps of the solver.
STEPS = 400
#: Times that what is left is solved for again at each size of window, as long as this share of it is placed; bins in the smallest part of a window.
ROUNDS, LEAST_GAIN, SMALLEST = 8, 0.02, 8
#: Remainders of one bin that are ranked together, about.
RANKED = 2_000

# A chunk between spaces of Latin and Cyrillic letters, which normalising leaves as they are and whose small forms are single letters, and then signs. The tokenizer cuts between the two; this does not hold of "'" and of "<", with which its special cases begin.
_LETTERS = r"A-Za-z\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{012f}\x{0131}-\x{024f}\x{0400}-\x{0481}\x{048a}-\x{052f}"
_SIGNS = r"""!"#$%&()*+,-./:;=>?@[\]^_`{|}~"""
_PLAIN = rf"^[{_LETTERS}]+[!-&(-/:;=-@\[-`{{-~]*$"
# The steps before the merges, as the tokenizer's file gives them, for which the above is true.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids are put together at a time.
_RUN = 1 << 20


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level tokenizer writes each byte: printable ones stand for themselves, the rest for those from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pool:
    """Runs of ids, one after the other."""

    def __init__(self, runs: list[bytes]):
        self.ids = np.frombuffer(b"".join(runs), "<u4")
        self.sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, which: np.ndarray) -> np.ndarray:
        """The ids of these runs in a row."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[which] - (ends - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))]


class Tokens:
    """ids of texts as the tokenizer gives them, found once for each distinct chunk between spaces of a batch: this tokenizer drops white space and no token spans it.

    A chunk of letters and then signs is put together of the two. Words of letters skip the tokenizer's steps before the
    merges: they are small letters already, and one piece each; common ones are remembered from batch to batch. Chunks
    that are neither go through all steps."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores already
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.words, self.most = Tokenizer.from_file(path), Tokenizer.from_file(path), most
        made = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in ((made.get("normalizer") or {}).get("normalizers") or [])]
        self.cuts_words = steps == _NORMALIZERS and json.dumps(_PATTERN) in json.dumps(made.get("pre_tokenizer"))
        self.words.normalizer, self.words.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.signs = _byte_signs()
        self.known: dict[str, bytes] = {}  # words met since `before` was full
        self.before: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """ids of words of small letters, many in one call; the last token of each is marked as an end."""
        out = []
        for first in range(0, len(words), 512):
            spelled = " ".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.signs) for w in words[first : first + 512])
            ids = np.array(self.words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        out = [self.known.get(w) or self.before.get(w) for w in words]
        missing = [w for w, ids in zip(words, out, strict=True) if ids is None]
        made = dict(zip(missing, self._letters(missing), strict=True))
        out = [ids or made[w] for w, ids in zip(words, out, strict=True)]
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        self.known.update(zip(words, out, strict=True))
        return out

    def _chunks(self, chunks: pa.StringArray) -> Pool:
        """The ids of distinct chunks."""
        plain = pc.match_substring_regex(chunks, _PLAIN) if self.cuts_words else pa.array(np.zeros(len(chunks), bool))
        is_plain = plain.to_numpy(zero_copy_only=False)
        some = chunks.filter(plain)
        words = pc.utf8_lower(pc.utf8_rtrim(some, _SIGNS)).dictionary_encode()
        signs = pc.replace_substring_regex(some, f"^[{_LETTERS}]+", "").dictionary_encode()
        odd = chunks.filter(pc.invert(plain)).to_pylist()
        runs = Pool([*self._word_ids(words.dictionary.to_pylist()), *self._whole([*signs.dictionary.to_pylist(), *odd, ""])])
        n_words, n_signs = len(words.dictionary), len(signs.dictionary)
        # Two runs a chunk: its word and its signs, or itself and nothing.
        pairs = np.full((len(chunks), 2), n_words + n_signs + len(odd))
        pairs[is_plain, 0], pairs[is_plain, 1] = words.indices.to_numpy(), signs.indices.to_numpy() + n_words
        pairs[~is_plain, 0] = np.arange(len(odd)) + n_words + n_signs
        out = Pool([])
        out.ids, out.sizes = runs.take(pairs.ravel()), runs.sizes[pairs].sum(axis=1)
        out.starts = np.cumsum(out.sizes) - out.sizes
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as little-endian unsigned 32-bit numbers, and where those of each end."""
        split = pc.ascii_split_whitespace(texts)  # an empty chunk at either end of a text that spaces begin or end has no ids
        chunks = split.flatten().dictionary_encode()
        pool, which = self._chunks(chunks.dictionary), chunks.indices.to_numpy()
        ids = [pool.take(which[a : a + _RUN]) for a in range(0, len(which), _RUN)]
        upto = np.append(0, np.cumsum(pool.sizes[which]))
        offsets = split.offsets.to_numpy()
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), upto[offsets[1:] - offsets[0]]


def _tokens(path: str, kept: dict = {}) -> Tokens:  # noqa: B006  one a worker
    if path not in kept:
        kept[path] = Tokens(path)
    return kept[path]


def _pieces(path: str, window: int, end_id: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for part in small_batches(batches, "body", 8 << 20):
            rows, first = [], 0
            ids, ends = tokens.encode(part.column("body"))
            raw = memoryview(ids).cast("B")
            for doc, last in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                n = last - first + 1
                for a in range(0, n, window):
                    length = min(window, n - a)
                    crc = zlib.crc32(raw[4 * (first + a) : 4 * min(first + a + length, last)])
                    rows.append((doc, a, length, zlib.crc32(end, crc) if a + length == n else crc, n))
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def combinations(stock: np.ndarray, size: int, slack: int = 0) -> np.ndarray:
    """All combinations of one to three bins in stock that fill a window of `size` widths but for at most `slack`: one row each, bins falling, 0 for no part. Bin b holds lengths up to b widths."""
    held = stock > 0
    out = []
    for total in range(size, max(size - slack, 1) - 1, -1):
        a = np.arange(1, total + 1)
        for c in range(0, total // 3 + 1):
            b = total - a - c
            good = (b <= a) & (b >= c) & held[a] & ((b == 0) | held[b])
            if c and not held[c]:
                continue
            out.append(np.stack([a[good], b[good], np.full(good.sum(), c)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solve(shapes: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: x >= 0, the repeats of each row of shapes, that bring what they use of each bin near the histogram, by accelerated projected gradients. A miss counts relative to the bin's size, so that many short remainders don't outweigh the few long ones."""
    weight = np.where(histogram > 0, 1 / np.maximum(histogram, 1), 0.0)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(shapes.ravel(), np.repeat(x, 3), len(histogram))

    def slope(y: np.ndarray) -> np.ndarray:
        return ((used(y) - histogram) * weight)[shapes].sum(axis=1)

    v = np.ones(len(shapes))
    for _ in range(20):  # the largest curvature, by powers
        v = (used(v / np.linalg.norm(v)) * weight)[shapes].sum(axis=1)
    limit = 1.05 * np.linalg.norm(v) + 1e-12
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - slope(y) / limit, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def _rounded(shapes: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Whole repeats under the stock `left`, which is drawn down: whole parts first, then one more for the largest fractions as long as the solution asks for more of the bins."""
    out = []

    def take(j: int, wanted: int) -> int:
        bins, counts = np.unique(shapes[j][shapes[j] > 0], return_counts=True)
        times = min(wanted, int((left[bins] // counts).min()))
        if times > 0:
            left[bins] -= times * counts
            out.append((times, tuple(int(b) for b in shapes[j] if b)))
        return times

    whole = np.floor(x + 1e-9).astype(np.int64)
    for j in np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)]:
        take(j, int(whole[j]))
    more = round(float(x.sum())) - int(whole.sum())
    for j in np.argsort(whole - x, kind="stable"):
        if more <= 0 or x[j] <= 1e-9:
            break
        more -= take(j, 1)
    return out


class Plan:
    """Sequences as (repeats, bins), in `solved` those of combinations and in `rest` those packed greedily."""

    def __init__(self, histogram: np.ndarray, rounds: int = ROUNDS, least: float = LEAST_GAIN):
        n = len(histogram) - 1
        self.solved: list[tuple[int, tuple[int, ...]]] = []
        self.rest: list[tuple[int, tuple[int, ...]]] = []
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        # Whole windows, then halves, quarters and so on, of which a sequence holds 2, 4, ..., as long as solutions still place much.
        parts = 1
        while n // parts >= SMALLEST and n % parts == 0 and left.any():
            for slack in (0, 1):
                for _ in range(rounds):
                    before = int(left.sum())
                    shapes = combinations(left, n // parts, slack if parts == 1 else 0)
                    if not len(shapes):
                        break
                    self._keep(_rounded(shapes, solve(shapes, left.astype(float)), left), parts, left)
                    if before - int(left.sum()) <= least * before:
                        break
            parts *= 2
        self._greedy(left)

    def _keep(self, found: list[tuple[int, tuple[int, ...]]], parts: int, left: np.ndarray) -> None:
        """Sequences of `parts` equal combinations, and of unequal ones where those don't come out even; what fills no sequence goes back."""
        single: list[tuple[int, ...]] = []
        for times, bins in found:
            if times // parts:
                self.solved.append((times // parts, bins * parts))
            single += [bins] * (times % parts)
        for first in range(0, len(single) - len(single) % parts, parts):
            self.solved.append((1, tuple(b for bins in single[first : first + parts] for b in bins)))
        for bins in single[len(single) - len(single) % parts :]:
            np.add.at(left, list(bins), 1)

    def _greedy(self, left: np.ndarray) -> None:
        """Many equal sequences at once: the longest opens a sequence, and the longest that fits is added until none does."""
        while left.any():
            taken: list[int] = []
            room, rest = len(left) - 1, left.copy()
            while len(fits := np.flatnonzero(rest[: room + 1])):
                taken.append(int(fits[-1]))
                rest[taken[-1]] -= 1
                room -= taken[-1]
            used, counts = np.unique(taken, return_counts=True)
            times = int((left[used] // counts).min())
            self.rest.append((times, tuple(taken)))
            left[used] -= times * counts

    def sequences(self) -> list[tuple[int, tuple[int, ...]]]:
        return self.solved + self.rest

    def solved_share(self) -> float:
        """The share of the remainders that solved combinations place."""
        placed, rest = (sum(times * len(bins) for times, bins in some) for some in (self.solved, self.rest))
        return placed / max(1, placed + rest)


def _assign(places: dict[int, tuple[np.ndarray, ...]]):
    """Rows (bin, rank, ...) to their sequence and place: for each bin, `places` has where its runs of ranks begin, and the sequence, the repeats and the place of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            sequence, place = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int32)
            for b in np.unique(bins):
                at = np.flatnonzero(bins == b)
                begins, firsts, slots = places[int(b)]
                i = np.searchsorted(begins, ranks[at], side="right") - 1
                sequence[at] = firsts[i] + ranks[at] - begins[i]
                place[at] = slots[i]
            kept = [c for c in batch.schema.names if c not in ("bin", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(place)], [*kept, "sequence_id", "place"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, bin_width: int = BIN, ranked: int = RANKED) -> DataFrame:
    """One row per piece: the id (bigint), start, length, ids_crc32, doc_tokens, sequence_id and offset.

    tokenizer: path of a tokenizers file whose tokens never span white space. A null text is an empty one and has just
    its end id. Rows are documents of their own even if they repeat. Each id lies in one piece; the pieces of a sequence
    follow each other without gaps. An empty table gives an empty one."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), body).mapInArrow(_pieces(tokenizer, window, end_id), schema), "pieces")
    bins = window // bin_width
    binned = pieces.withColumn("bin", F.ceil(F.col("length") / bin_width).cast("int"))
    histogram = np.zeros(bins + 1)
    for row in binned.groupBy("bin").agg(F.count("*").alias("n")).collect():
        histogram[row["bin"]] = row["n"]
    # Ranks within a bin: a bin of any size is dealt into groups by hash, which are ranked on their own, after the sizes of those before.
    groups = F.array(*[F.lit(max(1, -(-int(n) // ranked))) for n in histogram])
    grouped = binned.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.element_at(groups, F.col("bin") + 1)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1))
    ahead = grouped.groupBy("bin", "deal").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(before, F.lit(0))).select("bin", "deal", "ahead")
    turn = F.row_number().over(Window.partitionBy("bin", "deal").orderBy("doc_id", "start", "length", "ids_crc32"))
    ranks = grouped.withColumn("turn", turn).join(ahead, ["bin", "deal"]).withColumn("rank", F.col("ahead") + F.col("turn") - 1).drop("turn", "ahead", "deal")

    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank, next_sequence = np.zeros(bins + 1, np.int64), 0
    for times, taken in Plan(histogram).sequences():
        for place, b in enumerate(taken):
            runs.setdefault(b, []).append((int(next_rank[b]), next_sequence, place))
            next_rank[b] += times
        next_sequence += times
    places = {b: tuple(np.array(c) for c in zip(*r, strict=True)) for b, r in runs.items()}

    placed = ranks.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank").mapInArrow(_assign(places), f"{schema}, sequence_id long, place int")
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    out = placed.withColumn("offset", offset).drop("place")
    return out.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
