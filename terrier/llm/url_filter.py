"""URL filters: a bit-parallel wildcard automaton.

Rules are globs over a canonical URL: the host, A-Z lower-cased, the path, and `?` with the query if there is one, without
scheme and fragment. `*` stands for any run without `/` and `?`, `**` for any run; all else for itself. Every glob takes
one bit for its start and one for each of its letters, packed into 64-bit words, however many. One step of Shift-And then
moves all globs at once over one byte of a URL: D = ((D << 1) & B[byte]) | (D & L[byte]), where B has the states that a
byte leads into and L those with a wildcard behind them that accepts it; carries run from word to word. Whole batches of
URLs, longest first, take each step together, so URLs of all lengths are read to their end and memory stays that of one
small batch.

A URL that is null or has no `://` has an empty host and path, which no host rule fits. Of the host rules that fit, the
longest wins (host and path together; of equally long ones the first in the list); where none does, the longest glob
that fits decides, blocking before allowing, and where none does, the default. Each row is judged on its own: repeated
rows alike, none left out, an empty table gives no row, and other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import ascii_lower, small_batches

ALLOW, BLOCK = "allow", "block"
#: Of hosts and their subdomains, by the beginning of the path.
HOST_RULES = ((ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/"))
#: What says, whatever the host, that a page is no text to learn from: archives and programs, log-ins, carts, and sessions in the query.
GLOB_RULES = ((BLOCK, "**.zip"), (BLOCK, "**.exe"), (BLOCK, "**/login"), (BLOCK, "**/cart/**"), (BLOCK, "**?**sessionid=**"), (ALLOW, "*/robots.txt"))
#: URLs that take steps together.
BATCH = 4096
#: Ends every URL, so that a glob is complete only there. No UTF-8 text has this byte.
END = 0xFF


@dataclass(frozen=True)
class Automaton:
    """Masks of all globs by byte, as rows of 64-bit words."""

    start: np.ndarray
    into: np.ndarray
    stay: np.ndarray
    accept: tuple[tuple[int, int], ...]  # word and bit of each glob's last state


def compile_globs(globs: list[str]) -> Automaton:
    """Packs globs side by side: state 0 of a glob stands for nothing read, state i for its first i letters; the last letter is END."""
    parts = [[p for p in re.split(r"(\*+)", g) if p] for g in globs]
    width = sum(2 + sum(len(p.encode()) for p in ps if p[0] != "*") for ps in parts)
    words = max(1, -(-width // 64))
    start, into, stay = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    every = np.arange(256)
    run = {1: every[~np.isin(every, [ord("/"), ord("?"), END])], 2: every[every != END]}
    bit, accept = 0, []
    at = lambda i: (i // 64, np.uint64(1 << i % 64))
    for ps in parts:
        word, mask = at(bit)
        start[word] |= mask
        for p in ps:
            if p[0] == "*":
                word, mask = at(bit)
                stay[run[min(len(p), 2)], word] |= mask
                continue
            for c in p.encode():
                bit += 1
                word, mask = at(bit)
                into[c, word] |= mask
        bit += 1
        word, mask = at(bit)
        into[END, word] |= mask
        accept.append((word, bit % 64))
        bit += 1
    return Automaton(start, into, stay, tuple(accept))


def run_all(automaton: Automaton, urls: list[bytes]) -> np.ndarray:
    """Which globs fit which URLs, as a matrix of booleans."""
    order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
    sizes = np.array([len(urls[i]) + 1 for i in order], np.int64)
    held = np.frombuffer(b"".join(urls[i] + bytes([END]) for i in order), np.uint8)
    starts = np.cumsum(sizes) - sizes
    state = np.repeat(automaton.start[None, :], len(urls), axis=0)
    live = len(urls)
    for step in range(int(sizes[0]) if len(urls) else 0):
        while sizes[live - 1] <= step:
            live -= 1
        now, byte = state[:live], held[starts[:live] + step]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        now &= automaton.stay[byte]
        now |= moved & automaton.into[byte]
    fits = np.stack([(state[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in automaton.accept], axis=1).astype(bool)
    out = np.empty_like(fits)
    out[order] = fits
    return out


def host_globs(rule: str) -> tuple[str, str]:
    """A rule of a host as two globs: the host itself, and its subdomains."""
    return f"{rule}**", f"*.{rule}**"


def _first(fits: np.ndarray) -> np.ndarray:
    """Of each row the first column that is true, or the number of columns."""
    return np.where(fits.any(axis=1), fits.argmax(axis=1), fits.shape[1]) if fits.shape[1] else np.zeros(len(fits), int)


def _judge(host_rules: tuple[tuple[str, str], ...], globs: tuple[tuple[str, str], ...], default: str):
    hosts = sorted(host_rules, key=lambda r: -len(r[1]))
    others = sorted(globs, key=lambda r: (-len(r[1].replace("*", "")), r[0] != BLOCK))
    automaton = compile_globs([g for _, r in hosts for g in host_globs(r)] + [g for _, g in others])
    names = np.array([r for _, r in hosts] + [None], object)
    # One verdict for each host rule, then for each glob, then for none.
    said = np.array([v for v, _ in hosts] + [v for v, _ in others] + [default], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in small_batches(batches, "url"):
            for first in range(0, piece.num_rows, BATCH):
                batch = piece.slice(first, BATCH)
                urls = [u.encode() for u in batch.column("url").to_pylist()]
                fits = run_all(automaton, urls)
                rule = _first(fits[:, : 2 * len(hosts)].reshape(len(urls), -1, 2).any(axis=2))
                glob = _first(fits[:, 2 * len(hosts) :])
                verdict = said[np.where(rule < len(hosts), rule, len(hosts) + glob)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names[rule], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the query with its `?`: what follows the first `://` up to a fragment, all empty where there is none."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring_index(F.substring(url, at + 3, F.length(url)), "#", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?]*", 0)), F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*((?s:.*))", 1)


def filter_urls(pages: DataFrame, host_rules: tuple[tuple[str, str], ...] = HOST_RULES, globs: tuple[tuple[str, str], ...] = GLOB_RULES, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row. Rules are (verdict, text), a few thousand at most; their masks go to every task."""
    host, path, query = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.concat(host, path, query).alias("url"))
    return urls.mapInArrow(_judge(host_rules, globs, default), "page_id long, host string, path string, rule string, verdict string")
