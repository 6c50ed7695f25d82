"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with an error budget of k edits is cut into k + 1 pieces. Wherever a document holds the item
with at most k edits, at least one piece is left whole, so exact piece hits miss no occurrence. Hits are found for many
texts at once: all windows of a piece's length are hashed by differences of one running sum, looked up in a bit table and
then among the sorted hashes of the pieces. Hits of an item whose windows overlap are one stretch of the document; an
edit spoils at most one of the item's disjoint 4-grams, so a stretch that lacks more of them than the budget is discarded,
and Myers' bit-parallel distance gives the least edits of the item against any part of the rest (long stretches in
overlapping parts side by side, one machine word of each at a time).

Both sides are compared in lower case, with ASCII punctuation and white space as single spaces. The budget is
``rate`` x m, rounded down. An item without budget is its own piece and matches between word bounds.

The items are a stated query set: they are read in blocks of about ``block_bytes``, one after the other, each sent to all
tasks and held against every document. Nothing is collected from the documents.

Defined results: null and empty texts, and items without any letter or digit, match nothing; repeated documents and
items are reported each; ties in distance do not arise, as a pair is one row with its least distance; very long texts are
searched whole, in slices; empty tables give no rows; further columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, lean, relieved, written, written_for_later

_TO_SPACE = bytes.maketrans((string.punctuation + string.whitespace).encode(), b" " * len(string.punctuation + string.whitespace))
#: Of the filter before the distance.
_Q = 4
#: Characters of texts that are searched at once, and the most that a window holds (a longer piece starts with one).
_AT_ONCE, _WINDOW = 1 << 18, 12
#: Odd, so that it has an inverse modulo 2 to the 64; and a mixer of the high bits that the table is addressed by.
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def normalised(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()).decode("utf-8", "surrogatepass")


def least_distance(item: str, text: str) -> int:
    """The least edits that turn item into some part of text, by Myers' recurrence over one machine word of any width."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score, least = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < least:
                least = score
        ph = ph << 1 & full
        up = mh << 1 & full | ~(xv | ph) & full
        down = ph & xv
    return least


def least_within(item: str, text: str, budget: int) -> int | None:
    """The least edits that turn item into some part of text, or None if they are over the budget.

    Myers' recurrence in 64-bit words (the carry of a word goes to the next), on parts of the text side by side: part i
    starts at i x len(item) and overlaps the next ones, so that any occurrence within the budget lies in one part.
    """
    m, words = len(item), -(-len(item) // 64)
    alphabet = sorted(set(item))
    peq = np.zeros((words, len(alphabet) + 1), np.uint64)
    for i, c in enumerate(item):
        peq[i // 64, alphabet.index(c)] |= np.uint64(1 << i % 64)
    known = np.array([ord(c) for c in alphabet], np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    symbols = np.where(known[at] == codes, at, len(known))
    reach = 2 * m + budget
    lanes = -(-len(codes) // m)
    symbols = np.concatenate((symbols, np.full(lanes * m + reach - len(codes), len(known))))
    first = np.arange(lanes) * m
    one, top = np.uint64(1), [np.uint64(63)] * (words - 1) + [np.uint64((m - 1) % 64)]
    up = [np.full(lanes, ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(lanes, np.uint64) for _ in range(words)]
    score, least = np.full(lanes, m), np.full(lanes, m)
    for t in range(reach):
        now = symbols[first + t]
        plus = minus = np.zeros(lanes, np.uint64)
        for w in range(words):
            eq = peq[w][now]
            xv = eq | down[w]
            eq |= minus
            xh = ((eq & up[w]) + up[w] ^ up[w]) | eq
            ph = down[w] | ~(xh | up[w])
            mh = up[w] & xh
            more, less = ph >> top[w] & one, mh >> top[w] & one
            ph = ph << one | plus
            mh = mh << one | minus
            up[w] = mh | ~(xv | ph)
            down[w] = ph & xv
            plus, minus = more, less
        score += plus.astype(np.int64) - minus.astype(np.int64)
        np.minimum(least, score, out=least)
    best = int(least.min())
    return best if best <= budget else None


class _Powers:
    """Powers of _BASE and of its inverse, as many as the longest slice needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _AT_ONCE + 64)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def windows(codes: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the hashes of all windows of it."""
    up, down = _POWERS.of(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
        for size in sizes:
            if len(codes) >= size:
                yield size, (total[size:] - total[:-size]) * down[: len(codes) - size + 1] * _MIX


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Matcher:
    """Finds the items within their budgets in any text."""

    def __init__(self, items: list[tuple], rate: float) -> None:
        self.items = [(key, normalised(text)) for key, text in items]
        self.budget = np.array([int(len(t) * rate) for _, t in self.items], np.int64)
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        by_window: dict[int, list[tuple[int, int, int]]] = {}
        for i, (_, text) in enumerate(self.items):
            n = int(self.budget[i]) + 1
            for j in range(n) if text else ():
                a, b = len(text) * j // n, len(text) * (j + 1) // n
                by_window.setdefault(min(b - a, _WINDOW), []).append((i, a, b - a))
        #: For each window size: sorted hashes of the pieces' first windows, whose they are and where in it, and the table.
        self.pieces = {}
        for size, uses in sorted(by_window.items()):
            which, at, _ = np.array(uses, np.int64).T
            hashes = np.concatenate([next(windows(codes_of(self.items[i][1][a : a + size]), [size]))[1] for i, a, _ in uses])
            order = np.argsort(hashes, kind="stable")
            bits = min(28, max(12, int(len(hashes)).bit_length() + 4))
            table = np.zeros(1 << bits, bool)
            table[hashes >> np.uint64(64 - bits)] = True
            self.pieces[size] = (hashes[order], which[order], at[order], table, np.uint64(64 - bits))
        self.grams = lru_cache(4096)(lambda i: [self.items[i][1][j : j + _Q] for j in range(0, len(self.items[i][1]) - _Q + 1, _Q)])

    def _hits(self, codes: np.ndarray) -> np.ndarray:
        """Items, where they would start, and where the window lies, for every window that begins one of their pieces."""
        rows = [np.zeros((3, 0), np.int64)]
        for size, hashes in windows(codes, self.pieces):
            known, which, at, table, shift = self.pieces[size]
            place = np.flatnonzero(table[hashes >> shift])
            left = np.searchsorted(known, hashes[place])
            count = np.searchsorted(known, hashes[place], "right") - left
            ends = np.cumsum(count)
            use = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(left - ends + count, count)
            place = np.repeat(place, count)
            rows.append(np.stack((which[use], place - at[use], place)))
        return np.concatenate(rows, axis=1)

    def _least(self, i: int, stretch: str, before: str, after: str) -> int | None:
        item, k = self.items[i][1], int(self.budget[i])
        if not k:
            whole = f"{before}{stretch}{after}"
            at = whole.find(item)
            while at >= 0:
                if (not at or whole[at - 1] == " ") and whole[at + len(item) : at + len(item) + 1] in ("", " "):
                    return 0
                at = whole.find(item, at + 1)
            return None
        if item in stretch:
            return 0
        if sum(map(stretch.__contains__, self.grams(i))) < len(self.grams(i)) - k:
            return None
        if len(stretch) > 8 * len(item):
            return least_within(item, stretch, k)
        d = least_distance(item, stretch)
        return d if d <= k else None

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text's place, item's place, least distance) of all items that the texts hold, in order."""
        at, now, size = 0, [], 0
        for r, t in enumerate(texts):
            now.append(normalised(t))
            size += len(now[-1]) + 1
            if size > _AT_ONCE or r == len(texts) - 1:
                yield from ((at + row, i, d) for row, i, d in self._among(now))
                at, now, size = r + 1, [], 0

    def _among(self, bodies: list[str]) -> Iterator[tuple[int, int, int]]:
        # the mark between texts is no character, so no window that holds one is a piece's
        codes = np.concatenate([x for b in bodies for x in (codes_of(b), np.array([0x110000], np.uint32))])
        begin = np.cumsum([0, *(len(b) + 1 for b in bodies)])
        hits = []
        for s in range(0, len(codes), _AT_ONCE):
            hits.append(self._hits(codes[s : s + _AT_ONCE + _WINDOW - 1]))
            hits[-1][1:] += s
        del codes
        item, at, place = np.concatenate(hits, axis=1)
        row = np.searchsorted(begin, place, "right") - 1
        del hits, place
        order = np.lexsort((at, item, row))
        row, item, at = row[order], item[order], at[order]
        reach = self.size[item] + 2 * self.budget[item]
        cut = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > reach[1:])) + 1
        best: dict[tuple[int, int], int] = {}
        for a, b in zip(np.concatenate(([0], cut)).tolist() if len(at) else (), [*cut.tolist(), len(at)], strict=False):
            r, i = int(row[a]), int(item[a])
            k, body, base = int(self.budget[i]), bodies[r], int(begin[r])
            low, high = max(0, int(at[a]) - base - k), int(at[b - 1]) - base + int(self.size[i]) + k
            if best.get((r, i)) != 0 and (d := self._least(i, body[low:high], body[max(0, low - 1) : low], body[high : high + 1])) is not None:
                best[r, i] = min(d, best.get((r, i), d))
        return iter([(r, i, d) for (r, i), d in sorted(best.items())])

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item's place, least distance) of all items that the text holds."""
        return [(i, d) for _, i, d in self.found([text])]


def _blocks(items: DataFrame, item_key: str, item_text: str, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about block_bytes, dealt by a hash."""
    asked = items.select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = int(size // block_bytes) + 1
    return [asked if n == 1 else asked.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b) for b in range(n)]


def _sent(block: DataFrame) -> Broadcast:
    return block.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.1, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document and item that it holds: key, item_key, distance, item_chars."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    wide = items.select(F.col(f"`{item_key}`").alias("k")).schema["k"].dataType.simpleString()
    schema = f"`{key}` {source.schema['key'].dataType.simpleString()}, `{item_key}` {wide}, distance int, item_chars int"
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(wide)

    def finder(sent: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                found = [(r, matcher.items[i][0], d, len(matcher.items[i][1])) for r, i, d in matcher.found(batch.column(1).to_pylist())]
                rows, which, far, chars = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, kind), pa.array(far, pa.int32()), pa.array(chars, pa.int32())], [key, item_key, "distance", "item_chars"])
            relieved()

        return run

    lean(docs.sparkSession)
    blocks, out = _blocks(items, item_key, item_text, block_bytes), None
    for block in blocks:
        sent = _sent(block)
        found = source.mapInArrow(finder(sent), schema)
        if len(blocks) > 1:  # one block of items at a time in the workers
            found = written_for_later(found, "leaks")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.1, block_bytes: int = 32 << 20) -> DataFrame:
    """docs without those that hold an item. Each row is judged where it lies, so nothing is shuffled and ids play no part."""

    def judge(sent: Broadcast) -> Callable:
        @F.pandas_udf("boolean")
        def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(sent.value, rate)
            for texts in parts:
                held = np.zeros(len(texts), bool)
                held[[r for r, _, _ in matcher.found(texts.tolist())]] = True
                yield pd.Series(held)
            relieved()

        return holds

    lean(docs.sparkSession)
    blocks, last = _blocks(items, item_key, item_text, block_bytes), None
    for n, block in enumerate(blocks, 1):
        sent = _sent(block)
        docs = docs.where(~judge(sent)(F.col(f"`{text}`").cast("string")))
        if n < len(blocks):  # one block of items at a time in the workers
            docs, path = written(docs, "clean")
            sent.destroy()
            if last:
                dropped(docs.sparkSession, last)
            last = path
    return docs
