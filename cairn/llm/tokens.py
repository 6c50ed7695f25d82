"""Token ids of whole texts with a public tokenizer file, and each distinct word encoded once per worker.

Where a tokenizer provably never lets a token cross a word boundary, its ids for a text are those of the words in turn.
The words are cut out as bytes, told apart by Arrow, the distinct ones looked up in a memo, and only unknown ones go through
the tokenizers library, as texts of many words with a marker word after each. At a fixed number of words the memo forgets those met once, so memory is
bounded. Texts that hold an added token's string, texts with white space outside ASCII where that matters, and any other
tokenizer go through the library whole. All settings of the library stay as the file gives them: a special token's string
in a text becomes that token, and ``add_special_tokens=False`` adds none.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import blocks, relieved

#: Which bytes are white space in ASCII.
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: White space outside ASCII, in UTF-8.
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Words in the memo and of those in an idle worker, and unknown words in one text.
MEMO, IDLE, TOGETHER = 800_000, 300_000, 256
#: A word that no other is joined to, for its white space; words that hold its character are encoded alone.
_MARK = " \0"


class _Memo(dict):
    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """ids of texts as the tokenizers library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        norm, pre, model = plan.get("normalizer"), plan.get("pre_tokenizer") or {}, plan["model"]
        added = plan.get("added_tokens", [])
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in added), re.I) if added else None  # words are cut in lower case
        # a token that is sought in normalised text may not be seen in the raw one
        plain = model.get("type") == "BPE" and not model.get("dropout") and not (norm and any(x.get("normalized") for x in added))
        self.led = plain and not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        self.apart = plain and steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        mark = self._plain([_MARK])[0] if self.led or self.apart else []
        self.mark = np.array(mark, np.uint32) if mark and mark[-1] not in self._plain([" a.b"])[0] else None
        # ASCII words come here in lower case, which the normaliser of such a tokenizer leaves as they are
        self.bare = Tokenizer(self.tokenizer.model) if self.apart else self.tokenizer
        if self.apart:
            self.bare.pre_tokenizer = self.tokenizer.pre_tokenizer
        # ids whose token starts with a space, or ends a word: they tell simple words apart without a marker
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True) if self.led or self.apart else {}
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.led else t.endswith("</w>"))]] = True
        self._clear()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self._plain([w.decode("utf-8") for w in words])
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, words: list[bytes], by: object) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are led by one space, or have letters only: just one token of each has an edge."""
        text = (b"" if self.led else b" ").join(words).decode("utf-8")
        ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self._marked(words, by)
        return ids, np.diff(at, append=len(ids)) if self.led else np.diff(at, prepend=-1)

    def _marked(self, words: list[bytes], by: object) -> tuple[np.ndarray, np.ndarray]:
        after = _MARK.encode() if self.led else _MARK.encode() + b" "
        ids = np.array(by.encode_batch_fast([(after.join(words) + after).decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.mark[-1])
        if len(ends) != len(words):
            raise ValueError("the marker word was lost")
        keep = np.ones(len(ids), bool)
        for i in range(len(self.mark)):
            keep[ends - i] = False
        return ids[keep], np.diff(ends, prepend=-1) - len(self.mark)

    def _clear(self) -> None:
        self.memo, self.flat, self.size = _Memo(), np.empty(1 << 16, np.uint32), 0
        self.start, self.count, self.met = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def forget(self, most: int) -> None:
        """Keep the words met more than once, or where these are more than most, those met oftenest."""
        n = len(self.memo)
        met = self.met[:n]
        floor = 1 if (met > 1).sum() <= most else int(np.partition(met, n - most)[n - most])
        keep = np.flatnonzero(met > floor)
        words = np.array(list(self.memo), object)[keep].tolist()
        start, count, flat, met = self.start[keep], self.count[keep].astype(np.int64), self.flat, met[keep] // 2
        self.memo.clear()
        self._clear()
        self.memo.update(zip(words, range(len(words)), strict=True))
        ends = np.cumsum(count)
        self.flat = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + count, count)]
        self.start, self.count, self.met, self.size = ends - count, count.astype(np.int32), met, len(self.flat)

    def _learn(self) -> None:
        new = self.memo.new
        need, at = len(self.memo), len(self.memo) - len(new)
        nul = b"\0" in b"".join(new)
        if self.mark is None:
            odd = list(range(len(new)))
        elif self.led:
            odd = [i for i, w in enumerate(new) if w[0] > 32 or w[-1] < 33 or nul and b"\0" in w]
        else:
            odd = [i for i, w in enumerate(new) if b"\0" in w] if nul else []
        skip = set(odd)
        plain = [i for i in range(len(new)) if i not in skip] if odd else range(len(new))
        plainly = list(map(bytes.isascii, new)) if self.apart else []
        easy = [i for i in plain if new[i].isalpha()] if self.apart else [i for i in plain if new[i][0] == 32 and new[i][1] > 32]
        eased = set(easy)
        rest = [i for i in plain if i not in eased]
        some, rest = [i for i in rest if self.apart and plainly[i]], [i for i in rest if not self.apart or not plainly[i]]
        # ASCII words of a tokenizer with a normaliser are as it leaves them
        groups = [(easy, self.bare, self._joined), (some, self.bare, self._marked), (rest, self.tokenizer, self._marked)]
        got = [how([new[j] for j in part[i : i + TOGETHER]], by) for part, by, how in groups for i in range(0, len(part), TOGETHER)]
        plain = [*easy, *some, *rest]
        if odd:
            got.append(self._apart([new[i] for i in odd]))
        flat, count = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        where = at + np.concatenate([np.asarray(x, np.int64) for x in (plain, odd)])
        if need > len(self.start):
            self.start, self.count, self.met = (np.concatenate((x, np.zeros(need, x.dtype))) for x in (self.start, self.count, self.met))
        if self.size + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(self.size + len(flat), np.uint32)))
        self.flat[self.size : self.size + len(flat)] = flat
        self.start[where] = self.size + np.cumsum(count) - count
        self.count[where] = count
        self.size += len(flat)
        new.clear()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) in a row, and how many each has."""
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        if not whole:
            return self._by_words(texts)
        if len(whole) == len(texts):
            return self._apart(texts)
        chosen = set(whole)
        rest = [i for i in range(len(texts)) if i not in chosen]
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for some, (ids, n) in ((whole, self._apart([texts[i] for i in whole])), (rest, self._by_words([texts[i] for i in rest]))):
            for i, part in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = part
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _whole(self, text: bytes) -> bool:
        """Whether only the library's own way from text to ids is sure."""
        return not (self.led or self.apart) or self.added is not None and bool(self.added.search(text)) or self.led and not text.isascii() and bool(_ODD_SPACE.search(text))

    def _cut(self, texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The words of all texts in a row, and how many each text has: led by their white space, or without it in lower case."""
        joined = b"".join(texts)
        raw = np.frombuffer(joined if self.led else joined.lower(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        space = _SPACE[raw]
        first = np.zeros(len(raw), bool)
        first[np.concatenate(([0], ends[:-1]))[np.diff(ends, prepend=0) > 0]] = True
        if self.led:
            first[1:] |= space[1:] & ~space[:-1]
            start = np.flatnonzero(first)
            size = np.diff(start, append=len(raw))
        else:
            after = np.roll(space, 1) | first
            start = np.flatnonzero(~space & after)
            last = np.flatnonzero(~space & (np.roll(space, -1) | np.roll(first, -1)))
            if len(raw) and not space[-1] and (not len(last) or last[-1] != len(raw) - 1):
                last = np.append(last, len(raw) - 1)
            size, raw = last + 1 - start, raw[~space]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
        return words, np.diff(np.searchsorted(start, ends), prepend=0)

    def _by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO:
            self.forget(MEMO // 2)
        words, n = self._cut(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        which = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if self.memo.new:
            self._learn()
        seen = np.bincount(which)
        self.met[: len(seen)] += seen
        count, start = self.count[which].astype(np.int64), self.start[which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(start - ends + count, count)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
        return ids, np.diff(upto)


_KNOWN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _KNOWN:
        _KNOWN[path] = Encoder(path)
    return _KNOWN[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """For batches of (key, text): keys, and each text's ids with ``end`` after them."""
    e, tail = encoder(path), np.array([end], np.uint32)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for first, some in blocks(x.as_py() for x in texts):
            ids, counts = e.encode(some)
            cuts = np.concatenate(([0], np.cumsum(counts)))
            yield batch.column(0).slice(first, len(some)), [np.concatenate((ids[a:b], tail)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    # an executor may hold more workers than cores, and idle ones keep what they have
    if len(e.memo) > IDLE:
        e.forget(IDLE)
    relieved()


def width(path: str, end: int) -> np.dtype:
    """Two bytes an id where the vocabulary allows it, else four."""
    return np.dtype("<u2" if max(encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else "<u4")
