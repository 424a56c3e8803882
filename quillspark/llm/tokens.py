"""Token ids of whole texts, by the tokenizers library, a distinct piece at a time.

Both supported vocabularies split a text into pieces by a regular expression and
then encode each piece alone, so a text's ids are its pieces' ids joined.  Texts
repeat their pieces, and the library is asked for each distinct piece once per
worker.  Texts with characters outside Latin ranges, whose classes might differ
between Unicode versions, go through the library whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

#: Characters of the fast path: ASCII without rare controls, Latin-1, Latin Extended-A without U+0130, some punctuation.
_RARE = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ſ‐-‧€]")
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", " \t\n\r\xa0"
#: The pre-tokenizers' patterns within those characters.
_SPLIT = {
    "byte": re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"),
    "word": re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"),
}
#: Pieces that a worker remembers, in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 500_000, 40
#: Characters of texts that are split before their new pieces are encoded together.
TOGETHER = 500_000

_encoders: dict[tuple[str, str], "Encoder"] = {}
#: The C library that this process runs on; only some have malloc_trim.
_libc = ctypes.CDLL(None)


class _Pieces(dict):
    """Piece to its ids as little-endian 32-bit integers; the older generation goes when full."""

    def __init__(self, tokenizer):
        self.tokenizer, self.older = tokenizer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST:
            self.put(piece, ids)
        return ids

    def put(self, piece: str, ids: bytes) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids


class Encoder:
    """``kind`` is the vocabulary's way to split: "byte" or "word"."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that spell an added token go through the library whole, which gives that token's id.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.split, self.lower = _Pieces(self.tokenizer), _SPLIT[kind].findall, kind == "word"

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; new pieces of many texts go to the library in one call."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        rare = [_RARE.search(t) is not None or any(a in t for a in self.added) for t in texts]
        pieces = [() if r else self.split(t.lower() if self.lower else t) for t, r in zip(texts, rare)]
        self._learn(set(chain.from_iterable(pieces)))
        for text, whole, parts in zip(texts, rare, pieces):
            if whole:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(map(self.pieces.__getitem__, parts))

    def _learn(self, distinct: set[str]) -> None:
        """Encode new pieces of one space and letters (letters alone, for "word") as one text, which splits at just these pieces."""
        known, older = self.pieces, self.pieces.older
        new = [p for p in distinct if p not in known and p not in older and len(p) <= LONGEST and (p.isalpha() if self.lower else p[0] == " " and p[1:].isalpha())]
        for some in (new[i : i + 300] for i in range(0, len(new), 300)):
            found = self.tokenizer.encode((" " if self.lower else "").join(some), add_special_tokens=False)
            words = np.array(found.word_ids)
            ids, cuts = np.array(found.ids, np.uint32), np.flatnonzero(np.diff(words, prepend=-1))
            if len(cuts) == len(some):
                data, ends = ids.tobytes(), [*cuts[1:].tolist(), len(ids)]
                for piece, at, end in zip(some, cuts.tolist(), ends):
                    known.put(piece, data[4 * at : 4 * end])


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    if (path, kind) not in _encoders:
        forget()
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def hand_back() -> None:
    """Return this worker's free memory to the system: workers wait for later stages, and allocators keep what they once had."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def forget() -> None:
    """Drop what this worker's encoders remember; workers are shared by stages, and the next may need the memory."""
    _encoders.clear()
    hand_back()


def handing_back(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over batches, after which the worker returns its free memory."""
    def whole(batches: Iterable) -> Iterator:
        yield from run(batches)
        hand_back()

    return whole
