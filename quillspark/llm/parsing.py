"""Prefix-free parsing: corpus order of texts from suffix arrays of dictionary and parse."""

from __future__ import annotations

import numpy as np

from quillspark.llm.shingles import mix

#: Bytes of a trigger, and one trigger in so many windows; 0xFF is in no UTF-8 text.
TRIGGER, MODULUS, END = 8, 24, 0xFF


def eight(data: np.ndarray) -> np.ndarray:
    """Big-endian integer of the eight bytes from each position (zeros after the end)."""
    x = np.zeros(len(data) + 7, np.uint64)
    x[: len(data)] = data
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row among the distinct rows, later keys breaking ties of earlier ones."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    for k in keys[1:]:
        out = np.unique((out << np.uint64(32)) | k.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return out


def suffix_ranks(first: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling; equal suffixes get equal ranks.

    ``first`` ranks the first ``step`` symbols; ``left`` is how many symbols a
    suffix has up to its string's end, beyond which nothing is compared.
    """
    rank, n = first + np.uint64(1), len(first)
    longest = int(left.max()) if n else 0
    while step < longest:
        ahead = np.zeros(n, np.uint64)
        at = np.flatnonzero(left > step)
        ahead[at] = rank[at + step]
        finer = _dense(rank, ahead) + np.uint64(1)
        if finer.max() == rank.max():
            return finer
        rank, step = finer, 2 * step
    return rank


def corpus_order(text: np.ndarray, ends: np.ndarray, want: np.ndarray) -> np.ndarray:
    """``want`` (positions in ``text``) in lexicographic order of their suffixes.

    ``text`` is bytes of strings that each end with ``TRIGGER`` end marks;
    ``ends`` are the positions of those marks.  Phrases run from a trigger to
    the end of the next, so no phrase's suffix that is longer than a trigger is
    a prefix of another; a position is ordered by the rank of its phrase's rest
    and then by the rank of the parse that follows.
    """
    x = eight(text)
    trigger = mix(x) % np.uint64(MODULUS) == 0
    trigger[ends] = True
    trigger[len(text) - TRIGGER + 1 :] = False
    # A trigger that reaches into end marks would tie strings together.
    for back in range(1, TRIGGER):
        trigger[ends - back] = False
        inside = ends + back
        trigger[inside[inside < len(text)]] = False
    trigger[0] = True
    starts = np.flatnonzero(trigger)
    stops = np.append(starts[1:] + TRIGGER, len(text))
    lengths = stops - starts
    # Dictionary: distinct phrases, told apart by content (a hash finds them, bytes decide).
    weight = mix(np.arange(int(lengths.max()), dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.repeat(starts, lengths) + offset
    mixed = mix(text[place].astype(np.uint64) + np.uint64(1)) * weight[offset]
    total = mix(np.add.reduceat(mixed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    _, one, phrase = np.unique(total, return_index=True, return_inverse=True)
    d_len = lengths[one]
    d_start = np.cumsum(d_len) - d_len
    d_off = np.arange(int(d_len.sum())) - np.repeat(d_start, d_len)
    d_place = np.repeat(starts[one], d_len) + d_off
    d_left = np.repeat(d_len, d_len) - d_off
    same = text[place] == text[np.repeat(starts[one][phrase], lengths) + offset] if (lengths == d_len[phrase]).all() else None
    if same is None or not same.all():
        raise ValueError("two phrases share a hash")
    head, short = x[d_place], np.minimum(d_left, 8)
    head = np.where(short < 8, head >> (np.uint64(64) - short.astype(np.uint64) * np.uint64(8)) << (np.uint64(64) - short.astype(np.uint64) * np.uint64(8)), head)
    d_rank = suffix_ranks(_dense(head, short), d_left, 8)
    # Parse: phrases in their lexicographic order, then the order of the parse's suffixes.
    symbol = _dense(d_rank[d_start])[phrase]
    n = len(symbol)
    p_rank = suffix_ranks(symbol, n - np.arange(n), 1)
    own = np.searchsorted(starts, want, side="right") - 1
    rest = d_rank[d_start[phrase[own]] + want - starts[own]]
    follow = np.append(p_rank, 0)[own + 1]
    return want[np.lexsort((follow, rest))]


def repeated(text: np.ndarray, ends: np.ndarray, want: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Of each position in ``want``: does the same ``width``-byte string start at one of smaller ``order``?

    ``want`` is ascending, and each of its strings lies before its end mark.
    """
    if not len(want):
        return np.zeros(0, bool)
    sorted_at = corpus_order(text, ends, want)
    x = eight(text)
    a, b = sorted_at[:-1], sorted_at[1:]
    same = np.ones(len(a), bool)
    for k in [*range(0, width - 7, 8), width - 8]:
        same &= x[a + k] == x[b + k]
    heads = np.flatnonzero(np.append(True, ~same))
    key = order[np.searchsorted(want, sorted_at)]
    least = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(key))))
    out = np.zeros(len(want), bool)
    out[np.searchsorted(want, sorted_at)] = key > least
    return out
