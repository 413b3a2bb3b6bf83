"""Words of an Arrow text column as 64-bit codes, computed over the column's bytes without a loop over rows.

A word is a maximal run of characters from 0-9, A-Z, a-z and everything beyond ASCII; A-Z count as a-z. All bytes of a
UTF-8 character beyond ASCII are 0x80 or more, so runs of bytes are runs of characters."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from veilspark.llm.shared import slices, texts

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words of more bytes than this are rare, and coded one by one.
LONG_WORD = 64
#: Masks of the lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lower_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            t[b] = b
        elif 0x41 <= b <= 0x5A:
            t[b] = b + 32
    return t


LOWER = _lower_table()


class Words(NamedTuple):
    codes: np.ndarray  # uint64, one for each word; equal words have equal codes
    splits: np.ndarray  # words of row r: splits[r] to splits[r + 1]
    starts: np.ndarray  # byte offsets into data
    ends: np.ndarray
    data: np.ndarray  # the bytes, lower-cased; 0 where no word is
    rows: np.ndarray  # byte offset at which each row begins, and the end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _wide(data: np.ndarray) -> np.ndarray:
    """The bytes as whole 64-bit numbers, with zeros after them."""
    out = np.zeros((len(data) >> 3) + 2, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def _eights(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bytes from each place on, `left` or 8 of them, as a number."""
    word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
    both = wide[word] >> bits | (wide[word + 1] << (np.uint64(63) - bits)) << np.uint64(1)
    return both & _LOWEST[np.minimum(left, 8)]


def run_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code of the bytes of each run, which hold no zero; it does not depend on where the run lies.

    Runs of at most 8 bytes have codes of their own; longer ones can share one, so compare them (see same_runs)."""
    size, wide = ends - starts, _wide(data)
    out = mix(_eights(wide, starts, size))
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + _eights(wide, starts[at] + done, size[at] - done))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes of the run beside it (from_ to `to` in others), given that their codes agree."""
    size = ends - starts
    out = size == to - from_
    at, done = np.flatnonzero(out & (size > 8)), 0
    if not len(at):
        return out
    one, two = _wide(data), _wide(others)
    for i in at[size[at] > LONG_WORD].tolist():
        out[i] = data[starts[i] : ends[i]].tobytes() == others[from_[i] : to[i]].tobytes()
    at = at[size[at] <= LONG_WORD]
    while len(at):
        left = size[at] - done
        same = _eights(one, starts[at] + done, left) == _eights(two, from_[at] + done, left)
        out[at[~same]] = False
        done += 8
        at = at[same & (left > 8)]
    return out


def distinct_runs(codes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, beside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each run and the first run of each kind; runs are of one kind if their bytes (and beside) are equal."""
    import pandas as pd

    kinds, names = pd.factorize(codes)
    first = np.empty(len(names), np.int64)
    first[kinds[::-1]] = np.arange(len(kinds) - 1, -1, -1)
    like = first[kinds]
    same = same_runs(data, starts, ends, data, starts[like], ends[like])
    if beside is not None:
        same &= beside == beside[like]
    if not same.all():  # two of them share a code
        raw = data.tobytes()
        values = [(raw[a:b], c) for a, b, c in zip(starts.tolist(), ends.tolist(), beside.tolist() if beside is not None else [0] * len(starts), strict=True)]
        number = {v: i for i, v in enumerate(dict.fromkeys(values))}
        kinds = np.fromiter(map(number.__getitem__, values), np.int64, len(values))
        first = np.empty(len(number), np.int64)
        first[kinds[::-1]] = np.arange(len(kinds) - 1, -1, -1)
    return kinds, first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text bytes of a column without nulls, and each row's offset in them."""
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(column: pa.Array, letters: np.ndarray = LOWER, cut=None) -> Words:
    """Words of all rows of a column; null counts as empty. letters: what each byte counts as, 0 between words.

    cut: a function of these bytes that gives places (not the first) at which a word ends and another begins."""
    raw, off = buffers(texts(column))
    n = len(raw)
    low = letters[raw]
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), np.zeros(len(off), np.int64), none, none, low, off)
    inside = low != 0
    begins = np.empty(n + 1, bool)
    begins[:n] = inside
    begins[n] = False
    begins[1:n] &= ~inside[:-1]
    at_row = off[:-1][off[:-1] < n]
    begins[at_row] = inside[at_row]
    closes = np.empty(n, bool)
    closes[:] = inside
    closes[:-1] &= ~inside[1:]
    last = off[1:-1]
    last = last[(last > 0) & (last <= n)] - 1
    closes[last] = inside[last]
    if cut is not None:
        more = cut(low)
        begins[more], closes[more - 1] = True, True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    codes = run_codes(low, starts, ends)
    return Words(codes, np.searchsorted(starts, off), starts, ends, low, off)


def word_slices(column: pa.Array, max_bytes: int = 1 << 20):
    """(first row, last row, Words) over a column, some max_bytes at a time, so memory does not follow the batch."""
    column = texts(column)
    for a, b in slices(column, max_bytes):
        yield a, b, words_of(column.slice(a, b - a))


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-word windows of one text; a shorter text, unless empty, is one window."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    n = len(codes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + codes[i : i + n] + np.uint64(i + 1))
    return out
