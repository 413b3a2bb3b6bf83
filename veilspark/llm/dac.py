"""Directly addressable codes: integers in byte-wide levels, with continuation bitmaps and rank directories.

Level 0 holds each value's low 8 bits; its bitmap says which values go on, and these have their next 8 bits in level 1,
in order, and so on. The place of a value in the next level is the number of set bits before it: a directory entry for
each 512 bits plus a popcount. So any value is read in as many steps as it has bytes, without decoding others.

A file: magic, a JSON header with each part's dtype, offset and length, then the parts. Beside the codes it keeps the
document directory: document ids, a bitmap of null ids, and the token position at which each document begins."""

from __future__ import annotations

import io
import json
import struct

import numpy as np

MAGIC = b"DACF1\n"
BLOCK_BITS = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Levels:
    def __init__(self, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray], n: int):
        self.chunks, self.bitmaps, self.ranks, self.n = chunks, bitmaps, ranks, n

    @classmethod
    def encode(cls, values: np.ndarray) -> Levels:
        left = np.ascontiguousarray(values)
        left = left if left.dtype.kind == "u" else left.astype(np.uint64)
        n, chunks, bitmaps, ranks = len(left), [], [], []
        while True:
            chunks.append(left.astype(np.uint8))
            more = left > 255
            if not more.any():
                return cls(chunks, bitmaps, ranks, n)
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits)
            per = BLOCK_BITS // 8
            padded = np.concatenate([_ONES[bits], np.zeros(-len(bits) % per, np.uint8)]).reshape(-1, per)
            ranks.append(np.concatenate([[0], np.cumsum(padded.sum(axis=1, dtype=np.int64))]).astype(np.int64))
            left = left[more] >> left.dtype.type(8)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = at // BLOCK_BITS
        out = self.ranks[level][block].copy()
        byte = at >> 3
        for i, (b, end) in enumerate(zip(block * (BLOCK_BITS // 8), byte, strict=True)):
            out[i] += int(_ONES[self.bitmaps[level][b:end]].sum())
        low = self.bitmaps[level][np.minimum(byte, len(self.bitmaps[level]) - 1)] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return out + np.where(at & 7, _ONES[low], 0)

    def access(self, positions) -> np.ndarray:
        """Values at any positions."""
        at = np.atleast_1d(np.asarray(positions, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the codes")
        out, who = np.zeros(len(at), np.uint64), np.arange(len(at))
        for level, chunk in enumerate(self.chunks):
            out[who] |= chunk[at].astype(np.uint64) << np.uint64(8 * level)
            if level == len(self.bitmaps):
                break
            go = (self.bitmaps[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at, who = self._rank(level, at[go]), who[go]
            if not len(who):
                break
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b: two ranks for each level, then plain copies."""
        out = np.zeros(max(0, b - a), np.uint64)
        who = np.arange(len(out))
        for level, chunk in enumerate(self.chunks):
            out[who] |= chunk[a:b].astype(np.uint64) << np.uint64(8 * level)
            if level == len(self.bitmaps) or b <= a:
                break
            bits = np.unpackbits(self.bitmaps[level][a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a] == 1
            lo = int(self._rank(level, np.array([a]))[0])
            who = who[bits]
            a, b = lo, lo + len(who)
        return out


def _header(f) -> tuple[dict, int]:
    """The header of an open file, and where the parts begin."""
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack("<I", f.read(4))
    return json.loads(f.read(size)), len(MAGIC) + 4 + size


def stored_token(f, position: int) -> int:
    """The value at a position of an open file, of which it reads the header and, for each level, one directory entry and
    at most a block of the bitmap."""
    head, base = _header(f)
    place = {name: (np.dtype(kind), at) for name, kind, at, _ in head["parts"]}
    if not 0 <= position < head["n"]:
        raise IndexError("position outside the codes")

    def read(name: str, first: int, count: int) -> np.ndarray:
        kind, at = place[name]
        f.seek(base + at + first * kind.itemsize)
        return np.frombuffer(f.read(count * kind.itemsize), kind)

    out = level = 0
    while True:
        out |= int(read(f"chunk{level}", position, 1)[0]) << 8 * level
        if f"bits{level}" not in place:
            return out
        block = position // BLOCK_BITS
        first, bit = block * (BLOCK_BITS // 8), position & 7
        bits = read(f"bits{level}", first, (position >> 3) - first + 1)
        if not bits[-1] >> bit & 1:
            return out
        position = int(read(f"rank{level}", block, 1)[0]) + int(_ONES[bits[:-1]].sum()) + int(_ONES[bits[-1] & ((1 << bit) - 1)])
        level += 1


class TokenFile:
    """One file: codes of many documents' tokens, one after another."""

    def __init__(self, levels: Levels, doc_ids: np.ndarray, null_ids: np.ndarray, starts: np.ndarray):
        self.levels, self.doc_ids, self.null_ids, self.starts = levels, doc_ids, null_ids, starts

    def __len__(self) -> int:
        return len(self.doc_ids)

    def token(self, position: int) -> int:
        return int(self.levels.access(position)[0])

    def tokens(self, doc: int) -> np.ndarray:
        """Ids of the file's doc-th document."""
        return self.levels.slice(int(self.starts[doc]), int(self.starts[doc + 1])).astype(np.uint32)

    def dump(self) -> bytes:
        parts = [("doc_ids", self.doc_ids.astype(np.int64)), ("null_ids", np.packbits(self.null_ids.astype(bool), bitorder="little")), ("starts", self.starts.astype(np.int64))]
        for i, c in enumerate(self.levels.chunks):
            parts.append((f"chunk{i}", c))
        for i, (b, r) in enumerate(zip(self.levels.bitmaps, self.levels.ranks, strict=True)):
            parts += [(f"bits{i}", b), (f"rank{i}", r)]
        at, head, body = 0, [], []
        for name, a in parts:
            raw = a.tobytes()
            head.append([name, a.dtype.str, at, len(raw)])
            pad = -len(raw) % 8
            body.append(raw + b"\0" * pad)
            at += len(raw) + pad
        text = json.dumps({"n": self.levels.n, "docs": len(self.doc_ids), "parts": head}).encode()
        return MAGIC + struct.pack("<I", len(text)) + text + b"".join(body)

    @classmethod
    def load(cls, raw: bytes) -> TokenFile:
        head, base = _header(io.BytesIO(raw))
        part = {name: np.frombuffer(raw, np.dtype(kind), length // np.dtype(kind).itemsize, base + at) for name, kind, at, length in head["parts"]}
        many = lambda p: [part[f"{p}{i}"] for i in range(sum(k.startswith(p) and k[len(p) :].isdigit() for k in part))]
        nulls = np.unpackbits(part["null_ids"], bitorder="little")[: head["docs"]].astype(bool)
        return cls(Levels(many("chunk"), many("bits"), many("rank"), head["n"]), part["doc_ids"], nulls, part["starts"])
