"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are marked as the model's file says (spaces become the mark, one before the text) and cut into marked words: at
each run of marks, and wherever no piece holds the two characters side by side, as no segmentation crosses these. The
distinct words, sorted, are the leaves of a trie in depth-first order: a pass keeps the forward column of the current
path and, for the next word, goes back to the common prefix and extends it from there, so each prefix is scored once.

For a unigram model a forward cell holds the best score of its prefix and the last piece. For a merge (BPE) model, of
which the scores are merge ranks, the best sum of scores is not the library's result; there the cell holds the one last
piece with which the prefix's merging ends: a candidate follows its predecessor if merging the two leaves them as they
are. Either way the cells depend on the prefix alone, and ids equal the library's.

Decoding joins the pieces, bytes for byte pieces, and takes the mark before the text away again.

Cases: null and empty texts have no ids and decode to the empty string; characters without a piece become byte pieces,
or the unknown id where the model has none; a mark in a text is taken for a space (in these two cases alone a text does
not return whole); texts are encoded whole, however
long; repeated rows are alike; an empty table gives no rows; kept columns may have any names."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import Memo, slices, texts, trimmed
from veilspark.llm.wordcodes import LONG_WORD, buffers, distinct_runs, mix, words_of

MARK = "▁"
#: Every byte but the space is part of a word; NUL counts as the byte that UTF-8 never has.
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[0x20] = 0
WORD_BYTES[0] = 0xFF

# Fixed values of the model file (a protocol buffer): piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        elif kind == 2:
            size = number()
            value = raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, raw: bytes, model_type: int | None = None):
        self.pieces, self.scores, self.types = [], [], []
        self.type, self.dummy, self.strip, self.escape, self.unknown = UNIGRAM, True, True, True, 0
        for f, v in _fields(raw):
            if f == 1:
                d = dict(_fields(v))
                self.pieces.append(d.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.types.append(d.get(3, NORMAL))
            elif f == 2:
                self.type = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                d = dict(_fields(v))
                if d.get(2):
                    raise ValueError("only identity normalization is supported")
                self.dummy, self.strip, self.escape = (bool(d.get(k, 1)) for k in (3, 4, 5))
        self.type = model_type or self.type
        if self.type not in (UNIGRAM, BPE) or USER in self.types or UNUSED in self.types or not self.escape:
            raise ValueError("a unigram or merge model with plain pieces is needed")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.score = {p: self.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        byte = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if len(byte) == 256 else None
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: the longest piece that ends with three characters
        self.reach: dict[str, int] = {}
        for p in self.ids:
            self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        self.cut_at_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)

    def id_list(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


class SharedPrefix:
    """Segments distinct words in sorted order, reusing the forward column of common prefixes; `most` bounds the memo of pairs."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most, self.fits = model, most, {}
        self.floor = min(model.score.values(), default=0.0) - UNKNOWN_PENALTY

    def merged(self, text: str) -> list[str]:
        """Merging by score: the best neighbouring pair first, leftmost at ties."""
        part, score = list(text), self.model.score
        while len(part) > 1:
            best, at = None, -1
            for i in range(len(part) - 1):
                s = score.get(part[i] + part[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def follows(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            known = self.fits[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def segment(self, words: list[str]):
        """(word, its pieces) for distinct words, in sorted order."""
        unigram = self.model.type == UNIGRAM
        last: list[str] = [""]  # the forward column: last piece of each prefix
        best: list[float] = [0.0]
        before = ""
        for word in sorted(words):
            n = min(len(word), len(before))
            same = 0
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1 :], best[same + 1 :]
            if unigram:
                for end in range(same + 1, len(word) + 1):
                    self._best(word, end, last, best)
            else:
                self._follow(word, same, last)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            before = word
            yield word, out[::-1]

    def _follow(self, word: str, done: int, last: list[str]) -> None:
        ids, reach, fits = self.model.ids, self.model.reach, self.fits
        for end in range(done + 1, len(word) + 1):
            most = reach.get(word[end - 3 : end], 2) if end > 2 else end
            for begin in range(end - most if end > most else 0, end):
                piece = word[begin:end]
                if piece in ids or begin == end - 1:
                    fit = fits.get((last[begin], piece))
                    if fit or (fit is None and self.follows(last[begin], piece)):
                        last.append(piece)
                        break
            else:
                raise ValueError(f"no piece ends {word[:end]!r}")

    def _best(self, word: str, end: int, last: list[str], best: list[float]) -> None:
        score, top, pick = self.model.score, None, ""
        for begin in range(max(0, end - self.model.longest), end):
            s = score.get(word[begin:end])
            if s is None and begin == end - 1:
                s = self.floor
            if s is not None and (top is None or best[begin] + s > top):
                top, pick = best[begin] + s, word[begin:end]
        last.append(pick)
        best.append(top)


class Codec:
    """Encodes columns of texts; `most` bounds the memo of words."""

    def __init__(self, model: Model, most: int = 900_000):
        self.model, self.search, self.known = model, SharedPrefix(model), Memo(most)
        if not model.cut_at_marks or not model.dummy or model.strip:
            raise ValueError("the model must mark word beginnings, add one mark before a text and keep white space")
        self.kind = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self.codes = {p: np.array([i], self.kind).tobytes() for p, i in model.ids.items()}
        out = [bytes([model.bytes.index(i)]) if t == BYTE and model.bytes else p.replace(MARK, " ").encode() if t == NORMAL else b"" for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True))]
        out[model.unknown] = " ⁇ ".encode()
        self.size = np.array([len(x) for x in out], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    def forget(self) -> None:
        """Empties the memos."""
        self.known = Memo(self.known.most)
        self.search.fits.clear()

    def parts(self, unit: str) -> list[str]:
        """A marked word, cut where no piece holds both neighbours."""
        pairs, at, out = self.model.pairs, 0, []
        if all(map(pairs.__contains__, map(str.__add__, unit, unit[1:]))):
            return [unit]
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                out.append(unit[at:i])
                at = i
        out.append(unit[at:])
        return out

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct marked words."""
        cut = [self.parts(u) for u in units]
        known, codes = {}, self.codes
        for word, pieces in self.search.segment(list({p for ps in cut for p in ps})):
            try:
                known[word] = b"".join([codes[p] for p in pieces])
            except KeyError:  # a character without a piece
                known[word] = np.array([i for p in pieces for i in self.model.id_list(p)], self.kind).tobytes()
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in cut]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a text column without nulls, and how many each row has."""
        if MARK.encode() in buffers(column)[0].tobytes():
            column = pc.replace_substring(column, MARK, " ")  # the library cannot tell the two apart either
        w = words_of(column, WORD_BYTES)
        codes, starts, ends, splits = w.codes, w.starts, w.ends, w.splits
        row = np.repeat(np.arange(len(column)), np.diff(splits))
        previous = np.concatenate([[0], ends[:-1]])
        first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        gap = np.where(first, starts - w.rows[row] + 1, starts - previous)
        filled = np.diff(splits) > 0
        last = np.where(filled, ends[np.maximum(splits[1:] - 1, 0)] if len(ends) else 0, w.rows[:-1])
        tail = np.flatnonzero(w.rows[1:] > last)  # white space at a text's end is a word of marks alone
        if len(tail):
            more = last[tail]
            marks = w.rows[1:][tail] - more + ~filled[tail]
            codes = np.concatenate([codes, np.zeros(len(tail), np.uint64)])
            starts, ends, gap = np.concatenate([starts, more]), np.concatenate([ends, more]), np.concatenate([gap, marks])
            row = np.concatenate([row, tail])
            order = np.lexsort((starts, row))
            codes, starts, ends, gap, row = (x[order] for x in (codes, starts, ends, gap, row))
        odd = np.flatnonzero(gap != 1)
        codes[odd] = mix(codes[odd] + gap[odd].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kinds, at = distinct_runs(codes, w.data, starts, ends, gap)
        raw = buffers(column)[0].tobytes()
        spans = list(zip(starts[at].tolist(), ends[at].tolist(), gap[at].tolist(), strict=True))
        keys = [raw[a:b] if g == 1 else (g, raw[a:b]) for a, b, g in spans]
        found = self.known.get_all(keys)
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.units([MARK * g + raw[a:b].decode("utf-8", "surrogatepass") for a, b, g in (spans[i] for i in new)]), strict=True):
            found[i] = ids
            if spans[i][1] - spans[i][0] + spans[i][2] <= LONG_WORD:
                self.known.now[keys[i]] = ids
        flat = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        each = size[kinds]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begin[kinds] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.bincount(row, each, len(column)).astype(np.int64) if len(row) else np.zeros(len(column), np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids."""
        size = self.size[ids]
        upto = np.cumsum(size)
        raw = self.flat[np.repeat(self.begin[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = np.concatenate([[0], upto])[np.cumsum(counts)].tolist()
        if not ends:
            return []
        return [raw[a + (raw[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The worker's codec of a model file: workers live on between tasks, and so do its memos."""
    if path not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path] = Codec(Model(f.read()))
    return _CODECS[path]


def encode_texts(docs: DataFrame, model_path: str, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """The kept columns (as k0, k1, ...), ids, and decoded: the text that the ids give back.

    The memos go with each task, as this is a stage among others that need the workers' memory."""

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            column = texts(batch.column(batch.num_columns - 1))
            for a, b in slices(column, slice_bytes):
                ids, n = codec.encode(column.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), lists, pa.array(codec.decode(ids, n), pa.string())], [*batch.schema.names[:-1], "ids", "decoded"])
        codec.forget()

    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("t")).mapInArrow(trimmed(run), kinds + "ids array<int>, decoded string")


def digest_texts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip: the ids give the text back."""

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            column = texts(batch.column(1))
            for a, b in slices(column, slice_bytes):
                own = column.slice(a, b - a)
                ids, n = codec.encode(own)
                ends = np.concatenate([[0], np.cumsum(n)]).tolist()
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                same = [x == y for x, y in zip(codec.decode(ids, n), own.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(crc, pa.int64()), pa.array(same)], ["id", "n_tokens", "ids_crc32", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(trimmed(run), f"id {kind}, n_tokens long, ids_crc32 long, round_trip boolean")
    return found.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilspark.llm.shared import table

    return digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
