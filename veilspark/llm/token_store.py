"""Token ids of documents as files of directly addressable codes (see dac.py), in ascending id order.

Rows are range-partitioned and sorted by (id, hash of the text), so a repeated id can spread over tasks; the number of
ranges follows the input. Each task encodes whole texts in their order and writes a file into the shared folder whenever
`file_tokens` are held, so its memory is that of one file; under a name of its own attempt that is then moved into
place, so a repeated or lost task leaves whole files, the same ones. A table of each file's documents and tokens (one row
a file) gives the position at which each file begins; a task reads one file at a time, and read_token() a few bytes.

Encoding cuts a text at spaces, tabs and line feeds, which the vocabulary's file drops and never merges across; each
distinct piece goes through the tokenizers library once and, unless it is long, stays in a memo of bounded size that a
worker keeps between tasks. Plain words go in lower case, without the sign after them and many to a call: each one's ids end with a
token that closes a word.

Cases: null texts count as empty and hold the end id alone; null ids come first and stay null; repeated rows each have
their tokens; an empty table gives no files and no rows; other columns are ignored."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.dac import Levels, TokenFile, stored_token
from veilspark.llm.shared import Memo, materialize, new_dir, slices, texts, trimmed
from veilspark.llm.wordcodes import LONG_WORD, buffers, distinct_runs, words_of


SIGNS = ".,;:!?"
#: Pieces are cut at spaces, tabs and line feeds; NUL counts as the byte that UTF-8 never has.
PIECE_BYTES = np.arange(256, dtype=np.uint8)
PIECE_BYTES[[0x20, 0x09, 0x0A]] = 0
PIECE_BYTES[0] = 0xFF
#: The same with A-Z as a-z, which the vocabulary's file does too; not where a special string could arise from it.
LOWER_BYTES = PIECE_BYTES.copy()
LOWER_BYTES[0x41:0x5B] += 32
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWER, _LATIN = np.zeros(256, bool), np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_LATIN[0x9F:0xC0] = True  # after 0xC3: U+00DF to U+00FF
_LATIN[0xB7] = False  # a sign


def last_signs(data: np.ndarray) -> np.ndarray:
    """Signs between a letter and white space: pieces of their own, as the vocabulary's file splits them."""
    at = np.flatnonzero(_SIGN[data])
    at = at[(at > 0) & (at < len(data) - 1)]
    return at[_LETTER[data[at - 1]] & (data[at + 1] == 0)]


def plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pieces are a-z and lower-case letters of Latin-1 alone: these merge with no sign beside them."""
    odd = ~_LOWER[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[_LATIN[data[two + 1]]]
    odd[two] = odd[two + 1] = False
    count = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
    return count[ends] == count[starts]


class Encoder:
    """Token ids of whole texts; `most` bounds the memo of pieces."""

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.memo = Tokenizer.from_file(path), Memo(most)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _library(self, values: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(values, add_special_tokens=False)]

    def _words(self, new: list[bytes], group: int = 500) -> list[bytes]:
        """Ids of plain words, many to a call: each ends with the only token of its own that closes a word."""
        size, out = self.kind.itemsize, []
        for a in range(0, len(new), 40 * group):
            parts = [new[i : i + group] for i in range(a, min(len(new), a + 40 * group), group)]
            for part, raw in zip(parts, self._library([b" ".join(p).decode() for p in parts]), strict=True):
                ends = ((np.flatnonzero(self.closes[np.frombuffer(raw, self.kind)]) + 1) * size).tolist()
                if len(ends) == len(part) and ends[-1] == len(raw):
                    out += [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                else:
                    out += self._library([w.decode() for w in part])
        return out

    def _learn(self, pieces: list[bytes], are_plain: list[bool]) -> list[bytes]:
        """Ids of distinct pieces."""
        words = iter(self._words([p for p, ok in zip(pieces, are_plain, strict=True) if ok]))
        other = [p.decode() for p, ok in zip(pieces, are_plain, strict=True) if not ok]
        rest = iter([ids for a in range(0, len(other), 20_000) for ids in self._library(other[a : a + 20_000])])
        return [next(words if ok else rest) for ok in are_plain]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a text column without nulls, and how many each row has."""
        raw = buffers(column)[0].tobytes()
        w = words_of(column, PIECE_BYTES if b"<|" in raw else LOWER_BYTES, last_signs)
        kinds, first = distinct_runs(w.codes, w.data, w.starts, w.ends)
        low = w.data.tobytes()
        spans = list(zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True))
        keys = [low[a:b] for a, b in spans]
        known = self.memo.get_all(keys)
        new = [i for i, ids in enumerate(known) if ids is None]
        at = first[new]
        simple = plain(w.data, w.starts[at], w.ends[at]).tolist()
        pieces = [keys[i] if ok else raw[spans[i][0] : spans[i][1]] for i, ok in zip(new, simple, strict=True)]
        for i, ids in zip(new, self._learn(pieces, simple), strict=True):
            known[i] = ids
            if len(keys[i]) <= LONG_WORD:
                self.memo.now[keys[i]] = ids
        flat = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        each = size[kinds]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begin[kinds] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)]
        total = np.concatenate([[0], upto])
        return ids, np.diff(total[w.splits])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file: workers live on between tasks, and so does its memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _put(folder: str, name: str, raw: bytes) -> None:
    """Writes a file under a name of its own, then moves it into place; what another attempt put there is the same."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(raw)
    try:
        store.move(own, f"{path}/{name}")
    except OSError:
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise
        store.delete_file(own)


def ranges_of(rows: DataFrame, range_bytes: int = 64 << 20) -> int:
    """How many ranges a table is dealt to: by the bytes of its texts, and one a shuffle partition at least."""
    size = rows.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first().n or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, slice_bytes: int = 4 << 20, file_tokens: int = 16 << 20) -> DataFrame:
    """Writes the files and returns the table of files: file, docs, tokens, start (tokens of all earlier files)."""

    def dump(name, ids, nulls, codes, sizes) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        _put(folder, name, TokenFile(Levels.encode(np.concatenate(codes)), np.concatenate(ids), np.concatenate(nulls), starts).dump())
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(starts) - 1]), pa.array([int(starts[-1])])], ["file", "docs", "tokens"])

    def run(batches):
        encoder, part, held, number = encoder_of(tokenizer_path), ([], [], [], []), 0, 0
        name = f"part-{TaskContext.get().partitionId():07d}"
        for batch in batches:
            column, key = texts(batch.column(1)), batch.column(0)
            for a, b in slices(column, slice_bytes):
                got, size = encoder.encode(column.slice(a, b - a))
                own = key.slice(a, b - a)
                for x, y in zip(part, (own.fill_null(0).to_numpy(), np.asarray(own.is_null()), np.insert(got, np.cumsum(size), end_id), size + 1), strict=True):
                    x.append(y)
                held += len(part[2][-1])
                if held >= file_tokens:
                    yield dump(f"{name}-{number:07d}.dac", *part)
                    part, held, number = ([], [], [], []), 0, number + 1
        if part[0]:
            yield dump(f"{name}-{number:07d}.dac", *part)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(ranges or ranges_of(rows), "id", "h").sortWithinPartitions("id", "h")
    written = materialize(rows.select("id", "t").mapInArrow(trimmed(run), "file string, docs long, tokens long"), "files", folder)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _get(folder: str, name: str) -> TokenFile:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return TokenFile.load(f.read())


def read_token(files: DataFrame, folder: str, position: int) -> int:
    """The id at a position of the whole store: a few bytes of one file are read."""
    from pyarrow import fs

    found = files.where((F.col("start") <= position) & (F.col("start") + F.col("tokens") > position)).first()
    if found is None:
        raise IndexError("position outside the store")
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{found.file}") as f:
        return stored_token(f, position - found.start)


def _read(files: DataFrame, folder: str, of_part, kind: str) -> DataFrame:
    """Reads the files, dealt out evenly; of_part(file, first, end, start of the file) makes the batches of its documents."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = _get(folder, name)
                for a in range(0, len(f), 256):
                    yield of_part(f, a, min(len(f), a + 256), start)

    return files.select("file", "start").repartition(max(1, files.count())).mapInArrow(trimmed(run), kind)


def _doc_ids(f: TokenFile, a: int, b: int) -> pa.Array:
    return pa.array(f.doc_ids[a:b], mask=f.null_ids[a:b])


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """id, start, ids of each document, read from the files."""

    def part(f: TokenFile, a: int, b: int, start: int) -> pa.RecordBatch:
        at = f.starts[a : b + 1]
        flat = f.levels.slice(int(at[0]), int(at[-1])).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([_doc_ids(f, a, b), pa.array(at[:-1] + start), ids], ["id", "start", "ids"])

    return _read(files, folder, part, "id long, start long, ids array<int>")


def checksums(files: DataFrame, folder: str) -> DataFrame:
    """id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, of each document in the files."""

    def part(f: TokenFile, a: int, b: int, start: int) -> pa.RecordBatch:
        at = f.starts[a : b + 1]
        flat = f.levels.slice(int(at[0]), int(at[-1])).astype("<u4")
        cut = (at - at[0]).tolist()
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([_doc_ids(f, a, b), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return _read(files, folder, part, "id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilspark.llm.shared import table

    folder = new_dir(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return checksums(files, folder).withColumnRenamed("id", "doc_id")
