"""Benchmark decontamination with an FM-index over each shard of the training texts.

Benchmark items are cut into windows of 13 consecutive words (a shorter item is one window). Each batch of documents is
a shard: its words are numbered by the benchmark's own vocabulary, words outside it end a run, and runs that are shorter
than the shortest window, which hold no occurrence, are left out (an exact reduction of the alphabet and text). The runs
of a shard form an FM-index; every window is searched backwards through wavelet-tree ranks and its occurrences located
from sampled suffix positions. The word spans of a document's occurrences are merged into removal spans.

Words are looked up by code and compared by their bytes. The benchmark is held whole only up to `most_bytes` of text; a larger one
is dealt by item into groups of about that size, and the documents pass through one scan after another, without a
shuffle in either case.

Cases: null texts have no words and no hits; items without words or without id are left out; repeated items count once,
and repeated documents each have their row; an empty benchmark or table gives no hits or no rows; texts are scanned
whole, however long; columns of the documents, whatever their names, are kept as asked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.fm_index import FmIndex
from veilspark.llm.shared import texts, trimmed
from veilspark.llm.wordcodes import Words, same_runs, word_slices, words_of


class Phrases:
    """Windows of benchmark items over a vocabulary of word codes."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = 13):
        self.names = sorted({name for name, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        rows, code = [], {}
        for n, t in items:
            w = words_of(pa.array([t or ""], pa.string()))
            raw = w.data.tobytes()
            own = [raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
            code.update(zip(own, w.codes.tolist(), strict=True))
            if own:
                rows.append((number[n], own))
        words = sorted(code, key=lambda w: (code[w], w))
        self.codes = np.array([code[w] for w in words], np.uint64)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.codes >> np.uint64(44)).astype(np.int64)] = True
        symbol = {w: i for i, w in enumerate(words, 1)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, own in rows:
            s = [symbol[w] for w in own]
            for i in range(max(1, len(s) - size + 1)):
                found.setdefault(tuple(s[i : i + size]), set()).add(item)
        self.by_length = {}
        for n in sorted({len(k) for k in found}):
            keys = sorted(k for k in found if len(k) == n)
            self.by_length[n] = (np.array(keys, np.int64), [sorted(found[k]) for k in keys])
        self.least = min(self.by_length, default=0)

    def numbers(self, w: Words) -> np.ndarray:
        """Vocabulary number of each word, from 1; 0 outside."""
        out = np.zeros(len(w.codes), np.int32)
        at = np.flatnonzero(self.maybe[(w.codes >> np.uint64(44)).astype(np.int64)])
        i = np.searchsorted(self.codes, w.codes[at])
        while len(at):  # more than once only where words of the benchmark share a code
            j = np.minimum(i, len(self.codes) - 1)
            near = (i < len(self.codes)) & (self.codes[j] == w.codes[at])
            at, i = at[near], i[near]
            same = same_runs(w.data, w.starts[at], w.ends[at], self.data, self.starts[i], self.ends[i])
            out[at[same]] = i[same] + 1
            at, i = at[~same], i[~same] + 1
        return out


class Shard:
    """Runs of vocabulary words of a batch of documents, with the word at which each begins."""

    def __init__(self, column: pa.Array, phrases: Phrases):
        self.phrases, rows, runs, begins, base = phrases, [0], [], [], 0
        self.lengths: list[np.ndarray] = []
        for _, _, w in word_slices(column):
            rows += (w.splits[1:] + base).tolist()
            if len(w.codes) and phrases.least:
                self._runs(phrases.numbers(w), w.splits, base, runs, begins)
            base += len(w.codes)
        self.splits = np.array(rows, np.int64)
        self.runs = np.concatenate(runs) if runs else np.zeros(0, np.int32)
        self.begins = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        self.sizes = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)

    def _runs(self, number, splits, base, runs, begins) -> None:
        known = number != 0
        edge = np.zeros(len(known) + 1, bool)
        edge[splits] = True
        first = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        last = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        keep = last - first >= self.phrases.least
        first, size = first[keep], (last - first)[keep]
        runs.append(number[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())])
        begins.append(first + base)
        self.lengths.append(size)

    def occurrences(self, most_symbols: int = 2_000_000):
        """(words of a window, numbers of the windows found, word positions in the batch) by index and length."""
        ends = np.cumsum(self.sizes)
        a = 0
        while a < len(self.sizes):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + most_symbols, side="right")))
            size, own = self.sizes[a:b], self.runs[done : int(ends[b - 1])]
            text = np.zeros(len(own) + len(size), np.int64)
            starts = np.cumsum(size + 1) - size - 1
            text[np.arange(len(own)) + np.repeat(np.arange(len(size)), size)] = own
            index = FmIndex(text, len(self.phrases.codes))
            for n, (patterns, _) in self.phrases.by_length.items():
                which, at = index.occurrences(patterns)
                if len(which):
                    run = np.searchsorted(starts, at, side="right") - 1
                    yield n, which, self.begins[a:b][run] + at - starts[run]
            a = b


def scan(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Words before each row, whether each word is hit, and the items found in each row that has any."""
    shard = Shard(column, phrases)
    total = int(shard.splits[-1])
    change = np.zeros(total + 1, np.int32)
    items: dict[int, set[str]] = {}
    for n, which, at in shard.occurrences():
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        row = np.searchsorted(shard.splits, at, side="right") - 1
        names = phrases.by_length[n][1]
        for r, p in np.unique(np.stack([row, which], axis=1), axis=0).tolist():
            items.setdefault(r, set()).update(phrases.names[i] for i in names[p])
    return shard.splits, np.cumsum(change[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Byte ranges (of UTF-8) of maximal runs of hit words."""
    w = words_of(pa.array([text], pa.string()))
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"begin": int(w.starts[a]), "end": int(w.ends[b - 1])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _pass(phrases, keep: int, last: bool, cut: bool):
    """A scan over (kept columns, text, hits, items); hits is one bit a word. The last pass gives the results.

    cut: the text without its removal spans takes the spans' place."""

    def run(batches):
        for batch in batches:
            column = texts(batch.column(keep))
            splits, hit, found = scan(column, phrases.value)
            before, known = batch.column(keep + 1).to_pylist(), batch.column(keep + 2).to_pylist()
            n = np.diff(splits)
            for r, bits in enumerate(before):
                if bits:
                    hit[splits[r] : splits[r + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n[r]).astype(bool)
            items = [sorted({*(known[r] or ()), *found.get(r, ())}) for r in range(len(column))]
            kept = list(batch.columns[:keep])
            count = np.concatenate([[0], np.cumsum(hit)])
            hits = count[splits[1:]] - count[splits[:-1]]
            if not last:
                bits = [np.packbits(hit[splits[r] : splits[r + 1]]).tobytes() if hits[r] else None for r in range(len(column))]
                yield pa.RecordBatch.from_arrays([*kept, batch.column(keep), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], batch.schema.names)
                continue
            spans = [_spans(column[r].as_py(), hit[splits[r] : splits[r + 1]]) if hits[r] else [] for r in range(len(column))]
            if cut:
                left = [cut_spans(column[r].as_py(), x) if x else None for r, x in enumerate(spans)]
                changed = pa.array(left, pa.string())
                found = pc.if_else(pc.is_valid(changed), changed, batch.column(keep).cast(pa.string()))
            else:
                found = pa.array(spans, _SPAN)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(hits), pa.array(items, pa.list_(pa.string())), found], [*batch.schema.names[:keep], "n_words", "n_hit", "item_ids", "cut" if cut else "spans"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, most_bytes: int = 16 << 20, cut: bool = False) -> DataFrame:
    """The kept columns (as k0, k1, ...), n_words, n_hit, item_ids and spans (byte ranges to remove), a row a document.

    cut: the text without these ranges, as column cut, instead of spans."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0))), F.lit(0)).alias("n")).first().n
    groups = max(1, -(-size // most_bytes))
    now = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text_"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    for g in range(groups):
        own = items if groups == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g)
        phrases = spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in own.collect()], window))  # about most_bytes of items
        last = g == groups - 1
        now = now.mapInArrow(trimmed(_pass(phrases, len(keep), last, cut)), kinds + ("n_words long, n_hit long, item_ids array<string>, " + ("cut string" if cut else "spans array<struct<begin: long, end: long>>") if last else "text_ string, hits binary, items array<string>"))
    return now


def contaminated(share: int = 20):
    """Whether the hit words make up at least one in `share`."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def cut_spans(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without its removal spans."""
    if not text or not spans:
        return text
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for s in spans:
        out.append(raw[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """Leaves out contaminated documents, and cuts the removal spans out of the others; the columns stay."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    found = find_contamination(docs, benchmark, keep=tuple(others), text_col=text_col, cut=True, **options).where(~contaminated())
    out = {c: F.col(f"k{i}") for i, c in enumerate(others)} | {text_col: F.col("cut")}
    if chars_col in out:
        out[chars_col] = F.when(F.col("n_hit") > 0, F.length("cut").cast(docs.schema[chars_col].dataType)).otherwise(out[chars_col])
    return found.select(*[out[c].alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256)
    return found.select(F.col("k0").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, w[i : i + least(13, len(w)) - 1] AS x
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
