"""Token counts by the whole-token shortcut.

Offline, each entry of a byte-level BPE vocabulary is merged alone; the entries that end as the one token they name are
proven whole. A text is then cut into pre-tokens as the vocabulary's file prescribes: a pre-token that is a proven entry
counts one, and only the others are merged (each distinct one once, in a memo of bounded size). A special string in a
text counts one token, as the library has it by default.

Engines of regular expressions can differ on characters that Unicode assigned or moved lately. A character is sure if
Unicode 3.2 had it in the same class (letter, number, space, other) as now, or if it is in a block of later pictures that
is listed here. A text is cut at single spaces between sure characters, where a pre-token always begins; only stretches
that hold an unsure character are counted by the library itself. So counts equal the library's everywhere.

Cases: null and empty texts count 0 bytes and 0 tokens; texts are counted whole, however long; repeated rows count
alike; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import functools
import heapq
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import slices, texts, trimmed

# Fixed value: the pre-token pattern of byte-level BPE files with use_regex.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What texts mostly consist of; anything else is looked up.
COMMON = r"[^\t\n\r\x20-\x7E\xA1-ɏΑ-ΡΣ-ϿЀ-џא-תء-غ‐-‧‰-⁞₠-€←-⇿ぁ-ゖァ-ヺ一-龥가-힣]"
#: Later pictures, all of one class: first and last of each range.
PICTURES = ((0x1F300, 0x1F320), (0x1F330, 0x1F335), (0x1F337, 0x1F37C), (0x1F380, 0x1F393), (0x1F3A0, 0x1F3C4), (0x1F3C6, 0x1F3CA), (0x1F3E0, 0x1F3F0), (0x1F400, 0x1F43E), (0x1F442, 0x1F4F7), (0x1F4F9, 0x1F4FC), (0x1F500, 0x1F53D), (0x1F550, 0x1F567), (0x1F600, 0x1F64F), (0x1F680, 0x1F6C5))


@functools.lru_cache(1 << 16)
def is_sure(c: str) -> bool:
    """Whether every engine has the character in the same class."""
    kind = lambda data: {"L": "L", "N": "N", "Z": "Z"}.get(data.category(c)[0], "" if data.category(c) != "Cn" else None)
    now, then = kind(unicodedata), kind(unicodedata.ucd_3_2_0)
    if any(a <= ord(c) <= b for a, b in PICTURES):
        return now == ""
    if c.isspace() and c not in "\t\n\r \x0b\x0c\u00a0\u3000":  # which of the rarer ones are spaces, engines differ on
        return False
    return now is not None and now == then and unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cs")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself if printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Byte-pair merging by a file's merge list; lowest rank first, leftmost at ties."""

    def __init__(self, merges: list):
        pairs = (tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges)
        self.rank = {p: i for i, p in enumerate(pairs)}

    def merge(self, symbols: list[str]) -> list[str]:
        n, rank = len(symbols), self.rank
        part, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p]


def whole_tokens(path: str) -> tuple[dict[str, int], list[str]]:
    """Proven entries as text (each 1), and the file's special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merger, letters = Merger(spec["model"]["merges"]), byte_letters()
    byte = {c: b for b, c in enumerate(letters)}
    special = [t["content"] for t in spec.get("added_tokens", ())]
    out = {}
    for entry in spec["model"]["vocab"]:
        if entry in special or not all(c in byte for c in entry):
            continue
        try:
            text = bytes(byte[c] for c in entry).decode("utf-8")
        except UnicodeDecodeError:
            continue  # part of a character: no pre-token is like it
        if merger.merge(list(entry)) == [entry]:
            out[text] = 1
    return out, special


class Counter:
    """Counts tokens of texts; `most` bounds the memo of merged pre-tokens."""

    def __init__(self, path: str, whole: dict[str, int], special: list[str], most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.whole, self.most, self.memo = Tokenizer.from_file(path), whole, most, dict(whole)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut, self.odd = regex.compile(PRE_TOKEN), regex.compile(COMMON)
        self.special = special
        self.parts = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def by_library(self, values: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(values, add_special_tokens=False)]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        if not self.parts or not any(s in text for s in self.special):
            return self.cut.findall(text), 0
        runs = self.parts.split(text)
        return [p for r in runs for p in self.cut.findall(r)], len(runs) - 1

    def stretches(self, text: str) -> tuple[list[str], list[str]]:
        """Parts of a text that hold sure characters alone, and parts that the library has to count."""
        unsure = {c for c in set(self.odd.findall(text)) if not is_sure(c)}
        if not unsure:
            return [text], []
        held = "".join(map(regex.escape, sorted(unsure)))
        # to the last single space between sure characters before it, and to the first one after it
        seam = rf"(?<=[^\s{held}]) (?=[^\s{held}])"
        edges = [m.start() for m in regex.finditer(seam, text)]
        at = [0, *edges, len(text)]
        sure, odd, begin = [], [], 0
        marked = regex.compile(f"[{held}]")
        for a, b in zip(at[:-1], at[1:], strict=True):
            if marked.search(text, a, b):
                if a > begin:
                    sure.append(text[begin:a])
                odd.append(text[a:b])
                begin = b
        if begin < len(text):
            sure.append(text[begin:])
        return sure, odd

    def count(self, values: list[str]) -> list[int]:
        out, cut, odd = [0] * len(values), [], []
        for i, t in enumerate(values):
            if not t:
                continue
            if t.isascii() or not self.odd.search(t):
                cut.append((i, *self.pieces(t)))
            elif self.parts and any(s in t for s in self.special):
                odd.append((i, t))
            else:
                sure, rest = self.stretches(t)
                cut += [(i, *self.pieces(x)) for x in sure]
                odd += [(i, x) for x in rest]
        if len(self.memo) > self.most + len(self.whole):
            self.memo = dict(self.whole)
        memo = self.memo
        rest = list({p for _, ps, _ in cut for p in ps if p not in memo})
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            memo.update(zip(part, self.by_library(part), strict=True))
        for i, ps, n in cut:
            out[i] += n + sum(map(memo.__getitem__, ps))
        for (i, _), n in zip(odd, self.by_library([x for _, x in odd]), strict=True):
            out[i] += n
        return out


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str, proven) -> Counter:
    """The worker's counter of a tokenizer file, from its broadcast proof: workers live on between tasks, and so does its memo."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, *proven.value)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """id, n_bytes and n_tokens of each text."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))  # as many entries as the vocabulary has, at most

    def run(batches):
        counter = counter_of(tokenizer_path, whole)
        for batch in batches:
            column = texts(batch.column(1))
            counts = np.zeros(len(column), np.int64)
            for a, b in slices(column, slice_bytes):
                counts[a:b] = counter.count(column.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(column), pa.int64()), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    ids = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(trimmed(run), f"id {ids}, n_bytes long, n_tokens long")
    return found.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilspark.llm.shared import table

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)
