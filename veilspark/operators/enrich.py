"""What is added to chunks before and beside the rules: languages, and findings of models.

Models are functions over batches of texts, given by the caller; mocks stand in where none is at hand. Layouts (words of
a picture) and transcriptions (words of a recording) are arrays on the row, resolved to boxes and times by columns."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be at by this have from or an not but they",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "fr": "le la les et des en un une du est que pour dans qui par sur pas plus au avec se ce il sont ne",
    "es": "el los las y del que un una por con para es al lo como más su pero sus le ya este sí porque esta",
}

LANGUAGE = "struct<tag: string, confidence: float, provenance: string, start: int, end: int>"


def detect_language(text: Column, candidates: list[str] | None = None) -> Column:
    """Ranked languages by the share of function words; empty where no word tells.

    Words are runs of letters; each text is read once, in Arrow batches, as counting in lambdas of columns is interpreted."""
    chosen = [(t, w.split()) for t, w in FUNCTION_WORDS.items() if not candidates or t in candidates]

    @pandas_udf(f"array<{LANGUAGE}>")
    def ranked(texts: pd.Series) -> pd.Series:
        import regex

        word, out = regex.compile(r"\p{L}+"), []
        for t in texts:
            seen = Counter(word.findall(t.lower())) if t else {}
            found = sorted(((sum(seen.get(w, 0) for w in names), tag) for tag, names in chosen), reverse=True)
            total = sum(n for n, _ in found)
            out.append([{"tag": tag, "confidence": n / total, "provenance": "detected", "start": None, "end": None} for n, tag in found if n])
        return pd.Series(out, index=texts.index, dtype=object)

    return ranked(text)


def rank_languages(languages: Column) -> Column:
    """By confidence (none last), asserted before detected."""
    order = F.transform(languages, lambda g: F.struct((-F.coalesce(g["confidence"], F.lit(-1.0))).alias("a"), F.when(g["provenance"] == "asserted", 0).otherwise(1).alias("b"), g.alias("g")))
    return F.transform(F.array_sort(order), lambda x: x["g"])


def enrich_languages(chunks: DataFrame, text_col: str = "text", asserted: list[str] | None = None, candidates: list[str] | None = None) -> DataFrame:
    """languages: asserted ones as they are, else detected."""
    if asserted:
        given = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(1.0).cast("float").alias("confidence"), F.lit("asserted").alias("provenance"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")) for t in asserted])
        return chunks.withColumn("languages", given)
    return chunks.withColumn("languages", detect_language(F.col(text_col), candidates))


#: How a backend may join its tokens into spans, and fit spans to words: passed on to it as they are.
AGGREGATIONS, ALIGNMENTS = ("none", "first", "max", "average", "simple"), ("strict", "contract", "expand")


@dataclass
class Ner:
    """A span model: model(texts) -> for each text a list of (label, start, end, score)."""

    name: str
    model: Callable[[list[str]], list[list[tuple[str, int, int, float]]]]
    labels: tuple[str, ...] = ()
    mapping: dict[str, str] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()
    scales: dict[str, float] = field(default_factory=dict)
    aggregation: str = "simple"
    alignment: str = "strict"

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS or self.alignment not in ALIGNMENTS:
            raise ValueError("unknown aggregation or alignment")

    def recognize(self, chunks: DataFrame, *keys: str, text_col: str = "text", catalog=None) -> DataFrame:
        """keys and entities, one row a find: labels mapped, culled, scaled; spans outside the text left out."""
        model, mapping, ignored, scales, name = self.model, self.mapping, set(self.ignored), self.scales, self.name
        allowed = set(self.labels)

        @pandas_udf("array<struct<label: string, start: int, end: int, confidence: float>>")
        def find(texts: pd.Series) -> pd.Series:
            values = [t or "" for t in texts]
            out = []
            for t, spans in zip(values, model(values), strict=True):
                own = []
                for label, a, b, score in spans:
                    label = mapping.get(label, label)
                    if label in ignored or (allowed and label not in allowed) or not 0 <= a < b <= len(t):
                        continue
                    own.append({"label": label, "start": a, "end": b, "confidence": min(1.0, max(0.0, score * scales.get(label, 1.0)))})
                out.append(own)
            return pd.Series(out)

        found = chunks.select(*keys, F.col(text_col).alias("t_"), F.inline(find(F.col(text_col))))
        found = found.withColumn("value", F.substring("t_", F.col("start") + 1, F.col("end") - F.col("start"))).drop("t_").withColumn("recognizer", F.lit(name))
        return found.where(F.col("label").isin(list(catalog.labels))) if catalog is not None and catalog.labels else found


def mock_ner(names: dict[str, str]) -> Callable[[list[str]], list[list[tuple[str, int, int, float]]]]:
    """A model that knows strings by heart: string -> label."""

    def model(texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        return [[(label, m.start(), m.end(), 0.9) for s, label in names.items() for m in re.finditer(re.escape(s), t)] for t in texts]

    return model


# What a language model says, found again in the text


def _folded(s: str) -> tuple[str, list[int]]:
    """NFC with white space runs as one space, and the original position of each character."""
    out, at, i = [], [], 0
    while i < len(s):
        j = i + 1
        while j < len(s) and unicodedata.combining(s[j]):
            j += 1
        for c in unicodedata.normalize("NFC", s[i:j]):
            if c.isspace():
                if out and out[-1] == " ":
                    continue
                c = " "
            out.append(c)
            at.append(i)
        i = j
    at.append(len(s))
    return "".join(out), at


def localize(text: str, value: str, context: str | None = None, first: bool = False) -> tuple[int, int] | None:
    """Where a value that a model quotes stands: its context once in the text, the value once in it (or the first)."""
    t, at = _folded(text)
    v, c = _folded(value)[0].strip(), _folded(context)[0].strip() if context else None
    if not v:
        return None
    lo, hi = 0, len(t)
    if c:
        if t.count(c) != 1 and not (first and c in t):
            return None
        lo = t.index(c)
        hi = lo + len(c)
    n = t.count(v, lo, hi)
    if n == 0 or (n > 1 and not first):
        return None
    a = t.index(v, lo, hi)
    return at[a], at[a + len(v)]


@dataclass
class Llm:
    """extract(prompt) -> list of {label, value, context?, confidence?}; the prompt comes from a template."""

    name: str
    extract: Callable[[str], list[dict]]
    template: str = "List the sensitive values of these kinds: {labels}.\nText:\n{text}"
    labels: tuple[str, ...] = ()
    first: bool = False

    def prompt(self, text: str) -> str:
        """The template with {labels} and {text}, also in double braces, filled in; the text last, so it fills nothing."""
        out = re.sub(r"\{\{\s*(labels|text)\s*\}\}", r"{\1}", self.template)
        return out.replace("{labels}", ", ".join(self.labels)).replace("{text}", text)

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        out = []
        for c in self.extract(self.prompt(text)):
            span = localize(text, c["value"], c.get("context"), self.first)
            if span and (not self.labels or c["label"] in self.labels):
                out.append((c["label"], *span, float(c.get("confidence", 0.5))))
        return out

    def recognizer(self) -> Ner:
        return Ner(self.name, lambda texts: [self.find(t) for t in texts], self.labels)


# Layouts and transcriptions: words with their place, by character range


def resolve_box(words: Column, start: Column, end: Column) -> Column:
    """The union of the boxes of words (start, end, left, top, right, bottom) that a range touches."""
    hit = F.filter(words, lambda w: (w["start"] < end) & (start < w["end"]))
    side = lambda f, name: f(F.transform(hit, lambda w: w[name]))
    return F.when(F.size(hit) > 0, F.struct(side(F.array_min, "left").alias("left"), side(F.array_min, "top").alias("top"), side(F.array_max, "right").alias("right"), side(F.array_max, "bottom").alias("bottom")))


def resolve_time(words: Column, start: Column, end: Column) -> Column:
    """The time span of words (start, end, from_us, to_us, speaker) that a range touches; the speaker if it is one."""
    hit = F.filter(words, lambda w: (w["start"] < end) & (start < w["end"]))
    speakers = F.array_distinct(F.transform(hit, lambda w: w["speaker"]))
    return F.when(F.size(hit) > 0, F.struct(F.array_min(F.transform(hit, lambda w: w["from_us"])).alias("from_us"), F.array_max(F.transform(hit, lambda w: w["to_us"])).alias("to_us"), F.when(F.size(speakers) == 1, F.get(speakers, 0)).alias("speaker")))
