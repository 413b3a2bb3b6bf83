"""Recognizers: chunks in, entities out.

Two paths. native_spans() finds one pattern's matches and offsets with built-in functions alone (regexp_extract_all for
the matches, split for the gaps between), for a few families over much text. scan() runs all rules, dictionaries and
context words over each text in one Arrow pass: every rule of a call is settled and compiled beforehand, cheap literal
tests keep most patterns away from most texts, and no shuffle is needed.

An entity has chunk keys, label, start and end (characters), value, confidence, recognizer, rule and check names, the
confidence before context words, the word that lifted it, and the range's language."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.validators import VALIDATORS
from veilspark.operators import dictionaries as dicts
from veilspark.operators.context import Booster
from veilspark.operators.rules import BUILT_IN, Rule, Scope, compiled, in_scope, primary

ENTITY = "label string, start int, end int, value string, confidence float, recognizer string, rule string, validator string, base float, keyword string, language string"
_ENTITY_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float32()), ("recognizer", pa.string()), ("rule", pa.string()), ("validator", pa.string()), ("base", pa.float32()), ("keyword", pa.string()), ("language", pa.string())]))


def span_array(text: Column, regex: str, group: int = 0) -> Column:
    """array<struct<start,value>> of a pattern's matches; the pattern must not match the empty string."""
    m, g = F.regexp_extract_all(text, F.lit(regex), group), F.split(text, regex, -1)
    kind = "array<struct<start:int,value:string>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        found = F.array(F.struct(start.alias("start"), x["value"].alias("value"))).cast(kind)
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(a["out"], found).alias("out"))

    pairs = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda gap, value: F.struct(F.coalesce(gap, F.lit("")).alias("gap"), F.coalesce(value, F.lit("")).alias("value")))
    return F.when(F.size(m) > 0, F.aggregate(pairs, state, step, lambda a: a["out"])).otherwise(F.array().cast(kind))


def native_spans(chunks: DataFrame, regex: str, label: str, score: float, *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", check: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, label, start, end, value and confidence of one pattern's matches, by built-in functions alone."""
    hits = chunks.where(F.col(text_col).rlike(regex)).select(*keys, F.inline(span_array(F.col(text_col), regex)))
    hits = hits.where(check(F.col("value"))) if check else hits
    return hits.select(*keys, F.lit(label).alias("label"), "start", (F.col("start") + F.length("value")).alias("end"), "value", F.lit(score).cast("float").alias("confidence"))


DIGIT, DIGITS = re.compile(r"\d"), re.compile(r"\d+")
#: A match of at most so many characters that holds a digit lies within so many of one.
NEAR = 96


def longest(rx: re.Pattern) -> int:
    """Characters of the longest match."""
    from re import _parser

    return _parser.parse(rx.pattern).getwidth()[1]


def around_digits(text: str) -> list[tuple[int, int]]:
    """The parts of a text in which every match lies that holds a digit and has at most NEAR characters, with a character
    to spare at each end, so that word ends are seen; parts do not touch."""
    out: list[tuple[int, int]] = []
    for m in DIGITS.finditer(text):
        begin, end = max(0, m.start() - NEAR), m.end() + NEAR
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], end
        else:
            out.append((begin, end))
    return [(a, min(b, len(text))) for a, b in out]


class Scanner:
    """All rules and dictionaries of a call, over single texts."""

    def __init__(self, rules: Iterable[Rule], terms: Iterable[dicts.Dictionary], scope: Scope, boost: bool = True):
        self.scope = scope
        settled = in_scope(rules, scope)
        self.groups: dict[str, tuple[re.Pattern | None, list]] = {}
        self.near: list[tuple] = []
        for place, (r, v, rx) in enumerate(compiled(settled)):
            valid = VALIDATORS.get(v.validator) if v.validator else None
            if v.needs == DIGIT.pattern and longest(rx) <= NEAR:
                self.near.append((place, r, v, rx, valid))
                continue
            self.groups.setdefault(v.needs or "", (re.compile(v.needs) if v.needs else None, []))[1].append((place, r, v, rx, valid))
        asserted = {primary(x) for x in scope.languages}
        chosen = [d for d in terms if (not asserted or not d.languages or {*map(primary, d.languages)} & asserted) and scope.catalog.declares(d.label)]
        self.terms = dicts.Terms(chosen)
        self.booster = Booster.of(settled, scope, terms) if boost else None

    def entities(self, text: str, hints: list[str] = (), language: str | None = None, tokens: list[dict] = ()) -> list[dict]:
        hits = []

        def look(members: list, begin: int, end: int) -> None:
            for place, r, v, rx, valid in members:
                for m in rx.finditer(text, begin, end):
                    value = m[0]
                    if value and (valid is None or valid(value, self.scope.countries)):
                        hits.append((place, m.start(), {"label": r.labels[0], "start": m.start(), "end": m.end(), "value": value, "confidence": v.score, "recognizer": "pattern", "rule": r.name, "validator": v.validator, "base": v.score, "keyword": None, "language": language}))

        for begin, end in around_digits(text) if self.near else ():
            look(self.near, begin, end)
        for need, members in self.groups.values():
            if need is None or need.search(text):
                look(members, 0, len(text))
        out = [e for _, _, e in sorted(hits, key=lambda h: h[:2])]
        for start, end, d, score in self.terms.find(text):
            out.append({"label": d.label, "start": start, "end": end, "value": text[start:end], "confidence": score, "recognizer": "pattern", "rule": d.name, "validator": None, "base": score, "keyword": None, "language": language})
        if self.booster:
            self.booster.lift(text, out, list(hints), tokens)
        return out


_SCANNERS: dict[str, Scanner] = {}


def scanner(call: str, *settings) -> Scanner:
    """The scanner of a call to scan(), built once a worker, as workers outlive tasks; those of the last four calls stay."""
    if call not in _SCANNERS:
        while len(_SCANNERS) > 3:
            del _SCANNERS[next(iter(_SCANNERS))]
        _SCANNERS[call] = Scanner(*settings)
    return _SCANNERS[call]


def scan(chunks: DataFrame, scope: Scope | None = None, *, rules: Iterable[Rule] | None = None, terms: Iterable[dicts.Dictionary] | None = None, text_col: str = "text", hints_col: str | None = None, language_col: str | None = None, tokens_col: str | None = None, boost: bool = True) -> DataFrame:
    """The chunks with entities: an array, so that what follows stays on the row.

    language_col is what was detected: it labels entities and gates nothing. tokens_col: array of struct start, end,
    lemma, in order, by which context windows count."""
    scope = scope or Scope()
    rules, terms = list(BUILT_IN if rules is None else rules), list(dicts.BUILT_IN if terms is None else terms)
    Scanner(rules, terms, scope, boost)  # errors in rules show here, on the driver
    call = uuid.uuid4().hex

    def run(batches):
        s = scanner(call, rules, terms, scope, boost)
        for batch in batches:
            n = batch.num_columns
            text, hints, lang, tokens = (batch.column(n - i).to_pylist() for i in (4, 3, 2, 1))
            found = [s.entities(t, h or [], g, k or ()) if t else [] for t, h, g, k in zip(text, hints, lang, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(found, _ENTITY_TYPE)], [*batch.schema.names[:-4], "entities"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    extra = [F.col(text_col).alias("scan_text"), (F.col(hints_col) if hints_col else F.lit(None)).cast("array<string>").alias("scan_hints"), (F.col(language_col) if language_col else F.lit(None)).cast("string").alias("scan_language"), (F.col(tokens_col) if tokens_col else F.lit(None)).cast("array<struct<start:int,end:int,lemma:string>>").alias("scan_tokens")]
    return chunks.select("*", *extra).mapInArrow(run, f"{kept}, entities array<struct<{ENTITY.replace(' ', ': ').replace(',:', ',')}>>")


def exploded(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row an entity."""
    return scanned.select(*keys, F.inline("entities"))


def stamp_languages(entities: Column, languages: Column) -> Column:
    """Each entity with the first ranked language whose span holds it; a language without span holds all."""
    def one(e: Column) -> Column:
        fits = F.filter(languages, lambda g: g["start"].isNull() | ((g["start"] <= e["start"]) & (e["end"] <= g["end"])))
        return e.withField("language", F.coalesce(F.get(fits, 0)["tag"], e["language"]))

    return F.transform(entities, one)
