"""Context words: a keyword near an entity, or in a hint of its chunk, lifts the entity's confidence.

Rules lift by label, whichever rule found the entity. A rule lifts once at most; different rules add up, to 1 at most.
The window is five words before, the entity itself and five words after. Without a window hit any hint that holds a
keyword counts. Only asserted languages switch off rules of other languages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.operators.rules import Context, Rule, Scope, primary

WORD = re.compile(r"\w+(?:[.'’:]\w+)*", re.UNICODE)


@dataclass(frozen=True)
class Boost:
    label: str
    context: Context


def merged(boosts: Iterable[Boost]) -> list[Boost]:
    """Rules that differ in their words alone become one, words in first-seen order."""
    out: dict[tuple, Boost] = {}
    for b in boosts:
        key = (b.label, replace(b.context, keywords=()))
        if key in out:
            words = dict.fromkeys((*out[key].context.keywords, *b.context.keywords))
            out[key] = Boost(b.label, replace(b.context, keywords=tuple(words)))
        else:
            out[key] = b
    return list(out.values())


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) if not s.isascii() else s.lower()


def holds(text: str, keyword: str, boundary: bool) -> bool:
    """Whether text (in lower case) holds the keyword, between characters that are no letters or digits if boundary."""
    at = text.find(keyword)
    while at >= 0:
        end = at + len(keyword)
        if not boundary or not ((at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
            return True
        at = text.find(keyword, at + 1)
    return False


def window(text: str, start: int, end: int, before: int, after: int, step: int = 256) -> str:
    """The text from `before` words ahead of the entity to `after` words behind it.

    Words are looked for in a stretch of text that doubles until it holds enough whole ones or meets the text's end."""
    a, b = start, end
    if before:
        reach = step
        while True:
            lo = max(0, start - reach)
            words = [m.start() for m in WORD.finditer(text, lo, start)]
            if lo == 0 or len(words) > before:  # the first one may have begun before the stretch
                break
            reach *= 2
        a = words[-before] if len(words) >= before else lo if words else start
    if after:
        for n, m in enumerate(WORD.finditer(text, end), 1):
            b = m.end()
            if n == after:
                break
    return text[a:b]


def token_window(tokens: list[dict], start: int, end: int, before: int, after: int) -> tuple[int, int, list[str]] | None:
    """The range and the lemmas of `before` tokens ahead of those that the entity touches, these, and `after` behind.

    tokens: dicts with start, end and lemma, in order. None if the entity touches none."""
    first = bisect_right(tokens, start, key=lambda t: t["end"])
    last = bisect_left(tokens, end, key=lambda t: t["start"])
    if first >= last:
        return None
    near = tokens[max(0, first - before) : last + after]
    return min(start, near[0]["start"]), max(end, near[-1]["end"]), [ascii_lower(t["lemma"]) for t in near if t.get("lemma")]


class Booster:
    def __init__(self, boosts: Iterable[Boost], scope: Scope | None = None):
        asserted = {primary(x) for x in scope.languages} if scope else set()
        self.by_label: dict[str, list[tuple[Context, tuple[str, ...]]]] = {}
        for b in merged(boosts):
            if b.context.language is None or not asserted or primary(b.context.language) in asserted:
                self.by_label.setdefault(b.label, []).append((b.context, tuple(ascii_lower(k) for k in b.context.keywords)))

    @classmethod
    def of(cls, rules: Iterable[Rule], scope: Scope | None = None, dictionaries=()) -> Booster:
        terms = {d.name: d for d in dictionaries}
        boosts = []
        for r in rules:
            extra = tuple(t for n in r.dictionaries if n in terms for t, _ in terms[n].terms)
            contexts = r.context or ((Context(extra),) if extra else ())
            for c in contexts:
                boosts.append(Boost(r.labels[0], replace(c, keywords=(*c.keywords, *extra)) if r.context and extra else c))
        return cls(boosts, scope)

    def lift(self, text: str, entities: list[dict], hints: list[str], tokens: list[dict] = ()) -> None:
        """Raises confidences in place and names the first word of the rule that lifted.

        Where the text has tokens that the entity touches, the window counts these instead of words."""
        low_hints = [ascii_lower(h) for h in hints if h]
        views: dict[tuple, tuple[str, list[str] | None]] = {}
        for e in entities:
            for c, words in self.by_label.get(e["label"], ()):
                key = (e["start"], e["end"], c.before, c.after)
                if key not in views:
                    span = token_window(tokens, e["start"], e["end"], c.before, c.after) if tokens else None
                    near = text[span[0] : span[1]] if span else window(text, e["start"], e["end"], c.before, c.after)
                    views[key] = ascii_lower(near), span[2] if span else None
                near, lemmas = views[key]
                found = any(w in lemmas for w in words) if c.lemmas and lemmas is not None else any(holds(near, w, c.word_boundary) for w in words)
                if found or any(holds(h, w, c.word_boundary) for h in low_hints for w in words):
                    e["confidence"] = min(1.0, e["confidence"] + c.boost)
                    e["keyword"] = e["keyword"] or c.keywords[0]


def native_lift(text: Column, start: Column, end: Column, confidence: Column, keywords: list[str], boost: float = 0.35, words: int = 5) -> Column:
    """The lift by one rule as a Column: words are runs of word characters."""
    before = F.regexp_extract(F.substring(text, F.lit(1), start), rf"((?:\w+\W*){{0,{words}}})$", 1)
    after = F.regexp_extract(F.substring(text, end + 1, F.length(text)), rf"^(\W*(?:\w+\W*){{0,{words}}})", 1)
    near = F.lower(F.concat(before, F.substring(text, start + 1, end - start), after))
    hit = near.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(k) for k in keywords) + r")(?![\p{L}\p{N}])")
    return F.when(hit, F.least(F.lit(1.0), confidence.cast("double") + boost)).otherwise(confidence.cast("double")).cast("float")
