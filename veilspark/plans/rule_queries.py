"""Every built-in pattern over texts made for it, and the same in DuckDB SQL.

Each pattern's own grammar gives examples of it, and each example a spoiled copy. A row's text, chosen by its key, holds
three of these; the query scans them with a group's rules, without checks and context words, and SQL matches the same
patterns one by one. Examples are ASCII, on which both engines agree about letters, digits, spaces and word ends."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import replace
from re import _constants as op
from re import _parser as grammar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import recognize, rules

GROUPS = {
    "australia": rules.AUSTRALIA, "canada": rules.CANADA, "germany": rules.GERMANY, "spain": rules.SPAIN, "india": rules.INDIA, "italy": rules.ITALY, "korea": rules.KOREA, "poland": rules.POLAND,
    "nordic": rules.NORDIC, "other_countries": rules.OTHER_COUNTRIES, "united_kingdom": rules.UNITED_KINGDOM, "united_states": rules.UNITED_STATES, "world": rules.WORLD,
}

_CLASSES = {op.CATEGORY_DIGIT: "0123456789", op.CATEGORY_SPACE: " ", op.CATEGORY_WORD: "abcxyzABCXYZ0123456789", op.CATEGORY_NOT_SPACE: "abcxyz0189-"}


def _letters(items: list) -> str:
    """ASCII characters that a set holds."""
    out, negated = [], False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.RANGE:
            out += map(chr, range(value[0], min(value[1], 126) + 1))
        else:
            out += _CLASSES[value]
    if negated:
        return "".join(c for c in map(chr, range(48, 123)) if c not in out and c.isalnum())
    return "".join(c for c in out if c < "\x7f")


def _spelled(tree, rng: random.Random) -> str:
    out = []
    for kind, value in tree:
        if kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.IN:
            out.append(rng.choice(_letters(value)))
        elif kind is op.ANY:
            out.append(rng.choice("abc "))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            out += [_spelled(inner, rng) for _ in range(rng.randint(least, min(most, least + 3)))]
        elif kind is op.SUBPATTERN:
            out.append(_spelled(value[-1], rng))
        elif kind is op.BRANCH:
            out.append(_spelled(rng.choice(value[1]), rng))
    return "".join(out)


def examples(regex: str, n: int = 6) -> list[str]:
    """Different strings that the pattern matches whole, the same ones in every call."""
    rng, tree, whole, out = random.Random(regex), grammar.parse(regex), re.compile(regex), {}
    for _ in range(400):
        s = _spelled(tree, rng)
        if (m := whole.search(s)) and m[0] == s:
            out[s] = None
        if len(out) == n:
            break
    return list(out)


def spoiled(value: str) -> str:
    """The example with one character in the middle exchanged."""
    at = len(value) // 2
    return value[:at] + ("x" if value[at] != "x" else "7") + value[at + 1 :]


def values(group: list[rules.Rule]) -> list[str]:
    found = [s for r in group for v in r.variants for s in examples(v.regex)]
    return list(dict.fromkeys([*found, *map(spoiled, found)]))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Which three examples a row holds: (factor, offset) of its key.
PICKS = ((1, 0), (31, 7), (17, 3))


def texts(rows: DataFrame, key: str, group: list[rules.Rule]) -> DataFrame:
    known = values(group)
    options = F.array(*[F.lit(v) for v in known])
    pick: Callable[[int, int], Column] = lambda a, b: F.element_at(options, ((F.col(key) * a + b) % len(known) + 1).cast("int"))
    one, two, three = (pick(*p) for p in PICKS)
    return rows.select(key, F.concat(F.lit("See "), one, F.lit(" or "), two, F.lit("; ("), three, F.lit(").")).alias("text"))


def texts_sql(source: str, key: str, group: list[rules.Rule]) -> str:
    known = values(group)
    one, two, three = (f"o[({key} * {a} + {b}) % {len(known)} + 1]" for a, b in PICKS)
    return f"SELECT {key}, 'See ' || {one} || ' or ' || {two} || '; (' || {three} || ').' AS text FROM {source}, (SELECT [{', '.join(map(_sql, known))}] AS o)"


def matches(rows: DataFrame, key: str, group: list[rules.Rule]) -> DataFrame:
    """key, rule, label, start, end, value and confidence of every match of the group's patterns, unchecked."""
    bare = [replace(r, variants=tuple(replace(v, validator=None) for v in r.variants), context=(), dictionaries=()) for r in group]
    scanned = recognize.scan(texts(rows, key, group), rules=bare, terms=[], boost=False)
    return recognize.exploded(scanned, key).select(key, "rule", "label", "start", "end", "value", "confidence")


def matches_sql(source: str, key: str, group: list[rules.Rule]) -> str:
    each = []
    for r in group:
        for v in r.variants:
            rx = _sql(v.regex)
            each.append(f"""SELECT {key}, {_sql(r.name)} AS rule, {_sql(r.labels[0])} AS label, CAST(begins AS INTEGER) AS start, CAST(begins + length(value) AS INTEGER) AS "end", value, CAST({v.score} AS FLOAT) AS confidence FROM (
  SELECT {key}, m[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS begins
  FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, {rx}) AS m, regexp_split_to_array(text, {rx}) AS g FROM t)))""")
    return f"WITH t AS ({texts_sql(source, key, group)}) " + " UNION ALL ".join(each)


def register(queries: dict, oracle: dict) -> None:
    for name, group in GROUPS.items():

        def run(spark: SparkSession, sf_dir: str, group=group) -> DataFrame:
            return matches(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", group)

        queries[f"rules_{name}"] = run
        oracle[f"rules_{name}"] = matches_sql("customer", "c_custkey", group)
