"""Audit chains: every step of an entity's life, each event bound to its predecessors by a digest.

An event's digest covers its fields, each with its length, and its parents' digests (SHA-256). A chain holds if parents
are known, digests agree, none repeats, and the last event is the only one that no other has as parent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("pattern", "model", "deduplication", "conflict", "contested", "calibration", "refinement", "redaction")
EVENT = "struct<source: string, kind: string, confidence: float, detail: string, parents: array<string>, hash: string>"


def digest(source: Column, kind: Column, confidence: Column, detail: Column, parents: Column) -> Column:
    fields = [source, kind, confidence.cast("double").cast("string"), F.coalesce(detail, F.lit("")), F.array_join(parents, ",")]
    return F.sha2(F.concat(*[x for f in fields for x in (F.length(f).cast("string"), F.lit(":"), f)]).cast("binary"), 256)


def event(source: Column, kind: str, confidence: Column, detail: Column | None = None, parents: Column | None = None) -> Column:
    if kind not in KINDS:
        raise ValueError(f"no event kind {kind!r}")
    detail = F.lit(None).cast("string") if detail is None else detail
    parents = F.array().cast("array<string>") if parents is None else parents
    return F.struct(source.alias("source"), F.lit(kind).alias("kind"), confidence.cast("float").alias("confidence"), detail.alias("detail"), parents.alias("parents"), digest(source, F.lit(kind), confidence.cast("float"), detail, parents).alias("hash"))


def begin(first: Column) -> Column:
    return F.array(first)


def record(chain: Column, source: Column, kind: str, confidence: Column, detail: Column | None = None) -> Column:
    """The chain with one event more, whose parent is the last."""
    return F.array_append(chain, event(source, kind, confidence, detail, F.array(F.element_at(chain, -1)["hash"])))


def fuse(one: Column, two: Column, source: Column, kind: str, confidence: Column) -> Column:
    """Two chains as one, closed by an event with both ends as parents."""
    ends = F.array(F.element_at(one, -1)["hash"], F.element_at(two, -1)["hash"])
    return F.array_append(F.array_distinct(F.concat(one, two)), event(source, kind, confidence, None, ends))


def verify(chain: Column) -> Column:
    hashes = F.transform(chain, lambda e: e["hash"])
    parents = F.flatten(F.transform(chain, lambda e: e["parents"]))
    whole = F.forall(chain, lambda e: e["hash"] == digest(e["source"], e["kind"], e["confidence"], e["detail"], e["parents"]))
    known = F.forall(F.transform(chain, lambda e, i: F.size(F.array_except(e["parents"], F.slice(hashes, F.lit(1), i))) == 0), lambda ok: ok)
    sinks = F.array_except(hashes, parents)
    return F.coalesce((F.size(chain) > 0) & whole & known & (F.size(F.array_distinct(hashes)) == F.size(chain)) & (F.size(sinks) == 1) & (F.element_at(sinks, 1) == F.try_element_at(hashes, F.lit(-1))), F.lit(False))


def original_confidence(chain: Column) -> Column:
    return F.get(chain, 0)["confidence"]


def final_confidence(chain: Column) -> Column:
    return F.try_element_at(chain, F.lit(-1))["confidence"]


def recognizers(chain: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(chain, lambda e: e["kind"].isin("pattern", "model")), lambda e: e["source"]))


def content_hash(parts: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return h.hexdigest()
