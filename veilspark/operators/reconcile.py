"""Reconciliation: overlapping entities of a chunk become those that are kept.

Column forms where the rule is a plain one: calibrate, filter, catalog, exclusions, and same-label merging by windows.
The ordered folds (any grouping, any reconciler) run over a chunk's own entity array, so no shuffle is needed; fold()
is the same rule on plain lists. Entities keep the order in which they were found; ties go to the earlier one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.labels import Catalog
from veilspark.operators.rules import BASELINE

# The relation of two spans


def relation(a: tuple[int, int], b: tuple[int, int]) -> tuple[str, float]:
    """disjoint, contains, contained or crossing (with intersection over union); equal spans: the first contains."""
    (s1, e1), (s2, e2) = a, b
    inter = min(e1, e2) - max(s1, s2)
    if inter <= 0:
        return "disjoint", 0.0
    if s1 <= s2 and e2 <= e1:
        return "contains", inter / (e1 - s1)
    if s2 <= s1 and e1 <= e2:
        return "contained", inter / (e2 - s2)
    return "crossing", inter / (max(e1, e2) - min(s1, s2))


def relation_column(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(inter <= 0, "disjoint").when((s1 <= s2) & (e2 <= e1), "contains").when((s2 <= s1) & (e1 <= e2), "contained").otherwise("crossing")


def iou_column(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return inter / (F.greatest(e1, e2) - F.least(s1, s2))


# Plain layers as columns and frames


def calibrate(entities: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Confidence times the factor of its recognizer, held in 0 to 1."""
    if not factors:
        return entities
    table = F.create_map(*[F.lit(x) for k, v in factors.items() for x in (k, float(v))])
    raw = F.col("confidence").cast("double") * F.coalesce(F.try_element_at(table, F.col("recognizer")), F.lit(1.0))
    return entities.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(raw), 0.0).otherwise(raw))).cast("float"))


def filter_entities(entities: DataFrame, labels: list[str] | None = None, threshold: float | None = BASELINE) -> DataFrame:
    out = entities if labels is None else entities.where(F.col("label").isin(labels))
    return out if threshold is None else out.where(F.col("confidence") >= F.lit(threshold).cast("float"))


def cull(entities: DataFrame, catalog: Catalog) -> DataFrame:
    """Entities whose label the catalog declares; an empty catalog keeps all."""
    return entities.where(F.col("label").isin(list(catalog.labels))) if catalog.labels else entities


def exclude(entities: DataFrame, exclusions: DataFrame, *keys: str) -> DataFrame:
    """Entities that touch no excluded span (start, end) of the same chunk."""
    e, x = entities.alias("e"), exclusions.alias("x")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    touch = (F.col("e.start") < F.col("x.end")) & (F.col("x.start") < F.col("e.end"))
    on = touch
    for s in same:
        on = s & on
    return e.join(x, on, "left_anti")


def lift(entities: DataFrame, chunk_start: str = "chunk_start") -> DataFrame:
    """From chunk to document coordinates."""
    return entities.withColumn("start", F.col("start") + F.col(chunk_start)).withColumn("end", F.col("end") + F.col(chunk_start))


def by_category(entities: DataFrame, catalog: Catalog) -> DataFrame:
    """entities with their label's category; null for labels outside the catalog."""
    return entities.join(F.broadcast(catalog.frame(entities.sparkSession).select("label", "category")), "label", "left")


def islands(entities: DataFrame, *keys: str) -> DataFrame:
    """island: a number for each maximal run of overlapping spans of equal keys (touching ends do not overlap)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(upto.isNull() | (upto <= F.col("start")), 1).otherwise(0)
    return entities.withColumn("begins_", begins).withColumn("island", F.sum("begins_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins_")


def merge_same_label(entities: DataFrame, *keys: str) -> DataFrame:
    """Overlapping entities of one label as one: widest range, highest confidence, number of members."""
    found = islands(entities, *keys, "label")
    return found.groupBy(*keys, "label", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.count("*").alias("members")).drop("island")


def structural_pairs(entities: DataFrame, *keys: str) -> DataFrame:
    """Overlapping pairs of different labels in a chunk, with their relation: what the structural fold decides on.

    Only spans of one run of overlapping spans meet, so a chunk of many spans apart from each other makes few pairs."""
    entities, keys = islands(entities, *keys), (*keys, "island")
    a = entities.select(*keys, *[F.col(c).alias("a_" + c) for c in ("label", "start", "end", "confidence")])
    b = entities.select(*keys, *[F.col(c).alias("b_" + c) for c in ("label", "start", "end", "confidence")])
    both = a.join(b, list(keys)).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("a_label") < F.col("b_label")))
    spans = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    return both.drop("island").withColumn("relation", relation_column(*spans)).withColumn("iou", iou_column(*spans))


# Ordered folds

Entity = dict
Decision = tuple[str, ...]


def same_label(a: Entity, b: Entity) -> bool:
    return a["label"] == b["label"] and a["start"] < b["end"] and b["start"] < a["end"]


def cross_label(a: Entity, b: Entity) -> bool:
    return a["label"] != b["label"] and a["start"] < b["end"] and b["start"] < a["end"]


def highest_confidence(a: Entity, b: Entity) -> bool:
    """Whether a wins."""
    return a["confidence"] >= b["confidence"]


def longest_span(a: Entity, b: Entity) -> bool:
    return a["end"] - a["start"] >= b["end"] - b["start"]


@dataclass(frozen=True)
class Merging:
    """All of a cluster as one; score: max or noisy_or, of the confidences as they came."""

    score: str = "max"

    def decide(self, a: Entity, b: Entity) -> Decision:
        x, y = a["confidence"], b["confidence"]
        return "merge", max(x, y) if self.score == "max" else 1 - (1 - x) * (1 - y)


@dataclass(frozen=True)
class Exclusive:
    wins: Callable[[Entity, Entity], bool] = highest_confidence

    def decide(self, a: Entity, b: Entity) -> Decision:
        return ("drop second",) if self.wins(a, b) else ("drop first",)


@dataclass(frozen=True)
class Permissive:
    """Keeps all; contest=True marks every pair."""

    contest: bool = False

    def decide(self, a: Entity, b: Entity) -> Decision:
        return ("contest",) if self.contest else ("keep",)


@dataclass(frozen=True)
class Structural:
    """Nested spans stay unless the outer is surer by `margin`; crossing ones are settled from `threshold` on."""

    threshold: float = 0.5
    margin: float = 0.25
    wins: Callable[[Entity, Entity], bool] | None = highest_confidence

    def decide(self, a: Entity, b: Entity) -> Decision:
        kind, iou = relation((a["start"], a["end"]), (b["start"], b["end"]))
        if kind == "contains":
            return ("drop second",) if b["confidence"] + self.margin <= a["confidence"] else ("keep",)
        if kind == "contained":
            return ("drop first",) if a["confidence"] + self.margin <= b["confidence"] else ("keep",)
        if kind == "disjoint" or iou < self.threshold:
            return ("keep",)
        if self.wins is None:
            return ("contest",)
        return ("drop second",) if self.wins(a, b) else ("drop first",)


def clusters(entities: list[Entity], linked: Callable[[Entity, Entity], bool]) -> list[list[int]]:
    """Single-linkage clusters by overlap, found in a sweep over starts: only spans that are still open can link."""
    up = list(range(len(entities)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    open_: list[int] = []
    for i in sorted(range(len(entities)), key=lambda i: entities[i]["start"]):
        open_ = [j for j in open_ if entities[j]["end"] > entities[i]["start"]]
        for j in open_:
            if linked(entities[i], entities[j]):
                up[root(i)] = root(j)
        open_.append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(entities)):
        groups.setdefault(root(i), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def fold(entities: list[Entity], linked: Callable[[Entity, Entity], bool], reconciler) -> list[Entity]:
    """The kept entities, in order. Pairs i < j of each cluster are decided first, by confidences as they came; then
    drops, contests between survivors, and merges into the surer member (the earlier at ties) take effect."""
    out = [dict(e) for e in entities]
    gone: set[int] = set()
    for group in clusters(entities, linked):
        merges, contests, conflicts = [], [], []
        for x, i in enumerate(group):
            for j in group[x + 1 :]:
                if i in gone:
                    break
                if j in gone:
                    continue
                what = reconciler.decide(entities[i], entities[j])
                if what[0] == "drop second":
                    gone.add(j)
                    conflicts.append((i, j))
                elif what[0] == "drop first":
                    gone.add(i)
                    conflicts.append((j, i))
                elif what[0] == "contest":
                    contests.append((i, j))
                elif what[0] == "merge":
                    merges.append((i, j, what[1]))
        for kind, pairs in (("conflict", conflicts), ("contested", contests)):
            for i, j in pairs:
                if i not in gone:
                    out[i].setdefault("events", []).append((kind, entities[j]["label"]))
                if kind == "contested" and j not in gone:
                    out[j].setdefault("events", []).append((kind, entities[i]["label"]))
        for i, j, score in merges:
            if i in gone or j in gone:  # taken in by another member, with which the rest is paired too
                continue
            keep, drop = (i, j) if out[i]["confidence"] >= out[j]["confidence"] else (j, i)
            out[keep]["start"], out[keep]["end"] = min(out[i]["start"], out[j]["start"]), max(out[i]["end"], out[j]["end"])
            out[keep]["confidence"] = score
            out[keep].setdefault("events", []).append(("deduplication", out[drop].get("rule")))
            gone.add(drop)
    return [e for i, e in enumerate(out) if i not in gone]


def reconcile(scanned: DataFrame, layers: list[tuple[Callable, object]], *, text_col: str = "text", threshold: float | None = BASELINE, labels: list[str] | None = None, factors: dict[str, float] | None = None) -> DataFrame:
    """Layers (grouping, reconciler), in order, over each row's entity array; then calibration's threshold and labels.

    Values are read anew from the text where merging widened a range."""
    at, text_at = scanned.columns.index("entities"), scanned.columns.index(text_col)
    fields = [f.name for f in scanned.schema["entities"].dataType.elementType]
    factors = factors or {}
    keep = None if labels is None else frozenset(labels)
    least = None if threshold is None else float(threshold) - 1e-7

    def run(batches):
        for batch in batches:
            out = []
            for found, text in zip(batch.column(at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                now = found or []
                for e in now:
                    e["confidence"] = min(1.0, max(0.0, e["confidence"] * factors.get(e["recognizer"], 1.0)))
                for linked, how in layers:
                    now = fold(now, linked, how)
                now = [e for e in now if (keep is None or e["label"] in keep) and (least is None or e["confidence"] >= least)]
                for e in now:
                    e["value"] = (text or "")[e["start"] : e["end"]]
                out.append([{k: e.get(k) for k in fields} for e in now])
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return scanned.mapInArrow(run, scanned.schema)


#: The standard layers: overlapping finds of one label merge, then labels are told apart by structure.
STANDARD = [(same_label, Merging("max")), (cross_label, Structural())]


def entity_schema() -> T.StructType:
    from veilspark.operators.recognize import ENTITY

    return T._parse_datatype_string(ENTITY)
