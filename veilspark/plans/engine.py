"""The whole way: documents to chunks, chunks to entities, entities to redacted documents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.labels import Catalog
from veilspark.operators import dictionaries, policy, recognize, reconcile
from veilspark.operators import rules as ruleset
from veilspark.sources import frames
from veilspark.sources.formats import Registry


@dataclass
class Analyzer:
    """Chunks to reconciled entities, one row each; everything stays on the chunk's row until the end."""

    scope: ruleset.Scope = field(default_factory=ruleset.Scope)
    rules: list[ruleset.Rule] = field(default_factory=lambda: list(ruleset.BUILT_IN))
    terms: list[dictionaries.Dictionary] = field(default_factory=lambda: list(dictionaries.BUILT_IN))
    layers: list = field(default_factory=lambda: list(reconcile.STANDARD))
    factors: dict[str, float] = field(default_factory=dict)
    threshold: float | None = ruleset.BASELINE
    labels: list[str] | None = None

    def annotate(self, chunks: DataFrame, *, text_col: str = "text", hints_col: str | None = None, language_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
        """The chunks with their reconciled entities as an array."""
        found = recognize.scan(chunks, self.scope, rules=self.rules, terms=self.terms, text_col=text_col, hints_col=hints_col, language_col=language_col, tokens_col=tokens_col)
        return reconcile.reconcile(found, self.layers, text_col=text_col, threshold=self.threshold, labels=self.labels, factors=self.factors)

    def analyze(self, chunks: DataFrame, *keys: str, exclusions: DataFrame | None = None, chunk_start: str | None = None, **columns) -> DataFrame:
        """Entities in document coordinates; exclusions are in chunk coordinates."""
        kept = [*keys, *([chunk_start] if chunk_start else [])]
        out = recognize.exploded(self.annotate(chunks, **columns), *kept)
        out = reconcile.cull(out, self.scope.catalog)
        if exclusions is not None:
            out = reconcile.exclude(out, exclusions, *keys)
        return reconcile.lift(out, chunk_start).drop(chunk_start) if chunk_start else out


@dataclass
class Anonymizer:
    policy: policy.Policy = field(default_factory=policy.standard_policy)

    def select(self, entities: DataFrame, *keys: str) -> DataFrame:
        """Selections, to look at or edit before apply()."""
        return policy.select(entities, self.policy, *keys)

    def apply(self, texts: DataFrame, selections: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
        done = selections if "replacement" in selections.columns else policy.with_replacements(selections, texts, self.policy, *keys, text_col=text_col)
        return policy.apply_selections(texts, done, *keys, text_col=text_col)

    def anonymize(self, texts: DataFrame, entities: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
        return self.apply(texts, self.select(entities, *keys), *keys, text_col=text_col)


@dataclass
class Orchestrator:
    """Files of any registered format: read, analyzed, redacted, written back; and tables of texts in one pass."""

    analyzer: Analyzer = field(default_factory=Analyzer)
    anonymizer: Anonymizer = field(default_factory=Anonymizer)
    registry: Registry = field(default_factory=Registry.with_built_in)

    def report(self, documents: DataFrame) -> DataFrame:
        """Entities of each document's chunks."""
        chunks = frames.read_chunks(documents, self.registry).where("error IS NULL")
        return self.analyzer.analyze(chunks, "path", "chunk_id", hints_col="hints")

    def anonymize(self, documents: DataFrame) -> DataFrame:
        """path and redacted content."""
        chunks = frames.read_chunks(documents, self.registry).where("error IS NULL")
        selections = self.anonymizer.select(self.report(documents), "path", "chunk_id")
        edits = policy.with_replacements(selections, chunks, self.anonymizer.policy, "path", "chunk_id").where("replacement IS NOT NULL")
        return frames.write_edits(documents, edits.withColumn("drop", F.lit(None).cast("string")), self.registry)

    def redact(self, texts: DataFrame, text_col: str = "text", **columns) -> DataFrame:
        """Texts of a table, redacted on their own rows: no shuffle."""
        return policy.redact_rows(self.analyzer.annotate(texts, text_col=text_col, **columns), self.anonymizer.policy, text_col=text_col)


def usage(entities: DataFrame) -> DataFrame:
    """Finds by recognizer and rule."""
    return entities.groupBy("recognizer", "rule").agg(F.count("*").alias("entities"))


def label_report(entities: DataFrame, catalog: Catalog) -> DataFrame:
    """Counts by category and label, with subtotals."""
    return reconcile.by_category(entities, catalog).rollup("category", "label").agg(F.count("*").alias("entities"))


def core_rules(names: Iterable[str]) -> list[ruleset.Rule]:
    wanted = set(names)
    return [r for r in ruleset.BUILT_IN if r.name in wanted]
