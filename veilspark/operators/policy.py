"""Policies: which operator treats an entity, and what its text becomes.

Rules are tried in order: by label, by tag, by predicate, or for all. Overlapping entities (of any label) form one
cluster; among their operators the one that gives away least wins, then the wider span, then the earlier. A cluster
without operator stays as it is. The cluster's first member lends its label, the text is that of the whole range."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import redact
from veilspark.labels import Catalog
from veilspark.operators.reconcile import islands


@dataclass(frozen=True)
class Operator:
    """apply(value, label) -> replacement; a null replacement leaves the text as it is."""

    id: str
    leak: str
    apply: Callable[[Column, Column], Column]
    undo: Callable[[Column], Column] | None = None

    def or_else(self, other: Operator) -> Operator:
        leak = min(self.leak, other.leak, key=redact.LEAK.get)
        return Operator(f"{self.id}-or-else-{other.id}", leak, lambda v, label: redact.or_else(self.apply(v, label), other.apply(v, label)))


ERASE = Operator("erase@1.0.0", "irrecoverable", lambda v, _: redact.erase(v))
KEEP = Operator("keep@1.0.0", "recoverable", lambda v, _: redact.keep(v))
STARS = Operator("mask@1.0.0", "partial", lambda v, _: redact.mask(v))


def masked(char: str = "*", prefix: int = 0, suffix: int = 0) -> Operator:
    return Operator("mask@1.0.0", "partial", lambda v, _: redact.mask(v, char, prefix, suffix))


def replaced(template: str = "[{label}]") -> Operator:
    return Operator("replace@1.0.0", "partial", lambda v, label: redact.replace(v, label, template))


def hashed(bits: int = 256, salt: str = "") -> Operator:
    return Operator("hash@1.0.0", "recoverable", lambda v, _: redact.sha2(v, bits, salt))


def hmac_hashed(key: bytes | dict[str, bytes], bits: int = 256) -> Operator:
    """One key, or a key by label ("" for others)."""
    def apply(v: Column, label: Column) -> Column:
        if isinstance(key, bytes):
            return redact.hmac(v, key, bits)
        out = redact.hmac(v, key[""], bits) if "" in key else F.lit(None).cast("string")
        for name, k in key.items():
            if name:
                out = F.when(label == name, redact.hmac(v, k, bits)).otherwise(out)
        return out

    return Operator("hmac@1.0.0", "recoverable", apply)


def encrypted(key: bytes) -> Operator:
    return Operator("encrypt@1.0.0", "recoverable", lambda v, _: redact.encrypt(v, key), lambda v: redact.decrypt(v, key))


def pseudonymized(key: bytes) -> Operator:
    return Operator("pseudonymize@1.0.0", "recoverable", lambda v, label: redact.surrogate(v, label, key=key))


def faked(seed: str = "") -> Operator:
    return Operator("fake@1.0.0", "partial", lambda v, label: redact.shape_preserving(v, F.concat(F.lit(seed), label, v)))


def clamped(**bounds) -> Operator:
    return Operator("clamp@1.0.0", "partial", lambda v, _: redact.clamp(v, **bounds))


def generalized_date(to: str = "year", style: str | None = None) -> Operator:
    return Operator("generalize_date@1.0.0", "partial", lambda v, _: redact.generalize_date(v, to, style))


@dataclass
class Policy:
    """Ordered rules; catalog tells a label's tags."""

    catalog: Catalog = field(default_factory=Catalog.built_in)
    rules: list[tuple[str, object, Operator, str | None]] = field(default_factory=list)

    def label(self, *labels: str, use: Operator, because: str | None = None) -> Policy:
        self.rules.append(("label", labels, use, because))
        return self

    def tag(self, tag: str, use: Operator, because: str | None = None) -> Policy:
        self.rules.append(("tag", tag, use, because))
        return self

    def predicate(self, where: Column | Callable[[Callable[[str], Column]], Column], use: Operator, because: str | None = None) -> Policy:
        """where: a condition on a frame's columns, or a function that makes one from a function of field names, such as
        lambda of: of("confidence") > 0.9, which holds for rows' own entity arrays too."""
        self.rules.append(("predicate", where, use, because))
        return self

    def fallback(self, use: Operator, because: str | None = None) -> Policy:
        self.rules.append(("fallback", None, use, because))
        return self

    def _test(self, kind: str, what, of: Callable[[str], Column]) -> Column:
        if kind == "label":
            return of("label").isin(*what)
        if kind == "tag":
            return of("label").isin(*self.catalog.tagged(what)) if self.catalog.tagged(what) else F.lit(False)
        if kind == "predicate":
            return what(of) if callable(what) and not isinstance(what, Column) else what
        return F.lit(True)

    def choose(self, of: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
        """Position of the first rule that fits an entity (null: none), and what it matched by; of: its fields by name."""
        at, by = F.lit(None).cast("int"), F.lit(None).cast("string")
        for i, (kind, what, _, _) in reversed(list(enumerate(self.rules))):
            fits = F.coalesce(self._test(kind, what, of), F.lit(False))
            at, by = F.when(fits, i).otherwise(at), F.when(fits, kind).otherwise(by)
        return at, by

    def per_rule(self, position: Column, make: Callable[[Operator, str | None], Column]) -> Column:
        out = F.lit(None).cast("string")
        for i, (_, _, use, because) in enumerate(self.rules):
            out = F.when(position == i, make(use, because)).otherwise(out)
        return out


def select(entities: DataFrame, policy: Policy, *keys: str) -> DataFrame:
    """Selections: keys, start, end (the cluster's range), operator_id, leak, matched_by, attribution, rule_at, label
    (of the first member) and members. Rows without operator are kept out, and their clusters too."""
    at, by = policy.choose()
    found = islands(entities.withColumn("rule_at", at).withColumn("matched_by", by), *keys)
    leak = policy.per_rule(F.col("rule_at"), lambda use, _: F.lit(str(redact.LEAK[use.leak]))).cast("int")
    rank = F.struct(leak.alias("leak"), (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("early"), F.col("rule_at"), F.col("matched_by"))
    first = F.struct("start", "end", "label")
    out = found.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(first).alias("first"), F.count("*").alias("members"),
        F.max(F.when(F.col("rule_at").isNotNull(), rank)).alias("best"),
    )
    out = out.where(F.col("best").isNotNull()).select(*keys, "start", "end", F.col("first.label").alias("label"), "members", F.col("best.rule_at").alias("rule_at"), F.col("best.matched_by").alias("matched_by"))
    return out.withColumn("operator_id", policy.per_rule(F.col("rule_at"), lambda use, _: F.lit(use.id))).withColumn("leak", policy.per_rule(F.col("rule_at"), lambda use, _: F.lit(use.leak))).withColumn("attribution", policy.per_rule(F.col("rule_at"), lambda _, because: F.lit(because).cast("string")))


def with_replacements(selections: DataFrame, texts: DataFrame, policy: Policy, *keys: str, text_col: str = "text") -> DataFrame:
    """Selections with value (the range's text) and replacement."""
    both = selections.join(texts.select(*keys, F.col(text_col).alias("text_")), list(keys))
    value = F.substring(F.col("text_"), F.col("start") + 1, F.col("end") - F.col("start"))
    out = both.withColumn("value", value).drop("text_")
    return out.withColumn("replacement", policy.per_rule(F.col("rule_at"), lambda use, _: use.apply(F.col("value"), F.col("label"))))


def splice(text: Column, edits: Column) -> Column:
    """The text with its edits (array of struct start, end, replacement; apart from each other, in any order) made."""
    order = F.array_sort(F.filter(edits, lambda e: e["replacement"].isNotNull() & (e["start"] >= 0) & (e["end"] <= F.length(text)) & (e["start"] <= e["end"])))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    def step(a, e):
        return F.struct(e["end"].cast("int").alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["replacement"])).alias("out"))

    def finish(a):
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    return F.when(F.size(order) > 0, F.aggregate(order, state, step, finish)).otherwise(text)


def apply_selections(texts: DataFrame, selections: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Texts with all their replacements made; texts without any stay."""
    edits = selections.groupBy(*keys).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "replacement")).alias("edits_"))
    both = texts.join(edits, list(keys), "left")
    return both.withColumn(text_col, F.when(F.col("edits_").isNotNull(), splice(F.col(text_col), F.col("edits_"))).otherwise(F.col(text_col))).drop("edits_")


def redact_rows(scanned: DataFrame, policy: Policy, *, text_col: str = "text") -> DataFrame:
    """The same on each row's own entity array, without a shuffle: clusters by a fold over sorted entities.

    Predicates must be functions here: a Column names columns of a frame of entities, which a row's array has not."""
    if any(k == "predicate" and isinstance(w, Column) for k, w, *_ in policy.rules):
        raise ValueError("a predicate must be a function of field names here; a Column needs select() and apply_selections()")

    def ranked(e: Column) -> Column:
        at, _ = policy.choose(lambda name: e[name])
        leak = F.lit(-1)
        for i, (_, _, use, _) in enumerate(policy.rules):
            leak = F.when(at == i, redact.LEAK[use.leak]).otherwise(leak)
        best = F.struct(leak.alias("leak"), (e["end"] - e["start"]).alias("size"), (-e["start"]).alias("early"), F.coalesce(at, F.lit(-1)).alias("rule_at"))
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), best.alias("best"))

    spans = F.array_sort(F.transform("entities", ranked))
    kind = "array<struct<start:int,end:int,label:string,best:struct<leak:int,size:int,early:int,rule_at:int>>>"

    def step(out: Column, e: Column) -> Column:
        now = e["best"]
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & F.coalesce(F.try_element_at(out, F.lit(-1))["end"] > e["start"], F.lit(False))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], e["end"]).alias("end"), last["label"].alias("label"), F.greatest(last["best"], now).alias("best"))
        fresh = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), now.alias("best"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(fresh))).cast(kind)

    merged = F.aggregate(spans, F.array().cast(kind), step)

    def edit(c: Column) -> Column:
        value = F.substring(F.col(text_col), c["start"] + 1, c["end"] - c["start"])
        out = F.lit(None).cast("string")
        for i, (_, _, use, _) in enumerate(policy.rules):
            out = F.when(c["best"]["rule_at"] == i, use.apply(value, c["label"])).otherwise(out)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), out.alias("replacement"))

    return scanned.withColumn("edits_", F.transform(merged, edit)).withColumn(text_col, splice(F.col(text_col), F.col("edits_"))).drop("edits_")


def deanonymize(texts: DataFrame, selections: DataFrame, policy: Policy, *keys: str) -> DataFrame:
    """Selections with recovered: the value that the first reversible operator for them gives back, or null.

    A rule by label, by tag or for all is for a selection by its label; one by predicate for those it was chosen for."""
    at = F.lit(None).cast("string")
    for i, (kind, what, use, _) in reversed(list(enumerate(policy.rules))):
        if use.undo is not None:
            chosen = F.col("rule_at") == i if "rule_at" in selections.columns else F.lit(False)
            test = chosen if kind == "predicate" else policy._test(kind, what, F.col)
            at = F.when(test, use.undo(F.col("replacement"))).otherwise(at)
    return selections.join(texts.select(*keys).distinct(), list(keys), "left_semi").withColumn("recovered", at)


def standard_policy() -> Policy:
    """Names for contact data and numbers, stars for cards, nothing for the rest."""
    return Policy().label("email_address", "phone_number", "iban", "government_id", "ip_address", use=replaced()).label("payment_card", use=STARS).fallback(ERASE)
