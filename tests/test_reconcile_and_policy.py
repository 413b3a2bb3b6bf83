import itertools
import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import redact
from veilspark.labels import Catalog
from veilspark.operators import audit, enrich, policy, recognize, reconcile, vault
from veilspark.operators.reconcile import Exclusive, Merging, Permissive, Structural, cross_label, fold, longest_span, same_label
from veilspark.plans.engine import Analyzer, Anonymizer, Orchestrator, label_report, usage


def e(label, start, end, confidence):
    return {"label": label, "start": start, "end": end, "confidence": confidence, "recognizer": "pattern", "rule": label}


def kept(entities, linked, how):
    return [(x["label"], x["start"], x["end"], round(x["confidence"], 3)) for x in fold(entities, linked, how)]


def test_folds():
    assert kept([e("a", 0, 5, 0.6), e("a", 3, 9, 0.6)], same_label, Merging()) == [("a", 0, 9, 0.6)]
    assert kept([e("a", 0, 5, 0.6), e("a", 3, 9, 0.6)], same_label, Merging("noisy_or")) == [("a", 0, 9, 0.84)]
    assert kept([e("a", 0, 9, 0.6), e("b", 2, 5, 0.5)], cross_label, Structural()) == [("a", 0, 9, 0.6), ("b", 2, 5, 0.5)]
    assert kept([e("a", 0, 9, 0.9), e("b", 2, 5, 0.5)], cross_label, Structural()) == [("a", 0, 9, 0.9)]
    assert kept([e("b", 2, 5, 0.5), e("a", 0, 9, 0.75)], cross_label, Structural()) == [("a", 0, 9, 0.75)]
    assert kept([e("a", 0, 6, 0.5), e("b", 1, 8, 0.9)], cross_label, Structural()) == [("b", 1, 8, 0.9)]
    assert len(kept([e("a", 0, 6, 0.5), e("b", 5, 12, 0.9)], cross_label, Structural())) == 2
    assert len(kept([e("a", 0, 5, 0.2), e("b", 0, 5, 0.9)], cross_label, Structural())) == 2
    assert len(kept([e("a", 0, 5, 0.9), e("b", 0, 5, 0.2)], cross_label, Structural())) == 1
    assert kept([e("a", 0, 3, 0.9), e("a", 1, 9, 0.1)], same_label, Exclusive(longest_span)) == [("a", 1, 9, 0.1)]
    both = fold([e("a", 0, 6, 0.5), e("b", 1, 8, 0.9)], cross_label, Structural(wins=None))
    assert len(both) == 2 and all(x["events"][0][0] == "contested" for x in both)
    assert len(fold([e("a", 0, 6, 0.5), e("b", 1, 8, 0.9)], cross_label, Permissive())) == 2
    assert kept([e("a", 0, 5, 0.6), e("a", 5, 9, 0.6)], same_label, Merging()) == [("a", 0, 5, 0.6), ("a", 5, 9, 0.6)]


def test_merging_is_idempotent_and_order_free():
    rng = random.Random(1)
    for _ in range(100):
        es = [e(rng.choice("ab"), s := rng.randrange(40), s + rng.randrange(1, 12), rng.random()) for _ in range(rng.randrange(1, 9))]
        once = fold(es, same_label, Merging())
        assert fold(once, same_label, Merging()) == once
        rng.shuffle(es)
        assert sorted(kept(es, same_label, Merging())) == sorted((x["label"], x["start"], x["end"], round(x["confidence"], 3)) for x in once)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label string, start int, end int, confidence float, recognizer string")


def test_frames_agree_with_folds(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice("ab"), s := rng.randrange(60), s + rng.randrange(1, 15), round(rng.random(), 3), "pattern") for d in range(40) for _ in range(rng.randrange(1, 12))]
    got = sorted((r.doc_id, r.label, r.start, r.end, round(r.confidence, 3)) for r in reconcile.merge_same_label(frame(spark, rows), "doc_id").collect())
    expected = sorted((d, *x) for d, own in itertools.groupby(rows, key=lambda r: r[0]) for x in kept([e(*r[1:5]) for r in own], same_label, Merging()))
    assert got == expected


def test_plain_layers(spark):
    df = frame(spark, [(1, "a", 0, 5, 0.5, "pattern"), (1, "b", 5, 9, 0.5, "ner"), (2, "a", 0, 5, 0.9, "ner"), (None, "a", 0, 5, 0.9, "ner")])
    assert [round(r.confidence, 2) for r in reconcile.calibrate(df, {"ner": 1.5}).orderBy("doc_id", "start").collect()] == [1.0, 0.5, 0.75, 1.0]
    assert reconcile.filter_entities(df, ["a"], 0.6).count() == 2
    assert reconcile.cull(df, Catalog().with_label("b")).count() == 1 and reconcile.cull(df, Catalog()).count() == 4
    x = spark.createDataFrame([(1, 4, 5), (None, 0, 1)], "doc_id long, start int, end int")
    assert sorted((r.doc_id, r.label) for r in reconcile.exclude(df, x, "doc_id").collect()) == [(1, "b"), (2, "a")]
    lifted = reconcile.lift(df.withColumn("chunk_start", F.lit(10)))
    assert {(r.start, r.end) for r in lifted.collect()} == {(10, 15), (15, 19)}
    report = label_report(df.withColumn("label", F.lit("iban")), Catalog.built_in()).collect()
    assert {(r.category, r.label, r.entities) for r in report} == {("financial", "iban", 4), ("financial", None, 4), (None, None, 4)}
    assert reconcile.relation((0, 5), (0, 5)) == ("contains", 1.0)


# Operators


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_text_operators(spark):
    import hashlib
    import hmac

    assert one(spark, "abcdef", lambda v: redact.mask(v, "#", 1, 2)) == "a###ef"
    assert one(spark, "abc", lambda v: redact.mask(v, "#", 1, 2)) == "abc"
    assert one(spark, "x", lambda v: redact.replace(v, F.lit("iban"), "<{label}:{value}:{coref}>", F.lit("c1"))) == "<iban:x:c1>"
    assert one(spark, "abcdef", lambda v: redact.truncate(v, 1, 2)) == "aef"
    with pytest.raises(Exception, match="truncate"):
        one(spark, "abc", lambda v: redact.truncate(v, 1, 2))
    for key in (b"k", b"k" * 200):
        assert one(spark, "é", lambda v, key=key: redact.hmac(v, key)) == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
        assert one(spark, "é", lambda v, key=key: redact.hmac(v, key, 512)) == hmac.new(key, "é".encode(), hashlib.sha512).hexdigest()
    key = bytes(range(32))
    assert one(spark, "secret", lambda v: redact.decrypt(redact.encrypt(v, key), key)) == "secret"
    assert one(spark, "secret", lambda v: redact.decrypt(redact.encrypt(v, key), key[::-1])) is None
    assert one(spark, "not base64!", lambda v: redact.decrypt(v, key)) is None
    for value, out in (("95", "90+"), ("90", "90+"), ("3", "<5"), ("50", "50"), ("x", None), ("NaN", None)):
        assert one(spark, value, lambda v: redact.clamp(v, 5, 90)) == out
    assert one(spark, "x", lambda v: redact.or_else(redact.clamp(v, 5, 90), redact.erase(v))) == ""
    for value, to, out in (("1990-02-28", "year", "1990"), ("1990-02-28", "year_month", "1990-02"), ("02/28/1990", "year_month", "02/1990"), ("1990-02-30", "year", None), ("1990-02-28", "hour", None), ("1990-02-28T13:45:00Z", "hour", "1990-02-28T13:00"), ("soon", "year", None)):
        assert one(spark, value, lambda v, to=to: redact.generalize_date(v, to)) == out
    fake = one(spark, "Ab-12 é", lambda v: redact.shape_preserving(v, v))
    assert fake[0].isupper() and fake[1].islower() and fake[2] == "-" and fake[3:5].isdigit() and fake[5:] == " é"
    assert one(spark, None, redact.erase) is None


# Policies


def test_policy_and_splice(spark):
    texts = spark.createDataFrame([(1, "mail a@b.cd and 4111111111111111!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = frame(spark, [(1, "email_address", 5, 11, 0.5, "p"), (1, "url", 5, 9, 0.9, "p"), (1, "payment_card", 16, 32, 0.9, "p"), (1, "unknown", 0, 4, 0.9, "p")])
    rules = policy.Policy().label("email_address", use=policy.replaced()).label("url", use=policy.KEEP).tag("pci", policy.STARS, "card rule")
    chosen = policy.select(found, rules, "doc_id")
    got = {(r.start, r.end): (r.operator_id, r.matched_by, r.attribution, r.members) for r in chosen.collect()}
    assert got == {(5, 11): ("replace@1.0.0", "label", None, 2), (16, 32): ("mask@1.0.0", "tag", "card rule", 1)}
    done = {r.doc_id: r.text for r in Anonymizer(rules).anonymize(texts, found, "doc_id").collect()}
    assert done == {1: "mail [url] and ****************!", 2: "nothing", 3: None}  # the first member lends its label


def test_rows_and_frames_redact_alike(spark):
    docs = spark.createDataFrame([(1, "Write to ann@example.com, card 4111 1111 1111 1111, IBAN GB29 NWBK 6016 1331 9268 19."), (2, ""), (3, None), (4, "clean text")], "doc_id long, text string")
    o = Orchestrator()
    rows = {r.doc_id: r.text for r in o.redact(docs).collect()}
    found = o.analyzer.analyze(docs, "doc_id")
    frames = {r.doc_id: r.text for r in o.anonymizer.anonymize(docs, found, "doc_id").collect()}
    assert rows == frames
    assert rows[1] == "Write to [email_address], card *******************, IBAN [iban]." and rows[4] == "clean text"
    assert {r.rule for r in usage(found).collect()} >= {"email", "credit-card", "iban"}


def test_reversal(spark):
    key = bytes(range(32))
    docs = spark.createDataFrame([(1, "ann@example.com here")], "doc_id long, text string")
    rules = policy.Policy().label("email_address", use=policy.encrypted(key)).fallback(policy.ERASE)
    found = Analyzer().analyze(docs, "doc_id")
    done = policy.with_replacements(policy.select(found, rules, "doc_id"), docs, rules, "doc_id")
    assert policy.deanonymize(docs, done.cache(), rules, "doc_id").first().recovered == "ann@example.com"


def test_vault(spark, tmp_path):
    df = spark.createDataFrame([("email_address", "a@b.cd"), ("email_address", "a@b.cd"), ("iban", "a@b.cd")], "label string, value string")
    got = vault.entries(df, b"key")
    assert got.count() == 2 and got.select("surrogate").distinct().count() == 2
    path = f"file://{tmp_path}/vault"
    for _ in range(2):
        vault.append(got, path)
    assert spark.read.parquet(path).count() == 2
    assert {r.original for r in vault.reverse(got.select("label", "surrogate"), spark.read.parquet(path)).collect()} == {"a@b.cd"}
    twice = spark.read.parquet(path).union(got)  # as two writers leave it
    assert vault.reverse(got.select("label", "surrogate"), twice).count() == 2
    assert {len(r.surrogate.rsplit("_", 1)[1]) for r in got.collect()} == {32}


def test_audit(spark):
    df = spark.createDataFrame([(0.5,)], "c float")
    first = audit.event(F.lit("email"), "pattern", F.col("c"))
    chain = audit.record(audit.begin(first), F.lit("context"), "refinement", F.lit(0.85), F.lit("mail"))
    other = audit.begin(audit.event(F.lit("ner"), "model", F.lit(0.4)))
    fused = audit.fuse(chain, other, F.lit("reconcile"), "deduplication", F.lit(0.85))
    r = df.select(chain.alias("chain"), fused.alias("fused"))
    r = r.select(audit.verify(F.col("chain")).alias("a"), audit.verify(F.col("fused")).alias("b"), audit.verify(F.slice("fused", 2, 3)).alias("c"), audit.verify(F.reverse("chain")).alias("d"), audit.original_confidence(F.col("chain")).alias("x"), audit.final_confidence(F.col("chain")).alias("y"), audit.recognizers(F.col("fused")).alias("z")).first()
    assert (r.a, r.b, r.c, r.d) == (True, True, False, False)
    assert (round(r.x, 2), round(r.y, 2), r.z) == (0.5, 0.85, ["email", "ner"])
    with pytest.raises(ValueError):
        audit.event(F.lit("x"), "nope", F.lit(1.0))


# Models


def test_ner_and_llm(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob in Oslo"), (2, None)], "doc_id long, text string")
    ner = enrich.Ner("ner", enrich.mock_ner({"Ann": "PER", "Bob": "PER", "Oslo": "LOC"}), mapping={"PER": "person_name", "LOC": "city"}, ignored=("city",), scales={"person_name": 0.5})
    assert sorted((r.value, r.label, round(r.confidence, 2)) for r in ner.recognize(docs, "doc_id").collect()) == [("Ann", "person_name", 0.45), ("Bob", "person_name", 0.45)]
    llm = enrich.Llm("llm", lambda prompt: [{"label": "city", "value": "Oslo", "context": "in  Oslo"}, {"label": "city", "value": "n"}], labels=("city",))
    assert [(r.value, r.start) for r in llm.recognizer().recognize(docs, "doc_id").collect()] == [("Oslo", 15)]
    assert enrich.localize("a  b é", "b é") == (3, 6)
    assert enrich.localize("x x", "x") is None and enrich.localize("x x", "x", first=True) == (0, 1)


def test_languages_and_places(spark):
    docs = spark.createDataFrame([("the cat is in the house and it was for you",), ("der Hund und die Katze sind nicht im Haus",), ("xyz",)], "text string")
    got = [r.languages for r in enrich.enrich_languages(docs).collect()]
    assert [g[0].tag if g else None for g in got] == ["en", "de", None]
    assert enrich.enrich_languages(docs, asserted=["fr"]).first().languages[0].provenance == "asserted"
    w = spark.sql("SELECT array(named_struct('start', 0, 'end', 3, 'left', 1, 'top', 1, 'right', 5, 'bottom', 3, 'from_us', 10, 'to_us', 20, 'speaker', 'a'), named_struct('start', 4, 'end', 8, 'left', 6, 'top', 0, 'right', 9, 'bottom', 3, 'from_us', 20, 'to_us', 40, 'speaker', 'b')) AS w")
    r = w.select(enrich.resolve_box(F.col("w"), F.lit(2), F.lit(5)).alias("b"), enrich.resolve_time(F.col("w"), F.lit(2), F.lit(5)).alias("t"), enrich.resolve_box(F.col("w"), F.lit(9), F.lit(10)).alias("n")).first()
    assert tuple(r.b) == (1, 0, 9, 3) and tuple(r.t) == (10, 40, None) and r.n is None


def test_native_spans_equal_python(spark):
    import re

    texts = ["a1b22", "", None, "777", "x", "é1é22é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.value) for r in recognize.native_spans(df, "[0-9]+", "n", 0.5).collect())
    assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) if t for m in re.finditer("[0-9]+", t))


def test_rows_refuse_predicates_on_columns(spark):
    rules = policy.Policy().predicate(F.col("confidence") > 0.5, policy.ERASE)
    with pytest.raises(ValueError, match="predicate"):
        policy.redact_rows(spark.createDataFrame([], "text string"), rules)


@pytest.mark.parametrize("rules", [
    policy.Policy().predicate(lambda of: of("value").startswith("ann"), policy.STARS).fallback(policy.replaced()),
    policy.Policy().label("iban", use=policy.KEEP).predicate(lambda of: of("confidence") > 2, policy.ERASE).tag("pci", policy.masked("#", 4)),
    policy.Policy().predicate(lambda of: of("keyword").isNotNull(), policy.ERASE).label("email_address", use=policy.hashed()),
    policy.Policy(),
])
def test_rows_and_frames_agree_under_every_kind_of_rule(spark, rules):
    docs = spark.createDataFrame([(1, "Write to ann@example.com or bob@example.com, card 4111 1111 1111 1111, IBAN GB29 NWBK 6016 1331 9268 19."), (2, "https://example.com/a?b=ann@example.com"), (3, None)], "doc_id long, text string")
    o = Orchestrator()
    o.anonymizer.policy = rules
    rows = {r.doc_id: r.text for r in o.redact(docs).collect()}
    frames = {r.doc_id: r.text for r in o.anonymizer.anonymize(docs, o.analyzer.analyze(docs, "doc_id"), "doc_id").collect()}
    assert rows == frames
    assert (rows[1] == docs.first().text) == (not rules.rules)


def test_reversal_by_tag_and_predicate(spark):
    key = bytes(range(32))
    docs = spark.createDataFrame([(1, "ann@example.com pays by card 4111 1111 1111 1111")], "doc_id long, text string")
    rules = policy.Policy().tag("pci", policy.encrypted(key)).predicate(lambda of: of("value").startswith("ann"), policy.encrypted(key))
    done = policy.with_replacements(policy.select(Analyzer().analyze(docs, "doc_id"), rules, "doc_id"), docs, rules, "doc_id")
    assert {r.recovered for r in policy.deanonymize(docs, done.cache(), rules, "doc_id").collect()} == {"ann@example.com", "4111 1111 1111 1111"}


def test_structural_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice("abc"), s := rng.randrange(60), s + rng.randrange(1, 12), 0.5) for _ in range(80)]
    df = spark.createDataFrame(rows, "chunk int, label string, start int, end int, confidence double")
    got = sorted((r.chunk, r.a_label, r.b_label, r.a_start, r.a_end, r.b_start, r.b_end) for r in reconcile.structural_pairs(df, "chunk").collect())
    assert got == sorted((a[0], a[1], b[1], a[2], a[3], b[2], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3])
