"""What the plans look like: what is read, and where rows are moved."""

import re

from pyspark.sql import functions as F

from veilspark.operators import policy, recognize
from veilspark.plans import queries as own
from veilspark.plans.engine import Analyzer, Orchestrator, core_rules
from veilspark.sources import frames


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>", plan(df)) for c in m.split(",")})


def test_detection_and_row_redaction_do_not_shuffle(spark, small):
    docs = own.table(spark, small, "documents").select("doc_id", "text")
    core = Analyzer(rules=core_rules(["email", "ipv4"]), terms=[])
    for df in (core.analyze(docs, "doc_id"), Orchestrator(core).redact(docs), own.all_families(docs), frames.paragraphs(docs, "doc_id"), own.QUERIES["detected_language"](spark, small)):
        assert "Exchange" not in plan(df)
        assert read_columns(df) == ["doc_id", "text"]


def test_families_scan_once_and_stay_native(spark, small):
    p = plan(own.all_families(own.table(spark, small, "documents")))
    assert p.count("Scan parquet") == 1 and "Python" not in p and "Arrow" not in p


def test_native_spans_filter_before_they_match(spark, small):
    p = plan(own.family(own.table(spark, small, "documents"), "email_address"))
    assert p.index("RLIKE") >= 0 and "Python" not in p and "Exchange" not in p


def test_frames_shuffle_by_document_alone(spark, small):
    docs = own.table(spark, small, "documents").select("doc_id", "text")
    found = own.family(docs, "email_address")
    rules = policy.Policy().label("email_address", use=policy.replaced())
    chosen = policy.select(found, rules, "doc_id")
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)", plan(chosen))
    assert exchanges and all(kind == "hashpartitioning" and "doc_id" in keys for kind, keys in exchanges)
    for df in (chosen, own.QUERIES["structural_relations"](spark, small), own.QUERIES["exclusions"](spark, small)):
        assert "CartesianProduct" not in plan(df)


def test_columns_are_pruned(spark, small):
    assert read_columns(own.QUERIES["text_operators"](spark, small)) == ["c_custkey", "c_mktsegment", "c_name"]
    assert read_columns(own.QUERIES["checksum_validators"](spark, small)) == ["o_orderkey"]
    assert read_columns(recognize.native_spans(own.table(spark, small, "conversations"), "[0-9]{4}", "x", 0.5, keys=("conv_id",))) == ["conv_id", "text"]


def test_predicates_reach_the_scan(spark, small):
    docs = own.table(spark, small, "documents").where(F.col("doc_id") < 10)
    assert "LessThan(doc_id,10)" in plan(Analyzer(rules=core_rules(["email"]), terms=[]).analyze(docs, "doc_id"))
