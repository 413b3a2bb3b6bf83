"""Named queries over the driver's tables, and the same in DuckDB SQL where SQL can say it.

Patterns of queries that are held against SQL name their characters, so that both engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checks, redact
from veilspark.labels import Catalog
from veilspark.operators import audit, enrich, policy, recognize, reconcile, rules, vault
from veilspark.plans import check_queries, rule_queries
from veilspark.plans.engine import Analyzer, Anonymizer, Orchestrator, core_rules, label_report, usage
from veilspark.sources import frames
from veilspark.streaming import detect as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEY = bytes(range(32))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Spans of one family, by built-in functions

FAMILIES = {
    "email_address": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.5),
    "ip_address": (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", 0.6),
    "payment_card": (r"[1-6][0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}", 0.3),
    "phone_number": (r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.4),
    "government_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.5),
    "api_key": (r"(?:AKIA|ASIA)[0-9A-Z]{16}", 0.95),
    "url": (r"https?://[^ \n\r\t/$.?#][^ \n\r\t]*", 0.5),
    "date_time": (r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", 0.4),
}
CHECKS = {"payment_card": checks.luhn, "government_id": checks.ssn}
_LUHN_SQL = "(SELECT sum(CASE WHEN i % 2 = 0 THEN (CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END) ELSE d END) FROM (SELECT CAST(unnest(string_split(reverse(regexp_replace(value, '[^0-9]', '', 'g')), '')) AS INT) AS d, unnest(range(1, 1 + length(regexp_replace(value, '[^0-9]', '', 'g')))) AS i)) % 10 = 0"
_SSN_SQL = "CAST(value[1:3] AS INT) BETWEEN 1 AND 899 AND value[1:3] <> '666' AND value[5:6] <> '00' AND value[8:11] <> '0000'"
CHECKS_SQL = {"payment_card": _LUHN_SQL, "government_id": _SSN_SQL}


def family(docs: DataFrame, label: str, *keys: str) -> DataFrame:
    rx, score = FAMILIES[label]
    return recognize.native_spans(docs, rx, label, score, keys=keys or ("doc_id",), check=CHECKS.get(label))


def family_sql(label: str, key: str = "doc_id", source: str = "documents") -> str:
    rx, score = FAMILIES[label]
    return f"""SELECT {key}, '{label}' AS label, CAST(start AS INTEGER) AS start, CAST(start + length(value) AS INTEGER) AS "end", value, CAST({score} AS FLOAT) AS confidence FROM (
  SELECT {key}, m[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '{rx}') AS m, regexp_split_to_array(text, '{rx}') AS g FROM {source} WHERE text IS NOT NULL))
) WHERE {CHECKS_SQL.get(label, "true")}"""


#: Families of which the documents have few or none: table, key and text, in both languages alike.
MADE = {
    "government_id": ("customer", "c_custkey", "concat('ssn ', lpad(cast(c_custkey * 7919 % 1000 AS string), 3, '0'), '-', lpad(cast(c_custkey % 100 AS string), 2, '0'), '-', lpad(cast(c_custkey * 31 % 10000 AS string), 4, '0'), ' or 123-45-6789.')"),
    "api_key": ("customer", "c_custkey", "concat('key AKIA', upper(substring(md5(c_name), 1, 16)), ', then ASIA', upper(substring(md5(c_mktsegment), 1, cast(14 + c_custkey % 4 AS int))))"),
    "url": ("supplier", "s_suppkey", "concat('see https://example.org/', lower(s_name), '?id=', cast(s_suppkey AS string), ' and http:// or ftp://x, http://b.example')"),
    "date_time": ("orders", "o_orderkey", "concat('from ', cast(cast(o_orderdate AS date) AS string), ' to 2024-02-30, 1815-06-18')"),
}


def _register_families() -> None:
    for label in FAMILIES:
        name = f"spans_{label}"
        source, key, text = MADE.get(label, ("documents", "doc_id", "text"))
        QUERIES[name] = lambda spark, sf_dir, label=label, source=source, key=key, text=text: family(table(spark, sf_dir, source).selectExpr(key, f"{text} AS text"), label, key)
        ORACLE[name] = family_sql(label, key, f"(SELECT {key}, {text} AS text FROM {source})")


_register_families()


def _named(spans: Column, label: str, score: float) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"), F.lit(score).cast("float").alias("confidence")))


def all_families(docs: DataFrame, *keys: str) -> DataFrame:
    """Every family's spans from one scan: arrays of spans side by side, then one row each; texts that no family's
    cheap test passes make no array."""
    text, parts = F.col("text"), []
    for label, (rx, score) in FAMILIES.items():
        parts.append(F.when(text.rlike(rx), _named(recognize.span_array(text, rx), label, score)).otherwise(F.array().cast("array<struct<label:string,start:int,end:int,value:string,confidence:float>>")))
    rows = docs.select(*(keys or ("doc_id",)), F.inline(F.concat(*parts)))
    keep = F.lit(True)
    for label, check in CHECKS.items():
        keep = keep & ((F.col("label") != label) | check(F.col("value")))
    return rows.where(keep)


ALL_SQL = " UNION ALL ".join(f"({family_sql(x)})" for x in FAMILIES)
_CATEGORIES = "(VALUES " + ", ".join(f"('{x}', '{Catalog.built_in().category(x)}')" for x in FAMILIES) + ") AS c(label, category)"


@query(f"SELECT category, label, count(*) AS entities FROM ({ALL_SQL}) JOIN {_CATEGORIES} USING (label) GROUP BY ROLLUP (category, label)")
def label_rollup(spark, sf_dir):
    return label_report(all_families(table(spark, sf_dir, "documents")), Catalog.built_in())


@query(f"SELECT doc_id, label, start, \"end\", CAST(least(1.0, confidence * CASE label WHEN 'url' THEN 0.5 ELSE 1.2 END) AS FLOAT) AS confidence FROM ({ALL_SQL}) WHERE CAST(least(1.0, CAST(confidence AS DOUBLE) * CASE label WHEN 'url' THEN 0.5 ELSE 1.2 END) AS FLOAT) >= CAST(0.35 AS FLOAT)")
def calibrated_and_filtered(spark, sf_dir):
    found = all_families(table(spark, sf_dir, "documents")).withColumn("recognizer", F.when(F.col("label") == "url", "links").otherwise("pattern"))
    kept = reconcile.filter_entities(reconcile.calibrate(found, {"links": 0.5, "pattern": 1.2}))
    return kept.select("doc_id", "label", "start", "end", "confidence")


@query(f"SELECT doc_id, label, start FROM ({ALL_SQL}) WHERE label IN ('email_address', 'payment_card')")
def catalog_cull(spark, sf_dir):
    found = all_families(table(spark, sf_dir, "documents"))
    return reconcile.cull(found, Catalog().with_label("email_address").with_label("payment_card")).select("doc_id", "label", "start")


@query(f"SELECT doc_id, label, start FROM ({ALL_SQL}) WHERE label IN ({', '.join(repr(x) for x in FAMILIES if 'pii' in Catalog.built_in().labels[x][1])})")
def tagged_labels(spark, sf_dir):
    found = all_families(table(spark, sf_dir, "documents"))
    return found.where(F.col("label").isin(Catalog.built_in().tagged("pii"))).select("doc_id", "label", "start")


@query(f"SELECT doc_id, label, start, \"end\" FROM ({ALL_SQL}) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, 0 AS s, 400 AS t FROM documents WHERE source = 'src1') x WHERE x.doc_id = e.doc_id AND e.start < x.t AND x.s < e.\"end\")")
def exclusions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    excluded = docs.where("source = 'src1'").select("doc_id", F.lit(0).alias("start"), F.lit(400).alias("end"))
    return reconcile.exclude(all_families(docs), excluded, "doc_id").select("doc_id", "label", "start", "end")


# Spans to reconcile: line items as labelled intervals of an order

SPANS_SQL = "SELECT l_orderkey AS chunk, l_returnflag AS label, CAST(l_partkey % 97 AS INTEGER) AS start, CAST(l_partkey % 97 + CAST(l_quantity AS BIGINT) AS INTEGER) AS \"end\", CAST(CAST(round(l_discount * 100) AS BIGINT) % 10 / 10.0 AS FLOAT) AS confidence FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0"


def spans(spark, sf_dir) -> DataFrame:
    start = (F.col("l_partkey") % 97).cast("int")
    size = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").where(size > 0)
    return rows.select(F.col("l_orderkey").alias("chunk"), F.col("l_returnflag").alias("label"), start.alias("start"), (start + size).cast("int").alias("end"), (F.round(F.col("l_discount") * 100).cast("long") % 10 / 10.0).cast("float").alias("confidence"))


@query(f"""WITH s AS ({SPANS_SQL}), w AS (
  SELECT *, max("end") OVER (PARTITION BY chunk, label ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s
), i AS (SELECT *, sum(CASE WHEN upto IS NULL OR upto <= start THEN 1 ELSE 0 END) OVER (PARTITION BY chunk, label ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT chunk, label, min(start) AS start, max("end") AS "end", max(confidence) AS confidence, count(*) AS members FROM i GROUP BY chunk, label, island""")
def same_label_merge(spark, sf_dir):
    return reconcile.merge_same_label(spans(spark, sf_dir), "chunk")


_PAIR = 'a.start AS a_start, a."end" AS a_end, b.start AS b_start, b."end" AS b_end'


@query(f"""WITH s AS ({SPANS_SQL}) SELECT a.chunk, a.label AS a_label, b.label AS b_label, {_PAIR},
  CASE WHEN a.start <= b.start AND b."end" <= a."end" THEN 'contains' WHEN b.start <= a.start AND a."end" <= b."end" THEN 'contained' ELSE 'crossing' END AS relation,
  CAST(least(a."end", b."end") - greatest(a.start, b.start) AS DOUBLE) / (greatest(a."end", b."end") - least(a.start, b.start)) AS iou
  FROM s a JOIN s b ON a.chunk = b.chunk AND a.label < b.label AND a.start < b."end" AND b.start < a."end" """)
def structural_relations(spark, sf_dir):
    return reconcile.structural_pairs(spans(spark, sf_dir), "chunk").drop("a_confidence", "b_confidence")


def _arrays(spark, sf_dir) -> DataFrame:
    e = spans(spark, sf_dir).select("chunk", F.struct("label", "start", "end", F.lit(None).cast("string").alias("value"), "confidence", F.lit("pattern").alias("recognizer")).alias("e"))
    return e.groupBy("chunk").agg(F.array_sort(F.collect_list("e")).alias("entities")).withColumn("text", F.lit(""))


@query()
def structural_fold(spark, sf_dir):
    kept = reconcile.reconcile(_arrays(spark, sf_dir), [(reconcile.same_label, reconcile.Merging()), (reconcile.cross_label, reconcile.Structural())], threshold=None)
    return kept.select("chunk", F.inline("entities")).drop("value", "recognizer")


@query(f"""WITH s AS ({SPANS_SQL}), w AS (
  SELECT *, max("end") OVER (PARTITION BY chunk, label ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s
), i AS (SELECT *, sum(CASE WHEN upto IS NULL OR upto <= start THEN 1 ELSE 0 END) OVER (PARTITION BY chunk, label ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT chunk, label, max(confidence) AS confidence FROM i GROUP BY chunk, label, island""")
def exclusive_winner(spark, sf_dir):
    kept = reconcile.reconcile(_arrays(spark, sf_dir), [(reconcile.same_label, reconcile.Exclusive())], threshold=None)
    return kept.select("chunk", F.inline("entities")).select("chunk", "label", "confidence")


_POLICY_SQL = """CASE label WHEN 'R' THEN 2 WHEN 'A' THEN 1 WHEN 'N' THEN 0 END"""


@query(f"""WITH s AS ({SPANS_SQL}), w AS (
  SELECT *, max("end") OVER (PARTITION BY chunk ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s
), i AS (SELECT *, {_POLICY_SQL} AS leak_, sum(CASE WHEN upto IS NULL OR upto <= start THEN 1 ELSE 0 END) OVER (PARTITION BY chunk ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT chunk, min(start) AS start, max("end") AS "end", CASE max(leak_) WHEN 2 THEN 'erase@1.0.0' WHEN 1 THEN 'mask@1.0.0' ELSE 'keep@1.0.0' END AS operator_id, count(*) AS members FROM i GROUP BY chunk, island""")
def operator_selection(spark, sf_dir):
    chosen = policy.select(spans(spark, sf_dir), policy.Policy().label("R", use=policy.ERASE).label("A", use=policy.STARS).fallback(policy.KEEP), "chunk")
    return chosen.select("chunk", "start", "end", "operator_id", "members")


# Scalar operators


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 5 THEN c_name ELSE c_name[1:3] || repeat('*', length(c_name) - 5) || right(c_name, 2) END AS masked,
  '[' || c_mktsegment || ':' || c_name || ']' AS replaced, left(c_name, 2) || right(c_name, 3) AS truncated, sha256('salt' || c_name) AS hashed, '' AS erased FROM customer""")
def text_operators(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", redact.mask(n, "*", 3, 2).alias("masked"), redact.replace(n, F.col("c_mktsegment"), "[{label}:{value}]").alias("replaced"), redact.truncate(n, 2, 3).alias("truncated"), redact.sha2(n, 256, "salt").alias("hashed"), redact.erase(n).alias("erased"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN '5000+' WHEN c_acctbal <= 0 THEN '<0' ELSE 'between' END AS bucket FROM customer")
def clamp_balance(spark, sf_dir):
    v = redact.clamp(F.col("c_acctbal").cast("string"), floor=0, ceiling=5000)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(v.isin("5000+", "<0"), v).otherwise("between").alias("bucket"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%Y-%m-%dT%H:00') AS h, strftime(o_orderdate, '%m/%Y') AS us FROM orders")
def generalized_dates(spark, sf_dir):
    iso, us = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", redact.generalize_date(iso).alias("y"), redact.generalize_date(iso, "year_month").alias("ym"), redact.generalize_date(iso, "hour").alias("h"), redact.generalize_date(us, "year_month").alias("us"))


@query("SELECT c_custkey, c_name AS back, true AS hidden, CAST(NULL AS VARCHAR) AS wrong_key FROM customer")
def encrypt_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("secret", redact.encrypt(F.col("c_name"), KEY))
    return rows.select("c_custkey", redact.decrypt(F.col("secret"), KEY).alias("back"), (~F.col("secret").contains("Customer")).alias("hidden"), redact.decrypt(F.col("secret"), KEY[::-1]).alias("wrong_key"))


def _hmac_sql(value: str, key: bytes) -> str:
    """HMAC with SHA-256, for keys of 64 bytes at most."""
    inner, outer = ("unhex('" + bytes(b ^ x for b in key.ljust(64, b"\0")).hex() + "')" for x in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || encode({value}))))"


@query(f"SELECT c_custkey, {_hmac_sql('c_name', b'key')} AS h256, {_hmac_sql('c_mktsegment', KEY)} AS by_key FROM customer")
def hmac_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redact.hmac(F.col("c_name"), b"key").alias("h256"), redact.hmac(F.col("c_mktsegment"), KEY).alias("by_key"))


@query("SELECT c_mktsegment, count(DISTINCT c_name) AS people, count(DISTINCT c_name) AS surrogates FROM customer GROUP BY c_mktsegment")
def pseudonyms(spark, sf_dir):
    s = redact.surrogate(F.col("c_name"), F.lit("person_name"), key=KEY)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_name").alias("people"), F.countDistinct(s).alias("surrogates"))


@query("SELECT p_partkey, length(p_name) AS n, regexp_replace(regexp_replace(regexp_replace(p_name, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g') AS shape FROM part")
def fake_keeps_shape(spark, sf_dir):
    fake = redact.shape_preserving(F.col("p_name"), F.concat(F.lit("seed"), F.col("p_name")))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(fake, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.length(fake).cast("long").alias("n"), shape.alias("shape"))


def _weighted(value: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST({value}[{i + 1}:{i + 1}] AS INT) * {w}" for i, w in enumerate(weights)) + ")"


_V9, _V10, _V11 = "lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0')", "lpad(CAST(o_orderkey * 104729 % 10000000000 AS VARCHAR), 10, '0')", "lpad(CAST(o_orderkey * 1299709 % 100000000000 AS VARCHAR), 11, '0')"


@query(f"""SELECT o_orderkey, {_weighted("a", [3, 7, 1] * 3)} % 10 = 0 AS aba, {_weighted("a", [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0 AS tfn, (10 - {_weighted("a", list(range(8, 0, -1)))} % 10) % 10 = CAST(a[9:9] AS INT) AS acn,
  {_weighted("b", list(range(10, 0, -1)))} % 11 = 0 AS nhs, {_weighted("b", [6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = CAST(b[10:10] AS INT) AS nip, {_weighted("c", [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1])} % 10 = 0 AS pesel
  FROM (SELECT o_orderkey, {_V9} AS a, {_V10} AS b, {_V11} AS c FROM orders)""")
def checksum_validators(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b, c = (F.lpad((k * m % n).cast("string"), size, "0") for m, n, size in ((7919, 10**9, 9), (104729, 10**10, 10), (1299709, 10**11, 11)))
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.aba_routing(a).alias("aba"), checks.tfn(a).alias("tfn"), checks.acn(a).alias("acn"), checks.nhs(b).alias("nhs"), checks.nip(b).alias("nip"), checks.pesel(c).alias("pesel"))


rule_queries.register(QUERIES, ORACLE)
QUERIES["identifier_checks"], ORACLE["identifier_checks"] = check_queries.query, check_queries.ORACLE


# Chunks, hints and sources


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS chunk_start, regexp_replace(m[i], '\r?\n$', '') AS text
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\S\n]*\S[^\n]*(?:\n|\z))+') AS m, regexp_split_to_array(text, '(?:[^\S\n]*\S[^\n]*(?:\n|\z))+') AS g FROM documents))""")
def paragraph_chunks(spark, sf_dir):
    return frames.paragraphs(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT c_custkey, CAST(col AS INTEGER) AS col, column_name, text FROM (SELECT c_custkey, unnest([0, 1, 2]) AS col, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS column_name, unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS text FROM customer)")
def table_cells(spark, sf_dir):
    return frames.cells(table(spark, sf_dir, "customer"), "c_custkey", columns=["c_name", "c_nationkey", "c_mktsegment"]).drop("hints")


@query("SELECT event_id, k AS column_name, json_extract_string(props, '$.\"' || k || '\"') AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_key_hints(spark, sf_dir):
    return frames.json_cells(table(spark, sf_dir, "events"), "props", "event_id").drop("hints")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def dropped_rows_and_columns(spark, sf_dir):
    flagged = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return frames.drop_columns(frames.drop_rows(table(spark, sf_dir, "orders"), flagged, "o_custkey"), "o_custkey", "o_orderdate", "o_orderpriority")


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '')"


@query("SELECT doc_id, tag FROM (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tag DESC) AS r FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS tag, len(list_filter({_WORDS_SQL}, lambda w: list_contains({[*words.split()]!r}, w))) AS n FROM documents" for t, words in enrich.FUNCTION_WORDS.items()) + ") WHERE n > 0) WHERE r = 1")
def detected_language(spark, sf_dir):
    docs = enrich.enrich_languages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.where(F.size("languages") > 0).select("doc_id", F.get("languages", 0)["tag"].alias("tag"))


@query()
def markup_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("extension"), F.col("html").cast("binary").alias("content"))
    return frames.read_chunks(pages)


# Whole ways


def flagship(docs: DataFrame, *keys: str) -> DataFrame:
    return Analyzer().analyze(docs, *keys)


@query()
def detect_all_rules(spark, sf_dir):
    return flagship(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query()
def detect_core_rules(spark, sf_dir):
    core = Analyzer(rules=core_rules(["email", "phone", "credit-card", "iban", "ssn", "ipv4"]), terms=[])
    return core.analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query()
def detect_paragraphs(spark, sf_dir):
    chunks = frames.paragraphs(table(spark, sf_dir, "documents"), "doc_id")
    return Analyzer().analyze(chunks, "doc_id", "chunk_id", chunk_start="chunk_start")


@query()
def detect_scoped(spark, sf_dir):
    scope = rules.Scope(languages=("de",), countries=("DE",), catalog=Catalog.built_in().only(["email_address", "phone_number", "postal_code", "tax_id"]))
    return Analyzer(scope=scope).analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query()
def hinted_cells(spark, sf_dir):
    cells = frames.cells(table(spark, sf_dir, "customer").withColumn("card", F.concat(F.lit("411111111111"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))), "c_custkey", columns=["c_name", "card"])
    return Analyzer().analyze(cells, "c_custkey", "col", hints_col="hints")


@query()
def recognizer_usage(spark, sf_dir):
    return usage(recognize.exploded(recognize.scan(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id"))


def _replaced_sql(label: str) -> str:
    return f"regexp_replace(text, '{FAMILIES[label][0]}', '[{label}]', 'g')"


@query(f"SELECT doc_id, {_replaced_sql('email_address')} AS text FROM documents")
def redacted_emails(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Anonymizer(policy.Policy().label("email_address", use=policy.replaced())).anonymize(docs, family(docs, "email_address"), "doc_id")


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, '" + FAMILIES["email_address"][0] + "', '', 'g'), '" + FAMILIES["phone_number"][0] + "', '', 'g') AS text FROM conversations")
def redacted_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = family(turns, "email_address", "conv_id", "turn").unionByName(family(turns, "phone_number", "conv_id", "turn"))
    return Anonymizer(policy.Policy().fallback(policy.ERASE)).anonymize(turns, found, "conv_id", "turn")


@query()
def redacted_documents(spark, sf_dir):
    return Orchestrator().redact(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("entities")


@query()
def redacted_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("extension"), F.col("html").cast("binary").alias("content"))
    return Orchestrator().anonymize(pages).select("path", F.decode("content", "utf-8").alias("html"))


@query(f"SELECT label, value, value AS original FROM (SELECT DISTINCT label, value FROM ({ALL_SQL}) WHERE label IN ('email_address', 'phone_number'))")
def vault_reversal(spark, sf_dir):
    found = vault.entries(all_families(table(spark, sf_dir, "documents")).where("label IN ('email_address', 'phone_number')"), KEY)
    return vault.reverse(found.select("label", "value", "surrogate"), found).select("label", "value", "original")


@query(f"SELECT doc_id, label, start, 3 AS events, true AS verified, false AS tampered FROM ({ALL_SQL})")
def audit_chains(spark, sf_dir):
    found = all_families(table(spark, sf_dir, "documents"))
    chain = audit.begin(audit.event(F.lit("pattern"), "pattern", F.col("confidence")))
    found = found.withColumn("audit", chain)
    found = found.withColumn("audit", audit.record(F.col("audit"), F.lit("context"), "refinement", F.col("confidence")))
    found = found.withColumn("audit", audit.record(F.col("audit"), F.lit("policy"), "redaction", F.col("confidence"), F.lit("mask@1.0.0")))
    broken = F.transform("audit", lambda e: e.withField("detail", F.lit("other")))
    return found.select("doc_id", "label", "start", F.size("audit").alias("events"), audit.verify(F.col("audit")).alias("verified"), audit.verify(broken).alias("tampered"))


@query()
def mock_model_entities(spark, sf_dir):
    model = enrich.Ner("ner", enrich.mock_ner({"Apache License": "PRODUCT", "contact": "MISC"}), mapping={"PRODUCT": "product"}, ignored=("MISC",), scales={"product": 0.5})
    return model.recognize(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", catalog=Catalog.built_in())


# Documents of several formats, read, redacted and written back


def _documents(rows: DataFrame, key: str, extension: str, content: Column) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("path"), F.lit(extension).alias("extension"), content.cast("binary").alias("content"))


def _edits(chunks: DataFrame, where: Column, replacement: str) -> DataFrame:
    return chunks.where(where).select("path", "chunk_id", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(replacement).alias("replacement"), F.lit(None).cast("string").alias("drop"))


@query("SELECT CAST(event_id AS VARCHAR) AS path, '{\"k\": \"[k]\"}' AS text FROM events")
def json_documents(spark, sf_dir):
    docs = _documents(table(spark, sf_dir, "events"), "event_id", "json", F.col("props"))
    done = frames.write_edits(docs, _edits(frames.read_chunks(docs), F.array_contains("hints", "k"), "[k]"))
    return done.select("path", F.decode("content", "utf-8").alias("text"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, 'name,segment' || chr(10) || '***,' || c_mktsegment || chr(10) AS text FROM customer")
def csv_documents(spark, sf_dir):
    docs = _documents(table(spark, sf_dir, "customer"), "c_custkey", "csv", F.concat(F.lit("name,segment\n"), "c_name", F.lit(","), "c_mktsegment", F.lit("\n")))
    done = frames.write_edits(docs, _edits(frames.read_chunks(docs), (F.col("row") == 1) & (F.col("column_name") == "name"), "***"))
    return done.select("path", F.decode("content", "utf-8").alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'part' || chr(10) || p_name || chr(10) AS text FROM part")
def csv_dropped_columns(spark, sf_dir):
    docs = _documents(table(spark, sf_dir, "part"), "p_partkey", "csv", F.concat(F.lit("part,brand\n"), "p_name", F.lit(","), "p_brand", F.lit("\n")))
    edits = _edits(frames.read_chunks(docs), (F.col("row") == 0) & (F.col("col") == 1), "").withColumn("drop", F.lit("column"))
    return frames.write_edits(docs, edits).select("path", F.decode("content", "utf-8").alias("text"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, '<supplier id=\"' || s_suppkey || '\"><fullName>[name]</fullName></supplier>' AS text FROM supplier")
def xml_documents(spark, sf_dir):
    docs = _documents(table(spark, sf_dir, "supplier"), "s_suppkey", "xml", F.concat(F.lit('<supplier id="'), F.col("s_suppkey").cast("string"), F.lit('"><fullName>'), "s_name", F.lit("</fullName></supplier>")))
    done = frames.write_edits(docs, _edits(frames.read_chunks(docs), F.array_contains("hints", "full name"), "[name]"))
    return done.select("path", F.decode("content", "utf-8").alias("text"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(f"""WITH s AS ({SPANS_SQL}) SELECT chunk, label, start, "end" FROM s""")
def permissive_keeps_all(spark, sf_dir):
    kept = reconcile.reconcile(_arrays(spark, sf_dir), [(reconcile.cross_label, reconcile.Permissive())], threshold=None)
    return kept.select("chunk", F.inline("entities")).select("chunk", "label", "start", "end")


@query()
def noisy_or_merge(spark, sf_dir):
    kept = reconcile.reconcile(_arrays(spark, sf_dir), [(reconcile.same_label, reconcile.Merging("noisy_or"))], threshold=None)
    return kept.select("chunk", F.inline("entities")).drop("value", "recognizer")


@query(f"SELECT doc_id, label, start, lang AS language FROM ({ALL_SQL}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def stamped_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = all_families(docs, "doc_id", "lang")
    asserted = F.array(F.struct(F.col("lang").alias("tag"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    one = F.struct("start", "end", F.lit(None).cast("string").alias("language"))
    return found.withColumn("e", F.get(recognize.stamp_languages(F.array(one), asserted), 0)).select("doc_id", "label", "start", F.col("e.language").alias("language"))


@query(f"SELECT doc_id, start, CASE WHEN least(1.0, 0.3 + boost) >= 0.35 THEN true ELSE false END AS lifted FROM (SELECT doc_id, start, CASE WHEN regexp_matches(lower(text[greatest(1, start - 24):start] || value), '(^|[^a-z0-9])(card|visa|paid|payment)([^a-z0-9]|$)') THEN 0.35 ELSE 0 END AS boost FROM ({family_sql('payment_card')}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id))")
def context_lift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = family(docs, "payment_card").join(docs, "doc_id")
    near = F.lower(F.concat(F.substring(F.col("text"), F.greatest(F.lit(1), F.col("start") - 24), F.col("start") - F.greatest(F.lit(1), F.col("start") - 24) + 1), F.col("value")))
    lifted = near.rlike("(^|[^a-z0-9])(card|visa|paid|payment)([^a-z0-9]|$)")
    return found.select("doc_id", "start", (F.least(F.lit(1.0), F.lit(0.3) + F.when(lifted, 0.35).otherwise(0.0)) >= 0.35).alias("lifted"))


@query(f"""SELECT doc_id, start, CAST(CASE WHEN regexp_matches(near, '(^|[^\\p{{L}}\\p{{N}}])(phone|call|mobile|tel|fax|contact)([^\\p{{L}}\\p{{N}}]|$)') THEN least(1.0, CAST(confidence AS DOUBLE) + 0.35) ELSE confidence END AS FLOAT) AS confidence
  FROM (SELECT doc_id, start, confidence, lower(regexp_extract(text[1:start], '(?:\\w+\\W*){{0,5}}$') || value || regexp_extract(text["end" + 1:], '^\\W*(?:\\w+\\W*){{0,5}}')) AS near
        FROM ({family_sql('phone_number')}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id))""")
def context_window(spark, sf_dir):
    from veilspark.operators import context

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = family(docs, "phone_number").join(docs, "doc_id")
    words = ["phone", "call", "mobile", "tel", "fax", "contact"]
    return found.select("doc_id", "start", context.native_lift(F.col("text"), F.col("start"), F.col("end"), F.col("confidence"), words).alias("confidence"))


@query()
def audio_redaction(spark, sf_dir):
    """Vectors as samples of a clip, its second quarter silenced: what is left of each half."""
    import numpy as np
    import pyarrow as pa

    from veilspark.sources import media

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                samples = (np.nan_to_num(np.array([x or 0.0 for x in v or ()])) * 1000).astype("<i2").reshape(-1, 1)
                clip = media.encode_wav(samples, 64, 2)
                quiet, rate, _ = media.read_wav(media.encode_wav(media.redact_samples(media.read_wav(clip)[0], 64, 250_000, 500_000), 64, 2))
                out.append((int(np.abs(quiet[16:32]).sum()), int((quiet != samples).sum()), rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))]], ["vec_id", "left_in_range", "changed", "rate"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, left_in_range long, changed long, rate long")


@query("SELECT vec_id, 0 AS boxed, CAST(0 AS BIGINT) AS mosaic_colors FROM embeddings")
def picture_redaction(spark, sf_dir):
    """Vectors as 8 x 8 pictures: what shows within a black box, and how many colors a mosaic of one block keeps beyond one."""
    import numpy as np
    import pyarrow as pa

    from veilspark.sources import media

    def run(batches):
        for batch in batches:
            boxed, colors = [], []
            for v in batch.column(1).to_pylist():
                pixels = np.resize((np.nan_to_num(np.array([x or 0.0 for x in v or [0.0]])) * 255).astype(np.uint8), (8, 8, 1))
                boxed.append(int(media.blackbox(pixels, (2, 2, 6, 6))[2:6, 2:6].max()))
                colors.append(len(np.unique(media.pixelate(pixels, (0, 0, 8, 8), 8))) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(boxed, pa.int32()), pa.array(colors, pa.int64())], ["vec_id", "boxed", "mosaic_colors"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, boxed int, mosaic_colors long")


# Streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS label, count(*) AS entities FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    timed = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    path = streams.new_folder(spark, "counts")
    streams.keep_counts(streams.windowed_counts(timed, "ts", "1 hour"), path).trigger(availableNow=True).start().awaitTermination()
    return streams.kept_counts(spark, path).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "label", "entities")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return flagship(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


