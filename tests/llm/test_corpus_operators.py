import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, near_dup, toxicity
from veilspark.llm.components import components
from veilspark.llm.edit_distance import within
from veilspark.llm.fm_index import FmIndex
from veilspark.llm.near_dup import NearDuplicates
from veilspark.llm.text_cnn import TextCnn

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


# Near-duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=18), st.lists(st.integers(0, 5), max_size=18), st.integers(0, 20))
def test_banded_alignment(a, b, limit):
    d = distance(a, b)
    assert within(np.array(a, np.uint32), np.array(b, np.uint32), limit) == (d if d <= limit else None)


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"{rng.randrange(400):05d}", f"{rng.randrange(400):05d}") for _ in range(260)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("s", f"s{i}") for i in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    mine = collections.defaultdict(set)
    for n in up:
        mine[root(n)].add(n)
    theirs = collections.defaultdict(set)
    for n in up:
        theirs[got.get(n, n)].add(n)
    assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in theirs.values()}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def planted(rng):
    """Documents with copies, near copies, a shared passage, and chains."""
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, passage = [], make(40)
    for _ in range(40):
        docs.append(make(rng.randrange(30, 120)))
    for _ in range(30):
        docs.append(make(80) + passage + make(80))
    base = make(150)
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(1, 12)):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        docs.append(own)
    chain = make(120)
    for _ in range(12):
        docs.append(list(chain))
        for _ in range(5):
            chain[rng.randrange(len(chain))] = rng.choice(vocab)
    docs += [docs[0]] * 5 + [make(3)] * 2 + [make(1)]
    return [" ".join(d) for d in docs]


def brute_classes(texts):
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    number = {}
    codes = [None if t is None else np.array([number.setdefault(w, len(number)) for w in words(t)], np.uint32) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = codes[i], codes[j]
        if a is None or b is None:
            continue
        if not len(a) or not len(b):
            same = len(a) == len(b) and texts[i] == texts[j]
        else:
            same = within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None
        if same:
            up[root(i)] = root(j)
    out = collections.defaultdict(set)
    for i in range(len(texts)):
        out[root(i)].add(i)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize(("in_task", "at_once"), [(20_000, 16), (3, 2)])
def test_near_duplicates_equal_brute_force(spark, in_task, at_once):
    texts = planted(random.Random(5)) + [None, None, "", "", "...", "... ", "...", "One", "one!"]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in enumerate(texts)], "doc_id long, text string, k_ int, fp string")
    found = NearDuplicates(df, in_task=in_task, at_once=at_once)
    rows = found.members().collect()
    assert len(rows) == len(texts)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.class_id].add(r.id)
    assert {frozenset(v) for v in got.values()} == brute_classes(texts)
    assert all(r.class_id == min(got[r.class_id]) and r.class_size == len(got[r.class_id]) for r in rows)
    kept = found.kept()
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_large_bucket_of_different_texts_takes_one_round(spark):
    """Texts that share keys but are not similar, in buckets beyond what a task may hold, with a few copies among them."""
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common = make(8)
    docs = [common + make(8) for _ in range(60)]
    docs += [[*d[:-1], *make(1)] for d in docs[::10]]
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = NearDuplicates(df, in_task=8, at_once=2)
    assert len(found.roots) <= 3
    got = collections.defaultdict(set)
    for r in found.members().collect():
        got[r.class_id].add(r.id)
    assert {frozenset(v) for v in got.values()} == brute_classes(texts)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (None, text), (9, text + " more"), (9, "other words entirely"), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = NearDuplicates(df)
    assert sorted((r.id or -1, r.class_id or -1, r.class_size) for r in found.members().collect()) == [(-1, -1, 1), (-1, 7, 4), (7, 7, 4), (7, 7, 4), (9, 7, 4), (9, 9, 1)]
    assert found.kept().count() == 3
    assert NearDuplicates(df.limit(0)).members().collect() == []
    assert NearDuplicates(df.limit(0)).kept().collect() == []


def test_near_duplicates_at_the_edit_threshold(spark):
    """Copies with 10 to 20 % of the words changed, single words all over the text."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for n in [5] * 10 + [12] * 10 + [30] * 20 + [41] * 20 + [100] * 20 + [300] * 20 + [1000] * 5:
        one = make(n)
        other = list(one)
        for at in rng.sample(range(n), max(1, int(n * rng.uniform(0.1, 0.2)))):
            other[at] = make(1)[0]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(one), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.class_id for r in NearDuplicates(df).members().collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert len(set(found.values())) >= len(pairs)


def test_order_matters_to_the_sketch():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[100:], a[:100]])
    keys = near_dup.order_sketches([near_dup.shingles(x, 5) for x in (a, a.copy(), b)], 20, 3)
    assert (keys[0] == keys[1]).all()
    assert (keys[0] == keys[2]).sum() < 15


def test_very_long_text(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    other = list(long)
    for _ in range(800):
        other[rng.randrange(len(other))] = "x"
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other))], "doc_id long, text string")
    assert {r.class_id for r in NearDuplicates(df).members().collect()} == {1}


# Decontamination


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5), st.integers(1, 5))
def test_fm_index_finds_all(runs, n):
    text = np.array([x for r in runs for x in [*r, 0]], np.int64)
    patterns = np.array(list(itertools.product([1, 2, 3], repeat=min(n, 3))), np.int64)
    which, at = FmIndex(text, 3, sample=4).occurrences(patterns)
    expected = sorted((i, j) for i, p in enumerate(patterns) for j in range(len(text) - len(p) + 1) if (text[j : j + len(p)] == p).all())
    assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == expected


def brute_hits(docs, items, size=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most_bytes", [1 << 24, 600])
def test_contamination_equals_brute_force(spark, most_bytes):
    rng = random.Random(4)
    vocab = ["a", "b", "é", "D4", "word", "漢", "x1"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(10, 40))) for i in range(20)] + [(50, "Two words"), (51, None), (52, "..."), (None, say(20)), (3, say(15)), (60, say(13))]
    docs = [(i, say(rng.randrange(0, 60)) + " " + rng.choice([t for _, t in items if t]) + "; " + say(10)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, "TWO words"), (104, items[0][1]), (104, items[0][1]), (105, "two. Words two-words")]
    d = spark.createDataFrame([(*r, "n", 1) for r in docs], "doc_id long, text string, hits string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(d, b, most_bytes=most_bytes).collect()
    assert sorted((r.k0, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(brute_hits(docs, items))
    clean = decontaminate.remove_contamination(d, b, most_bytes=most_bytes)
    assert clean.columns == d.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    bad = {x[0] for x in brute_hits(docs, items) if x[2] and 20 * x[2] >= x[1]}
    assert set(left) == {x[0] for x in docs} - bad
    for i, t in docs:
        if i in left and t and not any(x[0] == i and x[2] for x in brute_hits(docs, items)):
            assert left[i] == t
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.find_contamination(d, nothing).collect())
    assert decontaminate.find_contamination(d.limit(0), b).collect() == []


def test_small_passages_are_cut(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"w{i}" for i in range(1000))
    d = spark.createDataFrame([(1, f"{long} {passage.upper()}, {long}", 5), (2, passage, 5), (3, long, 5)], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.remove_contamination(d, b).collect()}
    assert set(got) == {1, 3}
    assert got[1].text == f"{long} , {long}" and got[1].n_chars == len(got[1].text)
    assert (got[3].text, got[3].n_chars) == (long, 5)


# Toxicity


def test_toxicity_on_held_out_rows(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = {r.k0: r.score for r in toxicity.score_texts(docs, model).collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    insults = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    plain = [i for i in held if set(words(texts[i])) & insults]
    caught = [i for i in plain if rows[i] >= 0.7]
    false = [i for i in held if not marks[i] and rows[i] >= 0.7]
    assert len(caught) >= 0.9 * len(plain) and len(false) <= 0.05 * len(held)
    got = docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_reads_the_text_alone(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, say(40) + (" you idiot" if i % 4 == 0 else ""), "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "xx", 1.0), (2, "", "de", 2.0), (3, "...", None, 3.0), (None, "an idiot", "fr", 4.0), (5, "an idiot", "de", 5.0), (6, "w1 " * 50_000 + "idiot", "en", 6.0), (7, say(30), "en", 7.0)], "doc_id long, text string, lang string, score double")
    got = {r.k0: r.score for r in toxicity.score_texts(odd, model).collect()}
    assert got[None] == got[5] >= 0.7 and got[6] >= 0.7
    assert got[1] == got[2] == got[3] < 0.7 and got[7] < 0.7
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7}
    assert toxicity.reject_toxic(odd.limit(0), model).collect() == []
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.7 for r in toxicity.score_texts(docs, one_class).collect())
    assert toxicity.score_texts(docs, toxicity.train(docs, labels.limit(0))).where("score >= 0.7").count() == 0


def test_convolution_equals_plain_loops():
    rng = np.random.default_rng(1)
    model = TextCnn(bits=6, dim=3, widths=(1, 2, 3), filters=4)
    model.table[:-1] = rng.normal(0, 1, (64, 3))
    model.b[:], model.c = rng.normal(0, 1, 12), np.float32(0.3)
    texts = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 5, 0, 40, 3, 0)]
    splits = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.predict(np.concatenate(texts), splits)
    for text, p in zip(texts, got, strict=True):
        one, two = model.places(text)
        x = [model.table[a] + model.table[b] for a, b in zip(one, two, strict=True)]
        logit = float(model.c)
        for j, (w, width) in enumerate(zip(model.w, model.widths, strict=True)):
            for f in range(model.filters):
                sums = [sum(float(x[i + k] @ w[k][:, f]) for k in range(width) if i + k < len(x)) for i in range(len(x))]
                top = max(sums) + model.b[j * 4 + f] if sums else 0.0
                logit += max(0.0, float(top)) * float(model.u[j * 4 + f])
        assert abs(p - 1 / (1 + np.exp(-logit))) < 1e-5


def test_thresholds_split_at_the_gap():
    p, y = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])
    assert 0.3 <= toxicity.best_threshold(p, y) <= 0.8
    assert (p >= toxicity.best_threshold(p, y)).tolist() == [True, True, False, False]


# Pipeline


def shared_folders(spark):
    from veilspark.llm.shared import shared_dir

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def test_pipeline_stages(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {n: docs for n in ("raw",)}
    now = docs
    for name, stage in cp.STAGES:
        path = toxicity_path(spark, name)
        stage(spark, now, small).write.parquet(path)
        now = seen[name] = spark.read.parquet(path)
        if name != cp.STAGES[-1][0]:
            assert now.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    texts = {n: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for n, d in seen.items()}
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert ids["toxicity"] == {r.k0 for r in toxicity.score_texts(docs, model).where("score < 0.7").collect()}
    order = sorted(ids["toxicity"])
    classes = brute_classes([texts["toxicity"][i] for i in order])
    assert ids["near_dedup"] == {order[min(c)] for c in classes}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hits = {d: (n, h) for d, n, h, _ in brute_hits(sorted(texts["near_dedup"].items()), bench)}
    assert ids["decontamination"] == {d for d, (n, h) in hits.items() if not (h and 20 * h >= n)}
    import sentencepiece

    last = {r.doc_id: r for r in seen["sentencepiece"].collect()}
    import public_tokenizers as P

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for i, t in texts["decontamination"].items():
        assert last[i].ids == library.encode(t or "") and last[i].text == (t or "")
    before = set(shared_folders(spark))
    out = cp.run(spark, small)
    assert out.count() == len(last)
    assert [re.sub("-.*", "", n) for n in set(shared_folders(spark)) - before] == ["sentencepiece"]  # the rest is deleted


def toxicity_path(spark, name):
    from veilspark.llm.shared import new_dir

    return new_dir(spark, name)


def test_stages_take_odd_rows(spark, small):
    import corpus_pipeline as cp

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text of no id", "en", "s", 13), (4, "x", None, None, None), (4, "x", None, None, None)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        now = spark.createDataFrame(stage(spark, now, small).collect(), stage(spark, now, small).schema)
    assert now.count() == 4
    empty = now.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES[:3]:
        assert stage(spark, empty, small).collect() == []


def test_pipeline_of_empty_tables(spark, small, tmp_path):
    import corpus_pipeline as cp

    tables = {n: spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels", "benchmark")}

    def run(name, *empty):
        for n, df in tables.items():
            (df.limit(0) if n in empty else df).write.parquet(f"{tmp_path}/{name}/{n}.parquet")
        return cp.run(spark, f"{tmp_path}/{name}")

    assert run("none", "documents").collect() == []
    taught, docs = run("all", "labels", "benchmark"), tables["documents"]
    assert {r.doc_id for r in taught.collect()} == {r.doc_id for r in NearDuplicates(docs).kept().collect()}


def test_nothing_else_imports_this_folder():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for f in (root / "veilspark").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "veilspark.llm" not in f.read_text(), f
    assert F is not None
