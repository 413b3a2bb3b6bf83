import collections
import hashlib
import itertools
import json
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import chat_format, decontaminate, html_density, near_dup, token_count, token_store, wordcodes
from veilspark.llm import sentencepiece_viterbi as spv
from veilspark.llm.dac import Levels, TokenFile
from veilspark.llm.shared import Memo
from veilspark.llm.wordcodes import WORD_PATTERN, words_of

ODD = [None, "", " ", "  \n\t ", "a", "É é", "\x00", "x\x00y", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "漢字 😀", "don't. DON'T,", "  lead", "trail  ", "\x1c a\x85b\u2028c", "İx ǅ ß", "a" * 3000, "ab " * 20_000, "The THE the, the. .. a.. ... a,b a. .a .", "end.", "a.\nb,\tC! d?;", "<|ENDOFTEXT|> The."]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .É漢-\n", max_size=12)), max_size=6))
def test_word_codes_follow_the_pattern(values):
    w = words_of(pa.array(values, pa.string()))
    expected = [regex.findall(WORD_PATTERN, lower(v or "")) for v in values]
    assert np.diff(w.splits).tolist() == [len(x) for x in expected]
    flat = [x for e in expected for x in e]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == flat
    seen = {}
    for code, word in zip(w.codes.tolist(), flat, strict=True):
        assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


def thue_morse(n: int, first: int) -> str:
    """Letters a and b, by the parity of ones in their place: power sums of such words agree mod 2**64."""
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


ALIKE = [f"{thue_morse(n, 0)} {thue_morse(n, 1)}  {thue_morse(n, 0)}" for n in (64, 1024, 2048)] + ["", "x" * 70 + " " + "x" * 69 + "y"]


@pytest.mark.parametrize("weak", [False, True])
def test_words_that_share_a_code_are_told_apart(monkeypatch, weak):
    """Weak: all words of more than 8 bytes share one code."""
    if weak:
        real = wordcodes.run_codes
        monkeypatch.setattr(wordcodes, "run_codes", lambda data, starts, ends: np.where(ends - starts > 8, np.uint64(1 << 60), real(data, starts, ends)))
    values = [*ALIKE, "ab cd ab, cd. Ab", "the cat sat on the mat and the dog ran off remarkably undeterred remarkable"]
    column = pa.array(values, pa.string())
    path = P.path("word_bpe_49k.json")
    ids, n = token_store.Encoder(path).encode(column)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == [x.ids for x in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]
    path = P.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        codec = spv.Codec(spv.Model(f.read()))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2):  # the second time from the memo
        ids, n = codec.encode(column)
        ends = np.cumsum(n)
        assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == [library.encode(v) for v in values]
    assert codec.decode(ids, n) == values
    items = [("i", thue_morse(1024, 0)), ("j", "the cat sat on the dog"), ("k", "dog ran off remarkably undeterred")]
    splits, hit, found = decontaminate.scan(pa.array([thue_morse(1024, 1), values[-1], "cat dog"]), decontaminate.Phrases(items))
    assert found == {1: {"k"}} and hit.sum() == 5 and len(splits) == 4
    spelled = near_dup.spellings(wordcodes.words_of(pa.array(["a  B c", " A b-C ", "a bc", "", "--"])))
    assert spelled[0] == spelled[1] != spelled[2] and spelled[3] == spelled[4] == b""


# Chat


def plain_digest(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2] or "", r[3] or "")
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *key(r))), key=lambda r: r[0]):
        own = [(r[2] or "", r[3] or "") for r in own]
        said = [t for r, t in own if r == "assistant"]
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    return out


def test_chat_digests_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "</s>[INST] ok [/INST]", "a & b &lt; [x] &#91;", "<s>[INST:user]", "line\nline", "é😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a]b["]), rng.choice(texts)) for c in [*range(12), None] for t in range(rng.randrange(1, 9))]
    rows += [(20, t, "user", "no reply") for t in range(7)] + [(21, 0, "assistant", "same")] * 3 + [(22, None, "user", "x"), (22, 1, "assistant", "y")]
    rows += [(23, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(900)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, example int, loss_start string")
    for most in (2, 256):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(chat_format.prefix_targets(df, most_turns=most)).collect()}
        assert got == plain_digest(rows)
    assert chat_format.digests(chat_format.prefix_targets(df.limit(0))).collect() == []


def test_chat_examples_have_all_preceding_turns(spark):
    rows = [(1, t, r, f"text {t} [INST]") for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.prefix_targets(df)
    whole = chat_format.expand(examples).orderBy("example").collect()
    assert [e.loss_start is None for e in whole] == [False, False, True]
    for e, upto in zip(whole[:2], (3, 5), strict=True):
        assert chat_format.parse_turns(e.text) == [(r, t) for _, _, r, t in rows[:upto]]
        assert chat_format.unescape(e.text[e.loss_start : e.loss_end]) == rows[upto - 1][3]
    assert sum(r.n_turns for r in examples.collect()) == 6
    total = chat_format.digests(examples).first().formatted_chars
    assert total == sum(len(e.text) for e in whole[:2]) + len(chat_format.format_turn(*rows[5][2:])[0])


@pytest.mark.parametrize("most", [1, 7, 256])
def test_chat_digests_come_from_whole_examples(spark, most):
    """300 and 1,000 turns without a reply, replies all along, none at all: read from the examples spelled out."""
    rows = [(1, t, "user", f"say {t} [x]") for t in range(300)] + [(1, 300, "assistant", "at last & more")]
    rows += [(2, t, "user" if t < 1000 or t % 2 else "assistant", f"t{t}") for t in range(1009)]
    rows += [(3, t, "user", "alone") for t in range(520)] + [(4, t, "assistant", f"a{t}<") for t in range(40)]
    examples = chat_format.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most_turns=most)
    plain, chars = plain_digest(rows), collections.Counter()
    loss = collections.defaultdict(str)
    before: dict = {}
    for e in sorted(chat_format.expand(examples).collect(), key=lambda e: (e.conv_id, e.example)):
        if e.loss_start is not None:
            chars[e.conv_id] += len(e.text)
            loss[e.conv_id] += chat_format.unescape(e.text[e.loss_start : e.loss_end])
            assert e.text.startswith(before.get(e.conv_id, ""))
            before[e.conv_id] = e.text
        else:
            chars[e.conv_id] += len(e.text) - len(before.get(e.conv_id, ""))
    got = chat_format.digests(examples).collect()
    assert {r.conv_id: r.formatted_chars for r in got} == chars
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain
    assert all(r.loss_sha256 == hashlib.sha256(loss[r.conv_id].encode()).hexdigest() for r in got)


def test_chat_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, t, "user", f"say {t} [x]") for t in range(300)] + [(1, 300, "assistant", "at last & more")] + [(5, 0, "assistant", "r"), (5, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = duckdb.sql(chat_format.ORACLE)
    names = [c for c in expected.columns]
    assert sorted(tuple(r[c] for c in names) for r in chat_format.query(spark, str(tmp_path)).collect()) == sorted(expected.fetchall())


def test_chat_rows_are_whole_examples(spark):
    turns = [(r, f"text {t} [INST]") for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    df = spark.createDataFrame([(1, t, *x) for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert [chat_format.parse_turns(r.text) for r in chat_format.prefix_targets(df).collect()] == [turns[:3], turns[:5], turns]


@pytest.mark.parametrize("most", [1, 3, 256])
def test_chat_examples_are_spelled_out(spark, most):
    """The operator's own rows hold each reply's whole context, and the digests count what lies in them."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["é😀 [x]", "a & b", "", "<s>"]) + str(t)) for c in range(8) for t in range(rng.randrange(1, 30))]
    examples = chat_format.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most_turns=most)
    whole = collections.defaultdict(list)
    for r in examples.collect():
        whole[r.conv_id, r.example].append(r)
    chars: collections.Counter = collections.Counter()
    for c, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = [r[2:] for r in own]
        ends = [i + 1 for i, (role, _) in enumerate(own) if role == "assistant"]
        open_ = not ends or ends[-1] < len(own)
        assert sorted(k for k in whole if k[0] == c) == [(c, k) for k in range(len(ends) + open_)]
        for k, end in enumerate([*ends, len(own)][: len(ends) + open_]):
            parts = whole[c, k]
            text = "".join(r.text for r in parts)
            assert chat_format.parse_turns(text) == own[:end]
            assert [r.part for r in parts] == list(range(-(-end // most))) and all(len(chat_format.parse_turns(r.text)) <= most for r in parts)
            assert len({(r.loss_start, r.loss_end, r.known_chars) for r in parts}) == 1
            if k < len(ends):
                assert chat_format.unescape(text[parts[0].loss_start : parts[0].loss_end]) == own[end - 1][1]
            chars[c] += len(text) - (parts[0].known_chars if k == len(ends) else 0)
    assert {r.conv_id: r.formatted_chars for r in chat_format.digests(examples).collect()} == chars


@pytest.mark.parametrize("most", [2, 256])
def test_chat_digests_read_the_contexts(spark, most):
    """A changed or missing context, or a missing row, is an error: contexts are read, not added up."""
    from pyspark.sql import functions as F

    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(8)]
    examples = chat_format.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most_turns=most)
    assert len(chat_format.digests(examples).collect()) == 1
    changed = examples.withColumn("text", F.when(F.col("example") == 2, F.replace("text", F.lit("turn 0"), F.lit("turn X"))).otherwise(F.col("text")))
    cut = examples.withColumn("text", F.when(F.col("example") == 3, F.expr("replace(text, '<s>[INST:user]turn 0[/INST]</s>\n', '')")).otherwise(F.col("text")))
    for bad in (lambda: changed, lambda: cut, lambda: examples.where("example != 1"), lambda: examples.where("example != 2 or part > 0")):
        with pytest.raises(Exception, match="context is not the conversation before it|missing or out of order"):
            chat_format.digests(bad()).collect()


def test_chat_prefix_beyond_memory():
    prefix, turns = chat_format._Prefix(3, most_chars=60, in_memory=50), []
    for t in range(40):
        turns.append("é😀z" * (t % 9) + f"{t};" + "x" * (90 if t == 11 else 0))
        prefix.add(turns[-1])
        for _ in range(2):
            parts = list(prefix.parts())
            assert "".join(p for p, _ in parts) == "".join(turns) and parts[-1][1] == len(turns)
            assert ["".join(turns[a:b]) for a, b in itertools.pairwise([0, *(n for _, n in parts)])] == [p for p, _ in parts]
            assert all(b - a <= 3 and (len(p) <= 60 or b - a == 1) for (p, b), a in zip(parts, [0, *(n for _, n in parts)], strict=False))
    assert prefix.file._rolled
    prefix.close()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="&lt;<[]/INS#91a\n", max_size=30)), max_size=4))
def test_chat_template_is_reversible(turns):
    assert chat_format.parse_turns("".join(chat_format.format_turn(r, t)[0] for r, t in turns)) == turns
    for _, t in turns:
        assert not {"<", "["} & set(chat_format.escape(t))


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One  two<br>three &lt;x&gt;<p>Four</article><footer>f</footer>", "T\nOne two\nthree <x>\nFour"),
        ("<article><p><b>bold<br><p>Next</p></article>", "bold\nNext"),
        ("<body><div class='ad'>Buy</div><main><p>Real text here, long enough.</p><aside>side</aside><form>f</form><div class=comments><p>me too</p></div></main>", "Real text here, long enough."),
        ("<body><script>var t='</p>';</script><style>p{}</style><p>Only <i>this</i>.</p><!-- <p>no</p> -->", "Only this."),
        ("<body><div id=wrap><div class=sidebar><a href=1>x</a></div><div id=content><h2>Head</h2><p>Words, words, and more words.</p><p>Again many words of text.</p></div></div>", "Head\nWords, words, and more words.\nAgain many words of text."),
        ("<body><div class='page has-sidebar'><div class=sidebar><p>Not this, though it is long enough.</p></div><article><h1>T</h1><p>Text of the article.</p></article></div>", "T\nText of the article."),
        ("<body><main><article><header><h1>T</h1></header><p>Body text is here.</p><footer>tags</footer></article><section id='comments'><article class='comment'><p>I disagree with all of this, at length and with many words.</p></article></section></main>", "T\nBody text is here."),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<article><p>unclosed <a href='x>y'>tag", "unclosed tag"),
    ],
)
def test_html_cases(page, text):
    assert html_density.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><form id=aspnetForm><div class=top><a href=x>Menu</a></div><div id=content><h2>Head</h2><p>Words, words, and more words.</p><p>Again many words of text.</p></div></form></body>", "Head\nWords, words, and more words.\nAgain many words of text."),
        ("<form><input><article><h1>T</h1><p>Text of the article.</p></article></form>", "T\nText of the article."),
        ("<html><head><title>t</title><meta charset=utf-8><body><p>Only this.</p></body></html>", "Only this."),
        ("<html><head><title>t</title><p>Only this.</p></html>", "Only this."),
        ("<html><head><title>t</title>First<body><p>Then this.</p></body>", "First\nThen this."),
        ("<body><p>One part of it.</p></body></html><p>The other part.</p>", "One part of it.\nThe other part."),
        ("<article><h1>T</h1><div class='elementor-widget'><p>First words here.</p></div><div class='elementor-widget'><p>Second words here.</p></div></article>", "T\nFirst words here.\nSecond words here."),
        ("<article><h1>T</h1><p>Long enough a text to be most of it all.</p><div class='alert'><p>Mind this.</p></div></article>", "T\nLong enough a text to be most of it all.\nMind this."),
        ("<article><h1>T</h1><div class='social'><p>Half of the text.</p></div><div class='social'><p>And the other half.</p></div></article>", "T\nHalf of the text.\nAnd the other half."),
        ("<body><div class='page has-sidebar'><div class=sidebar><p>Not this.</p></div><div id=content><p>Words, words, and more words.</p><p>Again many words of text.</p></div></div>", "Words, words, and more words.\nAgain many words of text."),
        ("<body><form><h1>Log in</h1><p>Name</p></form><div><p>Words, words, and more words.</p><p>Again many words of text.</p></div>", "Words, words, and more words.\nAgain many words of text."),
    ],
)
def test_html_takes_back_what_holds_most_text(page, text):
    assert html_density.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a href=x>Menu</a></nav><main><h1>T</h1><p>lead</p><article><p>First words of it.</p><p>Second words of it.</p></article></main>", "T\nlead\nFirst words of it.\nSecond words of it."),
        ("<main><article><p>First words of it, the longest of all.</p></article><article><p>Second words.</p></article></main>", "First words of it, the longest of all.\nSecond words."),
        ("<body><div><div><article><p>First words of it, the longest of all.</p></article></div><div><article><p>Second words, nearly as many as there.</p></article></div></div><footer>f</footer>", "First words of it, the longest of all.\nSecond words, nearly as many as there."),
        ("<body><h1>T</h1><article><p>First words of it, the longest of all.</p><p>Second words of it, nearly as long.</p></article><ul><li><a href=x>Other</a></ul>", "T\nFirst words of it, the longest of all.\nSecond words of it, nearly as long."),
        ("<body><main><article><h1>T</h1><p>Text of it.</p></article><ul><li><a href=x>Other</a></ul></main><div><p>Call</p></div>", "T\nText of it."),
    ],
)
def test_html_rises_from_the_article(page, text):
    assert html_density.extract(page) == text


def test_html_needs_no_article_tag(medium):
    """The same text where the article is a plain block; mostly so where nothing but blocks and paragraphs is there."""
    pages = [r["html"] for r in pq.read_table(f"{medium}/pages.parquet").to_pylist()]
    texts = [html_density.extract(h) for h in pages]
    assert [html_density.extract(re.sub(r"<(/?)article", r"<\1div", h)) for h in pages] == texts
    bare = [html_density.extract(re.sub(r"<(/?)(article|nav|footer|h1)", r"<\1div", h)) for h in pages]
    assert sum(a == b for a, b in zip(bare, texts, strict=True)) > 0.75 * len(pages)


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p></span>" * 30_000 + "x", '<a b="' * 60_000, '<a b="' * 60_000 + ">", "<b>" * 60_000 + "<p>" * 60_000 + "t", "< " * 60_000 + ">", "<div class=ad>" * 9_000 + "<h1>x</h1>" * 9_000, "<!--" * 60_000, "<li>" * 60_000], ids=range(8))
def test_html_is_linear(page):
    began = time.process_time()
    html_density.extract(page)
    assert time.process_time() - began < 20  # quadratic reading takes minutes


def test_html_on_pages(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    import html
    import re

    got = {r.page_id: r.text for r in html_density.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.split(r"</article>|<footer", r.html.partition("<article>")[2])[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
    extra = pages.limit(3).selectExpr("page_id", "url", "html", "1 as text", "2 as n_chars")
    assert html_density.extract_text(extra).count() == 3
    assert html_density.extract_text(pages.limit(0)).collect() == []


# Token counts and ids


def test_token_counts_equal_the_library(spark, small):
    path = P.path("byte_bpe_50k.json")
    values = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)] * 2, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(path)
    for r in token_count.count_tokens(df, path).collect():
        t = values[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)), repr(t[:40])
    assert token_count.count_tokens(df.limit(0), path).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" aBé.,!'sdt\n\t<|endoftxt>12漢\u0300\x1c\u2028"), max_size=24), max_size=5))
def test_counts_equal_the_library(values):
    path = P.path("byte_bpe_50k.json")
    if "count" not in ENCODERS:
        ENCODERS["count"] = token_count.Counter(path, *token_count.whole_tokens(path))
    c = ENCODERS["count"]
    assert c.count(values) == c.by_library(values)


def test_whole_tokens_are_proven():
    path = P.path("byte_bpe_50k.json")
    whole, special = token_count.whole_tokens(path)
    library = Tokenizer.from_file(path)
    assert special == ["<|endoftext|>"]
    sample = random.Random(1).sample(sorted(whole), 3000)
    cut = regex.compile(token_count.PRE_TOKEN)
    for s in sample:
        if cut.findall(s) == [s]:
            assert len(library.encode(s, add_special_tokens=False).ids) == 1
    merger = token_count.Merger(json.load(open(path))["model"]["merges"])
    letters = token_count.byte_letters()
    for w in [" unbelievably", "tokenization", "zzzzqx", " 漢字"]:
        assert len(merger.merge([letters[b] for b in w.encode()])) == len(library.encode(w, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**24), max_size=1200), st.data())
def test_codes_give_any_value(values, data):
    a = np.array(values, np.uint32)
    levels = Levels.encode(a)
    f = TokenFile.load(TokenFile(levels, np.array([7]), np.array([False]), np.array([0, len(a)])).dump())
    assert f.tokens(0).tolist() == values
    if values:
        at = data.draw(st.lists(st.integers(0, len(values) - 1), max_size=10))
        assert f.levels.access(at).tolist() == [values[i] for i in at]
        assert f.token(len(values) - 1) == values[-1]
        lo = data.draw(st.integers(0, len(values)))
        assert f.levels.slice(lo, len(values)).tolist() == values[lo:]


def test_token_files_equal_the_library(spark, small):
    path = P.path("word_bpe_49k.json")
    rows = [(i - 3, v) for i, v in enumerate(ODD)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "doc_id long, text string, start string, id int")
    folder = token_store.new_dir(spark, "tokens")
    files = token_store.write_tokens(df, path, folder, end_id=2, ranges=5, slice_bytes=1 << 12, file_tokens=3000)
    assert files.count() > 20
    library, at, expected = Tokenizer.from_file(path), 0, []
    for i, v in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(v or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.checksums(files, folder).collect()) == expected
    one = token_store.read_tokens(files, folder).where("id = 103").first()
    assert one.ids[-1] == 2
    for k in (0, 1, len(one.ids) // 2, len(one.ids) - 1):
        assert token_store.read_token(files, folder, one.start + k) == one.ids[k]
    with pytest.raises(IndexError):
        token_store.read_token(files, folder, at)


def test_a_file_written_twice_is_whole(tmp_path):
    folder = f"file://{tmp_path}/store"
    for _ in range(2):
        token_store._put(folder, "part-0.dac", b"the same bytes")
    assert os.listdir(tmp_path / "store") == ["part-0.dac"]


def test_memo_is_bounded():
    memo = Memo(10)
    for i in range(100):
        assert memo.get_all([i]) == [None]
        memo.now[i] = i
        assert memo.get_all([i, i - 3])[0] == i
        assert len(memo.now) + len(memo.before) <= 13


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé.,!' \n<|x1"), max_size=20), max_size=6))
def test_pieces_equal_the_library(values):
    path = P.path("word_bpe_49k.json")
    e = ENCODERS.setdefault(path, token_store.Encoder(path))
    ids, n = e.encode(pa.array(values, pa.string()))
    ends = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.ids for x in e.library.encode_batch(values, add_special_tokens=False)]


ENCODERS: dict = {}


def test_token_files_with_repeated_and_null_ids(spark):
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id long, text string")
    folder = token_store.new_dir(spark, "tokens")
    got = token_store.checksums(token_store.write_tokens(df, path, folder, end_id=2), folder).collect()
    assert sorted((r.id is not None, r.id or 0, r.n_tokens) for r in got) == [(False, 0, 1), (False, 0, 2), (True, 1, 2), (True, 1, 3), (True, 1, 3)]
    assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == 11
    assert {r.start for r in got if r.id is None} == {0, min(r.n_tokens for r in got if r.start == 0)}
    empty = token_store.new_dir(spark, "tokens")
    assert token_store.checksums(token_store.write_tokens(df.limit(0), path, empty, end_id=2), empty).collect() == []


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_file=path), spv.Codec(spv.Model(f.read()))


def encode(codec, values):
    ids, n = codec.encode(pa.array(values, pa.string()))
    ends = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], codec.decode(ids, n)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" abthein.\n\té漢😀'-()1_/\x00▁"), max_size=40), max_size=5))
def test_piece_ids_equal_the_library(pieces, values):
    library, codec = pieces
    ids, back = encode(codec, values)
    assert ids == [library.encode(v) for v in values]
    assert back == [v.replace("▁", " ") for v in values]


def test_piece_ids_of_documents(spark, small, pieces):
    library, _ = pieces
    rows = [(i, v) for i, v in enumerate(ODD)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "doc_id long, text string, ids int, k0 string")
    values = dict(rows)
    for r in spv.encode_texts(df, P.path("piece_bpe_32k.model"), keep=("doc_id", "k0", "ids")).selectExpr("k0 as doc_id", "ids", "decoded").collect():
        t = values[r.doc_id] or ""
        assert r.ids == library.encode(t) and r.decoded == t
    assert all(r.round_trip for r in spv.digest_texts(df, P.path("piece_bpe_32k.model")).collect())
    assert spv.digest_texts(df.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_unigram_pass_finds_the_best_segmentation():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = spv.Model(f.read(), spv.UNIGRAM)
    search = spv.SharedPrefix(model)

    def best(word):
        top = [0.0] + [None] * len(word)
        for e in range(1, len(word) + 1):
            top[e] = max(top[b] + model.score.get(word[b:e], search.floor if e - b == 1 else -1e18) for b in range(e))
        return top[-1]

    words = ["▁the", "▁there", "▁thereby", "▁in", "▁inner", "▁inning", "tion", "▁unbelievable", "q", "▁▁▁x"]
    for word, parts in search.segment(words):
        assert "".join(parts) == word
        assert sum(model.score.get(p, search.floor) for p in parts) == pytest.approx(best(word))


def test_forward_columns_are_shared():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = spv.Model(f.read())
    search, calls = spv.SharedPrefix(model), []
    real = search.follows
    search.follows = lambda a, b: calls.append((a, b)) or real(a, b)
    list(search.segment(["▁international"]))
    alone = len(calls)
    calls.clear()
    list(search.segment(["▁international", "▁internationally", "▁internationals"]))
    assert len(calls) < 2 * alone
