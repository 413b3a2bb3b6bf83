import json
import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import policy, recognize, rules
from veilspark.plans.engine import Analyzer, Orchestrator, core_rules
from veilspark.sources import formats, frames, media
from veilspark.sources.formats import DecodeError, Edit, Registry
from veilspark.streaming import detect as streams

R = Registry.with_built_in()


def chunks(name, raw):
    return R.find(name).read(raw if isinstance(raw, bytes) else raw.encode())


def write(name, raw, edits):
    return R.find(name).write(raw if isinstance(raw, bytes) else raw.encode(), edits)


def test_registry():
    assert len(R.formats) == 15
    assert R.find("JSON").id == "json" and R.find(".Htm").id == "html" and R.find(None, "text/csv; charset=utf-8").id == "csv" and R.find("zzz") is None
    with pytest.raises(ValueError):
        R.add(R.formats["txt"])
    assert chunks("rtf", "{}") == []
    with pytest.raises(NotImplementedError):
        write("rtf", "{}", [])
    with pytest.raises(NotImplementedError):
        chunks("pdf", "x")


def test_text():
    t = "one\ntwo\r\n\r\n \nthree\n\nfour"
    assert [(c.start, c.text) for c in chunks("txt", t)] == [(0, "one\ntwo"), (13, "three"), (20, "four")]
    assert write("txt", t, [Edit(1, 0, 5, "3"), Edit(0, 4, 7, "2"), Edit(2, 0, 99, "no")]) == b"one\n2\r\n\r\n \n3\n\nfour"
    with pytest.raises(DecodeError):
        chunks("txt", b"\xff")


def test_csv():
    t = 'name;note\nAnn;"a;b\nc"\nBob;\n'
    cells = chunks("csv", t)
    assert [(c.row, c.col, c.text, c.hints) for c in cells[2:4]] == [(1, 0, "Ann", ("name",)), (1, 1, "a;b\nc", ("note",))]
    assert write("csv", t, [Edit(2, 0, 3, "X")]).decode() == 'name;note\nX;"a;b\nc"\nBob;\n'
    assert write("csv", t, [Edit(2, 0, 0, "", "row"), Edit(1, 0, 0, "", "column"), Edit(0, 0, 0, "", "row")]).decode() == "name\nBob\n"
    for d in ",\t;|":
        assert formats.sniff_delimiter(f"a{d}b\nc{d}d") == d
    assert chunks("csv", "") == []


def test_json():
    t = '{ "mail" : "a\\u0040b.cd", "list": ["x", 12, {"k": null}], "e": {}, "f": [] }'
    got = [(c.text, c.hints) for c in chunks("json", t)]
    assert got == [("mail", ()), ("a@b.cd", ("mail",)), ("list", ()), ("x", ("list",)), ("12", ("list",)), ("k", ()), ("null", ("k",)), ("e", ()), ("f", ())]
    assert write("json", t, [Edit(1, 0, 6, '"'), Edit(4, 0, 2, "**")]).decode() == '{ "mail" : "\\"", "list": ["x", "**", {"k": null}], "e": {}, "f": [] }'
    assert write("json", "[1]", [Edit(0, 0, 1, "22")]) == b"[22]"
    for bad in ("{", '{"a" 1}', "[1,]", "[1] x", "", "tru", '{"a":1,}', "[1 2]"):
        with pytest.raises(DecodeError):
            chunks("json", bad)
    assert len(chunks("json", "[" * 128 + "]" * 128)) == 0
    with pytest.raises(DecodeError):
        chunks("json", "[" * 129 + "]" * 129)


def test_markup():
    t = '<p class="firstName">Card <b>4111</b> &amp; more</p><!-- note --><script>x("1")</script>'
    got = [(c.text, c.hints[:1]) for c in chunks("html", t)]
    assert got == [("firstName", ("class",)), ("Card ", ("p",)), ("4111", ("b",)), (" &amp; more", ("p",)), (" note ", ())]
    assert "Card" in chunks("html", t)[2].hints
    assert write("html", t, [Edit(2, 0, 4, "[x]")]).decode() == t.replace("4111", "[x]")
    x = "<a><paymentCard n='1'>4111</paymentCard><![CDATA[raw]]></a>"
    assert [(c.text, c.hints) for c in chunks("xml", x)] == [("1", ("n",)), ("4111", ("payment card",)), ("raw", ("a",))]
    with pytest.raises(DecodeError):
        chunks("xml", "<a><b></a>" if False else "<a>")
    with pytest.raises(ValueError):
        write("xml", x, [Edit(1, 0, 99, "")])
    assert formats.words_of_name("paymentCard") == "payment card" and formats.words_of_name("bank-account_ID") == "bank account id"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office():
    doc = package({"word/document.xml": "<w:body><w:p><w:r><w:t>Mail a@</w:t></w:r><w:r><w:t>b.cd &amp; x</w:t></w:r></w:p></w:body>", "other.bin": "z"})
    assert [c.text for c in chunks("docx", doc)] == ["Mail a@b.cd & x"]
    new = write("docx", doc, [Edit(0, 5, 11, "[m]")])
    assert [c.text for c in chunks("docx", new)] == ["Mail [m] & x"]
    assert zipfile.ZipFile(io.BytesIO(new)).read("other.bin") == b"z"
    deck = package({"ppt/slides/slide1.xml": "<a:p><a:r><a:t>hi</a:t></a:r></a:p>"})
    assert [c.text for c in chunks("pptx", deck)] == ["hi"]
    book = package({"xl/sharedStrings.xml": "<sst><si><t>mail</t></si><si><t>a@b.cd</t></si></sst>", "xl/worksheets/sheet1.xml": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData>'})
    assert [(c.row, c.col, c.text, c.hints) for c in chunks("xlsx", book)] == [(0, 0, "mail", ()), (0, 1, "n", ()), (1, 0, "a@b.cd", ("mail",)), (1, 1, "7", ("n",))]
    assert [c.text for c in chunks("xlsx", write("xlsx", book, [Edit(2, 0, 6, "<x>")]))] == ["mail", "n", "<x>", "7"]
    with pytest.raises(ValueError):
        write("xlsx", book, [Edit(2, 0, 0, "", "row")])


def test_parts():
    inner = b"note for ann@example.com\n"
    doc = package({"word/document.xml": "<w:p><w:r><w:t>body</w:t></w:r></w:p>", "word/embeddings/a.txt": inner, "word/media/b.png": b"\x89PNG", "word/embeddings/c.bin": b"z"})
    f = R.find("docx")
    got = formats.read_document(R, f, doc)
    assert [(c.part, c.text) for c in got] == [("word/document.xml", "body"), ("word/embeddings/a.txt", "note for ann@example.com")]
    new = formats.write_document(R, f, doc, [Edit(0, 0, 4, "B"), Edit(1, 9, 24, "[m]")])
    assert [c.text for c in formats.read_document(R, f, new)] == ["B", "note for [m]"]
    book = package({"xl/worksheets/sheet1.xml": '<c r="A1"><v>1</v></c>', "xl/comments1.xml": "<comments><text>call me</text></comments>"})
    x = R.find("xlsx")
    assert [(c.part, c.text) for c in formats.read_document(R, x, book)] == [(None, "1"), ("xl/comments1.xml", "call me")]
    assert b"call you" in zipfile.ZipFile(io.BytesIO(formats.write_document(R, x, book, [Edit(1, 5, 7, "you")]))).read("xl/comments1.xml")


def test_sound_and_pictures():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(np.arange(1, 1001, dtype="<i2").tobytes())
    raw = out.getvalue()
    quiet, rate, _ = media.read_wav(write("wav", raw, [Edit(0, 100_000, 200_000, "silence")]))
    assert (quiet[100:200] == 0).all() and (quiet[:100, 0] == np.arange(1, 101)).all() and rate == 1000
    assert len(media.read_wav(write("wav", raw, [Edit(0, 0, 500_000, "erase")]))[0]) == 500
    tone = media.redact_samples(quiet, 1000, 0, 1_000_000, "tone", 100.0, 0.5, "square")
    assert abs(int(np.abs(tone).max()) - 16383) <= 1
    pixels = np.arange(32 * 32 * 3, dtype=np.uint8).reshape(32, 32, 3)
    assert (media.blackbox(pixels, (0, 0, 8, 8))[:8, :8] == 0).all()
    mosaic = media.pixelate(pixels, (0, 0, 32, 32), 16)
    assert (mosaic[:16, :16] == pixels[0, 0]).all() and (mosaic[16:, 16:] == pixels[16, 16]).all()
    soft = media.blur(np.full((20, 20, 1), 9, np.uint8), (2, 2, 18, 18), 2.0)
    assert (soft == 9).all()
    flash = np.zeros((21, 21, 1), np.uint8)
    flash[10, 10] = 255
    assert media.blur(flash, (0, 0, 21, 21), 2.0).max() < 30


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.chunk_start, r.text) for r in frames.paragraphs(docs, "doc_id").orderBy("chunk_id").collect()] == [(0, "a\nb"), (5, "c")]
    rows = spark.createDataFrame([(1, "x", '{"k": "v", "n": 1}')], "id long, a string, j string")
    assert [(r.col, r.column_name, r.text) for r in frames.cells(rows, "id", columns=["a"]).collect()] == [(0, "a", "x")]
    assert {(r.column_name, r.text) for r in frames.json_cells(rows, "j", "id").collect()} == {("k", "v"), ("n", "1")}
    assert frames.drop_rows(rows, rows, "id").count() == 0 and frames.drop_columns(rows, "a").columns == ["id", "j"]


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,card\nAnn,4111 1111 1111 1111\n")
    (tmp_path / "b.json").write_text('{"email": "ann@example.com", "n": 1}')
    (tmp_path / "c.txt").write_text("hi ann@example.com\n\nbye\n")
    (tmp_path / "d.html").write_text("<p title='x'>ann@example.com</p>")
    (tmp_path / "e.json").write_text("{")
    docs = frames.files(spark, f"file://{tmp_path}/*")
    bad = frames.read_chunks(docs).where("error IS NOT NULL").collect()
    assert [r.extension for r in bad] == ["json"]
    good = docs.where("path NOT LIKE '%e.json'")
    done = {r.path[-6:].lstrip("/"): bytes(r.content).decode() for r in Orchestrator().anonymize(good).collect()}
    assert done == {"a.csv": "name,card\nAnn,*******************\n", "b.json": '{"email": "[email_address]", "n": 1}', "c.txt": "hi [email_address]\n\nbye\n", "d.html": "<p title='x'>[email_address]</p>"}


def test_hints_lift_cells(spark):
    df = spark.createDataFrame([(1, "4111 1111 1111 1111", ["card"]), (2, "4111 1111 1111 1111", ["serial"])], "id long, text string, hints array<string>")
    assert [r.id for r in Analyzer().analyze(df, "id", hints_col="hints").collect()] == [1]


def test_scope_and_exclusions(spark):
    df = spark.createDataFrame([(1, "mail ann@example.com and bob@example.com"), (2, None)], "doc_id long, text string")
    x = spark.createDataFrame([(1, 0, 10)], "doc_id long, start int, end int")
    core = Analyzer(rules=core_rules(["email"]), terms=[])
    assert [r.value for r in core.analyze(df, "doc_id", exclusions=x).collect()] == ["bob@example.com"]
    lang = recognize.exploded(recognize.scan(df.withColumn("g", F.lit("en")), rules.Scope(), rules=core_rules(["email"]), terms=[], language_col="g"), "doc_id")
    assert {r.language for r in lang.collect()} == {"en"}


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, f"mail u{i}@example.com", "2024-01-01 00:0%d:00" % (i % 6)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    core = Analyzer(rules=core_rules(["email"]), terms=[])

    def drain(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    stream = spark.readStream.schema(schema).parquet(path)
    found = streams.detect(stream, core, "doc_id", "ts")
    assert len(drain(found, "found")) == 12
    clean = drain(streams.redact(stream, core, policy.Policy().label("email_address", use=policy.replaced())), "clean")
    assert {r.text for r in clean} == {"mail [email_address]"}
    counts = drain(streams.windowed_counts(found, "ts", "3 minutes"), "counts", "complete")
    assert sorted(r.entities for r in counts) == [6, 6]
    assert len(drain(streams.distinct_documents(stream.withColumn("doc_id", F.col("doc_id") % 4), "doc_id", "ts"), "ids")) == 4
    sessions = drain(streams.session_counts(found.withColumn("u", F.lit(1)), "ts", "u"), "sessions", "complete")
    assert [r.entities for r in sessions] == [12]
    vault_path = f"file://{tmp_path}/vault"
    q = streams.fill_vault(found.select("label", "value"), vault_path, b"key").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(vault_path).count() == 12


def test_kept_counts_take_late_rows_until_the_watermark(spark, tmp_path):
    path, out = tmp_path / "in", f"file://{tmp_path}/out"
    path.mkdir()
    schema = "ts timestamp, label string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(path))
    counts = streams.windowed_counts(stream, "ts", "5 minutes", late="10 minutes")

    def more(*minutes):
        lines = "".join(json.dumps({"ts": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00", "label": "a"}) + "\n" for m in minutes)
        (path / f"{len(list(path.iterdir()))}.json").write_text(lines)
        streams.keep_counts(counts, out).trigger(availableNow=True).start().awaitTermination()
        rows = streams.kept_counts(spark, out)
        return {(r.window_start.hour * 60 + r.window_start.minute): r.entities for r in rows.collect()}

    assert more(0, 1, 7) == {0: 2, 5: 1}
    assert more(4, 8, 31) == {0: 3, 5: 2, 30: 1}  # late, but within the watermark
    assert more(2, 33) == {0: 3, 5: 2, 30: 2}  # minute 2 comes behind it
    assert streams.kept_counts(spark, out).columns == ["window_start", "window_end", "label", "entities"]
