"""Documents as DataFrames of chunks, and edits back into documents.

Tables, paragraphs and JSON columns have native forms; files of any registered format go through one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.recognize import span_array
from veilspark.sources.formats import DecodeError, Edit, Registry, read_document, write_document

CHUNK = "chunk_id int, chunk_start int, row int, col int, sheet string, column_name string, part string, text string, hints array<string>"


def paragraphs(docs: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Paragraph chunks by built-in functions: keys, chunk_id, chunk_start, text."""
    blocks = span_array(F.col(text_col), r"(?:[^\S\n]*\S[^\n]*(?:\n|\z))+")
    rows = docs.select(*keys, F.posexplode(blocks).alias("chunk_id", "b"))
    return rows.select(*keys, "chunk_id", F.col("b.start").alias("chunk_start"), F.regexp_replace("b.value", r"\r?\n\z", "").alias("text"))


def cells(table: DataFrame, *keys: str, columns: list[str] | None = None) -> DataFrame:
    """One chunk a cell of a table, all as strings; the column's name is its hint."""
    names = columns or [c for c in table.columns if c not in keys]
    each = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("text")) for i, c in enumerate(names)])
    return table.select(*keys, F.inline(each)).withColumn("hints", F.array("column_name"))


def json_cells(table: DataFrame, column: str, *keys: str) -> DataFrame:
    """One chunk a top-level leaf of a JSON column; the key is its hint."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    return table.select(*keys, F.inline(entries)).select(*keys, F.col("key").alias("column_name"), F.col("value").alias("text"), F.array("key").alias("hints"))


def drop_rows(table: DataFrame, flagged: DataFrame, *keys: str) -> DataFrame:
    return table.join(flagged.select(*keys).distinct(), list(keys), "left_anti")


def drop_columns(table: DataFrame, *names: str) -> DataFrame:
    return table.drop(*names)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, content and sha256 of each file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "content", F.sha2("content", 256).alias("sha256"))


def read_chunks(documents: DataFrame, registry: Registry | None = None) -> DataFrame:
    """path, extension and chunks of each document; error tells why a document could not be read."""
    registry = registry or Registry.with_built_in()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for path, x, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = registry.find(x)
                try:
                    if f is None:
                        raise DecodeError(f"no format for {x!r}")
                    chunks = read_document(registry, f, raw or b"")
                    out += [(path, x, i, c.start, c.row, c.col, c.sheet, c.column_name, c.part, c.text, list(c.hints), None) for i, c in enumerate(chunks)]
                except (DecodeError, NotImplementedError, OSError, KeyError) as e:
                    out.append((path, x, None, None, None, None, None, None, None, None, None, str(e)))
            names = ["path", "extension", "chunk_id", "chunk_start", "row", "col", "sheet", "column_name", "part", "text", "hints", "error"]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return documents.select("path", "extension", "content").mapInArrow(run, f"path string, extension string, {CHUNK}, error string")


def write_edits(documents: DataFrame, edits: DataFrame, registry: Registry | None = None) -> DataFrame:
    """path and redacted content. edits: path, chunk_id, start, end, replacement, drop ("row", "column" or null)."""
    registry = registry or Registry.with_built_in()
    grouped = edits.groupBy("path").agg(F.collect_list(F.struct("chunk_id", "start", "end", "replacement", "drop")).alias("edits"))

    def run(batches):
        for batch in batches:
            out = []
            for x, raw, own in zip(batch.column("extension").to_pylist(), batch.column("content").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                f = registry.find(x)
                todo = [Edit(e["chunk_id"], e["start"], e["end"], e["replacement"] or "", e["drop"]) for e in own or ()]
                out.append(write_document(registry, f, raw, todo) if f and todo else raw)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    both = documents.select("path", "extension", "content").join(grouped, "path", "left")
    return both.mapInArrow(run, "path string, content binary")
