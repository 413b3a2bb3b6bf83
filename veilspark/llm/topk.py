"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Every vector becomes a sparse row of integer weights (a component's position is its term). Rows are packed into blocks
of bounded size; a block keeps one posting list for each term. For a block of queries each term's list is scattered,
weighted, into a dense array of scores (query x candidate); a partition selection then keeps the k best of the block,
and a ranking window merges the blocks. Each query block meets each candidate block once, in a grid whose cells are
spread over salts, so no task and no broadcast holds more than one block of each side.

Cases: null or empty tables give no rows; vectors that are null or hold a null or non-finite component take no part;
rows without id neither; an empty vector scores 0; vectors of different lengths meet in the positions both have;
a repeated query row counts once, repeated candidate rows each count, and a query's own id is never its candidate;
ties go to the smaller id; scores beyond a long are held at its ends. Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)
#: Up to this weight, products of up to 2**6 terms and more are exact in 64 bits.
SAFE_WEIGHT = 1 << 26

_BLOCK = pa.schema([("no", pa.int64()), ("ids", pa.binary()), ("ptr", pa.binary()), ("terms", pa.binary()), ("kind", pa.string()), ("weights", pa.binary())])
_BLOCK_DDL = "no long, ids binary, ptr binary, terms binary, kind string, weights binary"


def weights_of(lists: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that take part, and their floor(scale * x) other than zero as (row starts, terms, weights)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.cast(pa.float64())
    value = flat.to_numpy(zero_copy_only=False)
    ok = np.isfinite(value)
    bad = np.concatenate([[0], np.cumsum(~ok)])
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(lists.is_valid())
    rows = np.flatnonzero(good)
    sizes = (offsets[1:] - offsets[:-1])[rows]
    at = np.repeat(offsets[:-1][rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(rows) else sizes, sizes) + np.arange(sizes.sum())
    with np.errstate(over="ignore"):
        w = np.floor(value[at] * scale)
    terms = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = w != 0
    count = np.concatenate([[0], np.cumsum(keep)])
    ptr = count[np.concatenate([[0], np.cumsum(sizes)])]
    return rows, ptr.astype(np.int64), terms[keep].astype(np.int32), w[keep]


def packer(scale: float, rows_per_block: int):
    def pack(batches):
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() - 1
        for batch in batches:
            ids = batch.column(0)
            have = np.flatnonzero(np.asarray(ids.is_valid()))
            for a in range(0, len(have), rows_per_block):
                part = batch.take(pa.array(have[a : a + rows_per_block]))
                rows, ptr, terms, w = weights_of(part.column(1), scale)
                if not len(rows):
                    continue
                key = part.column(0).to_numpy()[rows]
                top = np.abs(w).max(initial=0)
                kind = "i2" if top < 1 << 15 else "i4" if top <= SAFE_WEIGHT else "f8"
                no += 1  # blocks of a task are dealt out in turn, each task beginning at another place
                yield pa.RecordBatch.from_arrays([pa.array([no])] + [pa.array([x]) for x in (key.astype(np.int64).tobytes(), ptr.tobytes(), terms.tobytes())] + [pa.array([kind]), pa.array([w.astype(kind).tobytes()])], schema=_BLOCK)

    return pack


def _unpack(row: dict, p: str) -> tuple[np.ndarray, ...]:
    ids, ptr, terms = (np.frombuffer(row[p + c], t) for c, t in (("ids", np.int64), ("ptr", np.int64), ("terms", np.int32)))
    w = np.frombuffer(row[p + "weights"], row[p + "kind"])
    return ids, ptr, terms, np.array([int(x) for x in w], object) if row[p + "kind"] == "f8" else w.astype(np.int64)


def postings(ptr: np.ndarray, terms: np.ndarray, w: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights)."""
    rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    edges = [*first.tolist(), len(order)]
    return {int(t): (rows[o := order[edges[i] : edges[i + 1]]], w[o]) for i, t in enumerate(names)}


def scores(queries: dict, candidates: dict, nq: int, n: int, exact: bool) -> np.ndarray:
    """Dense scores of a query block against a candidate block, one term at a time."""
    acc = np.zeros((nq, n), object if exact else np.int64)
    for t, (qr, qw) in queries.items():
        if t in candidates:
            cr, cw = candidates[t]
            if len(qr) == nq and len(cr) == n:
                acc += np.multiply.outer(qw, cw)
            else:
                acc[np.ix_(qr, cr)] += np.multiply.outer(qw, cw)
    return np.array([[min(max(x, LONG.min), LONG.max) for x in r] for r in acc], np.int64).reshape(nq, n) if exact else acc


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ids rise, and ties go to the earlier position."""
    n = len(score)
    if n > k:
        least = np.partition(score, n - k)[n - k]
        above = np.flatnonzero(score > least)
        at = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    else:
        at = np.arange(n)
    return at[np.lexsort((ids[at], -score[at].astype(object) if score[at].min(initial=0) == LONG.min else -score[at]))]


def _cells(k: int, tile: int = 64):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qid, qptr, qterms, qw = _unpack(row, "q_")
                cid, cptr, cterms, cw = _unpack(row, "c_")
                order = np.argsort(cid, kind="stable")
                rank = np.empty(len(cid), np.int64)
                rank[order] = np.arange(len(cid))
                lists = {t: (rank[r], w) for t, (r, w) in postings(cptr, cterms, cw).items()}
                lists = {t: (np.arange(len(cid)), w[np.argsort(r)]) if len(r) == len(cid) else (r, w) for t, (r, w) in lists.items()}
                cid, out = cid[order], []
                for a in range(0, len(qid), tile):
                    b = min(len(qid), a + tile)
                    lo, hi = qptr[a], qptr[b]
                    acc = scores(postings(qptr[a : b + 1] - lo, qterms[lo:hi], qw[lo:hi]), lists, b - a, len(cid), "f8" in (row["q_kind"], row["c_kind"]))
                    for i in range(b - a):
                        q, s, own = qid[a + i], acc[i], cid
                        x, y = np.searchsorted(cid, q, "left"), np.searchsorted(cid, q, "right")
                        if y > x:
                            s, own = np.delete(s, slice(x, y)), np.delete(cid, slice(x, y))
                        at = best(s, own, k)
                        out.append((np.full(len(at), q), own[at], s[at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "cand_id", "score"])

    return run


def top_k_inner_product(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0, query_block: int = 4096, row_block: int = 1024, cell_rows: int = 1 << 20) -> DataFrame:
    """query_id, rank (from 1), cand_id and score of each query's k best other rows.

    Candidates are copied once for each block of queries, blocks of queries once for each salt; a cell of the grid holds
    about cell_rows candidates, or fewer where that keeps all cores busy."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = vectors.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = asked.dropDuplicates(["id", "v"])
    size = vectors.agg(F.count("*").alias("all"), F.count_if(is_query).alias("asked")).first()
    groups = -(-size.asked // query_block) or 1
    salts = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups), -(-size.all // cell_rows))
    cells = 4 * groups * salts  # more partitions than cells, so that few of them share one
    q = asked.repartition(groups, F.xxhash64("id")).mapInArrow(packer(scale, query_block), _BLOCK_DDL)
    q = q.select(*[F.col(c).alias("q_" + c) for c in _BLOCK.names], F.pmod(F.col("no"), F.lit(groups)).alias("g"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).repartition(cells, "g", "salt").hint("shuffle_merge")
    c = rows.mapInArrow(packer(scale, row_block), _BLOCK_DDL)
    c = c.select(*[F.col(x).alias("c_" + x) for x in _BLOCK.names], F.pmod(F.col("no"), F.lit(salts)).alias("salt"))
    c = c.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).repartition(cells, "g", "salt")
    found = c.join(q, ["g", "salt"]).drop("g", "salt").mapInArrow(_cells(k), "query_id long, cand_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "cand_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    found = top_k_inner_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("cand_id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
