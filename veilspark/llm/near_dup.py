"""Near-duplicate classes by Order MinHash with verification by banded alignment.

A text is its sequence of words (wordcodes.py). Texts with the same sequence are one node. A node's three-word windows,
each labelled with its occurrence number, are ranked by `sketches` hash functions; the `kept` least windows of each,
in the order they have in the text, form one key, so keys agree where texts agree in content and in order. A changed word costs
a window for each word in it, so windows and keys are small: for pairs at the threshold a key holds two windows, and
texts of at most `short` words have further keys of one two-word window each. Nodes that
share a key are candidates: they are compared by banded alignment of their words, and linked if
1 - edit distance / longer length reaches `similarity` (0.8). Classes are the connected components of the links.

Within a key's bucket, all members are first compared with one of them (a star, so a group of copies costs as many
comparisons as it has members). Then components are formed, and buckets whose members are still in several components
are finished exactly: while a bucket is of bounded size, one task compares its members across components, by way of the
rare words that similar texts must share; larger ones are cut into pieces of bounded size, and each two pieces meet in a
task of their own, but for pieces of the largest component, which need not meet. So no candidate pair is left undecided,
the pairs of a group are not listed, and a bucket of any size takes one round.

Cases: a null text is a class of its own; texts without words are copies only of the same string; texts of at
most three words have one window; ids may repeat or be null (the class id is the least id, null if there is none, and its row is kept); texts are
read whole, however long; an empty table gives no rows; other columns, whatever their names, are not touched."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.llm.edit_distance import similar
from veilspark.llm.shared import materialize, new_dir, remove, trimmed
from veilspark.llm.wordcodes import Words, mix, shingles, word_slices

KEY = "struct<x: long, y: long>"
FULL, LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF), np.iinfo(np.int64).max


def occurrences(codes: np.ndarray) -> np.ndarray:
    """0, 1, ... for the first, second, ... time a code stands in the sequence."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(codes) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(heads, np.diff([*heads, len(codes)]))
    return out


def order_sketches(windows: list[np.ndarray], sketches: int, kept: int, first: int = 0) -> np.ndarray:
    """Keys of several texts' labelled windows (none empty): one line a text, one column a hash function, from the first
    on."""
    size = np.array([len(w) for w in windows], np.int64)
    begin = np.cumsum(size) - size
    flat = np.concatenate(windows)
    out = np.empty((len(windows), sketches), np.uint64)
    rows = np.arange(len(windows))
    for i in range(first, first + sketches):
        rank = mix(flat ^ np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF))
        rank[rank == FULL] -= np.uint64(1)
        place = np.full((len(windows), kept), np.iinfo(np.int64).max)
        for k in range(kept):
            least = np.minimum.reduceat(rank, begin)
            at = np.flatnonzero((rank == np.repeat(least, size)) & (rank != FULL))
            row = np.searchsorted(begin, at, side="right") - 1
            new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            at, row = at[new], row[new]
            place[row, k] = at
            rank[at] = FULL
        place.sort(axis=1)
        key = np.full(len(windows), i + 1, np.uint64)
        for k in range(kept):
            have = place[:, k] < len(flat)
            key[rows[have]] = mix(key[have] * np.uint64(0x2545F4914F6CDD1D) + flat[place[have, k]])
        out[:, i - first] = key
    return out


def fingerprint(kind: bytes, raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, person=kind).digest()



def labelled_windows(codes: np.ndarray, words: int) -> np.ndarray:
    s = shingles(codes, words)
    return mix(s + occurrences(s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def keys_of(texts: list[np.ndarray], words: int, sketches: int, kept: int, short: int) -> list[list[int]]:
    """Keys of texts, given as codes of their words (none empty); those of at most `short` words have more of them."""
    out = order_sketches([labelled_windows(x, words) for x in texts], sketches, kept).view(np.int64).tolist()
    few = [i for i, x in enumerate(texts) if len(x) <= short]
    if few:
        more = order_sketches([labelled_windows(texts[i], 2) for i in few], sketches, 1, sketches).view(np.int64).tolist()
        for i, line in zip(few, more, strict=True):
            out[i] += line
    return out


def spellings(w: Words) -> list[bytes]:
    """The words of each row, one zero byte between two."""
    inside = w.data != 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    raw, at = w.data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[w.rows].tolist()
    return [raw[a:b].strip(b"\0") for a, b in zip(at[:-1], at[1:], strict=True)]


def _sketcher(words: int, sketches: int, kept: int, short: int):
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            valid = np.asarray(column.is_valid())
            for a, b, w in word_slices(column):
                fps, n, texts, at, keys = [], np.diff(w.splits), [], [], [[] for _ in range(b - a)]
                spelled = spellings(w)
                for r in range(b - a):
                    own = w.codes[w.splits[r] : w.splits[r + 1]]
                    if not valid[a + r]:
                        fps.append(None)
                    elif not len(own):
                        fps.append(fingerprint(b"text", column[a + r].as_py().encode("utf-8", "surrogatepass")))
                    else:
                        fps.append(fingerprint(b"words", spelled[r]))
                        texts.append(own)
                        at.append(r)
                if texts:
                    for r, line in zip(at, keys_of(texts, words, sketches, kept, short), strict=True):
                        keys[r] = line
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(fps, pa.binary()), pa.array(n.astype(np.int32)), pa.array(keys, pa.list_(pa.int64()))], ["id", "k", "fp", "n", "keys"])

    return run


def _word_rows(batches):
    for batch in batches:
        for a, b, w in word_slices(batch.column(1)):
            small = (w.codes >> np.uint64(32)).astype(np.uint32)
            rows = [small[x:y].tobytes() for x, y in zip(w.splits[:-1], w.splits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], ["fp", "words"])


def _checker(least: float):
    """Of pairs with their words, the labels of those that are similar."""

    def run(batches):
        for batch in batches:
            wa, wb = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint32) for x in (wa, wb))
                ok[i] = similar(a, b, least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return run


def rare_words(words: list[np.ndarray], least: float) -> list[np.ndarray]:
    """Of each text the rarest distinct words, as many as a similar text can lack and one more.

    A text that is similar to one of n words lacks at most (1 - least) / least * n of its words, so the rarest word that
    two similar texts share is among these in both."""
    own = [np.unique(w) for w in words]
    _, back, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    out, at = [], 0
    for w, d in zip(words, own, strict=True):
        ids = back[at : at + len(d)]
        at += len(d)
        most = int(np.floor((1 - least) / least * len(w) + 1e-9)) + 1
        out.append(ids[np.lexsort((ids, count[ids]))[:most]])
    return out


def joined_labels(labels: list, words: list[np.ndarray], keys: np.ndarray, key: int, least: float, piece: np.ndarray | None = None) -> list[tuple]:
    """Pairs of labels that similar members connect, found exactly: every pair of members is in one component by now, or
    left to another of its keys, ruled out (by length, rare words or the number of words in common), or compared.

    keys: all keys of each member, a line a member; a pair is looked at under the least key that it shares.
    piece: if given, only members of different pieces meet."""
    number = {v: i for i, v in enumerate(dict.fromkeys(labels))}
    mine = np.array([number[v] for v in labels])
    up = np.arange(len(number))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    rare = rare_words(words, least)
    sizes = np.array([len(w) for w in words])
    begins = np.cumsum(sizes) - sizes
    labelled = np.concatenate([mix(w.astype(np.uint64) + (occurrences(w).astype(np.uint64) << np.uint64(32))) for w in words])
    tokens = np.unique(labelled, return_inverse=True)[1]
    marked = np.zeros(int(tokens.max()) + 1, bool)
    who = np.repeat(np.arange(len(words)), [len(r) for r in rare])
    flat = np.concatenate(rare)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    most = np.bincount(mine).argmax()
    found, names = [], list(number)
    for i in np.flatnonzero(mine != most).tolist():
        lo, hi = np.searchsorted(flat, rare[i], "left"), np.searchsorted(flat, rare[i], "right")
        near = np.unique(np.concatenate([who[a:b] for a, b in zip(lo, hi, strict=True)]))
        longer = np.maximum(sizes[near], sizes[i])
        near = near[(np.minimum(sizes[near], sizes[i]) >= least * longer - 1e-9) & (mine[near] != mine[i]) & ((near > i) | (mine[near] == most))]
        if piece is not None:
            near = near[piece[near] != piece[i]]
        shared = keys[near] == keys[i]
        near = near[np.where(shared, keys[near], LARGEST).min(axis=1, initial=LARGEST) == key]
        if not len(near):
            continue
        own, size = tokens[begins[i] : begins[i] + sizes[i]], sizes[near]
        marked[own] = True
        at = np.repeat(begins[near] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.add.reduceat(marked[tokens[at]].astype(np.int64), np.cumsum(size) - size)
        marked[own] = False
        longer = np.maximum(size, sizes[i])
        near = near[longer - common <= np.floor((1 - least) * longer + 1e-9)]
        for label in dict.fromkeys(mine[near].tolist()):
            p, q = root(label), root(int(mine[i]))
            if p != q and any(similar(words[i], words[j], least) for j in near[mine[near] == label].tolist()):
                up[p] = q
                found.append((names[mine[i]], names[label]))
    return found


def _finisher(least: float):
    def run(table: pa.Table) -> pa.Table:
        listed = table.column("keys").to_pylist()
        wide = max(map(len, listed))
        keys = np.array([x + [LARGEST] * (wide - len(x)) for x in listed], np.int64)
        piece = None if table.column("one")[0].as_py() == table.column("two")[0].as_py() else np.asarray(table.column("piece"))
        found = joined_labels(table.column("label").to_pylist(), [np.frombuffer(x, np.uint32) for x in table.column("words").to_pylist()], keys, table.column("key")[0].as_py(), least, piece)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return run


class NearDuplicates:
    """The steps over one table; `rows` (id, k, fp, n, keys) and `classes` are tables in the shared folder.

    All other tables of the steps are deleted once the classes are written."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float = 0.8, sketches: int = 32, kept: int = 2, short: int = 40, in_task: int = 20_000, in_task_words: int = 4_000_000, at_once: int = 16):
        self.docs, self.id_col, self.text_col, self.similarity = docs, id_col, text_col, similarity
        self.folder = new_dir(docs.sparkSession, "near_dup")
        self.in_task, self.in_task_words, self.at_once = in_task, in_task_words, at_once
        kind = docs.schema[id_col].dataType.simpleString()
        own = docs.select(F.col(id_col).alias("id"), self._key().alias("k"), F.col(text_col).cast("string").alias("t"))
        sketched = own.mapInArrow(trimmed(_sketcher(words, sketches, kept, short)), f"id {kind}, k {KEY}, fp binary, n int, keys array<long>")
        self.rows = materialize(sketched, "rows")
        self.nodes = self._keep(self.rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("rep"), F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
        self._join()
        self.classes = self._classes()
        remove(docs.sparkSession, self.folder)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self.folder)

    def _components(self, links: DataFrame) -> DataFrame:
        return components(links, self.folder)

    def _key(self):
        """128 bits of a row's id and text."""
        own = F.col(self.id_col), F.col(self.text_col)
        return F.struct(F.xxhash64(*own).alias("x"), F.xxhash64(F.lit("y"), *own).alias("y"))

    def _ratio(self, x: str, y: str):
        return F.least(x, y) >= self.similarity * F.greatest(x, y) - 1e-9

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, la, lb), the labels (as a, b) of those that are similar."""
        one = self.words.select(F.col("fp").alias("a"), F.col("words").alias("wa"))
        two = self.words.select(F.col("fp").alias("b"), F.col("words").alias("wb"))
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("la", "lb", "wa", "wb")
        return both.mapInArrow(trimmed(_checker(self.similarity)), "a binary, b binary")

    def _join(self) -> None:
        """Fills self.roots: steps (node, root) that lead each node, one after another, to its class."""
        buckets = self.nodes.select("fp", "n", F.explode("keys").alias("key"))
        lead = buckets.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", F.col("lead.fp").alias("lfp"), F.col("lead.n").alias("ln"))
        star = self._keep(buckets.join(lead, "key").select("key", "fp", "n", "lfp", "ln"), "star")
        wanted = star.select("fp").distinct().join(self.nodes.select("fp", F.col("rep.k").alias("k")), "fp").select("fp", "k")
        texts = self.docs.select(self._key().alias("k"), F.col(self.text_col).cast("string").alias("t")).join(wanted.hint("merge"), "k")
        self.words = self._keep(texts.select("fp", "t").mapInArrow(_word_rows, "fp binary, words binary").dropDuplicates(["fp"]), "words")
        pairs = star.where((F.col("fp") != F.col("lfp")) & self._ratio("n", "ln")).select(F.col("fp").alias("a"), F.col("lfp").alias("b")).distinct()
        self.roots = [self._components(self._verified(pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})))]
        self._finish(star.select("key", F.col("fp").alias("node"), "n", F.col("fp").alias("label")))

    def _onward(self, rows: DataFrame, step: DataFrame) -> DataFrame:
        names = rows.columns
        return rows.join(step.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label")).select(*names)

    def _first(self, rows: DataFrame, n: int) -> DataFrame:
        """n rows of each key as lfp, ln and ll."""
        w = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"))
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("key", F.col("node").alias("lfp"), F.col("n").alias("ln"), F.col("label").alias("ll"))

    def _open(self, members: DataFrame) -> DataFrame:
        """The members of buckets that are in several components after the last step, and whether one task may hold them."""
        labelled = self._onward(members, self.roots[-1])
        state = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("w"))
        state = state.where("x <> y").select("key", ((F.col("c") <= self.in_task) & (F.col("w") <= self.in_task_words)).alias("small"))
        return self._keep(labelled.join(state, "key"), "open")

    def _shapes(self, large: DataFrame) -> DataFrame:
        """key, its largest component (top), and members and words inside and outside it."""
        size = large.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("w"))
        shape = size.groupBy("key").agg(F.max(F.struct("c", "label", "w")).alias("t"), F.sum("c").alias("c"), F.sum("w").alias("w"))
        return shape.select("key", F.col("t.label").alias("top"), F.col("t.c").alias("ci"), F.col("t.w").alias("wi"), (F.col("c") - F.col("t.c")).alias("co"), (F.col("w") - F.col("t.w")).alias("wo"))

    def _pieces(self, large: DataFrame) -> DataFrame:
        """key, node, label, piece, one, two: a row for each task (key, one, two) that a member of a large bucket is in.

        Pieces hold about half of what a task may. Those outside the largest component come first; each of them meets
        itself, each other and each piece inside."""
        half, words = max(1, self.in_task // 2), max(1, self.in_task_words // 2)
        n = lambda c, w: F.greatest(F.ceil(F.col(c) / half), F.ceil(F.col(w) / words), F.lit(1)).cast("int")
        dealt = large.join(self._shapes(large).select("key", "top", n("co", "wo").alias("outer"), n("ci", "wi").alias("inner")), "key")
        own, inside = F.xxhash64("node", F.lit("piece")), F.col("label") == F.col("top")
        dealt = dealt.withColumn("piece", F.when(inside, F.col("outer") + F.pmod(own, "inner")).otherwise(F.pmod(own, "outer")).cast("int"))
        met = F.sequence(F.lit(0), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
        return dealt.withColumn("met", F.explode(met)).select("key", "node", "label", "piece", F.least("piece", "met").alias("one"), F.greatest("piece", "met").alias("two"))

    def _finish(self, members: DataFrame) -> None:
        """members: key, node, n, label, of which the labels lag one step behind self.roots.

        In buckets too large for one task of which the largest component holds a quarter, the others are compared with
        a few of it first, which takes in most that belong there."""
        members = self._open(members)
        large = members.where("NOT small")
        if large.take(1):
            top = self._shapes(large).where(4 * F.col("ci") >= F.col("ci") + F.col("co")).select("key", "top")
            split = self._keep(large.join(top, "key").withColumn("inside", F.col("label") == F.col("top")).drop("top", "small"), "split")
            if split.take(1):
                few = self._keep(self._first(split.where("inside"), self.at_once), "few")
                pairs = split.where("NOT inside").join(few, "key").where(self._ratio("n", "ln"))
                pairs = pairs.select(F.col("node").alias("a"), F.col("lfp").alias("b"), F.col("label").alias("la"), F.col("ll").alias("lb")).distinct()
                self.roots.append(self._components(self._verified(pairs)))
                members = self._open(members.drop("small"))
        if members.take(1):
            own = self.nodes.select(F.col("fp").alias("node"), "keys").join(self.words.select(F.col("fp").alias("node"), "words").hint("merge"), "node")
            none = F.lit(0).alias("piece"), F.lit(0).alias("one"), F.lit(0).alias("two")
            dealt = members.where("small").select("key", "node", "label", *none).unionByName(self._pieces(members.where("NOT small")))
            wide = dealt.join(own.hint("merge"), "node")
            self.roots.append(self._components(wide.groupBy("key", "one", "two").applyInArrow(_finisher(self.similarity), "a binary, b binary")))

    def _classes(self) -> DataFrame:
        """fp, class_id, class_size and the key of the class's first row."""
        rooted = self.nodes.select("fp", "id", "rep", "copies", F.col("fp").alias("label"))
        for step in self.roots:
            rooted = self._onward(rooted, step)
        total = self._keep(rooted.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("rep").alias("first")), "total")
        return materialize(rooted.select("fp", "label").join(total, "label").select("fp", "class_id", "class_size", F.col("first.k").alias("first_k")), "classes")

    def members(self) -> DataFrame:
        """id, class_id, class_size and kept, a row for each document; a null text is a class of its own.

        The row with the least id is kept, one without id only if none has any; rows that are alike in id and text are
        marked alike."""
        known = self.rows.where("fp IS NOT NULL").select("id", "k", "fp").join(self.classes, "fp").select("id", "class_id", "class_size", (F.col("k") == F.col("first_k")).alias("kept"))
        alone = self.rows.where("fp IS NULL").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
        return known.unionByName(alone)

    def kept(self) -> DataFrame:
        """The documents' own columns, one row of each class: that with the least id."""
        names, k = self.docs.columns, "k_"
        while k in (c.lower() for c in names):
            k += "_"
        first = self.classes.select(F.col("first_k").alias(k)).distinct()
        rows = self.docs.where(F.col(self.text_col).isNotNull()).withColumn(k, self._key()).join(first.hint("merge"), k, "left_semi").dropDuplicates([k])
        return rows.select(*[F.col(f"`{c}`") for c in names]).unionByName(self.docs.where(F.col(self.text_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    found = NearDuplicates(table(spark, sf_dir, "documents")).members()
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
