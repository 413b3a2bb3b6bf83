"""Toxicity scores of whole texts by a convolutional text classifier, with thresholds calibrated by language.

The classifier (text_cnn.py) learns from labelled texts: at most `most_toxic` and `most_clean` rows, chosen by a hash of
their id. Copies together weigh as one. One labelled row in four is left to calibration, which picks the epoch and, for each language the threshold that serves F1 best there.
The language is guessed from the text's own function words; a text's lang column, source, id and labels are no inputs.
A score is the probability, bent so that its language's threshold lies at `cut` (0.7): a text is toxic from there on.

Cases: null and empty texts, and texts without words, are scored from no words (the base rate); texts are scored whole,
however long; null ids are scored and never learned from; repeated rows score alike; without labels, or with one class
only, every score is the base rate, below the cut; an empty table gives no rows; other columns are kept as asked."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.text_cnn import TextCnn
from veilspark.llm.shared import trimmed
from veilspark.llm.wordcodes import shingles, word_slices, words_of

# Frequent function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be at by this have from or an not but they which you".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "le la les et des en un une du est que pour dans qui par sur pas plus au avec se ce il sont ne cette aux".split(),
    "es": "el los las y del que un una por con para es al lo como más su pero sus le ya este sí porque esta entre cuando".split(),
}


@dataclass
class Toxicity:
    cut: float = 0.7
    network: TextCnn = field(default_factory=TextCnn)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.9
    fitted: bool = False
    base: float = 0.05

    def __post_init__(self):
        self.languages = [*FUNCTION_WORDS, ""]
        code = {}
        for i, names in enumerate(FUNCTION_WORDS.values()):
            for c in words_of(pa.array(names, pa.string())).codes.tolist():
                code.setdefault(c, set()).add(i)
        self.marks = np.array(sorted(code), np.uint64)
        self.votes = np.zeros((len(self.marks) + 1, len(FUNCTION_WORDS)), np.float32)
        for j, c in enumerate(self.marks.tolist()):
            for i in code[c]:
                self.votes[j, i] = 1 / len(code[c])

    def language(self, codes: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """Index into languages of each text; the last where no word tells."""
        j = np.minimum(np.searchsorted(self.marks, codes), len(self.marks) - 1)
        known = np.flatnonzero(self.marks[j] == codes)
        row = np.searchsorted(splits, known, side="right") - 1
        total = np.stack([np.bincount(row, self.votes[j[known], i], len(splits) - 1) for i in range(self.votes.shape[1])], axis=1)
        return np.where(total.max(axis=1) > 0, total.argmax(axis=1), len(self.languages) - 1)

    def fit(self, texts: list[str | None], labels: list[int], calibrate: list[bool]) -> Toxicity:
        docs, langs = [], []
        for _, _, w in word_slices(pa.array([t or "" for t in texts], pa.string())):
            docs += [w.codes[a:b] for a, b in zip(w.splits[:-1], w.splits[1:], strict=True)]
            langs += self.language(w.codes, w.splits).tolist()
        return self.fit_codes(docs, langs, labels, calibrate)

    def fit_codes(self, docs: list[np.ndarray], langs: list[int], labels: list[int], calibrate: list[bool]) -> Toxicity:
        """docs: the word codes of each text."""
        y, held = np.array(labels, int), np.array(calibrate, bool)
        if len(set(y.tolist())) < 2:
            return self
        learn, held = np.flatnonzero(~held), np.flatnonzero(held)
        self.base = float(y.mean())
        weights = copy_weights(docs)
        chances = lambda net: np.concatenate([net.predict(docs[i], np.array([0, len(docs[i])])) for i in held])

        def loss(net) -> float:
            p = np.clip(chances(net), 0.02, 0.98)
            return float(-(weights[held] * np.where(y[held] == 1, np.log(p), np.log(1 - p))).sum())

        self.network.fit([docs[i] for i in learn], y[learn], weights=weights[learn], check=loss if len(held) else None)
        self.fitted = True
        lang = np.array(langs, int)
        if len(held):
            p = chances(self.network)
            self.threshold = best_threshold(p, y[held])
            for i, name in enumerate(self.languages):
                own = lang[held] == i
                if y[held][own].sum() >= 10:
                    self.thresholds[name] = best_threshold(p[own], y[held][own])
        return self

    def score(self, codes: np.ndarray, splits: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(splits) - 1, min(self.base, self.cut * 0.99))
        p = self.network.predict(codes, splits)
        t = np.array([self.thresholds.get(n, self.threshold) for n in self.languages])[self.language(codes, splits)]
        return np.clip(np.where(p < t, self.cut * p / t, self.cut + (1 - self.cut) * (p - t) / (1 - t)), 0.0, 1.0)


def copy_weights(docs: list[np.ndarray]) -> np.ndarray:
    """1 over the number of texts that share the least 5-word code: copies together weigh as one text."""
    least = np.array([shingles(d, 5).min() if len(d) else 0 for d in docs], np.uint64)
    _, back, count = np.unique(least, return_inverse=True, return_counts=True)
    return 1 / count[back]


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.3, most: float = 0.9) -> float:
    """The middle of the widest gap between neighbouring probabilities among the cuts with the best F1."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    after = np.append(p[1:], 0.0)
    gap = np.where((f1 >= f1.max() - 0.01) & (p > after), np.minimum(p, most) - np.maximum(after, least), -1)
    i = int(gap.argmax())
    return float(np.clip((min(p[i], most) + max(after[i], least)) / 2, least, most))


def held_out(id_col: str) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 3000, most_clean: int = 5000, most_words: int = 4_000_000) -> Toxicity:
    """Learns from a bounded sample of the labelled rows that are not held out: at most so many toxic and clean ids, and
    of their texts, taken in the order of a hash of the id, as many as have `most_words` words in all.

    Texts become word codes on the executors; the driver gets these, 8 bytes a word."""
    allowed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    allowed = allowed.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    part = lambda y, n: allowed.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = part(1, most_toxic).unionByName(part(0, most_clean))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id")
    rows = rows.select("y", (F.crc32(F.concat(F.lit("c"), F.col("id").cast("string")).cast("binary")) % 4 == 0).alias("c"), F.xxhash64("id").alias("h"), "t")
    model = Toxicity()

    def coded(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(3)):
                codes = [w.codes[x:y].tobytes() for x, y in zip(w.splits[:-1], w.splits[1:], strict=True)]
                own = [c.slice(a, b - a) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(w.splits)), pa.array(model.language(w.codes, w.splits)), pa.array(codes, pa.binary())], ["y", "c", "h", "n", "lang", "codes"])

    found = rows.mapInArrow(trimmed(coded), "y int, c boolean, h long, n long, lang long, codes binary")
    found = found.orderBy("h", "codes").limit(2 * (most_toxic + most_clean))  # an id can have several rows
    upto = F.sum("n").over(Window.orderBy("h", "codes").rowsBetween(Window.unboundedPreceding, 0))
    got = found.withColumn("upto", upto).where(F.col("upto") <= most_words).orderBy("h", "codes").select("y", "c", "lang", "codes").toArrow()
    texts = [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("codes")]
    return model.fit_codes(texts, got.column("lang").to_pylist(), got.column("y").to_pylist(), got.column("c").to_pylist())


def score_texts(docs: DataFrame, model: Toxicity, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns (as k0, k1, ...) and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            scores = [shipped.value.score(w.codes, w.splits) for _, _, w in word_slices(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[:-1], "score"])

    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("t")).mapInArrow(trimmed(run), kinds + "score double")


def reject_toxic(docs: DataFrame, model: Toxicity, *, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the cut, with their own columns."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = [shipped.value.score(w.codes, w.splits) for _, _, w in word_slices(batch.column(at))]
            yield batch.filter(pa.array((np.concatenate(scores) if scores else np.zeros(0)) < model_cut))

    model_cut = model.cut
    return docs.mapInArrow(trimmed(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model).withColumnRenamed("k0", "doc_id")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= model.cut).cast("int").alias("predicted"))
