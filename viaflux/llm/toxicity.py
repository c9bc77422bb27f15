"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text and their beginnings is trained in numpy on confirmed
toxic texts and on unlabelled ones. The risk of the unlabelled part is
corrected by the class prior and kept from becoming negative, so unlabelled
toxic texts don't teach that they are clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

#: Bounds of the training sample, drawn by a hash of doc_id.
MAX_POSITIVE = 2000
MAX_UNLABELLED = 4000
#: Bytes of the beginnings of words that are features beside the words.
PREFIXES = (4, 6)
#: Texts of the sample that a word has to occur in.
MIN_TEXTS = 4
#: Words are features if their shares in the two parts of the sample differ by so many standard errors.
MIN_Z = 4.0
ROUNDS = 150
RATE = 0.15
DECAY = 2e-4
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out. A null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def slice_features(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and of their beginnings, and the row of each."""
    data, offsets = tk.buffer_of(column)
    data = tk.LOWER[data]
    starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
    row = tk.rows_of(first, len(starts))
    hashes, rows = [tk.ranges_hash(data, starts, ends)], [row]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts >= size)
        # a beginning is another feature than a word of the same bytes
        hashes.append(tk.ranges_hash(data, starts[long], starts[long] + size) ^ np.uint64(size))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    bias: float

    def scores(self, hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts; a feature counts with log(1 + its number)."""
        out = np.full(n, self.bias)
        if len(hashes) and len(self.words):
            place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = np.flatnonzero(self.words[place] == hashes)
            pairs, counts = np.unique(row[known] * np.int64(len(self.words)) + place[known], return_counts=True)
            out += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)] * np.log1p(counts), n)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def risk(score: np.ndarray, w_p: np.ndarray, w_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part prior * R_p(+), the corrected negative part R_u(-) - prior * R_p(-), and their gradients by score.

    w_p and w_u weigh rows of the positive and the unlabelled part; each sums to 1.
    """
    s = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    loss_neg = np.logaddexp(0, score)
    positive = prior * (w_p * np.logaddexp(0, -score)).sum()
    return positive, (w_u * loss_neg).sum() - prior * (w_p * loss_neg).sum(), prior * w_p * (s - 1), (w_u - prior * w_p) * s


def _only(kept: np.ndarray, column: np.ndarray, row: np.ndarray, value: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The triples of the kept features, renumbered, and those features."""
    inside = kept[column]
    return (np.cumsum(kept) - 1).astype(np.int32)[column[inside]], row[inside], value[inside], words[kept]


def train(flat: np.ndarray, counts: np.ndarray, row: np.ndarray, positive: np.ndarray, prior: float, *, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY, min_z: float = MIN_Z) -> Model:
    """Fit on (feature hash, count, row) triples; `positive` marks confirmed rows, the others are unlabelled.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the
    logistic loss, minimised by Adam over the whole sample; where the second
    part is negative, its gradient is followed upwards instead.
    """
    p = positive.astype(bool)
    n = len(p)
    if not p.any() or p.all() or not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 5.0 if n and p.all() else -5.0)
    # features of few texts go first: they are most of the triples
    words, column, texts = np.unique(flat, return_inverse=True, return_counts=True)
    kept = texts >= MIN_TEXTS
    column, row, value, words = _only(kept, column.astype(np.int32), row.astype(np.int32), counts, words)
    value = np.log1p(value)
    of_p = p[row]
    mean_p = np.bincount(column[of_p], value[of_p], len(words)) / p.sum()
    mean_u = np.bincount(column[~of_p], value[~of_p], len(words)) / (~p).sum()
    mean, square = np.bincount(column, value, len(words)) / n, np.bincount(column, value * value, len(words)) / n
    z = (mean_p - mean_u) / np.sqrt(np.maximum(square - mean * mean, 1e-12) * (1 / p.sum() + 1 / (~p).sum()))
    column, row, value, words = _only(np.abs(z) >= min_z, column, row, value, words)
    width = len(words)
    w_p, w_u = np.where(p, 1 / p.sum(), 0), np.where(p, 0, 1 / (~p).sum())
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(row, value * theta[column], n) + theta[-1]
        _, negative, g_pos, g_neg = risk(score, w_p, w_u, prior)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        grad = np.append(np.bincount(column, value * g[row], width), g.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Train on rows outside fold 0.

    Positives are rows labelled 1; unlabelled texts are drawn from all rows,
    whatever their label. Both are the first rows by a hash of doc_id and text,
    then by doc_id, so the sample doesn't depend on how rows are stored, and
    neither repeated nor null doc_ids make it larger. The class prior is the
    share of 1 among all labelled ids outside fold 0. A doc_id labelled both
    ways counts as toxic. Without positives, or without others, every text gets
    the same score.
    """
    i, t = F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")
    rows = docs.select(i, t).filter(fold(F.col("i")) != 0)
    marks = labels.select(i, F.col(f"`{label}`").cast("int").alias("toxic")).filter((fold(F.col("i")) != 0) & F.col("toxic").isNotNull()).groupBy("i").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg("toxic").alias("p"), F.sum("toxic").alias("n")).first()
    prior = float(share["p"] or 0.0)
    total = rows.count()
    # ids in the order of their hash: max_positive at most are broadcast
    positive_ids = marks.filter("toxic = 1").select("i").orderBy(F.xxhash64(F.lit("sample"), "i"), "i").limit(max_positive)
    draw = F.xxhash64(F.lit("unlabelled"), "i", "t")
    # a threshold of the hash passes somewhat more than max_unlabelled rows of any table, of which the first are taken
    threshold = min(1.0, 1.2 * max_unlabelled / max(1, total))
    passed = F.pmod(draw, F.lit(1 << 30)) < int(threshold * (1 << 30))
    first = lambda part, n: part.select(draw.alias("h"), "i", "t").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "i").limit(n)

    def run(batches):
        for batch in tk.slices(batches, "t"):
            hashes, row = slice_features(batch.column(2))
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            head = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
            counts = np.diff(np.append(head, len(row))).astype(np.int32)
            offsets = pa.array(np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes[head].view(np.int64), counts)]
            yield pa.RecordBatch.from_arrays(lists, names=["words", "counts"])

    shaped = lambda part, n: first(part, n).mapInArrow(run, "words array<long>, counts array<int>").toArrow()
    # a positive that the draw also took stands in both parts
    flat, counts, row, positive = [], [], [], []
    for part, n, mark in ((rows.join(F.broadcast(positive_ids), "i"), max_positive, True), (rows.filter(passed), max_unlabelled, False)):
        table = shaped(part, n)
        if not table.num_rows:
            continue
        lists = table.column("words")
        row.append(np.repeat(np.arange(table.num_rows, dtype=np.int32) + sum(map(len, positive)), pc.list_value_length(lists).to_numpy()))
        flat += [c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in lists.chunks]
        counts += [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("counts").chunks]
        positive.append(np.full(table.num_rows, mark))
        del table, lists
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    parts = [join(x, kind) for x, kind in ((flat, np.uint64), (counts, np.int32), (row, np.int32), (positive, bool))]
    del flat[:], counts[:], row[:]
    return train(*parts, prior)


def scored(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """`docs` with the probability of being toxic of every whole text.

    Null and empty texts get the bias alone. Repeated rows are scored alike. An
    empty table gives an empty one. An input column of the added name is
    replaced; others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    base = docs.drop(column)

    def run(batches):
        model = Model(**shared.value)
        for batch in tk.slices(batches, text):
            hashes, row = slice_features(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(hashes, row, batch.num_rows))], names=[*batch.schema.names, column])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(column, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **names) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, in the input's columns, whatever their names.

    Null and empty texts are judged by the bias alone. Repeated rows stay or go
    together. An empty table gives an empty one; without labels all rows stay.
    """
    (score,) = tk.fresh(docs.columns, "score")
    model = fit(docs, labels, **names)
    return scored(docs, model, text=names.get("text", "text"), column=score).filter(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
