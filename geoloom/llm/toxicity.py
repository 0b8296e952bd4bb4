"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words and word beginnings is fitted in numpy from confirmed toxic texts and from
unlabelled texts of the corpus. The risk of the negative class is estimated as that of the unlabelled texts less the
class prior's share of the positive ones; where the estimate turns negative, which is overfitting, the step goes the
other way. Which features count is settled by sums over the sample's texts on the cluster; the driver gets the columns
chosen, of a bounded number of texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, blocks, lean, spread, words

MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "¡¿«»“”‘’…–—"
#: Lengths in characters of the word beginnings that are features beside whole words.
BEGINNINGS = range(3, 9)


def features(word: bytes) -> list[int]:
    """Ids (CRC-32) of a word's features: itself and its beginnings, in lower case and without marks around it."""
    text = word.decode("utf-8", "replace").lower().strip(MARKS)
    if not text:
        return []
    return [zlib.crc32(b"=" + text.encode()), *(zlib.crc32(text[:n].encode()) for n in BEGINNINGS if n <= len(text))]


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of a text's distinct features)."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: pa.Array, cache: dict[bytes, list[int]]) -> np.ndarray:
        ends, index, distinct = words(texts)
        known = dict(zip(self.ids.tolist(), range(len(self.ids))))
        own = []
        for w in distinct.to_pylist():
            if (got := cache.get(w)) is None:
                got = [known[f] for f in features(w) if f in known]
                if len(w) <= 24 and len(cache) < 150_000:
                    cache[w] = got
            own.append(got)
        counts = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((f for x in own for f in x), np.int64, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        useful = counts[index] > 0 if len(index) else np.zeros(0, bool)
        index, text = index[useful], text[useful]
        pairs = np.unique(np.repeat(text, counts[index]) * len(self.ids) + flat[spread(starts[index], counts[index])])
        sums = np.bincount(pairs // max(1, len(self.ids)), self.weights[pairs % max(1, len(self.ids))], len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + sums, -30, 30)))


class Matrix:
    """Rows of feature columns that are all 1."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        kept = []
        for r in rows:
            at = np.searchsorted(columns, r)
            at[at == len(columns)] = 0
            kept.append(at[columns[at] == r] if len(columns) else at[:0])
        self.n, self.m = len(rows), len(columns)
        self.row = np.repeat(np.arange(self.n), [len(k) for k in kept])
        self.column = np.concatenate(kept) if kept else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.m)


#: Added to the counts of texts with a feature, and without it, before they are compared.
SMOOTH = 2.0


def least_count(positives: int) -> int:
    """Positive texts that must have a feature: 2 where they are few, 5 from 200 on."""
    return min(5, max(2, positives // 40))


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, columns: int = 1500, steps: int = 300,
    rate: float = 0.1, decay: float = 2e-5, least: int | None = None, keep: float = 0.3,
) -> Model:
    """Non-negative PU risk with the logistic loss, by Adam over all rows at each step.

    positive, unlabelled: distinct feature ids of each text. Features found in fewer than `least` positive texts are
    left out (None: least_count()); of the others, `columns` with the largest contrast between the two sets are kept. Each
    step sees a random share `keep` of the features, at 1 / keep times their weights, so that no text's score hangs on
    one of them and inflected forms count by their beginnings; the weights are the mean of those of the last third of the
    steps. Without positive or unlabelled texts, or without features, every score is the prior."""
    prior = float(min(max(prior, 1e-3), 0.999))
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    if not positive or not unlabelled:
        return nothing
    ids, in_p = np.unique(np.concatenate(positive), return_counts=True)
    least = least_count(len(positive)) if least is None else least
    ids, in_p = ids[in_p >= least], in_p[in_p >= least]
    if not len(ids):
        return nothing
    u_ids, u_counts = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(u_ids, ids), max(0, len(u_ids) - 1))
    in_u = np.where(u_ids[at] == ids, u_counts[at], 0) if len(u_ids) else np.zeros(len(ids))
    p, u = (in_p + SMOOTH) / (len(positive) + 2 * SMOOTH), (in_u + SMOOTH) / (len(unlabelled) + 2 * SMOOTH)
    contrast = p * np.abs(np.log(p / u))
    best = np.sort(np.argsort(-contrast, kind="stable")[:columns])
    ids = ids[best]
    x_p, x_u = Matrix(positive, ids), Matrix(unlabelled, ids)
    w, b = np.zeros(len(ids) + 1), float(np.log(prior / (1 - prior)))
    w[-1] = b
    mean, square = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rng, late, last = np.random.default_rng(3), np.zeros_like(w), max(1, steps // 3)
    for step in range(1, steps + 1):
        seen = (rng.random(len(ids)) < keep) / keep
        g_p, g_u = x_p.times(w[:-1] * seen) + w[-1], x_u.times(w[:-1] * seen) + w[-1]
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        d_p_plus, d_p_minus, d_u = -sigmoid(-g_p) / len(g_p), sigmoid(g_p) / len(g_p), sigmoid(g_u) / len(g_u)
        if negative >= 0:
            e_p, e_u = prior * (d_p_plus - d_p_minus), d_u
        else:  # the negative class's risk cannot be negative: undo the overfitting
            e_p, e_u = prior * d_p_minus, -d_u
        grad = np.append(x_p.transposed_times(e_p) + x_u.transposed_times(e_u), e_p.sum() + e_u.sum())
        grad[:-1] = grad[:-1] * seen + decay * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        if step > steps - last:
            late += w / last
    w = late
    return Model(ids, w[:-1].copy(), float(w[-1]), prior)


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 3 is 1; false without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, ids: DataFrame, most: int, scratch: Scratch, name: str) -> DataFrame:
    """(features) of `most` rows of docs (doc_id, text) whose doc_id is in ids: of those `most` ids, with the smallest
    hash, and of rows that repeat one that with the smallest text hash."""

    def run(batches):
        for batch in blocks(batches):
            ends, index, distinct = words(batch.column("text"))
            own = [features(w) for w in distinct.to_pylist()]
            for k in range(0, batch.num_rows, 500):
                some = list(zip(ends[:-1], ends[1:]))[k : k + 500]
                out = [sorted({f for i in set(index[a:b].tolist()) for f in own[i]}) for a, b in some]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["features"])

    # the ids are chosen before texts are joined to them: `most` of them
    wanted = scratch.write(ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), f"{name}-ids")
    rows = docs.join(F.broadcast(wanted), "doc_id").withColumn("h", F.xxhash64("text"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("h", "text")).alias("t")).select("t.text")
    return scratch.write(rows.repartition(16).mapInArrow(lean(run), "features array<long>"), name)


def _columns(positive: DataFrame, unlabelled: DataFrame, n_p: int, n_u: int, columns: int) -> np.ndarray:
    """The features that fit() would choose from all of these texts' features."""
    count = lambda df, c: df.select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias(c))
    both = count(positive, "p").where(F.col("p") >= least_count(n_p)).join(count(unlabelled, "u"), "f", "left").na.fill(0, ["u"])
    p, u = (F.col("p") + SMOOTH) / (n_p + 2 * SMOOTH), (F.col("u") + SMOOTH) / (n_u + 2 * SMOOTH)
    best = both.orderBy((p * F.abs(F.log(p / u))).desc(), "f").limit(columns).select("f")
    return np.sort(np.array([r.f for r in best.collect()], np.int64))


def _read(texts: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """The chosen features of each text."""
    known = set(chosen.tolist())

    def run(batches):
        for batch in batches:
            out = [[f for f in x if f in known] for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["features"])

    table = texts.mapInArrow(lean(run), "features array<long>").toArrow()["features"].combine_chunks()
    flat, ends = np.asarray(table.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(table)).astype(np.int64))))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def train(
    docs: DataFrame, labels: DataFrame, most_positive: int = 2000, most_unlabelled: int = 15000, prior: float | None = None,
    columns: int = 1500,
) -> Model:
    """The model learned from docs (doc_id, text, ...) and labels (doc_id, toxic, ...), of rows that are not held out.

    The fit takes a bounded sample, rows with the smallest hash of doc_id: most_positive of those labelled toxic = 1,
    and most_unlabelled of all docs, whether labelled or not. prior: the share of toxic texts; if None, that among the
    labelled rows that are not held out, the only use of labels other than 1. Rows with a null doc_id, label or text
    teach nothing; a doc_id that is labelled twice is toxic if one of its labels says so; of rows of docs that repeat a
    doc_id one is taken. Other columns are ignored. Without a toxic text, or from empty tables, every score is the prior."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    mine = mine.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    mine = scratch.write(mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    if prior is None:
        prior = mine.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    own = own.where(~held_out(F.col("doc_id")))
    toxic = mine.where("toxic = 1").join(own.select("doc_id"), "doc_id", "left_semi")
    positive = sampled(own, toxic, most_positive, scratch, "positive")
    unlabelled = sampled(own, own, most_unlabelled, scratch, "unlabelled")
    n_p, n_u = positive.count(), unlabelled.count()
    chosen = _columns(positive, unlabelled, n_p, n_u, columns) if n_p and n_u else np.zeros(0, np.int64)
    if not len(chosen):
        return fit([], [], prior)
    return fit(_read(positive, chosen), _read(unlabelled, chosen), prior, columns, least=1)


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a score (double, 0 to 1) of every whole text. A null or empty text gets the bias's score. Other columns
    pass through unchanged; a column of docs named as `to` is replaced. An empty table gives an empty one."""
    docs = docs.drop(to)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        cache: dict[bytes, list[int]] = {}
        for batch in blocks(batches, text_col):
            found = model.score(batch.column(at), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, to])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))
