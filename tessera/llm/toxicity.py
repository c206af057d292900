"""Toxicity by multiple-instance learning.

A sentence's probability is a logistic function of its words; a document's is their noisy-or, one minus the product of
the sentences' complements. Only document labels are needed: the gradient of the document's likelihood tells each
sentence how much it answers for. The fitted sentence model then also locates the offending sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.shared import row_key, written

#: The classifier is fitted on this many labelled documents at most, those whose hashes come first, in so many parts. Scores cover all documents.
SAMPLE, PARTS = 20_000, 6
#: Features are hashed to BITS; those are fitted whose shares in toxic and other documents are APART standard errors apart.
BITS, APART, EPOCHS, RELAXED, RATE, PENALTY, FOLDS = 22, 3, 30, 20, 0.5, 8e-4, 5
#: A word counts as itself and by its beginnings of so many bytes, so that inflected forms share what is learnt.
PREFIXES = (4, 5, 6)
MEMBER = np.zeros(256, bool)
MEMBER[ord("0") : ord("9") + 1] = MEMBER[ord("a") : ord("z") + 1] = MEMBER[128:] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features of words; each sentence's first feature (and the end), start and end in bytes; each text's first sentence (and the end). Sentences without words are none."""
    low = kernels.LOWER[data]
    starts, ends, first = kernels.runs(MEMBER[low], off)
    forms = [ends, *(np.minimum(starts + k, ends) for k in PREFIXES)]
    feature = np.stack([(kernels.span_hash(low, starts, stop, seed) >> np.uint64(64 - BITS)).astype(np.int64) for seed, stop in enumerate(forms)], 1).ravel()
    number = np.cumsum(_STOPS[data])[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = np.diff(number) > 0
    new[first[:-1][np.diff(first) > 0]] = True
    begin = np.append(np.flatnonzero(new), len(starts))
    return feature, begin * len(forms), starts[begin[:-1]], ends[begin[1:] - 1], np.searchsorted(begin[:-1], first)


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**BITS
    bias: float

    def sentence_scores(self, feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The log-odds of each sentence; a feature counts once in a sentence."""
        told = np.flatnonzero(self.weights[feature])
        owner = np.searchsorted(begin, told, "right") - 1
        once = np.unique(owner * (1 << BITS) + feature[told])
        return self.bias + np.bincount(once >> BITS, self.weights[once & ((1 << BITS) - 1)], len(begin) - 1)


def slope(w: np.ndarray, b: float, x: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(by weight, by bias, loss): the noisy-or likelihood's negative logarithm summed over documents, and its gradient. x: features present in sentences; doc: each sentence's document; y: labels."""
    z = np.clip(b + np.bincount(sentence, w[x], len(doc)), -50, 50)
    log_q = -np.bincount(doc, np.logaddexp(0, z), len(y))
    some = np.maximum(-np.expm1(log_q), 1e-12)
    g = np.where(y == 0, 1.0, -np.exp(log_q) / some)[doc] / (1 + np.exp(-z))
    return np.bincount(x, g[sentence], len(w)), float(g.sum()), float(-np.where(y == 0, log_q, np.log(some)).sum())


def fit(gradient: Callable[[np.ndarray, float, np.ndarray], tuple[np.ndarray, float, float]], n_docs: int, n_features: int) -> tuple[np.ndarray, float]:
    """(weights, bias): full-batch Adam with a penalty on absolute weights. gradient(w, b, live) sums slope() over all documents, for the live features."""
    w, b, live = np.zeros(n_features), -5.0, np.ones(n_features, bool)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, EPOCHS + RELAXED + 1):
        penalty = PENALTY if t <= EPOCHS else PENALTY / 40  # then what was selected is fitted almost freely
        by_weight, by_bias, _ = gradient(w, b, live)
        raw = by_weight / n_docs
        # the penalty is on absolute weights: one at zero stays there unless its gradient is larger
        raw = np.where(live, np.where(w != 0, raw + penalty * np.sign(w), np.sign(raw) * np.maximum(np.abs(raw) - penalty, 0)), 0)
        grad = np.append(raw, by_bias / n_docs)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        new = w - np.where(live, step[:-1], 0)
        w, b = np.where(w * new < 0, 0.0, new), b - step[-1]
        if t % 10 == 0:  # features far from mattering leave
            live &= (w != 0) | (np.abs(raw) > 0) & (t < EPOCHS)
    return w, float(b)


def screened(rows: DataFrame, n: int, n1: int) -> np.ndarray:
    """The features whose share of toxic documents is APART standard errors or more from that of others, of those in enough documents to outweigh the penalty, from all rows given (y_, text): n, of which n1 are toxic. Counts are summed by batch, then by feature."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for lo, hi, data, off in kernels.text_blocks(batch.column(1), 1 << 19):
                feature, begin, _, _, first = sentences(data, off)
                owner = np.repeat(np.arange(hi - lo), np.diff(begin[first]))
                once = np.unique((owner << BITS) + feature)
                name, at = np.unique(once & ((1 << BITS) - 1), return_inverse=True)
                toxic = np.bincount(at, y[lo + (once >> BITS)], len(name))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.bincount(at, minlength=len(name))), pa.array(toxic.astype(np.int64))], names=["feature", "n", "n1"])

    counts = rows.select("y_", "text").mapInArrow(counted, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") > PENALTY * n)
    p1, p0, p = F.col("n1") / n1, (F.col("n") - F.col("n1")) / (n - n1), F.col("n") / n
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    return np.sort(counts.where(z >= APART).select("feature").toArrow().column("feature").to_numpy())


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """y_, text of at most `sample` labelled documents outside the held-out fold, those whose hashes come first; repeats of id and text are one document. A written table of PARTS parts."""
    known = labels.select(F.col(doc_id).alias("id_"), F.col(label).cast("int").alias("y_")).where(F.col("id_").isNotNull() & F.col("y_").isNotNull() & ~held_out(F.col("id_")))
    known = known.groupBy("id_").agg(F.max("y_").alias("y_")).orderBy(F.xxhash64("id_"), "id_").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h_")).join(F.broadcast(known), "id_")
    picked = rows.select("id_", "h_").distinct().orderBy(F.xxhash64("id_", "h_"), "id_", "h_").limit(sample)
    once = rows.join(F.broadcast(picked), ["id_", "h_"]).groupBy("id_", "h_").agg(F.max("y_").alias("y_"), F.max("text").alias("text"))
    return written(once.select("y_", "text").repartition(PARTS), "labelled")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents outside the held-out fold, each whole. Conflicting labels of an id: toxic wins; null labels are none. No labels: every score is near zero.

    The gradient is summed over the parts of the sample's table: texts and sentences stay on the executors, and a pass
    brings the driver PARTS vectors of the live features, in the order of the parts.
    """
    rows = labelled(docs, labels, doc_id, text, label, sample)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y_") > 0).cast("int")), F.lit(0)).alias("n1")).first()
    rows = rows.withColumn("y_", (F.col("y_") > 0).cast("int"))
    names = screened(rows, total.n, total.n1) if 0 < total.n1 < total.n else np.zeros(0, np.int64)
    if not len(names):
        return Model(np.zeros(1 << BITS, np.float32), -10.0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.full(1 << BITS, -1, np.int32)
        to[names] = np.arange(len(names))
        for batch in batches:
            for lo, hi, data, off in kernels.text_blocks(batch.column(1), 1 << 19):
                feature, begin, _, _, first = sentences(data, off)
                own = to[feature]
                told = np.flatnonzero(own >= 0)
                once = np.unique((np.searchsorted(begin, told, "right") - 1 << BITS) + own[told])
                sentence = once >> BITS
                edges = np.searchsorted(sentence, first)
                local = sentence - np.repeat(first[:-1], np.diff(edges))
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, pa.int32())) for v in (local, once & ((1 << BITS) - 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int32()), *lists], names=["y_", "n", "sentence", "feature"])

    bags = written(rows.select("y_", "text").mapInArrow(featured, "y_ int, n int, sentence array<int>, feature array<int>"), "bags")

    def gradient(w: np.ndarray, b: float, live: np.ndarray) -> tuple[np.ndarray, float, float]:
        at, asked, n = np.flatnonzero(w).astype(np.int32), np.packbits(live), len(w)
        values = w[at]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = np.zeros(n), [np.zeros(n), 0.0, 0.0]
            own[at] = values
            for batch in batches:
                y, size = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
                doc = np.repeat(np.arange(len(y)), size)
                lists = batch.column(2)
                sentence = lists.flatten().to_numpy() + np.repeat(np.cumsum(size) - size, lists.value_lengths().to_numpy())
                sums = [s + v for s, v in zip(sums, slope(own, b, batch.column(3).flatten().to_numpy(), sentence, doc, y), strict=True)]
            told = np.flatnonzero(np.unpackbits(asked, count=n) & (sums[0] != 0)).astype(np.int32)
            kind = pa.list_(pa.int32()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([told], kind[0]), pa.array([sums[0][told]], kind[1]), pa.array([sums[1]]), pa.array([sums[2]])], names=["part", "at", "by_weight", "by_bias", "loss"])

        found = sorted(bags.mapInArrow(run, "part int, at array<int>, by_weight array<double>, by_bias double, loss double").toArrow().to_batches(), key=lambda r: r.column(0)[0].as_py())
        by_weight, by_bias, loss = np.zeros(n), 0.0, 0.0
        for batch in found:
            for i in range(batch.num_rows):
                by_weight[batch.column(1)[i].values.to_numpy()] += batch.column(2)[i].values.to_numpy()
            by_bias, loss = by_bias + sum(batch.column(3).to_pylist()), loss + sum(batch.column(4).to_pylist())
        return by_weight, by_bias, loss

    w, b = fit(gradient, total.n, len(names))
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    return Model(weights, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, held_out, score, predicted, offending (start, end, p of sentences over one half, in code points). One pass, no shuffle.

    Null, empty and wordless texts have no sentences, score 0.0. Rows that repeat come back as often; other columns are ignored.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    spans = F.array().cast("array<struct<start:bigint,end:bigint,p:double>>")
    schema = src.select("doc_id", "key", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), spans.alias("offending")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, hi, data, off in kernels.text_blocks(batch.column(3), 1 << 19):
                feature, begin, start, end, first = sentences(data, off)
                z = own.sentence_scores(feature, begin)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                scores[lo:hi] = -np.expm1(-np.bincount(owner, np.logaddexp(0, z), hi - lo))
                for k in np.flatnonzero(z >= 0):
                    i = owner[k]
                    a, b, c = off[i], start[k], end[k]
                    heads = (data[a:c] & 0xC0) != 0x80
                    found[lo + i].append({"start": int(heads[: b - a].sum()), "end": int(heads.sum()), "p": float(1 / (1 + np.exp(-z[k])))})
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(found, kind)], names=schema.names)

    return src.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, in one pass: a document stays where it is read."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, data, off in kernels.text_blocks(batch.column(at), 1 << 19):
                feature, begin, _, _, first = sentences(data, off)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                keep[lo:hi] = -np.expm1(-np.bincount(owner, np.logaddexp(0, own.sentence_scores(feature, begin)), hi - lo)) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
