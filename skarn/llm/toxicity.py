"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is logistic in hashed weights of its words and word beginnings; a document's is the
noisy-or of its sentences, 1 - prod(1 - p). Weights are trained from document labels alone, through the
same noisy-or over all sentences, so that blame falls on the sentences that tell toxic documents from
clean ones; these can then be located.

The classifier is fitted on a bounded sample: at most SAMPLE_DOCS labelled rows, those of the smallest
hash of doc_id, and of these the texts of at most SAMPLE_TEXT characters. Scoring reads every whole text.

Null and empty texts have no sentence and score 0. Rows without a label, or with a null label or id,
teach nothing but are scored. Of repeated labels of one id, toxic (1) holds. Repeated document rows each
teach and are each scored; equal texts have equal scores. An empty table, or one with labels of one kind
only, gives a model that marks nothing. Only doc_id and text are read from documents, and doc_id and
toxic from labels, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, crc_bucket, prefix_hash, range_hash, text_blocks, with_fields, word_ranges, written

SAMPLE_DOCS, SAMPLE_TEXT = 8000, 20_000
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
STEMS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are features beside the word
STEPS, RATE, SHRINK = 200, 0.05, 5e-5
SIGMAS, START_BIAS = 2.5, -6.0  # features whose log-odds are within so many deviations of 0 stay out

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line end ! . ?


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (words and their stems), first feature of each sentence, row of each sentence, byte ranges of sentences in data."""
    low = LOWER[data]
    starts, ends, per_row = word_ranges(low, offs, _GAP)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    prefix = prefix_hash(low)
    features = np.empty((len(starts), 1 + len(STEMS)), np.int32)
    features[:, 0] = range_hash(prefix, starts, ends) >> U64(64 - BUCKET_BITS)
    for k, n in enumerate(STEMS, 1):  # a word shorter than the stem repeats its whole form, under another name
        features[:, k] = range_hash(prefix, starts, np.minimum(starts + n, ends)) * U64(2 * n + 1) >> U64(64 - BUCKET_BITS)
    row = np.repeat(np.arange(len(per_row)), per_row)
    number = np.searchsorted(np.flatnonzero(_STOP[low]), starts) + row
    first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return features.ravel(), first * features.shape[1], row[first], np.stack([starts[first], ends[last]], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def evidence(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """-log(1 - p) of each sentence; a document's is the sum of its sentences'."""
        return np.logaddexp(0, np.add.reduceat(self.weights[buckets], first) + self.bias) if len(first) else np.zeros(0)


def silent() -> Model:
    return Model(np.zeros(BUCKETS), -40.0)


def train(column: np.ndarray, sentence: np.ndarray, doc: np.ndarray, labels: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the noisy-or likelihood, with shrinkage.

    column and sentence name the feature and the sentence of each occurrence, doc the document of
    each sentence, start the weights to begin with.
    """
    n_docs, first = len(labels), doc
    names, weights, bias = start, start.copy(), START_BIAS
    state = [np.zeros(len(names) + 1), np.zeros(len(names) + 1)]
    for t in range(1, STEPS + 1):
        z = np.bincount(sentence, weights[column], len(first)) + bias
        total = np.bincount(doc, np.logaddexp(0, z), n_docs)
        pull = np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)
        slope = pull[doc] / (1 + np.exp(-np.maximum(z, -500))) / n_docs
        grad = np.append(np.bincount(column, slope[sentence], len(names)) + SHRINK * weights, slope.sum())
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = RATE * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        weights -= step[:-1]
        bias -= step[-1]
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Learns from labelled rows outside fold 0 of crc32(doc_id)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_bucket(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS), "sample")  # bounded: ids and labels of SAMPLE_DOCS rows
    texts = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_TEXT).join(F.broadcast(sample), "doc_id").select("text", "label")

    def count(batches):
        for rows, data, offs in text_blocks(batches):
            buckets, first, row, _ = sentences(data, offs)
            of_doc = np.repeat(row, np.diff(np.concatenate([first, [len(buckets)]])))
            seen = np.unique(of_doc * BUCKETS + buckets)
            found, n = np.unique(seen % BUCKETS * 2 + rows.column("label").to_numpy()[seen // BUCKETS], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // 2), pa.array(np.where(found % 2, n, 0)), pa.array(np.where(found % 2, 0, n))], ["bucket", "a", "c"])

    totals = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if totals.keys() != {0, 1}:
        return silent()
    a, c = F.col("a") + 0.5, F.col("c") + 0.5
    odds = F.log(a / (totals[1] + 1)) - F.log(c / (totals[0] + 1))
    telling = texts.mapInArrow(count, "bucket long, a long, c long").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    telling = telling.select("bucket", ((F.abs(odds) - SIGMAS * F.sqrt(1 / a + 1 / c)) * F.signum(odds)).alias("start"), odds.alias("odds")).filter(F.col("start") * F.col("odds") > 0)
    chosen = {r.bucket: r.start for r in telling.select("bucket", "start").collect()}  # at most BUCKETS
    names = np.array(sorted(chosen), np.int64)
    start = np.array([chosen[b] for b in names.tolist()])
    if not len(names):
        return silent()
    place = np.full(BUCKETS, -1, np.int32)
    place[names] = np.arange(len(names))

    def features(batches):
        for rows, data, offs in text_blocks(batches):
            buckets, first, row, _ = sentences(data, offs)
            of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(buckets)]])))
            column = place[buckets]
            kept = column >= 0
            column, sentence = column[kept], of[kept]
            heads = np.searchsorted(row, np.arange(len(rows) + 1))
            cuts = np.searchsorted(sentence, heads)
            rel = (sentence - np.repeat(heads[:-1], np.diff(cuts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("label"),
                    pa.array(np.diff(heads)),
                    pa.array([column[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([rel[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                ["label", "sentences", "columns", "within"],
            )

    got = sorted(texts.mapInArrow(features, "label int, sentences long, columns binary, within binary").collect())  # SAMPLE_DOCS rows
    per_doc = np.array([r.sentences for r in got], np.int64)
    columns = [np.frombuffer(r["columns"], np.int32) for r in got]
    base = np.repeat((np.cumsum(per_doc) - per_doc).astype(np.int32), [len(x) for x in columns])
    sentence = base + np.concatenate([np.frombuffer(r.within, np.int32) for r in got])
    weights, bias = train(np.concatenate(columns), sentence, np.repeat(np.arange(len(got)), per_doc), np.array([r.label for r in got]), start)
    out = np.zeros(BUCKETS)
    out[names] = weights
    return Model(out, bias)


def score(model: Model, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", at_least: float = 0.5) -> DataFrame:
    """keep, score, predicted, offending of every row.

    offending lists sentences of p >= at_least: byte ranges in the text, and p.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input
    name = text if text in keep else "__text"
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches):
        model = shared.value
        for rows, data, offs in text_blocks(batches, name):
            buckets, first, row, ranges = sentences(data, offs)
            evidence = model.evidence(buckets, first)
            scores = -np.expm1(-np.bincount(row, evidence, len(rows)))
            p = -np.expm1(-evidence)
            found: list[list[dict]] = [[] for _ in range(len(rows))]
            for s in np.flatnonzero(p >= at_least):
                a, b = ranges[s] - offs[row[s]]
                found[row[s]].append({"start": int(a), "end": int(b), "p": float(p[s])})
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(found, pa.list_(place))], [*keep, "score", "predicted", "offending"])

    source = docs.select(*keep, *([] if text in keep else [F.col(text).alias(name)]))
    return source.mapInArrow(run, with_fields(docs.select(*keep), "score double, predicted int, offending array<struct<start:long,end:long,p:double>>"))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    fold = docs.select("doc_id", "text").withColumn("held_out", crc_bucket(F.col("doc_id"), folds) == 0)
    return score(fit(docs, labels, folds), fold, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")
