"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is a logistic function of its words' 5-byte n-grams (so inflected words count by their stems); the sentences' scores are combined by noisy-or with a leak,
1 - (1 - leak) * prod(1 - score), and the weights are trained from document labels through that combination. The sentences'
own scores then tell where the offence is.

1. About `SAMPLE` labelled documents of each class train, chosen by a hash of doc_id (a documented bound; so labels are
   joined by a broadcast of bounded size and no text is shuffled). Their n-grams are counted by label.
2. The `FEATURES` n-grams that tell the labels apart best are the model's features (the model's size is fixed).
3. Weights are fitted to the sample's labels.
4. All documents are scored in one scan; the model is a small broadcast of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets
from barwright.llm.store import small_batches

GRAM = 5
BITS = 19
BUCKETS = 1 << BITS
FEATURES = 2048
#: Features' least chi-square: what chance alone gives a few of all the n-grams.
LEAST_CHI = 30.0
#: The weight of the toxic class in training, as a share: above its own share, as a missed toxic document costs more.
TOXIC_SHARE = 0.3
SAMPLE = 8000
STEPS = 300
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def is_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


class Sentences:
    """Sentences of a batch: the bucket and sentence of every n-gram, the document, first and end byte of every sentence.

    A sentence ends behind a run of . ! ? or a line break. Words are runs of letters, digits and multi-byte characters,
    A-Z lower-cased. n-grams lie within a word and one blank before or behind it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = bytesets.LOWER[data]
        inside = bytesets.PLAIN_WORD[lower]
        n = len(data)
        padded = np.full(n + GRAM + 1, 32, np.uint64)  # padded[i + 1] is byte i
        padded[1 : n + 1] = np.where(inside, lower, 32)
        within = np.zeros(n + GRAM + 1, bool)
        within[1 : n + 1] = inside
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        fits = np.ones(n, bool)  # n-gram i: from the byte before byte i to GRAM - 2 bytes behind it
        value = np.zeros(n, np.uint64)
        for k in range(GRAM):
            value |= padded[k : k + n] << np.uint64(8 * k)
            if 0 < k < GRAM - 1:
                fits &= within[k : k + n]
        if n:
            ends = np.zeros(n + GRAM, np.int64)
            ends[:n] = text
            ends[n:] = -1
            fits &= (ends[np.arange(n) + GRAM - 3] == text) if GRAM > 3 else True
            first_byte = np.zeros(n, bool)
            first_byte[offsets[:-1][np.diff(offsets) > 0]] = True
            value = np.where(first_byte, value & ~np.uint64(255) | np.uint64(32), value)
            last = np.zeros(n, np.int64)
            last[:] = np.repeat(offsets[1:], np.diff(offsets))
            over = np.arange(n) + GRAM - 2 >= last  # the last byte of the n-gram lies in the next text: a blank
            top = np.uint64(255 << 8 * (GRAM - 1))
            value = np.where(over, value & ~top | np.uint64(32 << 8 * (GRAM - 1)), value)
        at = np.flatnonzero(fits)
        breaks = np.zeros(n + 1, np.int64)
        if n:
            np.cumsum(_END[data], out=breaks[1:])
        new = np.zeros(n, bool)  # the first word byte of each sentence
        words = np.flatnonzero(inside)
        if len(words):
            new[words[0]] = True
            new[words[1:]] = (breaks[words[1:]] != breaks[words[:-1]]) | (text[words[1:]] != text[words[:-1]])
        number = np.cumsum(new) - 1
        self.buckets = (bytesets.mixed(value[at]) >> np.uint64(64 - BITS)).astype(np.int64)
        self.sentence = number[at]
        first = np.flatnonzero(new)
        self.doc = text[first]
        self.begin = first - offsets[self.doc]
        ends = words[np.searchsorted(words, np.append(first[1:], n)) - 1] + 1 if len(first) else first
        self.end = ends - offsets[self.doc]
        self.texts = len(offsets) - 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by bucket; 0 for those that are no features
    bias: float
    leak: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        """Each feature counts once in a sentence."""
        w = self.weights[s.buckets]
        has = np.flatnonzero(w)
        pairs = np.unique(s.sentence[has] * BUCKETS + s.buckets[has])
        sums = np.bincount(pairs // BUCKETS, self.weights[pairs % BUCKETS], len(s.doc))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))

    def document_scores(self, s: Sentences, p: np.ndarray) -> np.ndarray:
        clean = np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), s.texts)
        return 1 - (1 - self.leak) * np.exp(clean)


def word_statistics(labelled: DataFrame) -> DataFrame:
    """bucket, n_toxic, n_clean: in how many labelled documents (text, toxic) a word of the bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in bytesets.chunks(batches):
            s = Sentences(*bytesets.utf8(batch.column("text")))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = np.unique(s.doc[s.sentence] * BUCKETS + s.buckets)
            label = toxic[pairs // BUCKETS]
            for k in (0, 1):
                total[k] += np.bincount(pairs[label == k] % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1][some]), pa.array(total[0][some])], names=["bucket", "n_toxic", "n_clean"])

    return labelled.mapInArrow(run, "bucket long, n_toxic long, n_clean long").groupBy("bucket").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def features(labelled: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """The buckets with the largest chi-square of their presence against the label."""
    a, b = F.col("n_toxic").cast("double"), F.col("n_clean").cast("double")
    total = n_toxic + n_clean
    chi = F.pow(a * n_clean - b * n_toxic, 2) * total / ((a + b) * (total - a - b + 1.0) * max(n_toxic, 1) * max(n_clean, 1))
    rows = word_statistics(labelled).where(a + b >= 3).select("bucket", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
    return np.array(sorted(r["bucket"] for r in rows), np.int64)


def fitted(doc: np.ndarray, owner: np.ndarray, feature: np.ndarray, n_features: int, n_sentences: np.ndarray, labels: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Weights by feature, bias and leak, by gradient steps (with momentum and a step for each weight) on the noisy-or likelihood of the labels.

    doc: the document of each sentence that has features; owner and feature: the sentence of each of its features;
    n_sentences: all sentences of each document; prior: the weight of label 1.
    """
    plain = n_sentences - np.bincount(doc, minlength=len(labels)).astype(float)
    leak = 0.001
    x = np.zeros(n_features + 1)
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    share = labels.mean() if len(labels) else 0.0
    weight = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))  # each class weighs its share, whatever the sample holds
    weight = weight / weight.sum() if len(weight) else weight
    for step in range(1, steps + 1):
        z = np.bincount(owner, x[feature], len(doc)) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-x[-1]))
        log_clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)) + plain * np.log1p(-p0) + np.log1p(-leak)
        clean = np.exp(log_clean)
        slope = np.where(labels == 1, clean / np.maximum(1 - clean, 1e-6), -1.0) * weight  # of the log-likelihood by -log_clean
        gz = slope[doc] * p
        g = np.append(np.bincount(feature, gz[owner], n_features), gz.sum() + (slope * plain).sum() * p0)
        g[:-1] -= 2e-6 * x[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1]), leak


def learned(labelled: DataFrame) -> Model:
    """A model from rows (text, toxic 0 or 1), as many as one task can hold features of; rows with a null label are left out; null texts are empty.

    Without any labelled row the model scores everything as the leak.
    """
    labelled = small_batches(labelled).where(F.col("toxic").isin(0, 1)).select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    weights = np.zeros(BUCKETS)
    if not n_toxic:
        return Model(weights, -20.0, 0.001)
    chosen = features(labelled, n_toxic, n_clean)
    if not len(chosen):
        return Model(weights, -20.0, 0.001)
    known = labelled.sparkSession.sparkContext.broadcast(chosen)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int64)
        number[known.value] = np.arange(len(known.value))
        for batch in bytesets.chunks(batches):
            s = Sentences(*bytesets.utf8(batch.column("text")))
            n_sentences = np.bincount(s.doc, minlength=s.texts)
            f = number[s.buckets]
            pairs = np.unique(s.sentence[f >= 0] * BUCKETS + f[f >= 0])
            sentence, feature = pairs // BUCKETS, pairs % BUCKETS
            cuts = np.searchsorted(s.doc[sentence], np.arange(s.texts + 1))
            packed = [np.stack([sentence[a:b], feature[a:b]], axis=1).astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n_sentences, pa.int64()), pa.array(packed, pa.binary())], names=["toxic", "n", "packed"])

    rows = sorted((r["toxic"], r["n"], bytes(r["packed"])) for r in labelled.mapInArrow(reduced, "toxic int, n long, packed binary").collect())
    pairs = [np.frombuffer(r[2], "<i4").reshape(-1, 2).astype(np.int64) for r in rows]
    doc_of = np.repeat(np.arange(len(rows)), [len(p) for p in pairs])
    every = np.concatenate(pairs)
    # sentences are told apart within their documents; their numbers are made anew
    _, owner = np.unique(doc_of * (1 << 32) + every[:, 0], return_inverse=True)
    doc = doc_of[np.unique(owner, return_index=True)[1]]
    x, bias, leak = fitted(doc, owner, every[:, 1], len(chosen), np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), TOXIC_SHARE)
    weights[chosen] = x
    return Model(weights, bias, leak)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences (number, first and end byte, score; those of 0.5 or more, or the worst if the document is predicted toxic), of every document.

    Null and empty texts, and texts without a word, have no sentences and score the leak. Equal texts score equally.
    Other columns are ignored; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in bytesets.chunks(batches):
            s = Sentences(*bytesets.utf8(batch.column("text")))
            p = m.sentence_scores(s)
            total = np.clip(m.document_scores(s, p), 0, 1)
            first = np.searchsorted(s.doc, np.arange(s.texts))
            worst: list[list[dict]] = [[] for _ in range(s.texts)]
            best = np.zeros(s.texts)
            np.maximum.at(best, s.doc, p)
            for k in np.flatnonzero((total[s.doc] >= 0.5) & ((p >= 0.5) | (p == best[s.doc]))).tolist():
                d = int(s.doc[k])
                worst[d].append({"sentence": k - int(first[d]), "begin": int(s.begin[k]), "end": int(s.end[k]), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(total), pa.array((total >= 0.5).astype(np.int32)), pa.array(worst, kind)],
                names=["doc_id", "held_out", "score", "predicted", "sentences"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<sentence: int, begin: int, end: int, score: double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs that the model doesn't predict toxic, in one scan. All columns stay; null texts are kept as they are."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            clean = []
            for part in bytesets.chunks(iter([batch])):
                s = Sentences(*bytesets.utf8(part.column("text")))
                clean.append(m.document_scores(s, m.sentence_scores(s)) < 0.5)
            yield batch.filter(pa.array(np.concatenate(clean))) if clean else batch

    return docs.mapInArrow(run, docs.schema)


def labelled_training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of about SAMPLE documents of each label whose doc_id isn't held out (all, if there are no more).

    A doc_id labelled twice counts as toxic if one label says so; labels other than 0 and 1 count as none.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, int(SAMPLE / max(n.get(1, 0), SAMPLE) * 1_000_000)).otherwise(int(SAMPLE / max(n.get(0, 0), SAMPLE) * 1_000_000))
    chosen = labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
