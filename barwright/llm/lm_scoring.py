"""Language-model scoring by deleted interpolation.

P(w | u, v) = l3 * P3(w | u, v) + l2 * P2(w | v) + l1 * P1(w) + l0 / (V + 1): n-gram maximum-likelihood estimates of words,
mixed with weights that depend on how often the contexts (u, v) and v were seen (buckets by octave). The weights are learned by
expectation-maximisation on the training documents of class `DELETED` with the counts of all other training documents; scores
are taken with the counts of all training documents.

All words, bigrams and trigrams are counted, none is merged with others or left out:

* documents are dealt into chunks of about `CHUNK_TOKENS` tokens, written as words and places (`chunked`);
* each chunk sends its distinct n-grams (63 bits of a hash) and their counts, sorted and packed, to the buckets that the keys'
  ranges make (`messages`); a bucket adds up its keys' counts and sends every chunk those of the keys it had, in the order in
  which they came, so no key goes back (`replies`);
* a chunk has then the counts of its tokens' n-grams and contexts, side by side (`Counted`), and scores its documents.

So a bucket and a chunk hold a bounded number of keys at any input size, and the most frequent n-gram comes once from a chunk.
Counts have 64 bits. For every context that was seen, the probabilities of all words and of one unknown word sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets
from barwright.llm.store import small_batches, written

#: Of the classes crc32(doc_id) mod 7 that train (all but 2), the one on which the weights are learned.
DELETED = 5
HELD_OUT = 2
#: The end of a text, a token of its own: no word has this value but by a collision of 64 bits.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
#: What stands before a text's first word.
START = np.uint64(0x57A257A257A257A2)
CHUNK_TOKENS = 2_500_000
BUCKET_KEYS = 1_000_000
EM_STEPS = 30
BINS = 24
_U = np.uint64


def doc_class():
    return F.crc32(F.col("doc_id").cast("string")) % 7


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token values of a batch, each text's words and then END, and the offsets of the texts in them."""
    words = bytesets.Words(data, offsets, bytesets.SPACED_WORD)
    counts = words.counts()
    out = np.full(len(words.hashes) + len(counts), END, _U)
    place = np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)), counts)
    out[place] = words.hashes
    return out, words.text_offsets + np.arange(len(counts) + 1)


def packed(x: np.ndarray) -> bytes:
    """64-bit values by place of their bytes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).astype(_U, copy=False).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, _U)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(_U).reshape(-1)


CHUNK_TYPE = "chunk long, deleted boolean, doc_id array<long>, held_out array<boolean>, n array<long>, n_texts long, n_tokens long, n_words long, words binary, places binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Documents of about CHUNK_TOKENS tokens a row: ids, lengths, distinct token values and each token's place in them.

    Chunks hold either documents of the class DELETED or others. n_texts and n_tokens count what trains.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray, pa.Table]]] = {True: [], False: []}
        task, made = TaskContext.get().partitionId() << 32, 0

        def out(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            parts, held[deleted] = held[deleted], []
            n = np.concatenate([p[1] for p in parts])
            rows = pa.concat_tables([p[2] for p in parts]).combine_chunks()
            trains = ~rows["held_out"].fill_null(False).to_numpy().astype(bool)
            values = np.concatenate([p[0] for p in parts])
            del parts
            words, places, times = np.unique(values, return_inverse=True, return_counts=True)
            order = np.argsort(-np.floor(np.log2(times)), kind="stable")  # frequent words first, their places take fewer bits
            turned = np.empty(len(order), np.int64)
            turned[order] = np.arange(len(order))
            words, places = words[order], turned[places]
            made += 1
            columns = {
                "chunk": [task + made],
                "deleted": [deleted],
                "doc_id": pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())),
                "held_out": pa.array([rows["held_out"].to_pylist()], pa.list_(pa.bool_())),
                "n": pa.array([n], pa.list_(pa.int64())),
                "n_texts": [int(trains.sum())],
                "n_tokens": [int(n[trains].sum())],
                "n_words": [len(words)],
                "words": pa.array([packed(np.diff(words, prepend=_U(0)))], pa.binary()),
                "places": pa.array([packed(places)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

        for batch in bytesets.chunks(batches):
            values, offsets = tokens(*bytesets.utf8(batch.column("text")))
            n = np.diff(offsets)
            of = batch.column("deleted").to_numpy(zero_copy_only=False).astype(bool)
            rows = pa.Table.from_batches([batch]).select(["doc_id", "held_out"])
            for deleted in (False, True):
                own = of == deleted
                if own.any():
                    held[deleted].append((values[np.repeat(own, n)], n[own], rows.filter(pa.array(own))))
                    if sum(len(p[0]) for p in held[deleted]) >= CHUNK_TOKENS:
                        yield out(deleted)
        for deleted in (False, True):
            if held[deleted]:
                yield out(deleted)
        bytesets.give_back()

    rows = docs.select("doc_id", (doc_class() == HELD_OUT).alias("held_out"), F.coalesce(doc_class() == DELETED, F.lit(False)).alias("deleted"), "text")
    return rows.mapInArrow(run, CHUNK_TYPE)


class Grams:
    """The keys (63 bits) of a chunk: of its distinct words, and of the bigram and trigram that end at each token."""

    def __init__(self, row: dict):
        self.n = np.array(row["n"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        words = np.append(np.cumsum(unpacked(row["words"], row["n_words"]), dtype=_U), START)
        self.places = unpacked(row["places"], int(self.offsets[-1])).view(np.int64)
        self.trains = np.repeat(np.array([not h for h in row["held_out"]], bool), self.n)
        as_key = lambda x: x >> _U(1)
        spread = lambda k: bytesets.mixed(words * _U(0x9E3779B97F4A7C15) + _U(k))
        self.of_words = as_key(spread(1)[:-1])
        self._terms = [spread(k) for k in range(2, 7)]

    def before(self, back: int) -> np.ndarray:
        """Places of the words so many tokens before; a text's start has the last place."""
        out = np.full(len(self.places), len(self._terms[0]) - 1)
        if back < len(out):
            out[back:] = self.places[:-back]
        for k in range(back):
            first = self.offsets[:-1] + k
            out[first[first < self.offsets[1:]]] = len(self._terms[0]) - 1
        return out

    def keys(self, n: int) -> np.ndarray:
        terms = self._terms[:2] if n == 2 else self._terms[2:]
        total = terms[-1][self.places]
        for back in range(1, n):
            total += terms[-1 - back][self.before(back)]
        total = bytesets.mixed(total)
        total >>= _U(1)
        return total

    def distinct(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For words, bigrams and trigrams the distinct keys, sorted, and how often each is in the texts that train."""
        order = np.argsort(self.of_words)
        yield self.of_words[order], np.bincount(self.places[self.trains], minlength=len(order))[order]
        for n in (2, 3):
            both = self.keys(n)
            both <<= _U(1)
            both |= self.trains
            both.sort()
            key = both >> _U(1)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield key[first], np.add.reduceat((both & _U(1)).astype(np.int64), first)


def messages(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, deleted, n1, n2, n3, keys, counts: the distinct keys of each chunk, those of one range a row."""
    bounds = np.array([(k << 63) // buckets for k in range(buckets)] + [(1 << 63) - 1], _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = list(Grams(row).distinct())
                cuts = [np.append(np.searchsorted(key, bounds[:-1]), len(key)) for key, _ in found]
                out = []
                for b in range(buckets):
                    own = [slice(c[b], c[b + 1]) for c in cuts]
                    sizes = [s.stop - s.start for s in own]
                    if sum(sizes):
                        keys = np.concatenate([k[s] for (k, _), s in zip(found, own, strict=True)])
                        counts = np.concatenate([c[s] for (_, c), s in zip(found, own, strict=True)])
                        out.append((b, row["chunk"], row["deleted"], *map(int, sizes), packed(np.diff(keys, prepend=_U(0))), packed(counts)))
                types = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "chunk", "deleted", "n1", "n2", "n3", "keys", "counts"])
        bytesets.give_back()

    return chunks.select("chunk", "deleted", "held_out", "n", "n_words", "words", "places").mapInArrow(run, "bucket int, chunk long, deleted boolean, n1 long, n2 long, n3 long, keys binary, counts binary")


REPLY_TYPE = "chunk long, bucket int, deleted boolean, n1 long, n2 long, n3 long, counts binary, of_deleted binary"


def replies(sent: DataFrame) -> DataFrame:
    """For each message the counts of its keys in all texts that train and, for chunks of the class DELETED, in that class.

    One more row a bucket, with a null chunk, has in n1 how many words train.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "chunk", "deleted", "n1", "n2", "n3"]).to_pylist()
        sizes = np.array([r["n1"] + r["n2"] + r["n3"] for r in rows])
        at = np.append(0, np.cumsum(sizes))
        keys, counts = np.empty(at[-1], _U), np.empty(at[-1], np.int64)
        word, deleted = np.zeros(at[-1], bool), np.zeros(at[-1], bool)
        for i, r in enumerate(rows):
            keys[at[i] : at[i + 1]] = np.cumsum(unpacked(table["keys"][i].as_py(), int(sizes[i])), dtype=_U)
            counts[at[i] : at[i + 1]] = unpacked(table["counts"][i].as_py(), int(sizes[i])).view(np.int64)
            word[at[i] : at[i] + r["n1"]] = True
            deleted[at[i] : at[i + 1]] = r["deleted"]
        order = np.argsort(keys)
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        first, group = np.flatnonzero(new), np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.add.reduceat(counts[order], first)
        lost = np.add.reduceat((counts * deleted)[order], first)
        out = [(r["chunk"], r["bucket"], r["deleted"], r["n1"], r["n2"], r["n3"], packed(total[group[at[i] : at[i + 1]]]), packed(lost[group[at[i] : at[i + 1]]]) if r["deleted"] else None) for i, r in enumerate(rows)]
        out.append((None, rows[0]["bucket"], False, int((word[order][first] & (total > 0)).sum()), 0, 0, None, None))
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "bucket", "deleted", "n1", "n2", "n3", "counts", "of_deleted"])

    return sent.groupBy("bucket").applyInArrow(run, REPLY_TYPE)


@dataclass
class Totals:
    """Texts, tokens and distinct tokens that train."""

    texts: int
    tokens: int
    distinct: int


class Counted:
    """A chunk with the counts of its tokens, and of the bigrams and trigrams that end at them."""

    def __init__(self, table: pa.Table, without_deleted: bool = False):
        rows = table.select(["bucket", "n1", "n2", "n3"]).to_pylist()
        mine = next(i for i, r in enumerate(rows) if r["bucket"] is None)
        self.row = table.slice(mine, 1).to_pylist()[0]
        grams = Grams(self.row)
        self.offsets = grams.offsets
        parts: list[list[np.ndarray]] = [[], [], []]
        for i in sorted((i for i in range(len(rows)) if i != mine), key=lambda i: rows[i]["bucket"]):
            sizes = [rows[i]["n1"], rows[i]["n2"], rows[i]["n3"]]
            counts = unpacked(table["counts"][i].as_py(), sum(sizes)).view(np.int64)
            if without_deleted:
                counts = counts - unpacked(table["of_deleted"][i].as_py(), sum(sizes)).view(np.int64)
            for held, part in zip(parts, np.split(counts, np.cumsum(sizes)[:2]), strict=True):
                held.append(part)
        of_words = np.empty(len(grams.of_words), np.int64)
        of_words[np.argsort(grams.of_words)] = np.concatenate(parts[0])
        self.counts = [of_words[grams.places]]
        for n in (2, 3):
            key = grams.keys(n)
            order = np.argsort(key)
            key = key[order]
            group = np.cumsum(np.append(True, key[1:] != key[:-1]))
            del key
            group -= 1
            own = np.empty(len(order), np.int64)
            own[order] = np.concatenate(parts[n - 1])[group]
            del order, group
            self.counts.append(own)
            parts[n - 1] = []

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of texts of about 200,000 tokens."""
        begin = 0
        while begin < len(self.offsets) - 1:
            end = max(begin + 1, int(np.searchsorted(self.offsets, self.offsets[begin] + 200_000, side="right")) - 1)
            yield begin, end
            begin = end

    def estimates(self, totals: Totals, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the contexts, and the four estimates of each token of the texts from begin to end."""
        c1, c2, c3 = (c[self.offsets[begin] : self.offsets[end]] for c in self.counts)
        first = self.offsets[begin:end] - self.offsets[begin]
        x2, x3 = np.roll(c1, 1), np.roll(c2, 1)  # every token but END has one after it, so a context's count is its n-gram's
        x2[first] = x3[first] = totals.texts
        octave = lambda x: np.minimum(np.log2(x + 1.0).astype(np.int64), BINS - 1)
        p0 = np.full(len(c1), 1.0 / (totals.distinct + 1))
        return octave(x3) * BINS + octave(x2), np.stack([p0, c1 / max(totals.tokens, 1), c2 / np.maximum(x2, 1), c3 / np.maximum(x3, 1)], axis=1)


def learn_weights(deleted: DataFrame, totals: Totals) -> np.ndarray:
    """Mixing weights by context bucket, by expectation-maximisation on the chunks (and replies) of `deleted`.

    The tokens' estimates go into a histogram (each estimate to half an octave, so its size has a bound), which is summed by a
    shuffle; the iterations run on the histogram.
    """
    level = lambda p: np.where(p > 0, np.clip(np.round(-2 * np.log2(np.maximum(p, 1e-30))), 0, 62), 63).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        chunk = Counted(table, without_deleted=True)
        keys, counts = [], []
        for begin, end in chunk.blocks():
            bucket, p = chunk.estimates(totals, begin, end)
            key, n = np.unique(((bucket * 64 + level(p[:, 1])) * 64 + level(p[:, 2])) * 64 + level(p[:, 3]), return_counts=True)
            keys.append(key)
            counts.append(n)
        bytesets.give_back()
        return pa.table({"key": np.concatenate(keys), "n": np.concatenate(counts)})

    rows = deleted.groupBy("chunk").applyInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    bucket = key >> 18
    value = lambda x: np.where(x == 63, 0.0, 2.0 ** (-x / 2))
    p = np.stack([np.full(len(key), 1.0 / (totals.distinct + 1)), value(key >> 12 & 63), value(key >> 6 & 63), value(key & 63)], axis=1)
    prior = np.tile([0.02, 0.5, 0.4, 0.08], (BINS * BINS, 1))  # a bucket without tokens keeps these
    prior[np.arange(BINS * BINS) % BINS == 0, 2] = 0  # contexts that were never seen have no estimate
    prior[np.arange(BINS * BINS) < BINS, 3] = 0
    weights = prior / prior.sum(axis=1, keepdims=True)
    for _ in range(EM_STEPS):
        part = weights[bucket] * p
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        gathered = prior + np.stack([np.bincount(bucket, part[:, k], BINS * BINS) for k in range(4)], axis=1)
        weights = gathered / gathered.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    score is the model's log10 probability of the text, base_score that of add-one unigrams. Null and empty texts have the end
    as their one token. If no text trains, every count is 0 and both scores come from the smoothing alone. Repeated rows and
    rows with equal doc_id are scored each for itself (and train each); rows with a null doc_id train, and their held_out is null. Other columns are ignored.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(chunked(docs))
    row = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_texts", "n_tokens")], *[F.coalesce(F.sum(F.when(F.col("deleted"), F.col(c))), F.lit(0)) for c in ("n_texts", "n_tokens")], F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    back = written(replies(messages(chunks, max(1, -(-3 * row[4] // (2 * BUCKET_KEYS))))))  # about three keys for two tokens
    distinct = back.where(F.col("chunk").isNull()).agg(F.sum("n1")).first()[0] or 0
    totals = Totals(row[0], row[1], distinct)
    met = chunks.unionByName(back.where(F.col("chunk").isNotNull()), allowMissingColumns=True)
    weights = docs.sparkSession.sparkContext.broadcast(learn_weights(met.where("deleted"), Totals(row[0] - row[2], row[1] - row[3], distinct)))
    base_log = float(np.log10(totals.tokens + distinct + 1))

    def run(table: pa.Table) -> pa.Table:
        chunk = Counted(table)
        known, first = chunk.counts[0], chunk.offsets[:-1]
        own = []
        for begin, end in chunk.blocks():
            bucket, p = chunk.estimates(totals, begin, end)
            own.append(np.add.reduceat(np.log10((weights.value[bucket] * p).sum(axis=1)), first[begin:end] - first[begin]))
        base = np.add.reduceat(np.log10(known + 1.0) - base_log, first)
        bytesets.give_back()
        return pa.Table.from_arrays(
            [
                pa.array(chunk.row["doc_id"], pa.int64()),
                pa.array(chunk.row["held_out"], pa.bool_()),
                pa.array(chunk.row["n"], pa.int64()),
                pa.array(np.add.reduceat((known > 0).astype(np.int64), first)),
                pa.array(np.full(len(first), totals.tokens, np.int64)),
                pa.array(base),
                pa.array(np.concatenate(own)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return met.groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
