"""Language identification by language-bitmask n-gram filters.

A filter is one array of rows of 64-bit words, one word for every 64 languages. Each n-gram sets the bits of its languages in
the rows at `PROBES` places of the array (a Bloom filter for each language, sliced by bit), so the AND of those rows gives all
languages that have the n-gram, at once. A text's n-grams are counted for each language by those bits; the counts are
corrected for the filter's false positives; the language with the most decides.

n-grams are runs of `GRAM` bytes of the lower-cased UTF-8 text in which everything but letters' bytes is a blank. Their
counts by language are gathered over all training texts. A language has an n-gram if at least one in 1 / `RATE` of its n-grams
is that one (so it has 1 / RATE at most, whatever the input, and the filters have a bound) and its rate there is not far below
the highest rate among the languages (words of other languages stray into texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm import bytesets

GRAM = 4
PROBES = 4
#: The least rate of an n-gram among those of a language.
RATE = 1 / 200_000
#: A language has an n-gram if its rate is at least this share of the highest rate.
SHARE = 0.2
#: Bits of a filter for each n-gram in it.
BITS_A_GRAM = 12
_U = np.uint64
_LETTER = bytesets.LOWER.copy()
_LETTER[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram values (the bytes themselves) and the text of each; n-grams of blanks only are left out."""
    b = _LETTER[data].astype(np.uint32)
    n = max(len(b) - GRAM + 1, 0)
    value = np.zeros(n, np.uint32)
    for k in range(GRAM):
        value |= b[k : k + n] << np.uint32(8 * (GRAM - 1 - k))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    last = np.repeat(offsets[1:], np.diff(offsets))[:n]
    fits = (np.arange(n) + GRAM <= last) & (value != 0x20202020)
    return value[fits], owner[fits]


def places(values: np.ndarray, size: int) -> list[np.ndarray]:
    """The PROBES places of each n-gram in an array of `size` (a power of two) words."""
    h = bytesets.mixed(values.astype(_U) + _U(0x51ED270B))
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(i) * step) & _U(size - 1)).astype(np.int64) for i in range(PROBES)]


def is_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def gram_counts(training: DataFrame) -> DataFrame:
    """lang, gram, n over all training texts (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in bytesets.chunks(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            names, code = np.unique(langs, return_inverse=True)
            value, owner = grams(*bytesets.utf8(batch.column("text")))
            key, n = np.unique((code[owner].astype(_U) << _U(32)) | value, return_counts=True)
            for i, name in enumerate(names):
                own = key >> _U(32) == i
                old = total.get(name, (np.zeros(0, _U), np.zeros(0, np.int64)))
                both, at = np.unique(np.concatenate([old[0], key[own] & _U(0xFFFFFFFF)]), return_inverse=True)
                total[name] = both, np.bincount(at, np.concatenate([old[1], n[own]]), len(both)).astype(np.int64)
        for name, (key, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return training.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The filters of all languages, any number of them, in one array of bitmasks."""

    def __init__(self, langs: list[str], by_lang: list[np.ndarray], shares: list[float]):
        self.langs, self.shares = langs, shares
        most = max([1, *map(len, by_lang)])
        self.size = 1 << max(10, int(np.ceil(np.log2(most * BITS_A_GRAM))))
        self.words = np.zeros((self.size, -(-len(langs) // 64)), _U)
        for i, values in enumerate(by_lang):
            for at in places(values, self.size):
                np.bitwise_or.at(self.words[:, i // 64], at, _U(1) << _U(i % 64))
        self.false_positives = np.array([self.bit(self.words, i).mean() for i in range(len(langs))]) ** PROBES

    @staticmethod
    def bit(masks: np.ndarray, i: int) -> np.ndarray:
        """Whether each mask has language i: 0 or 1."""
        return (masks[:, i // 64] >> _U(i % 64)) & _U(1)

    def masks(self, values: np.ndarray) -> np.ndarray:
        out = np.full((len(values), self.words.shape[1]), ~_U(0))
        for at in places(values, self.size):
            out &= self.words[at]
        return out

    def estimates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and language, the n-grams that the language has, corrected for false positives."""
        value, owner = grams(data, offsets)
        mask, texts = self.masks(value), len(offsets) - 1
        total = np.bincount(owner, minlength=texts)
        found = np.stack([np.bincount(owner, self.bit(mask, i), texts) for i in range(len(self.langs))], axis=1)
        return np.maximum(found - total[:, None] * self.false_positives, 0) / (1 - self.false_positives)


def packed_grams(rows: DataFrame) -> dict[str, np.ndarray]:
    """The n-grams (lang, gram) of each language; four bytes each come to the driver, at most 1 / RATE of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, gram = np.array(batch.column("lang").to_pylist(), object), batch.column("gram").to_numpy().astype("<u4")
            names = sorted(set(lang))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([gram[lang == x].tobytes() for x in names], pa.binary())], names=["lang", "grams"])

    out: dict[str, list[np.ndarray]] = {}
    for row in rows.select("lang", "gram").mapInArrow(run, "lang string, grams binary").toLocalIterator():
        out.setdefault(row["lang"], []).append(np.frombuffer(bytes(row["grams"]), "<u4"))
    return {x: np.concatenate(parts).astype(_U) for x, parts in out.items()}


def learned(training: DataFrame) -> Filters:
    """Filters from all rows of training (text, lang) with a lang, for any number of languages; null texts count as empty."""
    labelled = training.where(F.col("lang").isNotNull())
    counts = gram_counts(labelled)
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(sums), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= RATE)
    kept = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("top"))
    by_lang = packed_grams(kept)
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    return Filters(langs, [by_lang.get(x, np.zeros(0, _U)) for x in langs], [totals[x] / sum(totals.values()) for x in langs])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its text alone.

    score: the decided language's share of the corrected counts. Null texts and texts without a letter: `und`, 0. Texts none
    of whose n-grams any language has: the most frequent language of the training rows, 0; ties go to the first by name.
    Without any training row every text is `und`. Equal rows give equal results; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        names = np.array([*f.langs, "und"], object)
        prior = int(np.argmax(f.shares)) if f.langs else 0
        for batch in bytesets.chunks(batches):
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if f.langs:
                found = f.estimates(*bytesets.utf8(batch.column("text")))
                total = found.sum(axis=1)
                best = np.where(total > 0, found.argmax(axis=1), prior)
                score = np.where(total > 0, found.max(axis=1) / np.maximum(total, 1e-300), 0.0)
            else:
                best, score = np.zeros(len(letters), int), np.zeros(len(letters))
            best, score = np.where(letters, best, len(f.langs)), np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
