"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows; documents' windows are looked up and verified.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is `n` consecutive words of an
item; an item of fewer words, but not none, is one window. Every task hashes the windows of its documents in bulk; only
windows whose hash is in the set are compared word by word. There is no shuffle.

The broadcast set is arrays (`Windows`): of each word 24 bytes and its text, so about six times the items' text. Its size is
checked by that: items are dealt into blocks of at most `block_bytes` of text, one scan for each block, and only if there is
more than one block are the blocks' findings joined by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets
from barwright.llm.store import fresh, written

WINDOW_WORDS = 13
BLOCK_BYTES = 8 << 20


def window_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(at, at + n))


@dataclass
class Windows:
    """The windows of a block of items: by length, sorted hashes, the first word of each window and its item; and the words."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    names: list[str | None]

    def items(self, length: int, value: np.uint64, text: bytes) -> list[str | None]:
        """The items that have the window of this hash and text; none: no such window."""
        hashes, at, item = self.by_length[length]
        lo, hi = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
        return [self.names[i] for k, i in zip(at[lo:hi].tolist(), item[lo:hi].tolist(), strict=True) if window_at(self.data, self.starts, self.ends, k, length) == text]


def windows_of(items: list[tuple[str | None, str | None]], n: int) -> Windows:
    words = bytesets.Words(*bytesets.utf8(pa.array([t or "" for _, t in items], pa.string())), bytesets.PLAIN_WORD)
    counts = words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    own = np.minimum(counts, n)[owner]  # the window length of each word's item
    by_length = {}
    for length in np.unique(own).tolist():
        hashes, fits = words.shingles(length)
        at = np.flatnonzero(fits & (own == length))
        at = at[np.argsort(hashes[at], kind="stable")]
        by_length[length] = hashes[at], at.astype(np.int32), owner[at].astype(np.int32)
    return Windows(by_length, words.data, words.starts.astype(np.int32), words.ends.astype(np.int32), [i for i, _ in items])


def found_in(words: bytesets.Words, windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """By text, the runs of words (by their places in the batch) that occurring windows cover, in order and apart, and the items."""
    hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for length, (sorted_hashes, _, _) in windows.by_length.items():
        hashes, fits = words.shingles(length)
        at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
        for k in np.flatnonzero(fits & (sorted_hashes[at] == hashes)).tolist():
            if same := windows.items(length, hashes[k], window_at(words.data, words.starts, words.ends, k, length)):
                doc = int(np.searchsorted(words.text_offsets, k, side="right")) - 1
                spans, names = hits.setdefault(doc, ([], set()))
                spans.append((k, k + length))
                names.update(x for x in same if x is not None)
    for doc, (spans, names) in hits.items():
        apart: list[tuple[int, int]] = []
        for b, e in sorted(spans):
            if apart and b <= apart[-1][1]:
                apart[-1] = apart[-1][0], max(apart[-1][1], e)
            else:
                apart.append((b, e))
        hits[doc] = apart, names
    return hits


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]], n: int) -> DataFrame:
    """row (a key of the document's row), n_words, spans (of words, end exclusive), byte_spans and items of all documents against one block of items."""
    known = docs.sparkSession.sparkContext.broadcast(windows_of(items, n))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for batch in bytesets.chunks(batches):
            words = bytesets.Words(*bytesets.utf8(batch.column("text")), bytesets.PLAIN_WORD)
            hits = found_in(words, windows)
            spans_out, bytes_out, items_out = [], [], []
            for d in range(batch.num_rows):
                if d not in hits:
                    spans_out.append([])
                    bytes_out.append([])
                    items_out.append([])
                    continue
                merged = hits[d][0]
                first, base = int(words.text_offsets[d]), int(words.offsets[d])
                spans_out.append([{"begin": b - first, "end": e - first} for b, e in merged])
                bytes_out.append([{"begin": int(words.starts[b]) - base, "end": int(words.ends[e - 1]) - base} for b, e in merged])
                items_out.append(sorted(hits[d][1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(spans_out, span), pa.array(bytes_out, span), pa.array(items_out, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "byte_spans", "items"],
            )

    spans = "array<struct<begin: int, end: int>>"
    return docs.mapInArrow(run, f"row string, doc_id long, n_words long, spans {spans}, byte_spans {spans}, items array<string>")


def row_key():
    """What rows with equal doc_id and text share, and no others."""
    return F.concat_ws("/", F.col("doc_id").cast("long").cast("string"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def fused(spans):
    """Spans (struct of spans and byte_spans) in order, those that overlap or touch made one: what one block would have found."""
    kind = "array<struct<spans: struct<begin: int, end: int>, byte_spans: struct<begin: int, end: int>>>"

    def add(done, x):
        last = F.element_at(done, -1)
        longer = lambda c: F.struct(last[c]["begin"].alias("begin"), F.greatest(last[c]["end"], x[c]["end"]).alias("end")).alias(c)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(longer("spans"), longer("byte_spans"))))
        return F.when((F.size(done) > 0) & (x["spans"]["begin"] <= F.get(done, F.size(done) - 1)["spans"]["end"]), joined).otherwise(F.concat(done, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans, byte_spans, items, n_hit of every document.

    Null and empty texts have no words and no hits; null or empty items have no windows; items with a null item_id hit but
    are not named; repeated items are named once; with no items nothing is hit. Rows with equal doc_id are kept apart.
    Columns other than doc_id and text (item_id and text of the benchmark) are ignored.
    """
    return findings(docs, benchmark, n, block_bytes).drop("row")


def items_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """item_id and text of the items, and the number of blocks that their text makes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-total // block_bytes) or 1


def findings(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, by_content: bool = False) -> DataFrame:
    """`hits` and row: a row's number or, with several blocks or by_content, its `row_key`."""
    items, blocks = items_of(benchmark, block_bytes)
    number = F.monotonically_increasing_id().cast("string") if blocks == 1 and not by_content else row_key()
    docs = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        one = scan(docs, [tuple(r) for r in part.collect()], n)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:  # equal rows of equal documents have equal findings, so they are counted apart by the first block only
        found = found.groupBy("row", "doc_id").agg(
            F.first("n_words").alias("n_words"),
            fused(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("spans", "byte_spans"))))).alias("both"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            (F.count("*") / blocks).cast("int").alias("copies"),
        )
        found = found.select("row", "doc_id", "n_words", F.col("both.spans").alias("spans"), F.col("both.byte_spans").alias("byte_spans"), "items", "copies")
        found = found.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1)))))
    return found.select("row", "doc_id", "n_words", "spans", "byte_spans", F.array_sort("items").alias("items"), covered.cast("long").alias("n_hit"))


def contaminated(n_hit, n_words):
    """The rule: at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The findings of `hits` as doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, spans: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents; with spans=True, those stay and lose the hit passages instead. All columns stay.

    The text of a document that loses spans is what lies outside them, as it was. Every row is judged by its own text, rows
    with null or equal doc_ids too. Null and empty texts stay; an empty table stays empty.
    """
    items, blocks = items_of(benchmark, block_bytes)
    if not spans and blocks == 1:
        known = docs.sparkSession.sparkContext.broadcast(windows_of([tuple(r) for r in items.collect()], WINDOW_WORDS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = []
                for part in bytesets.chunks(iter([batch])):
                    words = bytesets.Words(*bytesets.utf8(part.column("text")), bytesets.PLAIN_WORD)
                    hit = np.zeros(part.num_rows, np.int64)
                    for d, (runs, _) in found_in(words, known.value).items():
                        hit[d] = sum(e - b for b, e in runs)
                    kept.append(~contaminated(hit, words.counts()))
                yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

        return docs.mapInArrow(run, docs.schema)
    row, cut = fresh(docs, "row"), fresh(docs, "cuts")
    found = findings(docs, benchmark, WINDOW_WORDS, block_bytes, by_content=True)
    if not spans:
        gone = written(found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("row").alias(row)).distinct())
        return docs.withColumn(row, row_key()).join(gone, row, "left_anti").select(*docs.columns)
    cuts = found.where(F.size("byte_spans") > 0).groupBy(F.col("row").alias(row)).agg(F.first("byte_spans").alias(cut))
    raw = F.encode("text", "utf-8")
    begins = F.concat(F.array(F.lit(0)), F.col(cut)["end"])
    ends = F.concat(F.col(cut)["begin"], F.array(F.octet_length("text")))
    kept = F.aggregate(F.zip_with(begins, ends, lambda b, e: F.decode(F.substring(raw, b + 1, e - b), "utf-8")), F.lit(""), lambda a, x: F.concat(a, x))
    joined = docs.withColumn(row, row_key()).join(cuts, row, "left")
    return joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
