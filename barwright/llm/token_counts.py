"""Token counts: the pieces of every distinct pre-token are counted once, then joined to the documents' pre-token frequencies.

1. The distinct pre-tokens of all documents, with the number of documents (each task sends its own distinct ones).
2. Each is encoded once. Only the number of its ids is kept.
3. A document's tokens are the sum over its pre-tokens of frequency times number. The most frequent pre-tokens, at most
   `broadcast_rows` of them whatever the input, go to the tasks as a broadcast table; all others are joined by a shuffle,
   in which each document has only its few rare ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets
from barwright.llm.pretokens import pretokenizer, tokenizer_path
from barwright.llm.store import written

#: Rows of the broadcast table at most; pre-tokens longer than BROADCAST_CHARS never go there, so its size is bounded.
BROADCAST_ROWS = 300_000
BROADCAST_CHARS = 40


def pretoken_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pretoken, n_docs (roughly: counted by task and text), n_pieces: one row for each distinct pre-token of all texts."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokenizer(tokenizer).pieces
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pretoken", "n_docs"])

        for batch in bytesets.chunks(batches):
            for text in batch.column("text").to_pylist():
                found.update(set(split(text)))
            if len(found) > 1_000_000:  # a task's memory is bounded; what it sends twice is merged by the shuffle
                yield out()
                found.clear()
        if found:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pretokenizer(tokenizer).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n_docs"), pa.array(count(batch.column("pretoken").to_pylist()), pa.int32())], names=["pretoken", "n_docs", "n_pieces"])

    counted = docs.select("text").mapInArrow(seen, "pretoken string, n_docs long").groupBy("pretoken").agg(F.sum("n_docs").alias("n_docs"))
    return counted.mapInArrow(pieces, "pretoken string, n_docs long, n_pieces int")


def most_frequent(table: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows of a pretoken_table: those in more documents than the least number that keeps to the bound."""
    short = table.where(F.length("pretoken") <= BROADCAST_CHARS)
    octaves = {r["octave"]: r["n"] for r in short.groupBy(F.floor(F.log2("n_docs") * 4).alias("octave")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for octave in sorted(octaves, reverse=True):
        total += octaves[octave]
        if total > rows:
            break
        least = octave
    return short.where(F.floor(F.log2("n_docs") * 4) >= least) if least is not None else short.limit(0)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    Null and empty texts have 0 bytes and tokens. Special strings inside texts count as the tokenizer's library takes them
    by default (one token each). Repeated rows and rows with equal or null doc_id are counted each for itself. Other columns are
    ignored; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(pretoken_table(docs, path))
    frequent = most_frequent(table, broadcast_rows).select("pretoken", "n_pieces").toPandas()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent["pretoken"], frequent["n_pieces"].tolist(), strict=True)))
    schema = "row long, doc_id long, n_bytes long, n_known long, rare array<struct<pretoken: string, freq: int>>"
    rare_type = pa.list_(pa.struct([("pretoken", pa.string()), ("freq", pa.int32())]))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces_of = pretokenizer(path).pieces, known.value.get
        for batch in bytesets.chunks(batches):
            sums, offsets, names, freqs = [], [0], [], []
            for text in batch.column("text").to_pylist():
                total = 0
                for pretoken, freq in Counter(split(text)).items():
                    n = pieces_of(pretoken)
                    if n is None:
                        names.append(pretoken)
                        freqs.append(freq)
                    else:
                        total += freq * n
                sums.append(total)
                offsets.append(len(names))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(freqs, pa.int32())], names=["pretoken", "freq"])).cast(rare_type)
            sizes = np.diff(bytesets.utf8(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), rare], names=["row", "doc_id", "n_bytes", "n_known", "rare"])

    # rows are told apart by their numbers, which the written table fixes
    counted = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(frequencies, schema))
    rare = counted.select("row", F.inline("rare")).join(table.select("pretoken", "n_pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("freq").cast("long") * F.col("n_pieces")).alias("n_rare"))
    n_tokens = F.col("n_known") + F.coalesce("n_rare", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "n_known").join(rare, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
