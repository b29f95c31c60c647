"""Suffix-array dedup: byte strings of LENGTH that occur twice are found by longest-previous-factor arrays and cut out.

1. Every window of `length` bytes has an anchor: the least hash of the `GRAM`-byte strings in it (the last of equal ones).
   Equal windows have equal anchors at the same place, so windows meet by anchor. The windows that share one anchor in a text
   follow each other; their bytes together are the anchor's context. Only hashes are shuffled.
2. Anchors that occur once have no repeated window. Occurrences with equal contexts are copies of one class: all their windows
   repeat. If an anchor has several classes, one context of each (the earliest) goes on.
3. The contexts of an anchor meet in one task (`CHUNK` of them at most; more are dealt by a hash of the context). There, a
   suffix array of the windows' starts is built by prefix doubling, and the previous and next smaller text positions in suffix
   order give each window's longest previous factor, up to `length`: an earlier match or none. The same in the other direction
   gives later matches.
4. Where an anchor's contexts were dealt to several tasks, each sends a hash of every different window that it holds; these
   meet in packed arrays.
5. A byte goes if it is in a window with an earlier match (keep_first) or with any match. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets
from barwright.llm.jaccard_join import runs
from barwright.llm.store import Scratch, distinct_ids, files_for, fresh, join_by_weight, small_batches, written

LENGTH = 400
GRAM = 48
CHUNK = 96
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 20
#: Windows of spread anchors in a bucket, about.
BUCKET_WINDOWS = 250_000
#: Tables up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Documents of a task of the last step, whose rows are small.
DOCS_A_TASK = 20_000
_U = np.uint64


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    n = len(x)
    full = np.full(-(-n // width) * width, ~_U(0))
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Hashed:
    """Hashes of byte strings of a batch."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = bytesets.powers(len(data))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(bytesets.BYTE_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return bytesets.mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(_U))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, context (hashes), doc, lo (first window), n (windows), copies of every anchor of every text.

    Of equal contexts in one text the first is sent, with their number; the windows of the others, which it repeats, are sent
    as they are, with a null anchor.
    """
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches):
            data, offsets = bytesets.utf8(batch.column("text"))
            if len(data) < length:
                continue
            hashed = Hashed(data)
            places = np.arange(len(data) - gram + 1)
            grams = hashed.of(places, places + gram)
            key = grams & ~_U(0xFFFFFFFF) | (_U(0xFFFFFFFF) - places.astype(_U))
            picked = (_U(0xFFFFFFFF) - (sliding_least(key, width) & _U(0xFFFFFFFF))).astype(np.int64)
            starts = np.arange(len(picked))
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(picked)]
            valid = starts + length <= offsets[text + 1]
            starts, picked, text = starts[valid], picked[valid], text[valid]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(starts)))
            lo, at = starts[first], picked[first]
            context = bytesets.mixed(hashed.of(lo, lo + n + length - 1) + (at - lo).astype(_U) * _U(0x9FB21C651E98DF25))
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[text[first]].astype(np.int64)
            lo = (lo - offsets[text[first]]).astype(np.int64)
            order = np.lexsort((lo, context, grams[at], doc))
            same = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            same[1:] = (doc[a] == doc[b]) & (grams[at][a] == grams[at][b]) & (context[a] == context[b])
            one = np.flatnonzero(~same)
            copies = np.diff(np.append(one, len(order))).astype(np.int32)
            again = order[same]
            windows = np.repeat(lo[again] - (np.cumsum(n[again]) - n[again]), n[again]) + np.arange(int(n[again].sum()))
            more = spans_of(np.repeat(doc[again], n[again]), windows)
            one = order[one]
            nulls = pa.nulls(len(more[0]), pa.int64())
            columns = [
                pa.concat_arrays([pa.array(grams[at][one].view(np.int64)), nulls]),
                pa.concat_arrays([pa.array(context[one].view(np.int64)), nulls]),
                pa.array(np.concatenate([doc[one], more[0]])),
                pa.array(np.concatenate([lo[one].astype(np.int32), more[1]])),
                pa.array(np.concatenate([n[one].astype(np.int32), more[2]])),
                pa.array(np.concatenate([copies, np.ones(len(more[0]), np.int32)])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "doc", "lo", "n", "copies"])

    return docs.mapInArrow(run, "anchor long, context long, doc long, lo int, n int, copies int")


def ranked(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the different values."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.zeros(len(key), np.int64)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def window_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of `length` bytes at starts, in the order of bytes, by prefix doubling. Each string lies within data."""
    padded = np.zeros(len(data) + 2 * length + 16, np.uint8)
    padded[: len(data)] = data
    n = len(data) + length
    value = np.zeros(n, _U)
    size = min(8, length)
    for k in range(size):
        value |= padded[k : k + n].astype(_U) << _U(8 * (7 - k))
    rank = ranked(value)
    while 2 * size <= length:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        rank, size = ranked(key), 2 * size
    if size == length:
        return rank[starts]
    return ranked(rank[starts] * (n + 1) + rank[starts + length - size])


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1."""
    out = np.arange(len(x)) - 1
    todo = np.flatnonzero((out >= 0) & (x[out] > x))
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[(out[todo] >= 0) & (x[out[todo]] > x[todo])]
    return out


def factor_matches(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which windows have a longest previous factor of their whole length: an equal window at a smaller position.

    rank: of each window's string; position: of each window in all texts. In suffix order (equal strings by falling position,
    so the next smaller one matters) the neighbours with smaller positions on either side have the longest common prefixes.
    """
    order = np.lexsort((-position, rank))
    r, p = rank[order], position[order]
    before = previous_smaller(p)
    after = len(p) - 1 - previous_smaller(p[::-1])[::-1]  # len(p) where there is none
    found = np.zeros(len(p), bool)
    some = before >= 0
    found[some] |= r[before[some]] == r[some]
    some = after < len(p)
    found[some] |= r[after[some]] == r[some]
    out = np.empty(len(p), bool)
    out[order] = found
    return out


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, salt, doc, lo, n, many, spread, bytes of the wanted occurrences (anchor, doc, lo, n, salt, many, spread).

    What is wanted grows with the input, so it is joined to the texts by a shuffle.
    """
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "salt", "lo", "n", "many", "spread")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches):
            rows: list[tuple] = []
            for doc, text, parts in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                raw = text.encode()
                rows += [(p["anchor"], p["salt"], doc, p["lo"], p["n"], p["many"], p["spread"], raw[p["lo"] : p["lo"] + p["n"] + length - 1]) for p in parts]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names=["anchor", "salt", "doc", "lo", "n", "many", "spread", "bytes"])

    joined = docs.join(by_doc, docs["doc_id"] == by_doc["doc"]).select("doc_id", "text", "parts")
    return joined.mapInArrow(run, "anchor long, salt int, doc long, lo int, n int, many boolean, spread boolean, bytes binary")


def spans_of(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, lo, n) of windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], start[first].astype(np.int32), np.diff(np.append(first, len(doc))).astype(np.int32)


#: What a chunk finds: spans of windows (kind 0), or packed windows of spread anchors for one bucket (kind 1).
_FOUND = "kind int, bucket int, doc long, lo int, n int, packed binary"
_PACKED = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("done", "<i4")])


def _spans_batch(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    k = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.int32()), pa.array(doc), pa.array(lo), pa.array(n), pa.nulls(k, pa.binary())], names=["kind", "bucket", "doc", "lo", "n", "packed"])


def chunk_matches(parts: DataFrame, length: int, keep_first: bool, buckets: int) -> DataFrame:
    """Spans of windows with matches in their chunk, and packed windows, for so many buckets, where the anchor is spread over chunks."""
    keys = ["anchor", "salt"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        """Whole chunks, about ARRAY_BYTES at once."""
        for x in runs(batches, keys):
            sizes = x["n"].astype(np.int64) + length - 1
            cut = np.ones(len(sizes), bool)
            cut[1:] = (x["anchor"][1:] != x["anchor"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
            block = np.maximum.accumulate(np.where(cut, (np.cumsum(sizes) - sizes) // ARRAY_BYTES, 0))
            for b in np.unique(block):
                yield {k: v[block == b] for k, v in x.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            n = x["n"].astype(np.int64)
            sizes = n + length - 1
            data = np.frombuffer(b"".join(x["bytes"]), np.uint8)
            base = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            starts = base[row] + inner
            _, group = np.unique(np.stack([x["anchor"], x["salt"].astype(np.int64)]), axis=1, return_inverse=True)
            group = group.reshape(-1)
            rank = window_ranks(data, starts, length) * (len(n) + 1) + group[row]  # equal windows have equal anchors
            doc, start = x["doc"][row], x["lo"][row] + inner
            by_place = np.lexsort((start, doc))
            position = np.empty(len(row), np.int64)
            position[by_place] = np.arange(len(row))
            earlier = factor_matches(rank, position)
            if keep_first:
                gone = earlier
                lone = ~earlier
            else:
                later = factor_matches(rank, len(row) - 1 - position)
                gone = earlier | later | x["many"][row]
                lone = ~earlier  # one of each different window
            if gone.any():
                yield _spans_batch(*spans_of(doc[gone], start[gone]))
            send = np.flatnonzero(lone & x["spread"][row])
            for part in np.array_split(send, -(-len(send) // 20_000)) if len(send) else []:
                hashed = Hashed(data)
                packed = np.zeros(len(part), _PACKED)
                packed["h1"] = hashed.of(starts[part], starts[part] + length)
                packed["h2"] = bytesets.mixed(x["anchor"][row[part]].view(_U) + _U(7) * hashed.of(starts[part] + length // 3, starts[part] + length))
                packed["doc"], packed["start"], packed["done"] = doc[part], start[part], gone[part]
                packed = packed[np.argsort(packed["h1"], kind="stable")]
                bucket = ((packed["h1"] >> _U(33)) * _U(buckets) >> _U(31)).astype(np.int32)
                names, first = np.unique(bucket, return_index=True)
                blobs = [p.tobytes() for p in np.split(packed, first[1:])]
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(names), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "doc", "lo", "n", "packed"])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _FOUND)


def across_chunks(packed: DataFrame, keep_first: bool) -> DataFrame:
    """Spans (doc, lo, n) of the packed windows that match one of another chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, ["bucket"]):
            for b in np.unique(x["bucket"]):
                w = np.frombuffer(b"".join(x["packed"][x["bucket"] == b]), _PACKED)
                w = w[np.lexsort((w["start"], w["doc"], w["h2"], w["h1"]))]
                same = np.zeros(len(w), bool)
                same[1:] = (w["h1"][1:] == w["h1"][:-1]) & (w["h2"][1:] == w["h2"][:-1])
                gone = same.copy()
                if not keep_first:
                    gone[:-1] |= same[1:]
                gone &= w["done"] == 0
                doc, lo, n = spans_of(w["doc"][gone], w["start"][gone])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(n)], names=["doc", "lo", "n"])

    return packed.select("bucket", "packed").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, lo int, n int")


def repeated_windows(docs: DataFrame, length: int, keep_first: bool, scratch: Scratch) -> DataFrame:
    """doc, lo, n: runs of window starts with a match (keep_first: an earlier match), of documents with doc_ids of their own."""
    gram = max(1, min(GRAM, length // 2))
    every = scratch.keep(anchors(docs, length, gram))
    first, again = every.where("anchor IS NOT NULL"), every.where("anchor IS NULL")
    twice = scratch.keep(first.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).where("total > 1").select("anchor", "rows"))
    met = scratch.keep(join_by_weight(first, twice, ["anchor"], "rows"))
    files = files_for(met.count())
    place = F.struct("doc", "lo", "n")
    classes = scratch.written(met.groupBy("anchor", "context").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.min(place).alias("first")).coalesce(files))
    kinds = scratch.keep(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    # all occurrences in classes of two or more
    copied = classes.where("copies > 1").select("anchor", "context", "rows", F.col("first.doc").alias("first_doc"), F.col("first.lo").alias("first_lo"))
    copies = join_by_weight(met, copied, ["anchor", "context"], "rows")
    if keep_first:
        copies = copies.where((F.col("doc") != F.col("first_doc")) | (F.col("lo") != F.col("first_lo")))
    several = join_by_weight(classes.drop("rows"), kinds.withColumn("rows", F.col("kinds")), ["anchor"], "rows")
    chunks = F.ceil(F.col("kinds") / CHUNK).cast("int")
    wanted = scratch.keep(several.select("anchor", F.pmod(F.xxhash64("context"), chunks).cast("int").alias("salt"), "first.doc", "first.lo", "first.n", (F.col("copies") > 1).alias("many"), (chunks > 1).alias("spread")))
    spread = wanted.where("spread").agg(F.sum("n")).first()[0] or 0
    found = scratch.table(chunk_matches(contexts(docs, wanted, length), length, keep_first, max(1, -(-spread // BUCKET_WINDOWS))), 20_000)
    out = again.select("doc", "lo", "n").unionByName(copies.select("doc", "lo", "n")).unionByName(found.where("kind = 0").select("doc", "lo", "n"))
    return out.unionByName(across_chunks(found.where("kind = 1"), keep_first))


def with_spans(docs: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, str]:
    """docs and a column (its name is given back) of the maximal removed runs (binary: their begin and end bytes, 64-bit each; null: none)."""
    scratch = Scratch()
    windows = repeated_windows(small_batches(docs).select("doc_id", "text"), length, keep_first, scratch)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, n in zip(batch.column("lo"), batch.column("n"), strict=True):
                lo = np.array(lo.values, np.int64)
                end = lo + np.array(n.values, np.int64) + length - 1
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(end[order])
                new = np.ones(len(lo), bool)
                new[1:] = lo[1:] > end[:-1]
                first = np.flatnonzero(new)
                out.append(np.stack([lo[first], end[np.append(first[1:], len(lo)) - 1]], axis=1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary())], names=["doc", "removed"])

    lists = windows.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    spans = written(lists.mapInArrow(merge, "doc long, removed binary").coalesce(files_for(docs.count())))
    scratch.release()
    size = spans.agg(F.sum(F.octet_length("removed") + 24)).first()[0] or 0
    removed = fresh(docs, "removed")
    spans = spans.select(F.col("doc").alias("doc_id"), F.col("removed").alias(removed))
    return docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "doc_id", "left").select(*docs.columns, removed), removed


def removals(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Removed is each byte in a string of `length` bytes that also starts elsewhere (keep_first: that starts earlier, by doc_id,
    then byte). Null texts are empty; texts shorter than `length` lose nothing. Strings may overlap themselves. If doc_ids are null or
    repeated, rows are told apart by their order in the table instead. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, name = distinct_ids(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches):
            columns: list[list] = [[], [], [], []]
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                raw = text.encode()
                spans = np.frombuffer(removed or b"", "<i8").reshape(-1, 2).tolist()
                kept = hashlib.sha256()
                at = gone = 0
                for b, e in spans:
                    kept.update(raw[at:b])
                    gone += e - b
                    at = e
                kept.update(raw[at:])
                for c, v in zip(columns, (len(raw), gone, len(spans), kept.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs, length, keep_first)[0].select(F.col(name).alias("doc_id"), "text", "removed").coalesce(files_for(docs.count(), DOCS_A_TASK))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, each text without what repeats an earlier one (by doc_id, then byte); the first copy stays.

    A character goes only if all of its bytes do. All rows and columns stay; a null text stays null. If doc_ids are null or repeated, rows are
    ordered as in the table.
    """
    names = docs.columns
    docs, name = distinct_ids(docs)
    out, removed_runs = with_spans(docs, length, keep_first=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column(removed_runs).to_pylist(), strict=True):
                if text is not None and removed:
                    raw = text.encode()
                    parts, at = [], 0
                    for b, e in np.frombuffer(removed, "<i8").reshape(-1, 2).tolist():
                        while b < e and raw[b] & 0xC0 == 0x80:
                            b += 1
                        while e > b and e < len(raw) and raw[e] & 0xC0 == 0x80:
                            e -= 1
                        parts.append(raw[at:b])
                        at = e
                    parts.append(raw[at:])
                    text = b"".join(parts).decode()
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns([removed_runs])

    changed = out.mapInArrow(run, docs.schema)
    return changed.select(*(F.col(f"`{name if c == 'doc_id' else c}`").alias(c) for c in names))
