"""Hard negatives of anchors by bit-sliced integer products.

Components become whole numbers and are cut into bit-planes, each packed into 64-bit words, so the product of a row's plane
with an anchor is a sum of popcounts. Planes are taken most significant first. What the planes so far leave open lies in an
interval (all remaining bits 0 where the anchor's component is positive and 1 where it is negative, or the other way), so a
pair's score does too, and each plane narrows it. A pair goes as soon as its interval can't reach what its anchor still wants:

* positives: the least score among the best so far of the anchor's own label;
* negatives: the range of scores that the anchor's positives allow, and in it the best so far of each positive.

Anchors are a stated set of rows (ids divisible by `every`). They are taken in chunks of a bounded number of components; a
chunk is broadcast and meets all rows where they are, so no row is shuffled, whatever its label. Each task sends its best for
each anchor only, and, so that this does not grow with the number of tasks, only what is no worse than the k-th best of a
sixteenth of the rows, which are looked at first for this bound, after a sixteenth of them, and so on from what one task
holds. All rows count in the end; bounds only save work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.store import Scratch, small_batches

#: Components become floor(SCALE * x).
SCALE = 256
#: Vectors of this length or more (after scaling) take no part; below it all scores and intervals fit a long.
LONGEST = 1 << 26
#: Components of the anchors that are broadcast at once.
CHUNK = 1 << 21
#: Rows of a task's part of the table, and what is compared at once.
ROWS_A_TASK = 5_000
ROW_BLOCK, ANCHOR_BLOCK = 1024, 256
#: A pass for bounds reads so many times fewer rows than the next one.
BOUNDS = 16
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def prepared(embeddings: DataFrame, id_modulus: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part; where vec_id is divisible by id_modulus, label is (label + 1) % labels."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    length = F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e * float(SCALE * SCALE))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).where(length < float(LONGEST) ** 2)
    label = F.col("label").cast("long")
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % id_modulus == 0, (label + 1) % labels).otherwise(label).alias("label"),
        F.transform(x, lambda e: F.floor(e * float(SCALE)).cast("long")).alias("v"),
    )


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of numbers; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def planes(v: np.ndarray, bits: int) -> np.ndarray:
    """Words of bits by plane (least significant first; the last has the sign), row and word."""
    width = -(-v.shape[1] // 64) * 8
    out = np.zeros((bits, len(v), width), np.uint8)
    for j in range(bits):
        packed = np.packbits((v >> j) & 1, axis=1, bitorder="little")
        out[j, :, : packed.shape[1]] = packed
    return out.view("<u8")


def weights(bits: int) -> list[int]:
    return [1 << j for j in range(bits - 1)] + [-(1 << (bits - 1))]


class Anchors:
    """What tasks need to know of a block of anchors."""

    def __init__(self, row: np.ndarray, label: np.ndarray, v: np.ndarray, bits: int) -> None:
        self.row, self.label, self.planes = row, label, planes(v, bits)
        self.up, self.down = np.maximum(v, 0).sum(axis=1), np.minimum(v, 0).sum(axis=1)

    def product(self, words: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Of one plane's words (rows x words, or with a new axis before the words) with the anchors at those places."""
        total: np.ndarray | int = 0
        for w, q in zip(weights(len(self.planes)), self.planes, strict=True):
            q = q[at]
            count = sum(np.bitwise_count(words[..., k] & q[..., k]).astype(np.int64) for k in range(q.shape[-1]))
            total = total + w * count
        return total


def scored(rows: np.ndarray, anchors: Anchors, low: np.ndarray, high: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows and anchors and scores of the pairs whose score lies between the anchor's low and high. rows: planes; live: the pairs that count."""
    w, every = weights(len(rows)), slice(None)
    part = np.zeros(live.shape, np.int64)
    live = live & (low <= high)
    for j in reversed(range(len(rows))):
        part += w[j] * anchors.product(rows[j][:, None, :], every)
        rest = (1 << j) - 1
        live &= (part + rest * anchors.up >= low) & (part + rest * anchors.down <= high)
        if live.mean() < 1 / 8:
            break
    r, a = np.nonzero(live)
    s = part[r, a]
    for k in reversed(range(j)):
        s = s + w[k] * anchors.product(rows[k][r], a)
        rest = (1 << k) - 1
        keep = (s + rest * anchors.up[a] >= low[a]) & (s + rest * anchors.down[a] <= high[a])
        r, a, s = r[keep], a[keep], s[keep]
    return r, a, s


class Best:
    """The first k of each group by score (highest first), id and row; floor: each group's least score that can still matter."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.k = floor.copy(), k
        self.rows = np.zeros((4, 0), np.int64)  # group, score, id, row

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        x = np.concatenate([self.rows, np.stack([group, score, ids, row])], axis=1)
        x = x[:, np.lexsort((x[3], x[2], -x[1], x[0]))]
        rank = np.arange(x.shape[1]) - np.searchsorted(x[0], x[0])
        self.rows = x[:, rank < self.k]
        last = x[:, rank == self.k - 1]
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[1])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        v = matrix(batch.column("v"), width)
        row, ids, label = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        order = np.argsort(label, kind="stable")
        for i in range(0, len(order), ROW_BLOCK):
            at = order[i : i + ROW_BLOCK]
            yield row[at], ids[at], label[at], v[at]


_FOUND = "anchor long, slot int, score long, vec_id long, row long"


def _sent(bests: list[Best], anchors: list[Anchors], slots: int) -> Iterator[pa.RecordBatch]:
    for best, a in zip(bests, anchors, strict=True):
        group, score, ids, row = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(a.row[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(ids), pa.array(row)], names=["anchor", "slot", "score", "vec_id", "row"])


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and slot, with rank (from 1)."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def same_label(rows: DataFrame, anchors, width: int, k: int, floors) -> DataFrame:
    """Of each anchor the first k other rows of its label (slot 0). anchors, floors: broadcasts of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Anchors] = anchors.value
        bests = [Best(f, k) for f in floors.value]
        for row, ids, label, v in _blocks(batches, width):
            x = planes(v, len(blocks[0].planes))
            for a, best in zip(blocks, bests, strict=True):
                mine = np.flatnonzero(np.isin(label, a.label))
                if not len(mine):
                    continue
                live = (label[mine][:, None] == a.label) & (row[mine][:, None] != a.row)
                r, c, s = scored(x[:, mine], a, best.floor, np.full(len(a.row), _MOST), live)
                best.add(c, s, ids[mine[r]], row[mine[r]])
        yield from _sent(bests, blocks, 1)

    return first_of(rows.mapInArrow(run, _FOUND), k)


def other_label(rows: DataFrame, anchors, width: int, k: int, ranges) -> DataFrame:
    """Of each anchor and slot the first k rows of other labels whose score lies in the slot's range. ranges: a broadcast of (low, high, floor) by block and anchor * slots + slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Anchors] = anchors.value
        slots = len(ranges.value[0][0]) // len(blocks[0].row)
        bests = [Best(np.maximum(low, floor), k) for low, _, floor in ranges.value]
        tops = [high.reshape(-1, slots) for _, high, _ in ranges.value]
        for row, ids, label, v in _blocks(batches, width):
            x = planes(v, len(blocks[0].planes))
            for a, best, top in zip(blocks, bests, tops, strict=True):
                floor = best.floor.reshape(-1, slots)
                wanted = floor <= top
                low = np.where(wanted, floor, _MOST).min(axis=1)
                high = np.where(wanted, top, _LEAST).max(axis=1)
                r, c, s = scored(x, a, low, high, label[:, None] != a.label)
                for slot in range(slots):
                    ok = (s >= floor[c, slot]) & (s <= top[c, slot])
                    best.add(c[ok] * slots + slot, s[ok], ids[r[ok]], row[r[ok]])
        yield from _sent(bests, blocks, slots)

    return first_of(rows.mapInArrow(run, _FOUND), k)


def steps(tasks: int) -> list[int]:
    """By what the passes for bounds divide the rows, the smallest pass first: what it reads fits a task or so."""
    out = [BOUNDS]
    while out[0] < tasks:
        out.insert(0, out[0] * BOUNDS)
    return out


def _table(df: DataFrame) -> dict[str, np.ndarray]:
    return {name: column.to_numpy() for name, column in zip(df.columns, df.toArrow().columns, strict=True)}


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; embeddings (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by every; a row's score is its integer inner product with the anchor. Of an
    anchor and each of its first `positives` other rows of its label: the first `negatives` rows of other labels whose score is
    at least least % and at most most % of the positive's. Higher scores come first, then smaller ids, then (rows with one id)
    earlier rows; rows that repeat are rows of their own, anchors and positives too. Rows with a null id, label or vector, a
    null or non-finite component, or a vector of a length of 2**18 or more (its scores could leave a long) take no part; of
    vectors of different sizes the missing components count as 0, so an empty one scores 0. A positive with a negative score
    has no negatives. Other columns are ignored; no anchors, no rows.
    """
    spark = embeddings.sparkSession
    scratch, out = Scratch(), Scratch()
    table = scratch.written(prepared(small_batches(embeddings)).withColumn("row", F.monotonically_increasing_id()))
    is_anchor = F.col("vec_id") % every == 0
    count, n_anchors, width, largest, smallest = table.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width, bits = max(1, width or 0), 1 + max(int(largest or 0).bit_length(), (-int(smallest or 0) - 1).bit_length() if (smallest or 0) < 0 else 0, 1)
    tasks = max(1, -(-count // ROWS_A_TASK))
    rows = scratch.keep(table.repartition(tasks, "row"))
    samples = [rows.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).coalesce(max(1, tasks // step)) for step in steps(tasks)]
    names = table.select(F.col("row"), F.col("vec_id").alias("id"))
    chunks = max(1, -(-n_anchors * width // CHUNK))
    found = []
    for chunk in range(chunks):
        got = table.where(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk)).select("row", "label", "v").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        row, label, v = got["row"].to_numpy(), got["label"].to_numpy(), matrix(got["v"].combine_chunks(), width)
        order = np.argsort(label, kind="stable")
        cuts = [order[i : i + ANCHOR_BLOCK] for i in range(0, len(order), ANCHOR_BLOCK)]
        blocks = [Anchors(row[c], label[c], v[c], bits) for c in cuts]
        where = {r: (b, i) for b, c in enumerate(cuts) for i, r in enumerate(row[c].tolist())}
        shared = [spark.sparkContext.broadcast(blocks)]

        def spread(values: np.ndarray, anchor: np.ndarray, slot: np.ndarray, slots: int, missing: int, blocks=blocks, where=where) -> list[np.ndarray]:
            """Values by block and anchor * slots + slot."""
            out = [np.full(len(a.row) * slots, missing, np.int64) for a in blocks]
            for x, a, s in zip(values.tolist(), anchor.tolist(), slot.tolist(), strict=True):
                b, i = where[a]
                out[b][i * slots + s] = x
            return out

        def told(values: list):
            shared.append(spark.sparkContext.broadcast(values))
            return shared[-1]

        def bounds(best, k: int, slots: int, spread=spread, blocks=blocks) -> list[np.ndarray]:
            """The k-th best of each sample, where there are as many: the k-th best of all rows can't be lower. best: from rows and floors so far."""
            floors = [np.full(len(a.row) * slots, _LEAST, np.int64) for a in blocks]
            for sample in samples:
                x = _table(best(sample, floors).where(F.col("rank") == k).select("anchor", "slot", "score"))
                floors = [np.maximum(a, b) for a, b in zip(floors, spread(x["score"], x["anchor"], x["slot"], slots, _LEAST), strict=True)]
            return floors

        alike = lambda some, floors: same_label(some, shared[0], width, positives, told(floors))
        near = scratch.written(alike(rows, bounds(alike, positives, 1)).select("anchor", (F.col("rank") - 1).alias("slot"), "score", F.col("vec_id").alias("positive_id")))
        x = _table(near.select("anchor", "slot", "score"))
        none = x["score"] < 0  # 50 % of it would be more than 95 %
        low, high = np.where(none, _MOST, -(-x["score"] * least // 100)), np.where(none, _LEAST, x["score"] * most // 100)
        lows, highs = spread(low, x["anchor"], x["slot"], positives, _MOST), spread(high, x["anchor"], x["slot"], positives, _LEAST)
        unlike = lambda some, floors: other_label(some, shared[0], width, negatives, told(list(zip(lows, highs, floors, strict=True))))
        hard = unlike(rows, bounds(unlike, negatives, positives)).select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        joined = hard.join(near.withColumnRenamed("score", "positive_score"), ["anchor", "slot"]).join(names, F.col("anchor") == F.col("row"))
        found.append(out.written(joined.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
        for b in shared:
            b.destroy()
    scratch.release()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*out.paths) if found else spark.createDataFrame([], schema)


ORACLE_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b) QUALIFY row_number() OVER w <= 3
"""
