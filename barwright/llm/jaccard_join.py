"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets are one node (a hash of the set),
so exact copies never meet as pairs.

1. A shingle is as rare as its rarest word at least. Words are counted by a sketch of fixed size over all documents; a set is
   ordered by its shingles' rarest word's count, then by hash, so the rarest shingles come first. (Any common order gives
   right results; a rare-first one keeps lists short: most texts have enough shingles with a word of their own.)
2. Two sets that are similar enough share a shingle of their prefixes. Prefix shingles go through one shuffle, packed by
   bucket (24 bytes each); those that one node alone has are dropped there. What remains are the lists of nodes by shingle.
   Of lists with the same nodes only that of the first shingle in the order stays: two near copies share most of their
   prefixes, and one list is enough to meet.
3. In each list, pairs must pass the length filter, the positional filter (by the first shingle that two sets share, what
   lies behind it bounds what they share), and the suffix filter: a bitmap of `SIGNATURE_BITS` holds for each place the parity
   of the number of shingles there, so the bits in which two bitmaps differ are at most the elements that are in one set only.
4. Verified links make components. The first rounds send, of the pairs of a task that pass, only as many as would join their
   components if all were links; the last round sends every pair that passes between nodes of different components. So
   every pair that passes the filters was verified or lies within one component, no link between components is lost, and
   a large group of near copies costs about its size.
5. A list longer than BLOCK is dealt into blocks. In the last rounds the members of its largest component need not meet
   each other: they are copied for each block of the other nodes only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets
from barwright.llm.components import components
from barwright.llm.store import BROADCAST_IDS, Scratch, distinct_ids, files_for, join_by_weight, small_batches, without, written

SKETCH_BITS = 22
SLICES = 16
#: Partial sketches added up by one task.
FAN_IN = 32
SIGNATURE_BITS = 1024
BLOCK = 1024
#: By round: partners of a node in a list, and whether only pairs that would join components are sent. The last round has no end.
ROUNDS = ((2, True), (1 << 60, True), (1 << 60, False))
#: Different pairs that a task holds before it sends them.
HELD_PAIRS = 500_000
#: Rows of prefixes that a task holds before it sends them, and of a bucket before it sends what it has.
HELD_ROWS = 500_000
BUCKET_ROWS = 4_000_000
#: Buckets for each shuffle partition at least; more if buckets would have more than a fourth of BUCKET_ROWS.
BUCKETS = 4
_POSTING = np.dtype([("shingle", "<i8"), ("node", "<i8"), ("n", "<i4"), ("place", "<i4")])
_U = np.uint64


def shingle_sets(column: pa.Array, n: int, word_counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by text and hash, the text of each, the sizes of the sets, and, with word_counts (a sketch), the count of each shingle's rarest word."""
    words = bytesets.Words(*bytesets.utf8(column), bytesets.SPACED_WORD)
    hashes, fits = words.shingles(n)
    counts = words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    values, texts = hashes[fits], owner[fits]
    rarest = np.zeros(len(values), np.uint32)
    if word_counts is not None and len(values):
        c = word_counts[bucket_of(words.hashes)]
        rarest = np.lib.stride_tricks.sliding_window_view(c, n).min(axis=1)[np.flatnonzero(fits)]
    if len(short):
        values, texts, rarest = np.concatenate([values, words.whole()[short]]), np.concatenate([texts, short]), np.concatenate([rarest, np.zeros(len(short), np.uint32)])
    values, texts, at = bytesets.distinct_in_texts(values, texts)
    return values, texts, np.bincount(texts, minlength=len(counts)), rarest[at]


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - SKETCH_BITS)).astype(np.int64)


def set_hash(values: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole set, as a signed 64-bit number."""
    ends = np.cumsum(sizes)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(bytesets.mixed(values), out=sums[1:])
    return bytesets.mixed((sums[ends] - sums[ends - sizes]) * _U(0xA24BAED4963EE407) + sizes.astype(_U)).view(np.int64)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches):
            values, texts, sizes, _ = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(set_hash(values, texts, sizes))], names=["doc_id", "n_shingles", "node"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long")


def sketch(docs: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur in all documents (2**SKETCH_BITS buckets of 4 bytes, whatever the input)."""
    width = (1 << SKETCH_BITS) // SLICES
    most = 0xFFFFFFFF

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in bytesets.chunks(batches):
            at, c = np.unique(bucket_of(bytesets.Words(*bytesets.utf8(batch.column("text")), bytesets.SPACED_WORD).hashes), return_counts=True)
            total[at] += c
        blobs = [zlib.compress(x.tobytes(), 1) for x in np.minimum(total, most).astype("<u4").reshape(SLICES, width)]
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["at", "slice", "counts"])

    def add(key, table):
        total = np.zeros(width, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        blob = zlib.compress(np.minimum(total, most).astype("<u4").tobytes(), 1)  # it stops at the largest number
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([blob], pa.binary())})

    parts, schema = docs.select("text").mapInArrow(count, "at int, slice int, counts binary"), "at int, slice int, counts binary"
    tasks = docs.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("at", F.floor(F.col("at") / FAN_IN).cast("int")).groupBy("at", "slice").applyInArrow(add, schema)
        if tasks <= 1:
            break
    rows = {r["slice"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), "<u4") for r in parts.collect()}
    return np.concatenate([rows.get(k, np.zeros(width, "<u4")) for k in range(SLICES)])


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    """Rows sorted by shingle and node, each pair of them once."""
    rows = rows[np.lexsort((rows["node"], rows["shingle"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    return rows[new]


def prefixes(docs: DataFrame, n: int, percent: int, counts, buckets: int) -> DataFrame:
    """bucket, packed: the prefix of every set, rarest shingles first, as _POSTING rows by bucket of the shingle."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = distinct_rows(np.concatenate(held))  # copies are one
        bucket = rows["shingle"].view(_U) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        names, first = np.unique(bucket, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, first[1:])], pa.binary())], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        held: list[np.ndarray] = []
        size = 0
        for batch in bytesets.chunks(batches):
            values, texts, sizes, rarest = shingle_sets(batch.column("text"), n, known)
            node = set_hash(values, texts, sizes)
            order = np.lexsort((values, rarest, texts))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            length = sizes - -(-percent * sizes // 100) + 1
            inside = place < length[texts]
            at = texts[inside]
            rows = np.empty(len(at), _POSTING)
            rows["shingle"], rows["node"], rows["n"], rows["place"] = values[order][inside].view(np.int64), node[at], sizes[at], place[inside]
            held.append(rows)
            size += len(rows)
            if size >= HELD_ROWS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return docs.select("text").mapInArrow(run, "bucket int, packed binary")


def shared_lists(postings: DataFrame) -> DataFrame:
    """shingle, node, n, place, part: prefix shingles that two nodes or more have. part: of a bucket that was too large to hold, which is sent in parts; there, shingles of one node and repeated rows may be left."""

    def several(held: list[np.ndarray], part: bool) -> Iterator[pa.RecordBatch]:
        rows = distinct_rows(np.concatenate(held))
        new = np.ones(len(rows), bool)
        new[1:] = rows["shingle"][1:] != rows["shingle"][:-1]
        length = np.diff(np.append(np.flatnonzero(new), len(rows)))
        rows = rows[np.repeat((length > 1) | part, length)]
        for k in range(0, len(rows), 100_000):
            some = rows[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[c])) for c in ("shingle", "node", "n", "place")] + [pa.array(np.full(len(some), part))], names=["shingle", "node", "n", "place", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of one bucket
        bucket, size, part = None, 0, False
        for batch in batches:
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
                if b != bucket:
                    if held:
                        yield from several(held, part)
                    held, bucket, size, part = [], b, 0, False
                elif size > BUCKET_ROWS:
                    part = True
                    yield from several(held, part)
                    held, size = [], 0
                held.append(np.frombuffer(packed.as_buffer(), _POSTING))
                size += len(held[-1])
        if held:
            yield from several(held, part)
        bytesets.give_back()

    return postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shingle long, node long, n int, place int, part boolean")


def different_lists(lists: DataFrame) -> DataFrame:
    """shingle, node, n, place, length (of the list): of lists with the same nodes, that of the shingle that comes first in the order.

    Two sets' first common shingle has a list that stays, as no other list with the same nodes can come before it.
    """
    heads = lists.groupBy("shingle").agg(F.count("*").alias("length"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"), F.min_by("place", "node").alias("place"), F.max("part").alias("part"))
    alone = F.when(F.col("part"), F.col("shingle")).alias("alone")  # rows may repeat there, so hashes don't tell lists apart
    kept = heads.where("length > 1").groupBy("length", "h1", "h2", alone).agg(F.min_by("shingle", "place").alias("shingle"))
    return join_by_weight(lists.drop("part"), kept.select("shingle", "length", F.col("length").alias("rows")), ["shingle"], "rows")


def signatures(values: np.ndarray, texts: np.ndarray, n_texts: int) -> np.ndarray:
    """A row of bits for each set: the parity of the number of its shingles at each of SIGNATURE_BITS places."""
    out = np.zeros(n_texts * SIGNATURE_BITS // 8, np.uint8)
    at, times = np.unique(texts * SIGNATURE_BITS + (values >> _U(64 - SIGNATURE_BITS.bit_length() + 1)).astype(np.int64), return_counts=True)
    odd = at[times % 2 == 1]
    np.add.at(out, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
    return out.reshape(n_texts, SIGNATURE_BITS // 8)


def whole_sets(docs: DataFrame, ids: DataFrame, n: int, members: bool) -> DataFrame:
    """doc_id, node, n and signature, or the set's members, of the documents in ids (doc_id)."""
    column = "members" if members else "signature"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches):
            values, texts, sizes, _ = shingle_sets(batch.column("text"), n)
            if members:
                ends = np.cumsum(sizes)
                blobs = [values[e - k : e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
            else:
                blobs = [x.tobytes() for x in signatures(values, texts, len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(set_hash(values, texts, sizes)), pa.array(sizes.astype(np.int32)), pa.array(blobs, pa.binary())], names=["doc_id", "node", "n", column])

    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text").mapInArrow(run, f"doc_id long, node long, n int, {column} binary")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by keys, in parts that hold whole runs of equal keys."""
    rest: pa.Table | None = None

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        return {c: (t.column(c).to_numpy() if not pa.types.is_binary(t.schema.field(c).type) else np.array(t.column(c).to_pylist(), object)) for c in t.column_names}

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = np.ones(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            last &= x == x[-1] if len(x) else True
        cut = int(np.argmax(last)) if len(last) else 0
        if cut:
            yield arrays(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield arrays(rest)


def passing(x: dict[str, np.ndarray], percent: int, most: int) -> np.ndarray:
    """Pairs of rows of the same key (shingle, left, right), of different components, that pass the filters (the suffix filter only where x has signatures).

    A column for each pair: both nodes, their components, and by how much the pair passes the suffix filter (0 without signatures).
    Of each row, the first `most` such partners among the front rows before it.
    """
    order = np.lexsort((x["node"], x["n"], -x["front"], x["right"], x["left"], x["shingle"]))
    shingle, left, right, node, n, place, comp, side, front = (x[c][order] for c in ("shingle", "left", "right", "node", "n", "place", "comp", "side", "front"))
    n, place = n.astype(np.int64), place.astype(np.int64)
    bits = np.frombuffer(b"".join(x["signature"][order]), _U).reshape(len(order), -1) if "signature" in x else None
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(new)))
    begin = np.repeat(first, sizes)
    partners = np.minimum(np.arange(len(new)) - begin, np.repeat(np.add.reduceat(front.astype(np.int64), first), sizes)) if len(first) else np.zeros(0, np.int64)
    seen = np.zeros(len(new), np.int64)
    found: list[np.ndarray] = [np.zeros((5, 0), np.int64)]
    live = np.flatnonzero(partners > 0)
    step = 0
    while len(live):
        i, j = live, begin[live] + step
        ok = (comp[i] != comp[j]) & ((left[i] == right[i]) | (side[i] != side[j]))  # no pair of one block in a pair of blocks
        i, j = i[ok], j[ok]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= need)
        i, j, room = i[ok], j[ok], (n[i] + n[j] - 2 * need)[ok]
        if bits is not None and len(i):
            room = room - np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            ok = room >= 0
            i, j, room = i[ok], j[ok], room[ok]
        seen[i] += 1
        found.append(np.stack([node[i], node[j], comp[i], comp[j], room]))
        step += 1
        live = live[(partners[live] > step) & (seen[live] < most)]
    return np.concatenate(found, axis=1)


def partnered(lists: DataFrame, percent: int) -> DataFrame:
    """The nodes that have a partner by length and position in some list, and all nodes of lists longer than BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, ["shingle"]):
            none = np.zeros(len(x["node"]), np.int64)
            pairs = passing(x | {"left": none, "right": none, "side": none, "front": none + 1, "comp": x["node"]}, percent, 1 << 60)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(pairs[:2]))], names=["node"])

    short = lists.where(F.col("length") <= BLOCK).select("shingle", "node", "n", "place").repartition("shingle").sortWithinPartitions("shingle")
    return short.mapInArrow(run, "node long").unionByName(lists.where(F.col("length") > BLOCK).select("node")).distinct()


def dealt(lists: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """lists (shingle, node, n, place, signature) with comp, and the keys under which rows meet: shingle, left, right, side, front (see `passing`).

    Without labels every node is a component, and a row goes to its own block only: what is found so is but a first part of
    the links. With labels (those of nodes without links may be missing), lists within one component go; nodes of a list's
    largest component meet the other nodes, and these meet each other, in all pairs of blocks.
    """
    own = lambda blocks: F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1))).cast("int")
    zero = F.lit(0)
    if labels is None:
        block = own(F.ceil(F.col("length") / BLOCK).cast("int"))
        return lists.select("shingle", "node", "n", "place", "signature", F.col("node").alias("comp"), block.alias("left"), block.alias("right"), zero.alias("side"), F.lit(1).alias("front"))
    now = lists.drop("length").join(labels.withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = now.groupBy("shingle", "comp").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("comp", "c").alias("top"), F.max("c").alias("most"), F.sum("c").alias("length"))
    sizes = scratch.written(sizes.where("most < length").withColumn("rows", F.col("length")))
    now = join_by_weight(now, sizes, ["shingle"], "rows")
    rest = F.col("comp") != F.col("top")
    blocks, top_blocks = F.ceil((F.col("length") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    key = lambda left, right, side, front: F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), side.cast("int").alias("side"), front.cast("int").alias("front"))
    s, t = own(blocks), own(top_blocks)
    among = F.transform(F.sequence(zero, blocks - 1), lambda o: key(F.least(s, o), F.greatest(s, o), s < o, s >= o))
    against = F.transform(F.sequence(zero, top_blocks - 1), lambda o: key(s, blocks + o, zero, F.lit(1)))
    of_top = F.transform(F.sequence(zero, blocks - 1), lambda o: key(o, blocks + t, F.lit(1), zero))
    keys = F.when(F.col("length") <= BLOCK, F.array(key(zero, zero, zero, rest))).when(rest, F.concat(among, against)).otherwise(of_top)
    return now.select("shingle", "node", "n", "place", "signature", "comp", F.inline(keys))


def joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs join two parts, if all pairs before them were joined."""
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(int(at.max()) + 1 if len(at) else 0))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            out[i] = True
    return out


def candidates(rows: DataFrame, percent: int, most: int, only_joining: bool) -> DataFrame:
    """Distinct pairs a < b of one round. rows: what `dealt` gave."""
    keys = ["shingle", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.minimum(held[0], held[1])), pa.array(np.maximum(held[0], held[1]))], names=["a", "b"])
        for x in runs(batches, keys):
            held = np.concatenate([held, passing(x, percent, most)], axis=1)
            if only_joining:  # the likeliest links first
                held = held[:, np.argsort(-held[4], kind="stable")]
                held = held[:, joining(held[2], held[3])]
            else:  # a pair passes in several lists that it shares
                held = held[:, np.unique(np.stack([np.minimum(held[0], held[1]), np.maximum(held[0], held[1])]), axis=1, return_index=True)[1]]
            if held.shape[1] >= HELD_PAIRS:
                yield out()
                held = held[:, :0]
        yield out()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets are similar enough."""
    members = sets.select("node", "members")
    side = lambda c: members.select(F.col("node").alias(c), F.col("members").alias(f"{c}_members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, documents: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Components of the nodes that have links (node, label; a table of scratch). documents: what sets_of gave."""
    own = Scratch()
    try:
        counts = docs.sparkSession.sparkContext.broadcast(sketch(docs))
        postings = documents.agg(F.sum(F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1)).first()[0] or 0
        buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * postings // BUCKET_ROWS))
        # tables are written where more is built on them, so that plans stay short
        lists = own.written(different_lists(own.keep(shared_lists(prefixes(docs, n, percent, counts, buckets)))))
        one = documents.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        nodes = own.written(partnered(lists, percent).join(one, "node").select("doc_id"))
        if nodes.isEmpty():
            return None
        unlinked = docs.sparkSession.createDataFrame([], "node long, label long")
        sets = scratch.table(whole_sets(docs, nodes, n, members=False))
        lists = scratch.table(lists.join(sets.select("node", "signature"), "node"))
        own.release()
        labels = found = None
        for most, only_joining in ROUNDS:
            pairs = own.written(candidates(dealt(lists, labels, own), percent, most, only_joining))
            if labels is None:  # from the second round on all pairs of blocks meet, also if the first found no link
                labels = unlinked
            wanted = own.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "doc_id"), "node").select("doc_id"))
            if not wanted.isEmpty():
                new = scratch.written(verified(pairs, own.keep(whole_sets(docs, wanted, n, members=True)), percent))
                if not new.isEmpty():
                    found = new if found is None else found.unionByName(new)
                    labels = components(found, scratch)
            own.release()
        return labels
    finally:
        own.release()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every document (doc_id, text).

    Documents link if 100 * intersection >= percent * union of their sets of n-word shingles. Null and empty texts, and texts
    without words, have empty sets and no links: each is a component of its own. Texts of fewer than n words are one shingle.
    Equal rows are copies. A row with a null doc_id is linked to what a copy with a doc_id is linked to; without one it is
    linked to its copies only, and their component is null. Other columns are ignored; an empty table gives no rows.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch()
    documents = Scratch().table(sets_of(docs, n))
    labels = links(docs, documents, n, percent, scratch)
    some = documents.where("n_shingles > 0")
    if labels is not None:
        some = some.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        some = some.withColumn("label", F.col("node"))
    least = some.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = written(some.join(least, "label").select("doc_id", "n_shingles", "component_id").coalesce(files_for(docs.count())))
    scratch.release()
    return out.unionByName(documents.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null ids last; of equal ids the first row of the table). All columns stay."""
    numbered, name = distinct_ids(docs)
    same = near_duplicates(numbered, n, percent)
    if name == "doc_id":
        dropped = same.where("doc_id <> component_id").select("doc_id")
    else:
        ids = numbered.select("doc_id", F.col(f"`{name}`").alias("id"))
        first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id"))).alias("first")
        kept = same.join(ids, "doc_id").groupBy("component_id").agg(first).select("component_id", F.col("first.doc_id").alias("kept"))
        dropped = same.join(kept, "component_id").where("doc_id <> kept").select("doc_id")
    out = without(numbered, written(dropped.coalesce(files_for(docs.count()))))
    return out if name == "doc_id" else out.drop("doc_id").withColumnRenamed(name, "doc_id").select(*docs.columns)
