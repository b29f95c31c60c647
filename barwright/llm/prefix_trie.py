"""The trie of conversation prefixes, from the sorted conversations and the lengths of their common prefixes.

A conversation is the sequence of its turns' fingerprints (128 bits of role and text), 16 bytes a turn; texts go no further.
Conversations are sorted by that sequence, then id, and dealt in that order to blocks of a bounded number of turns. With L(i)
the number of turns that conversation i shares with the one before it, a node of depth d is a stretch of conversations between
two places where L is less than d. In a block:

* all nearest smaller values of L, to the left and right, give the Cartesian tree: each value spans the stretch between its
  two; equal values with one stretch are one node, kept at the first of them;
* depths that have no value of their own (between a stretch's value and its parent's, and below all values up to each
  conversation's length) are filled in, each a node with one child;
* counts, sums and minima over stretches are differences of running sums, and a sparse table.

Nodes that reach over a block's border are known there by depth: those that come in (depths up to L of the block's first
conversation) and those that go out (up to that of the next block's first). Their pieces, at most as many a border as its two
conversations share turns, are joined by the block's minima: a piece that comes in belongs to the nearest block to the left in
which L falls below its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.sharding import CRC_TABLE, crc_sql
from barwright.llm.store import Scratch, small_batches

#: Bytes of a turn's fingerprint.
PRINT = 16
#: Turns in a block, and the least a block is cut to where there are more shuffle partitions than blocks.
TURNS_A_BLOCK, LEAST_TURNS = 65_536, 2_048
#: Conversations c - c % FAMILY to the next share their first turns.
FAMILY, HEADS = 5, 9


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (the fingerprints of its turns), sizes (bytes of its texts) of every rebuilt conversation.

    c has the first h turns of conversation c - c % 5 (h = CRC-32 of c in decimals % 9), then its own after its first h. Turns
    go by number (null first), then role, then fingerprint; null roles and texts count as empty; rows with a null conv_id belong to none.
    One shuffle: a family's conversations come together, as fingerprints.
    """
    c = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    mark = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * PRINT)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    turns = conversations.where(c.isNotNull()).select((c - c % FAMILY).alias("base"), c.alias("conv_id"), turn.alias("t"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    families = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "ts")).alias("members"))
    base = F.filter("members", lambda m: m["conv_id"] == F.col("base"))
    heads = families.withColumn("head", F.coalesce(F.slice(F.get(base, F.lit(0))["ts"], 1, HEADS - 1), F.expr("slice(members[0].ts, 1, 0)")))
    each = heads.select("head", F.inline("members"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS).cast("int")
    ts = each.withColumn("h", h).withColumn("ts", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("ts", F.col("h") + 1, F.size("ts"))))
    return ts.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["mark"]), "")).alias("key"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Fingerprints that two keys begin with alike."""
    if a == b:
        return len(a) // PRINT
    n, lo = min(len(a), len(b)) // PRINT, 0
    while lo < n and a[PRINT * lo : PRINT * lo + PRINT] == b[PRINT * lo : PRINT * lo + PRINT]:
        lo += 1
    return lo


def nearest_smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the nearest with a smaller value to the left (-1: none) and right (len: none), and whether no equal value lies between it and the left one."""
    n = len(x)
    left, right, first = np.full(n, -1), np.full(n, n), np.ones(n, bool)
    stack: list[int] = []
    values = x.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack and values[stack[-1]] == v:
            j = stack[-1]
            left[i], first[i] = left[j], False
            right[j] = -1 - i  # as far as the equal one reaches
            stack[-1] = i
        else:
            left[i] = stack[-1] if stack else -1
            stack.append(i)
    for i in range(n - 1, -1, -1):
        if right[i] < 0:
            right[i] = right[-1 - right[i]]
    return left, right, first


class Minima:
    """Least values of stretches [a, b]."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k) + 1])
        return out


class Counts:
    """How often a value occurs in stretches [a, b]."""

    def __init__(self, x: np.ndarray) -> None:
        self.n = len(x) + 2
        self.found = np.sort((x + 1) * self.n + np.arange(len(x)))

    def __call__(self, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = (value + 1) * self.n
        return np.searchsorted(self.found, v + b, "right") - np.searchsorted(self.found, v + a, "left")


_OUT = "kind string, block long, depth int, side string, conv_id long, parent long, parent_depth int, parent_side string, n_convs long, n_children long, n_leaves long, saved_tokens long, before long, ends string, started boolean, outgoing boolean"
_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in _OUT.split(", ")])


def block_nodes(block: int, conv: np.ndarray, keys: list[bytes], sizes: list[np.ndarray], before: bytes | None, after: bytes | None) -> pd.DataFrame:
    """A block's nodes, as rows of _OUT: kind node, or piece of one that reaches over the block's borders.

    Of pieces, n_children counts values equal to the depth less conversations that end there (children less 1), saved_tokens is the
    sum of the bytes shared, and before is the bytes of the turns above a started node; ends lists the ids of conversations that end there.
    """
    m = len(conv)
    lengths = np.array([len(k) // PRINT for k in keys])
    shared = [-1 if before is None else shared_turns(before, keys[0])] + [shared_turns(a, b) for a, b in zip(keys, keys[1:])]
    last = -1 if after is None else shared_turns(keys[-1], after)
    e = np.array([*shared, last])
    sums = [np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in sizes]
    above = lambda i, d: int(sums[i][d - 1]) if d > 0 else 0  # bytes of the turns above depth d
    alike = np.concatenate([[0], np.cumsum([s[max(k, 0)] for s, k in zip(sums, shared, strict=True)])])
    leaves = np.concatenate([[0], np.cumsum(e[1:] < lengths)])
    least, equal, ended = Minima(conv), Counts(e[:-1]), Counts(lengths)
    left, right, first = nearest_smaller(e)
    ids = lambda a, b: ",".join(map(str, conv[a:b].tolist()))

    # whole nodes: stretches [l, r] for depths from low + 1 to high
    j = np.flatnonzero(first & (left >= 0) & (right <= m))
    j = j[j < m]
    i = np.arange(m)
    l, r = np.concatenate([left[j], i]), np.concatenate([right[j] - 1, i])
    low, high = np.concatenate([np.maximum(e[left[j]], e[right[j]]), np.maximum(e[i], e[i + 1])]), np.concatenate([e[j], lengths])
    some = high > low
    l, r, low, high = l[some], r[some], low[some], high[some]
    n = high - low
    at = np.repeat(np.arange(len(l)), n)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at] + 1
    a, b = l[at], r[at]
    count, smallest, end = b - a + 1, least(l, r)[at], ended(depth, a, b)
    parent_at = np.where(e[l] >= e[r + 1], l, r + 1)  # the value that spans the parent
    p_left, p_right = left[parent_at], right[parent_at]
    whole = (p_left >= 0) & (p_right <= m)
    p_least = np.where(whole, 0, -1)
    p_least[whole] = least(p_left[whole], p_right[whole] - 1)
    top = depth == low[at] + 1
    inside = ~top | whole[at]
    nodes = pd.DataFrame(
        {
            "kind": "node",
            "block": block,
            "depth": depth,
            "side": None,
            "conv_id": smallest,
            "parent": pd.array(np.where(top, p_least[at], smallest), "Int64"),
            "parent_depth": pd.array(np.where(inside, 0, depth - 1), "Int64"),
            "parent_side": np.where(p_left[at] < 0, "L", "R"),
            "n_convs": count,
            "n_children": equal(depth, a + 1, b) + 1 - end,
            "n_leaves": leaves[b + 1] - leaves[a],
            "saved_tokens": alike[b + 1] - alike[a + 1] - (count - 1) * np.array([above(x, d) for x, d in zip(a.tolist(), depth.tolist(), strict=True)], np.int64).reshape(-1),
            "before": 0,
            "ends": [hashlib.sha256(ids(x, x + k).encode()).hexdigest() if k else None for x, k in zip(a.tolist(), end.tolist(), strict=True)],
            "started": True,
            "outgoing": False,
        }
    )
    nodes.loc[~inside, "parent"] = pd.NA
    nodes.loc[inside, ["parent_depth", "parent_side"]] = pd.NA
    nodes.loc[nodes["depth"] == 0, ["parent", "parent_depth", "parent_side"]] = pd.NA

    # pieces: those that come in, and those that start here and go out
    pieces = []
    d = np.arange(e[0] + 1)
    stop = np.searchsorted(-np.minimum.accumulate(e[1:]), -d, "right")  # the first of e[1:] below d
    pieces.append(("L", d, np.zeros_like(d), np.minimum(stop, m - 1), stop >= m))
    d = np.arange(last + 1)
    start = m - 1 - np.searchsorted(-np.minimum.accumulate(e[:-1][::-1]), -d, "right")
    d, start = d[start >= 0], start[start >= 0]
    pieces.append(("R", d, start, np.full_like(d, m - 1), np.ones(len(d), bool)))
    frames = [nodes]
    for side, d, a, b, out in pieces:
        k, own = ended(d, a, b), a + (side == "R")  # a node's first value is not its own
        frames.append(
            pd.DataFrame(
                {
                    "kind": "piece",
                    "block": block,
                    "depth": d,
                    "side": side,
                    "conv_id": least(a, b),
                    "n_convs": b - a + 1,
                    "n_children": equal(d, own, b) - k,
                    "n_leaves": leaves[b + 1] - leaves[a],
                    "saved_tokens": alike[b + 1] - alike[own],
                    "before": [above(x, y) for x, y in zip(a.tolist(), d.tolist(), strict=True)],
                    "ends": [ids(x, x + y) if y else None for x, y in zip(a.tolist(), k.tolist(), strict=True)],
                    "started": side == "R",
                    "outgoing": out,
                }
            )
        )
    names = [f.split()[0] for f in _OUT.split(", ")]
    return pd.concat([f for f in frames if len(f)], ignore_index=True).reindex(columns=names) if any(map(len, frames)) else nodes.reindex(columns=names)


def _hashes(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each node's ends; pieces come sorted by node and block, and only one node's state is held."""
    node, state = None, None
    for part in pieces:
        done = []
        for depth, start, ends in zip(part["depth"].tolist(), part["start"].tolist(), part["ends"].tolist(), strict=True):
            if (depth, start) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, start), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pd.DataFrame(done, columns=["depth", "start", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "start", "ends_sha256"])


def sorted_blocks(convs: DataFrame, turns: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """convs with block, in blocks that follow each other in the order of key and conv_id; and, for each block, the keys that come right before and after it."""
    partitions = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-turns // TURNS_A_BLOCK), min(partitions, -(-turns // LEAST_TURNS)))
    table = scratch.written(convs.repartitionByRange(blocks, "key", "conv_id").withColumn("block", F.spark_partition_id().cast("long")))
    ends = table.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("block")
    return table, ends.select("block", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))


def trie(convs: DataFrame, turns: int) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node. convs: conv_id (each once), key, sizes; turns: about how many there are."""
    scratch, out = Scratch(), Scratch()
    table, borders = sorted_blocks(small_batches(convs), turns, scratch)
    none = F.lit(None)
    member = table.select("block", F.lit(0).alias("place"), "conv_id", "key", "sizes")
    border = lambda c, place: borders.where(F.col(c).isNotNull()).select("block", F.lit(place).alias("place"), none.cast("long").alias("conv_id"), F.col(c).alias("key"), none.cast("array<bigint>").alias("sizes"))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("place", "ascending"), ("key", "ascending"), ("conv_id", "ascending")])
        place, keys = part["place"].to_numpy(), part["key"].to_pylist()
        own = part.filter(pa.array(place == 0))
        nodes = block_nodes(part["block"][0].as_py(), own["conv_id"].to_numpy(), [k for k, x in zip(keys, place, strict=True) if x == 0], own["sizes"].to_pylist(), keys[0] if place[0] < 0 else None, keys[-1] if place[-1] > 0 else None)
        return pa.Table.from_pandas(nodes, schema=_SCHEMA, preserve_index=False)

    found = out.written(member.unionByName(border("before", -1)).unionByName(border("after", 1)).groupBy("block").applyInArrow(run, _OUT))
    scratch.release()
    nodes, pieces = found.where("kind = 'node'"), found.where("kind = 'piece'")

    # a piece that comes in belongs to the nearest block to the left that started a node of its depth; within a block, L comes before R
    nearest = Window.partitionBy("depth").orderBy("block", "side").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("start", F.last(F.when(F.col("started"), F.col("block")), ignorenulls=True).over(nearest))
    whole = pieces.groupBy("depth", "start").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        (F.sum("n_children") + 1).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        (F.sum("saved_tokens") - (F.sum("n_convs") - 1) * F.sum(F.when(F.col("started"), F.col("before")))).alias("saved_tokens"),
    )
    listed = pieces.where("ends IS NOT NULL").select("depth", "start", "block", "side", "ends")
    hashes = listed.repartition("depth", "start").sortWithinPartitions("depth", "start", "block", "side").select("depth", "start", "ends").mapInPandas(_hashes, "depth int, start long, ends_sha256 string")
    whole = whole.join(hashes, ["depth", "start"], "left")
    # what a piece belongs to, by place: for parents of nodes within a block, and for parents of nodes that start in a block and leave it
    known = pieces.select("depth", "start", "block", "side", "outgoing").join(whole.select("depth", "start", F.col("conv_id").alias("_parent")), ["depth", "start"])
    above = known.where("outgoing").select((F.col("depth") + 1).alias("depth"), F.col("block").alias("start"), "_parent")
    whole = whole.join(above, ["depth", "start"], "left").select("conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inner = nodes.where("parent_depth IS NULL").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    places = known.select("block", F.col("depth").alias("parent_depth"), F.col("side").alias("parent_side"), F.col("_parent").alias("parent_conv_id"))
    outer = nodes.where("parent_depth IS NOT NULL").join(places, ["block", "parent_depth", "parent_side"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return inner.unionByName(outer).unionByName(whole).withColumns({"depth": F.col("depth").cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))})


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text; see `rebuilt`): a row for each distinct prefix, the empty one too.

    conv_id (the smallest that begins so), depth, parent_conv_id (of the prefix one turn shorter; null for the root), n_convs,
    n_children, n_leaves, saved_tokens (bytes that one copy of each prefix saves in its subtree), ends_sha256 (of the ids of the
    conversations that end there). A conversation that has no turns left is a member of the root only. Turns that repeat a
    number, or whole rows that repeat, are turns of their own. Rows with a null conv_id and other columns are ignored; an empty
    table gives no rows, not even a root. A conversation must fit a row, as fingerprints of 16 bytes and sizes.
    """
    return trie(rebuilt(conversations), conversations.count())


ORACLE_SQL = f"""
WITH RECURSIVE crc AS {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, turn, role, strlen(text) AS size, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS mark FROM t),
o AS (SELECT conv_id, size, mark, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark) AS i FROM m),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
b AS (SELECT c.conv_id, 0 AS part, o.i, o.mark, o.size FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, o.mark, o.size FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
s AS (SELECT c.conv_id, coalesce(list(mark ORDER BY part, i) FILTER (WHERE mark IS NOT NULL), []) AS marks, list(size ORDER BY part, i) FILTER (WHERE mark IS NOT NULL) AS sizes FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY 1),
p AS (SELECT conv_id, d, array_to_string(marks[:d], '') AS pre, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(marks) AS last FROM s, unnest(range(0, len(marks) + 1)) AS u(d)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT substr(pre, 1, 32 * (d - 1)) AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT substr(n.pre, 1, 32 * u.up) AS pre, (n_convs - 1) * size AS saved, k.n_children IS NULL AS leaf FROM n LEFT JOIN k ON k.pre = n.pre, unnest(range(0, n.d + 1)) AS u(up)),
g AS (SELECT pre, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM a GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, f.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, g.n_leaves, g.saved_tokens, n.ends_sha256
FROM n JOIN g ON g.pre = n.pre LEFT JOIN k ON k.pre = n.pre LEFT JOIN n f ON n.d > 0 AND f.d = n.d - 1 AND f.pre = substr(n.pre, 1, 32 * (n.d - 1))
"""
