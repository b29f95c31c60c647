"""Sharding, hard negatives and the prefix trie: brute force on small tables, edge cases, groups that hold much of a table."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from barwright.llm import hard_negatives, prefix_trie, sharding

# sharding

DOCS = "doc_id long, text string, source string, shard int, n long, _start long, start string"


def shards_of(df, **kwargs):
    return [r.asDict() for r in sharding.digest(df, **kwargs).collect()]


def test_shards_are_even_gapless_and_hold_the_mixture(spark, monkeypatch):
    """A source with half of all rows, middling ones, and many of one row; in parts of 50 rows."""
    monkeypatch.setattr(sharding, "ROWS_A_PART", 50)
    sources = ["hot"] * 1000 + ["a"] * 300 + ["b"] * 333 + [None] * 64 + [""] * 48 + [f"one{i}" for i in range(255)]
    df = spark.createDataFrame([(i, f"text {i}", s, 7, None, None, "x") for i, s in enumerate(sources)], DOCS)
    got = shards_of(df)
    by_shard = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(16)}
    assert all(slots == list(range(125)) for slots in by_shard.values())
    source = dict(enumerate(sources))
    for s, n in (("hot", 1000), ("a", 300), ("b", 333), (None, 64), ("", 48)):
        held = [sum(r["shard"] == k and source[r["doc_id"]] == s for r in got) for k in range(16)]
        assert sum(held) == n and all(abs(x - n / 16) <= 2 + n / 125 for x in held)  # the 255 small sources shift cuts by about their root, 16 of 2000 rows
    singles = [sum(r["shard"] == k and (source[r["doc_id"]] or "").startswith("one") for r in got) for k in range(16)]
    assert max(singles) < 45  # not all in one shard
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    # within a source the order is shuffled
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if source[r["doc_id"]] == "hot"] != list(range(1000))
    assert sorted(map(str, got)) == sorted(map(str, shards_of(df.repartition(7))))


def test_shards_are_the_fractional_ranks_in_order(spark):
    r = random.Random(1)
    rows = [(i, "t" * r.randrange(40), r.choice(["x", "y", "y", "y", None])) for i in range(300)]
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    placed = []
    for s in ("x", "y", None):
        own = sorted((h(f"0:{i}"), i) for i, _, source in rows if source == s)
        name = "" if s is None else f"={s}"
        placed += [((k + h(f"0:{name}") / 2.0**60) / len(own), name, i) for k, (_, i) in enumerate(own)]
    order = [i for _, _, i in sorted(placed)]
    want = {i: (at * 16 // 300, at - -(-(at * 16 // 300) * 300 // 16)) for at, i in enumerate(order)}
    got = shards_of(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {x["doc_id"]: (x["shard"], x["slot"]) for x in got} == want
    assert all(x["size"] == len(rows[x["doc_id"]][1]) + 1 and x["text_crc32"] == zlib.crc32(rows[x["doc_id"]][1].encode()) for x in got)


def test_sharding_edge_cases(spark):
    rows = [(1, None, None, 1, 1, 1, "x"), (1, None, None, 1, 1, 1, "x"), (None, "é" * 3, "s", None, None, None, None), (2, "", "", 1, 1, 1, "x"), (3, "word " * 60_000, "s", 1, 1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = shards_of(df)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted([(1, 0), (1, 0), (7, zlib.crc32("ééé".encode())), (1, 0), (300_001, zlib.crc32(b"word " * 60_000))])
    assert len({(r["shard"], r["slot"]) for r in got}) == 5 and all(r["slot"] == 0 for r in got)
    assert shards_of(df.where("doc_id > 9")) == []
    whole = sharding.interleaved(df, 3)
    assert sorted(whole.columns) == sorted([*df.drop("shard").columns, "shard", "slot"]) and sorted(r["shard"] for r in whole.collect()) == [0, 0, 1, 1, 2]


def test_written_shards_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 3 == 0]) for i in range(100)], "doc_id long, text string, source string")
    sharding.written_shards(sharding.interleaved(df, 4, seed="s"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={k}" for k in range(4)]
    for k in range(4):
        assert sorted(r["slot"] for r in back.where(f"shard = {k}").collect()) == list(range(25))


# hard negatives


def brute_negatives(rows, every=50):
    good = [(i, v, y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    e = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in good]
    out = []
    for a, (i, v, y) in enumerate(e):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, b) for b, (j, w, _) in enumerate(e) if b != a)
        near = [x for x in scored if e[x[2]][2] == y][:5]
        for ps, j, _ in near:
            hard = [x for x in scored if e[x[2]][2] != y and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
            out += [(i, j, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(hard, 1)]
    return sorted(out)


def negatives_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, row long, score long, slot string")
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect())


def vectors(seed, n, width, repeat):
    rng = np.random.default_rng(seed)
    centres = 0.3 * rng.normal(size=width) + 0.1 * rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 4))
        v = (centres[y] + rng.normal(size=width) * 0.2).astype(np.float32) if i % repeat else centres[0].astype(np.float32)
        rows.append((i, v.tolist(), y))
    return rows


@pytest.mark.parametrize(("width", "repeat", "chunk", "task"), [(8, 5, 1 << 21, 10), (70, 1000, 140, 100)])
def test_hard_negatives_are_exact(spark, monkeypatch, width, repeat, chunk, task):
    """Also with a fifth of all rows alike, vectors of two words, anchors in several chunks and blocks, and two passes for bounds."""
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "ROWS_A_TASK", task)
    assert hard_negatives.steps(50) == [256, 16] and hard_negatives.steps(5) == [16]
    rows = vectors(width, 500, width, repeat)
    assert negatives_of(spark, rows) == brute_negatives(rows) != []


def test_hard_negatives_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.75, 0.5], 2), (3, [0.75, 0.5], 2), (4, [0.5, 0.5], 3), (7, [1.0, 0.5], 1), (9, [0.5], 4), (10, [], 4), (50, [-1.0, -0.5], 1), (100, [0.0, 0.0], 9)]
    bad = [(11, [nan, 1.0], 1), (12, [inf, 0.0], 1), (13, [None, 1.0], 2), (14, None, 2), (15, [1.0, 1.0], None), (None, [1.0, 0.5], 1), (150, [-inf, 0.0], 1)]
    got = negatives_of(spark, rows + bad)
    assert got == brute_negatives(rows) and any(r[0] == r[1] == 0 for r in got)
    assert negatives_of(spark, rows[2:9]) == []
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.5], 2)]) == []


def test_intervals_hold_the_scores_and_tighten():
    rng = np.random.default_rng(0)
    v, w = rng.integers(-100, 100, (50, 9)), rng.integers(-100, 100, (6, 9))
    a = hard_negatives.Anchors(np.arange(6), np.zeros(6), w, 8)
    x, want = hard_negatives.planes(v, 8), v @ w.T
    low, high = np.full(6, -3000), np.full(6, 9000)
    r, c, s = hard_negatives.scored(x, a, low, high, np.ones((50, 6), bool))
    assert set(zip(r.tolist(), c.tolist(), s.tolist())) == {(i, j, int(want[i, j])) for i in range(50) for j in range(6) if -3000 <= want[i, j] <= 9000}


# the prefix trie


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn, role, mark, text))
    own = {c: [(t[2], t[4]) for t in sorted(v, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block long, key string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.conversation_trie(df).collect()), key=str)


def random_turns(seed, n, texts, most, hot):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < hot:
            rows += [(c, t, "user", f"é{t}") for t in range(3)]
        else:
            rows += [(c, t, r.choice(["user", "assistant"]), f"t{r.randrange(texts)}") for t in range(r.randrange(1, most))]
    return rows


@pytest.mark.parametrize("least", [4, 20, 2048])
@pytest.mark.parametrize(("texts", "most", "hot"), [(1, 6, 0.4), (2, 4, 0.0), (50, 30, 0.3)])
def test_trie_is_exact(spark, monkeypatch, least, texts, most, hot):
    """In one block and in many, with a group of copies that reaches over several."""
    monkeypatch.setattr(prefix_trie, "LEAST_TURNS", least)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = random_turns(texts + least, 90, texts, most, hot)
        assert trie_of(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_trie_edge_cases(spark):
    rows = [(7, 0, None, None), (7, None, "a", ""), (7, 0, None, None), (7, 1, "x", "word " * 50_000), (None, 0, "a", "b"), (-3, 0, "a", ""), (-3, 0, "a", "b"), (13, 4, "z", "only"), (2**62, 1, "a", "")]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 0, "a", "b")]) == []
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # no turn is left
    assert trie_of(spark, [(lone, 0, "a", "b")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())] == brute_trie([(lone, 0, "a", "b")])


def test_nearest_smaller_values():
    r = random.Random(2)
    for _ in range(200):
        x = np.array([r.randrange(4) for _ in range(r.randrange(1, 12))])
        left, right, first = prefix_trie.nearest_smaller(x)
        for i, v in enumerate(x):
            l = max((k for k in range(i) if x[k] < v), default=-1)
            assert left[i] == l and right[i] == min((k for k in range(i + 1, len(x)) if x[k] < v), default=len(x))
            assert first[i] == (v not in x[l + 1 : i])
