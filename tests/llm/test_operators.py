"""Operators 1 to 10: edge cases, brute force on small tables, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import bytesets, chat_format, components, decontamination, jaccard_join, language_id, lm_scoring, media, motion_jpeg, packing, pretokens, store, suffix_dedup, token_counts, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, node string, n long"  # with columns whose names the operators use themselves
LONG = "word " * 60_000
EDGE = [
    (1, None, "en", "x", 1),
    (2, "", "en", "x", 1),
    (3, " \n\t ", None, "x", 1),
    (4, "One", "en", None, None),
    (5, "one", "fr", "x", 1),
    (6, "Ünïcode ✓ 漢字 text, twice. Ünïcode ✓ 漢字 text, twice.", "de", "x", 1),
    (7, LONG, "en", "x", 1),
    (8, "<|endoftext|> a <|endoftext|>", "en", "x", 1),
    (9, "0 \u0085   1", "en", "x", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", lowered(text))


def plain_words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered(text))


# words and hashes


def test_words_of_bytes_are_words_of_text():
    import pyarrow as pa

    texts = [t or "" for _, t, *_ in EDGE]
    for kind, words in ((bytesets.SPACED_WORD, spaced), (bytesets.PLAIN_WORD, plain_words)):
        w = bytesets.Words(*bytesets.utf8(pa.array(texts)), kind)
        found = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
        assert found == [x for t in texts for x in words(t)]
        assert w.counts().tolist() == [len(words(t)) for t in texts]
        seen = {}
        for word, h in zip(found, w.hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_chunks_cut_by_bytes_and_keep_all_rows():
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(["a" * n if n % 3 else None for n in range(100)]), "k": pa.array(range(100))})
    parts = list(bytesets.chunks(iter([batch, batch.slice(0, 0)]), size=200))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(100)) and len(parts) > 10


# 1 n-gram Jaccard join


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = spaced(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(docs, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, n, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, n, percent).collect()}
    assert got == want


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_jaccard_join_of_a_large_group_in_blocks_and_rounds(spark, monkeypatch):
    """Copies of one text with 0 to 3 edits: some link to the first, some to others only, some to none."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3]))) for i in range(120)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)


@pytest.mark.parametrize(("block", "copies", "other"), [(64, 1000, False), (64, 1000, True), (1024, 3300, False)])
def test_jaccard_join_finds_the_only_link_of_a_long_list(spark, monkeypatch, block, copies, other):
    """Two near texts among many that share their shingles but are not near: whatever blocks they are dealt to, and whether other links are found or not."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(block)
    base = [f"w{i}" for i in range(200)]

    def changed(k):
        words = list(base)
        for i in r.sample(range(5, 195), k):
            words[i] = f"x{r.random()}"
        return " ".join(words)

    rows = [(i, changed(6)) for i in range(copies)]
    words = list(base)
    words[60] = "a1"
    words[120] = "a2"
    near = list(words)
    near[160] = "b1"
    near[30] = "b2"
    rows += [(copies, " ".join(words)), (copies + 1, " ".join(near))]
    if other:
        rows += [(copies + 2, " ".join(f"o{i}" for i in range(100))), (copies + 3, " ".join(f"o{i}" for i in range(101)))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near_to = {a: [b for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] for a in range(copies, len(rows))}
    assert near_to[copies] and near_to[copies + 1]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    for a, others in near_to.items():
        assert all(got[a] == got[b] for b in others)
    assert len(got) == len(rows) and (not other or got[copies + 3] == copies + 2)


def test_jaccard_join_edge_cases(edge, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(edge, 3, 90).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4)
    assert got[7] == (1, 7)
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.deduplicated(edge, 3, 90)
    assert kept.columns == edge.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_repeated_rows_are_copies(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).orderBy("doc_id").collect()] == [(5, 5), (5, 5), (9, 5)]


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


# 2 chat formatting


def test_preferences(spark):
    rows = [
        (0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "why"),
        (2, 0, "user", None), (3, 0, "user", ""), (4, 1, "user", "alone"), (7, 0, None, "only rejected"), (None, 0, "user", "nobody"), (8, 0, "user", "a"), (8, 0, "user", "a"), (9, 0, "assistant", "a"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    got = {r["pair_id"]: r for r in chat_format.preferences(df).collect()}
    assert got[0]["prompt"] == "<|system|>\ns\n<|user|>\nq\n" and got[0]["chosen"] == "<|assistant|>\ngood\n" and got[0]["rejected_mask"] == "10"
    assert got[1]["n_prompt"] == 1 and got[1]["chosen"] == "" and got[1]["chosen_mask"] == ""  # null and empty texts are alike
    assert got[2]["rejected"] is None and got[2]["n_prompt"] == 0 and got[2]["chosen_mask"] == "0"
    assert got[3]["chosen"] is None and got[3]["rejected"].startswith("<||>")
    assert got[4]["n_prompt"] == 0 and got[4]["n_chosen"] == 2
    assert None not in got and chat_format.preferences(df.limit(0)).count() == 0


# 3 language identification


def test_language_identification(docs, edge, empty):
    filters = language_id.learned(docs.where(~language_id.is_held_out()))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language_id.identify(docs, filters).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    one = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge, filters).collect()}
    assert one[1] == one[2] == one[3] == one[9] == "und" and one[6] in filters.langs
    assert language_id.identify(empty, filters).count() == 0
    nothing = language_id.learned(empty)
    assert {r["lang_pred"] for r in language_id.identify(edge, nothing).collect()} == {"und"}


def test_filters_return_all_languages_and_correct_false_positives():
    rng = np.random.default_rng(1)
    own = [rng.integers(1, 2**32, 3000).astype(np.uint64) for _ in range(3)]
    f = language_id.Filters(["a", "b", "c"], [np.concatenate([own[0], own[1]]), own[1], own[2]], [1, 1, 1])
    assert ((f.masks(own[1]) & np.uint64(3)) == 3).all() and ((f.masks(own[0]) & np.uint64(1)) == 1).all()
    other = rng.integers(1, 2**32, 20000).astype(np.uint64)
    rate = [((f.masks(other) >> np.uint64(i)) & np.uint64(1)).mean() for i in range(3)]
    assert np.allclose(rate, f.false_positives, atol=0.01)


def test_languages_by_definition(spark):
    """Languages of n-grams from dictionaries, decided by plain counts: the filters decide alike but where counts are close."""
    rng = random.Random(4)
    letters = {"x": "abcdeä", "y": "defghö", "z": "ghijk"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choice("xyz") for _ in range(150))] + [(900, None, "x"), (901, "42 !", "y"), (902, "abcd", None)]

    def grams(t):
        b = "".join(c if c.isalpha() else " " for c in lowered(t)).encode()
        return [g for g in (b[k : k + 4] for k in range(len(b) - 3)) if g != b"    "]

    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(grams(t))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    has = lambda lang, g: rate[lang].get(g, 0) >= max(language_id.RATE, language_id.SHARE * max(r.get(g, 0) for r in rate.values()))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learned(df.where(~language_id.is_held_out()))
    for r in language_id.identify(df.unionByName(df.limit(3)), filters).collect():
        found = {lang: sum(has(lang, g) for g in grams(rows[r["doc_id"]][1])) for lang in rate} if r["doc_id"] < 900 else {}
        if found:
            best = sorted(found.values())
            assert r["lang_pred"] == max(found, key=found.get) or best[-1] - best[-2] < 3
            assert abs(r["score"] - best[-1] / sum(best)) < 0.05
        elif r["doc_id"] in (900, 901):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_more_languages_than_bits_of_a_word():
    rng = np.random.default_rng(3)
    own = [rng.integers(1, 2**32, 200).astype(np.uint64) for _ in range(130)]
    f = language_id.Filters([f"l{i:03d}" for i in range(130)], own, [1 / 130] * 130)
    assert f.words.shape[1] == 3
    for i in (0, 63, 64, 127, 128, 129):
        masks = f.masks(own[i])
        assert f.bit(masks, i).all() and f.bit(masks, (i + 1) % 130).mean() < 0.05


# 4 benchmark decontamination


def brute_hits(text, items, n=13):
    w = plain_words(text)
    hit, names = set(), set()
    for name, t in items:
        i = plain_words(t)
        k = min(n, len(i))
        windows = {tuple(i[a : a + k]) for a in range(len(i) - k + 1)} if k else set()
        for a in range(len(w) - k + 1) if k else []:
            if tuple(w[a : a + k]) in windows:
                hit.update(range(a, a + k))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_decontamination_is_exact(spark, docs, block_bytes):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").union(spark.createDataFrame([(900, "of the"), (901, None), (902, "..."), (900, "of the")], "item_id long, text string"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.hits(docs, bench, block_bytes=block_bytes).collect()}
    assert got == {r["doc_id"]: brute_hits(r["text"], items) for r in docs.collect()}


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_decontamination_cuts_the_same_with_several_blocks(spark, block_bytes):
    """Passages in any order, nested, overlapping and side by side; equal and null doc_ids have cuts of their own."""
    words = [f"w{i}" for i in range(200)]
    at = lambda b, e: " ".join(words[b:e])
    passages = [(100, 130), (0, 20), (105, 118), (120, 145), (145, 160), (10, 30), (180, 195)]
    bench = spark.createDataFrame([(f"b{k}", at(b, e)) for k, (b, e) in enumerate(passages)], "item_id string, text string")
    rows = [(1, at(0, 200)), (1, at(90, 170)), (1, at(40, 60)), (None, at(170, 200)), (2, at(50, 200)), (2, at(50, 200))]
    got = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench, spans=True, block_bytes=block_bytes).collect()
    left = lambda b, e: [w for i, w in enumerate(words[b:e], b) if not any(x <= i < y for x, y in passages)]
    want = [(1, left(0, 200)), (1, left(90, 170)), (1, left(40, 60)), (None, left(170, 200)), (2, left(50, 200)), (2, left(50, 200))]
    assert sorted((str(r["doc_id"]), r["text"].split()) for r in got) == sorted((str(i), w) for i, w in want)


def test_decontamination_edge_cases(spark, edge, empty):
    bench = spark.createDataFrame([(1, "one", "z"), (2, "", "z"), (3, "漢字 text twice", "z")], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: r for r in decontamination.digest(edge, bench).collect()}
    assert got[1]["n_words"] == 0 and not got[1]["contaminated"] and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["contaminated"] and got[4]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[6]["n_hit"] == 6
    assert decontamination.digest(empty, bench).count() == 0 and decontamination.digest(edge, bench.limit(0)).where("n_hit > 0").count() == 0
    assert sorted(r["doc_id"] for r in decontamination.clean(edge, bench).collect()) == [1, 2, 3, 7, 8, 9]
    cut = {r["doc_id"]: r["text"] for r in decontamination.clean(edge, bench, spans=True).collect()}
    assert cut[4] == "" and cut[6] == "Ünïcode ✓ . Ünïcode ✓ ." and cut[1] is None and cut[7] == LONG


# 5 token counts, 6 packing


def ids_by_library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pretokens.tokenizer_path()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("broadcast_rows", [300_000, 20])
def test_token_counts_match_the_library(docs, edge, empty, broadcast_rows):
    both = docs.select("doc_id", "text").union(edge.select(edge.doc_id + 10_000, "text"))
    want = {r[0]: len(ids_by_library(r[1])) for r in both.collect()}
    rows = token_counts.token_counts(both.union(both.limit(20)), broadcast_rows=broadcast_rows).collect()  # some rows are repeated
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(want) + 20 and all(r["n_tokens"] == want[r["doc_id"]] for r in rows)
    assert {k: r["n_tokens"] for k, r in got.items()} == want
    assert got[10_001]["n_bytes"] == 0 and got[10_007]["over_limit"] and got[10_006]["n_bytes"] == len(EDGE[5][1].encode())
    assert token_counts.token_counts(empty).count() == 0


def test_packing_fills_sequences_with_the_shortest_documents(spark):
    """Documents of one and of a few ids: all sequences but the last are full."""
    df = spark.createDataFrame([(i, "" if i % 2 else "a b") for i in range(9000)], "doc_id long, text string").coalesce(1)
    by = {}
    for r in packing.pack(df).collect():
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert sorted(by.values())[1:] == [2048] * (len(by) - 1)


def test_packing(spark, docs, edge, empty):
    both = docs.select("doc_id", "text").union(edge.select(edge.doc_id + 10_000, "text"))
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack(both).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for name, text in ((r[0], r[1]) for r in both.collect()):
        ids = np.array([*ids_by_library(text), 1], "<u4")
        at = 0
        for p in sorted(pieces[name], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len(s) <= packing.Limits().segments
    total = sum(p["length"] for s in sequences.values() for p in s)
    assert total / (2048 * len(sequences)) > 0.9
    assert packing.pack(empty).count() == 0
    assert [r["length"] for r in packing.pack(edge.limit(1)).collect()] == [1]


def test_placing_keeps_all_three_limits():
    rng = np.random.default_rng(2)
    limits = packing.Limits(tokens=100, segments=5, loss_tokens=40, open_sequences=8)
    tokens = rng.integers(1, 100, 500)
    sizes = np.stack([tokens, np.ones(500, int), np.minimum(rng.integers(0, 41, 500), tokens)], axis=1)
    bins = packing.place(sizes, limits)
    for b in np.unique(bins):
        assert (sizes[bins == b].sum(axis=0) <= [100, 5, 40]).all()


# 7 language-model scoring


def test_lm_scores(spark, docs, edge):
    both = docs.select("doc_id", "text").union(edge.select(edge.doc_id + 10_000, "text"))
    rows = {r[0]: [*spaced(r[1]), 0] for r in both.collect()}
    counts = collections.Counter()
    for i, w in rows.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    held = []
    for r in lm_scoring.score(both).collect():
        w = rows[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
        if r["held_out"]:
            held.append((r["base_score"], r["score"]))
    assert sum(s for _, s in held) > sum(b for b, _ in held)  # better than the base on held-out texts


def test_lm_scores_of_repeated_rows(spark):
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 not in (lm_scoring.HELD_OUT, lm_scoring.DELETED))
    rows = [(one, "the cat sat"), (one, "the cat sat"), (one, "rare words here"), (None, "the end")]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_known"] for r in got) == [3, 4, 4, 4] and all(r["train_tokens"] == 15 for r in got)


def test_lm_scores_of_nothing(spark, empty):
    assert lm_scoring.score(empty).count() == 0
    lone = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in lm_scoring.score(lone).collect())


def test_lm_scores_by_definition(spark, monkeypatch):
    """score against counts in dictionaries and weights drawn by chance; and the probabilities after every context sum to one."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 9)))) for i in range(70)]
    bins = lm_scoring.BINS
    weights = np.random.default_rng(5).random((bins * bins, 4))
    weights[np.arange(bins * bins) % bins == 0, 2] = 0
    weights[:bins, 3] = 0
    weights /= weights.sum(axis=1, keepdims=True)
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda deleted, totals: weights)
    counts = collections.Counter()
    texts = 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != lm_scoring.HELD_OUT:
            texts += 1
            w = ["<", "<", *spaced(t), 0]
            counts.update(tuple(w[k - n + 1 : k + 1]) for k in range(2, len(w)) for n in (1, 2, 3))
    vocabulary = [g[0] for g in counts if len(g) == 1]
    total = sum(counts[(w,)] for w in vocabulary)

    def probability(u, v, w):
        x2 = texts if v == "<" else counts[(v,)]
        x3 = texts if v == "<" else counts[(u, v)]
        l0, l1, l2, l3 = weights[int(math.log2(x3 + 1)) * bins + int(math.log2(x2 + 1))]
        return l0 / (len(vocabulary) + 1) + l1 * counts[(w,)] / total + l2 * counts[(v, w)] / max(x2, 1) + l3 * counts[(u, v, w)] / max(x3, 1)

    for u, v, _ in [g for g in counts if len(g) == 3]:
        assert math.isclose(sum(probability(u, v, w) for w in [*vocabulary, "unknown"]), 1, rel_tol=1e-9)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = ["<", "<", *spaced(t), 0]
        assert math.isclose(got[i], sum(math.log10(probability(*w[k - 2 : k + 1])) for k in range(2, len(w))), rel_tol=1e-9)


def test_em_raises_the_likelihood_of_the_class_of_the_weights(spark, docs, monkeypatch):
    """More steps, a better fit to the texts on which the weights are learned."""
    some = docs.select("doc_id", "text").where("length(text) < 2000").limit(80).collect()
    df = spark.createDataFrame(some, "doc_id long, text string")
    chunks = lm_scoring.chunked(df)
    back = lm_scoring.replies(lm_scoring.messages(chunks, 3))
    met = chunks.unionByName(back.where("chunk IS NOT NULL"), allowMissingColumns=True).where("deleted")
    fit = []
    for steps in (0, 1, 30):
        monkeypatch.setattr(lm_scoring, "EM_STEPS", steps)
        weights = lm_scoring.learn_weights(met, lm_scoring.Totals(60, 10_000, 3_000))
        assert np.allclose(weights.sum(axis=1), 1)
        monkeypatch.setattr(lm_scoring, "learn_weights", lambda *_, w=weights: w)
        fit.append(sum(r["score"] for r in lm_scoring.score(df).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == lm_scoring.DELETED))
        monkeypatch.undo()
    assert fit[0] < fit[2]


def of_class(c, n):
    """n ids of a class."""
    return [i for i in range(60 * n + 60) if zlib.crc32(str(i).encode()) % 7 == c][:n]


def scores(spark, rows):
    return {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_lm_scores_tell_pairs_of_rare_words(spark):
    """Every word has the same count and rank beyond any class table; only the pairs differ."""
    pairs = [(f"a{i}", f"b{i}") for i in range(3000)]
    common = " ".join(f"c{i}" for i in range(2500))  # more frequent than the words of the pairs
    rows = [(i, " ".join([common, common, *(w for p in pairs for w in p)])) for c in (0, 1, lm_scoring.DELETED) for i in of_class(c, 2)]
    seen, other = of_class(lm_scoring.HELD_OUT, 2)
    tail = pairs[2500:]
    got = scores(spark, [*rows, (seen, " ".join(f"{a} {b}" for a, b in tail)), (other, " ".join(f"{a} {b}" for (a, _), (_, b) in zip(tail, tail[7:] + tail[:7])))])
    assert got[seen] > got[other] + 500


def test_lm_scores_use_pairs_that_only_the_class_of_the_weights_has(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in of_class(lm_scoring.DELETED, 3)] + [(i, "other words of the other texts") for c in (0, 1) for i in of_class(c, 3)]
    seen, other = of_class(lm_scoring.HELD_OUT, 2)
    got = scores(spark, [*rows, (seen, " ".join(words)), (other, " ".join(words[::-1]))])
    assert got[seen] > got[other] + 1


@pytest.mark.parametrize(("chunk", "bucket"), [(4_000_000, 1_000_000), (300, 50)])
def test_lm_ngrams_are_counted_in_full(spark, docs, monkeypatch, chunk, bucket):
    """Counts of all words, bigrams and trigrams that train, over several chunks and buckets; every text's estimates."""
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
    some = docs.select("doc_id", "text").where("length(text) < 400").limit(60).collect()
    counts = collections.Counter()
    for i, t in some:
        if zlib.crc32(str(i).encode()) % 7 != lm_scoring.HELD_OUT:
            w = ["<", "<", *spaced(t), 0]
            counts.update((n, *w[k - n + 1 : k + 1]) for k in range(2, len(w)) for n in (1, 2, 3))
    chunks = lm_scoring.chunked(spark.createDataFrame(some, "doc_id long, text string")).persist()
    back = lm_scoring.replies(lm_scoring.messages(chunks, max(1, 3000 // bucket))).where("chunk is not null")
    texts = dict(some)
    found = 0
    for c in chunks.unionByName(back, allowMissingColumns=True).toArrow().to_pandas().groupby("chunk"):
        table = lm_scoring.pa.Table.from_pandas(c[1].astype({"bucket": "Int64", "n1": "Int64", "n2": "Int64", "n3": "Int64", "n_words": "Int64"}), preserve_index=False)
        got = lm_scoring.Counted(table)
        for d, i in enumerate(got.row["doc_id"]):
            w, at = ["<", "<", *spaced(texts[i]), 0], int(got.offsets[d])
            for n in (1, 2, 3):
                assert got.counts[n - 1][at : at + len(w) - 2].tolist() == [counts[(n, *w[k - n + 1 : k + 1])] for k in range(2, len(w))]
            found += 1
    assert found == len(some)


# 8 suffix-array dedup


def brute_removals(rows, length, keep_first):
    seen = collections.defaultdict(list)
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]].append((i, k))
    masks = {i: bytearray(len(t)) for i, t in texts}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places[1:] if keep_first else places:
                masks[i][k : k + length] = b"\1" * length
    out = {}
    for i, t in texts:
        m = masks[i]
        kept = bytes(b for b, x in zip(t, m, strict=True) if not x)
        out[i] = (len(t), sum(m), sum(1 for a in range(len(m)) if m[a] and (a == 0 or not m[a - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("length", "chunk"), [(400, 96), (50, 96), (50, 2)])
def test_removals_are_exact(spark, monkeypatch, keep_first, length, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 20_000)
    rng = random.Random(length + chunk)
    word = lambda: "".join(rng.choice("abcdefü") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, long = text(25), text(120)
    rows = [(i, f"{text(rng.randint(0, 40))} {common} {text(rng.randint(0, 40))}") for i in range(20)]
    rows += [(100, long), (101, long), (102, long[:300] + "!" + long[300:]), (103, "ab " * 300), (104, "ab " * 200), (105, None), (106, ""), (107, "short"), (108, long[100:] + long[:200])]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"), length, keep_first).collect()}
    assert got == brute_removals(rows, length, keep_first)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    sizes = (300, 399, 400, 401, 600)
    rows = []
    for k, size in enumerate(sizes):
        passage = " ".join(f"w{k}{i:02d}" for i in range(150))[:size]
        assert len(passage) == size and len(passage.split()) > 50
        rows += [(2 * k, f"{'abcde'[k]}<{passage}>fghij"), (2 * k + 1, f"{'klmno'[k]}({passage})pqrst")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * k + j: (size + 8, size * (size >= 400), int(size >= 400)) for k, size in enumerate(sizes) for j in (0, 1)}


def test_later_copies_go_and_characters_stay_whole(spark, empty):
    passage = "ü" * 5 + " ".join(f"passage{i}ö" for i in range(60))
    rows = [(2, "Second " + passage + " end", "k"), (1, "First " + passage + " ende", "k"), (3, None, None)]
    out = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, lo string"))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lo"]
    assert got[1] == rows[1][1] and got[3] is None and passage not in got[2] and got[2].startswith("Second")
    assert suffix_dedup.deduplicated(empty).count() == 0 and suffix_dedup.removals(empty).count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(None, text), (1, text), (1, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in suffix_dedup.removals(df).collect())
    assert got == [(0, True), (1, False), (1, True)]


def test_previous_smaller():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, 500)
    want = [max((j for j in range(i) if x[j] <= x[i]), default=-1) if False else max((j for j in range(i) if not x[j] > x[i]), default=-1) for i in range(500)]
    assert suffix_dedup.previous_smaller(x).tolist() == want


# 9 media columns


@pytest.mark.parametrize("payload", [bytes(range(256)), b"\xff" * 64 * 5, b"\0" * 64, bytes(64 * 70)])
def test_frames_round_trip(payload):
    blocks = len(payload) // 64
    sizes = [min(32, blocks - k) for k in range(0, blocks, 32)]
    frames = motion_jpeg.frames_of(np.frombuffer(payload, np.uint8), np.array(sizes))
    video = motion_jpeg.parse_avi(motion_jpeg.avi(frames, 256))
    assert video.frames == frames and video.milliseconds == motion_jpeg.MILLISECONDS
    assert b"".join((c - 256).astype(np.uint8).tobytes() for c in motion_jpeg.coefficients(video.frames)) == payload


def general_frame(blocks, restart):
    """A frame with runs of zeros, end-of-block codes and other tables, coded bit by bit."""
    dc, ac = [0, 1, 2, 3, 4, 5, 6], [0x00, 0x01, 0x02, 0x11, 0xF0, 0x03, 0x21]
    code = lambda symbols, s: format(symbols.index(s), "03b")  # noqa: E731  all codes of 3 bits
    counts = lambda symbols: bytes([0, 0, len(symbols), *[0] * 13])
    size = lambda v: abs(v).bit_length()
    bits_of = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    out, part, before = b"", "", 0
    for k, b in enumerate(blocks):
        d = b[0] - before
        before = b[0]
        part += code(dc, size(d)) + bits_of(d, size(d))
        run = 0
        for v in b[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                part += code(ac, 0xF0)
                run -= 16
            part += code(ac, run << 4 | size(v)) + bits_of(v, size(v))
            run = 0
        if run:
            part += code(ac, 0x00)
        if (restart and (k + 1) % restart == 0) or k + 1 == len(blocks):
            part += "1" * (-len(part) % 8)
            out += bytes(int(part[i : i + 8], 2) for i in range(0, len(part), 8)).replace(b"\xff", b"\xff\x00")
            if k + 1 < len(blocks):
                out += bytes([0xFF, 0xD0 + (k // restart) % 8])
            part, before = "", 0
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [2] * 64)) + seg(0xC0, bytes([8, 0, 8]) + (8 * len(blocks)).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])) + seg(0xC4, bytes([0]) + counts(dc) + bytes(dc)) + seg(0xC4, bytes([0x10]) + counts(ac) + bytes(ac))
    return head + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_decoder_of_general_frames(restart):
    blocks = [[0] * 64 for _ in range(5)]
    blocks[0][:3] = [30, 1, -2]
    blocks[1][0], blocks[1][40] = -7, 3
    blocks[2][:] = [5] + [1] * 63
    blocks[3][2] = 1
    # position 40 is reached through zero runs of 16 and runs of 1 or 2 only
    blocks[1][17 + 16 + 2] = 1
    blocks[1][40] = 0
    frame = general_frame(blocks, restart)
    assert motion_jpeg.coefficients([frame])[0].tolist() == blocks
    image = motion_jpeg.pixels(motion_jpeg.coefficients([frame])[0], motion_jpeg.header(frame))
    assert image.shape == (8, 40) and (image[:, 32:] == 128).all()


def test_media_of_texts(spark, docs, edge, empty):
    both = docs.select("doc_id", "text").union(edge.select(edge.doc_id + 10_000, "text"))
    texts = {r[0]: (r[1] or "").encode() for r in both.collect()}
    by_text = {}
    for r in media.digest(media.encoded(both)).collect():
        raw = texts[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert by_text.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    assert media.digest(media.encoded(empty)).count() == 0


def test_feature_by_definition(spark):
    """Frames of 2,048 bytes, shares of 16 levels, cuts by the rule, one frame after the other."""
    rng = random.Random(6)
    texts = ["".join(chr(rng.choice([65 + 16 * (k // 5000 % 3), 97])) for k in range(n)) for n in (0, 1, 63, 64, 5000, 40_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, None)]
    size = 64 * motion_jpeg.FRAME_BLOCKS
    for r in media.digest(media.encoded(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        raw = (texts[r["doc_id"]] if r["doc_id"] is not None else "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        frames = [payload[k : k + size] for k in range(0, len(payload), size)]
        shares = [[sum(b >> 4 == level for b in f) / len(f) for level in range(16)] for f in frames]
        cuts, begin, history = [], 0, []
        for i in range(len(frames) - 1):
            d = sum(abs(x - y) for x, y in zip(shares[i], shares[i + 1], strict=True))
            near = history[-media.HISTORY :]
            mean = sum(near) / len(near) if near else 0
            limit = max(media.LEAST, mean + media.DEVIATIONS * math.sqrt(sum((x - mean) ** 2 for x in near) / len(near))) if near else media.LEAST
            history.append(d)
            if d > limit:
                cuts.append((begin, i))
                begin, history = i + 1, []
        cuts.append((begin, len(frames) - 1))
        ms = motion_jpeg.MILLISECONDS
        assert r["feature"] == f"frames={len(frames)};shots=" + ",".join(f"{round(a * ms)}-{round((b + 1) * ms)}" for a, b in cuts)


def test_clips(spark):
    dark, light = np.full(64 * 32, 10, np.uint8), np.tile(np.arange(64, dtype=np.uint8) * 3, 32)
    frames = [motion_jpeg.frames_of(x, np.array([32]))[0] for x in (dark, dark, dark, light, light)]
    rows = [("a", motion_jpeg.avi(frames, 256)), ("b", None), ("c", b"no video"), ("d", motion_jpeg.avi([], 8)), ("e", motion_jpeg.avi([b"no frame"], 8))]
    got = [(r["media_id"], r["clip"], r["start_ms"], r["end_ms"]) for r in media.clips(spark.createDataFrame(rows, "media_id string, media binary")).collect()]
    assert ("b", None, None, None) in got and ("c", None, None, None) in got and ("d", None, None, None) in got and ("e", None, None, None) in got
    assert [g for g in got if g[0] == "a"][0][2] == 0 and [g for g in got if g[0] == "a"][-1][3] == 200


def test_shots_adapt():
    shares = np.zeros((30, 16))
    for i in range(30):
        shares[i, (i // 10) * 5] = 1
    assert media.shots(shares) == [(0, 9), (10, 19), (20, 29)]
    assert media.shots(shares[:1]) == [(0, 0)] and media.shots(shares[:0]) == []


# 10 toxicity


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(5)
    words = [f"wort{rng.randrange(3000)}" for _ in range(3000)]
    rows, labels = [], []
    for i in range(1500):
        sentences = [" ".join(rng.choice(words) for _ in range(8)).capitalize() + "." for _ in range(5)]
        toxic = i % 5 == 0
        if toxic:
            sentences[i % 4] = sentences[i % 4][:-1] + " grumblix" + rng.choice(["en", "er", "st"]) + "."
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learned(toxicity.labelled_training(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    got = toxicity.score(df, model).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    hit = [r for r in held if r["predicted"] == 1]
    found = [dict(rows)[r["doc_id"]].encode()[s["begin"] : s["end"]] for r in hit for s in r["sentences"]]
    assert np.mean([b"grumblix" in f for f in found]) > 0.95
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1, "z"), (4, 0, "z"), (5, None, "z"), (99, 1, "z")], "doc_id long, toxic int, text string")
    model = toxicity.learned(toxicity.labelled_training(edge, labels))
    got = {r["doc_id"]: r for r in toxicity.score(edge, model).collect()}
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] and got[1]["predicted"] == 0
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.learned(toxicity.labelled_training(empty, labels.limit(0)))
    assert toxicity.score(edge, nothing).where("predicted = 1").count() == 0
    assert sorted(r["doc_id"] for r in toxicity.without_toxic(edge, nothing).collect()) == list(range(1, 10))


def test_noisy_or_of_sentences():
    import pyarrow as pa

    s = toxicity.Sentences(*bytesets.utf8(pa.array(["One two. Three!\nfour", "", "?!", "five"])))
    assert s.doc.tolist() == [0, 0, 0, 3] and s.begin.tolist() == [0, 9, 16, 0] and s.end.tolist() == [7, 14, 20, 4]
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, 0.1)
    scores = model.document_scores(s, model.sentence_scores(s))
    assert np.allclose(scores, [1 - 0.9 * 0.125, 0.1, 0.1, 1 - 0.9 * 0.5])


def test_packing_keeps_a_lower_limit_on_loss(spark):
    """Full pieces, placing and filling all keep the three limits, and every token lies in one piece."""
    rng = np.random.default_rng(7)
    limits = packing.Limits(tokens=2048, segments=8, loss_tokens=500)
    lengths = rng.integers(1, 6000, 300)
    prompts = np.minimum(rng.choice([0, 100, 3000], 300), lengths)
    pieces = packing.packed(lengths, prompts, limits)
    covered, sums = collections.defaultdict(list), collections.defaultdict(lambda: np.zeros(3, int))
    for d, start, n, sequence, _ in pieces:
        covered[d].append((start, n))
        sums[sequence] += [n, 1, packing.loss_of(int(prompts[d]), start, n)]
    assert all((s <= [2048, 8, 500]).all() for s in sums.values())
    for d, length in enumerate(lengths.tolist()):
        at = 0
        for start, n in sorted(covered[d]):
            assert start == at and n > 0
            at += n
        assert at == length
    rows = spark.createDataFrame([(i, "p " * 300 if i % 2 else None, "w " * 900) for i in range(12)], "doc_id long, ask string, text string")
    by_sequence = collections.Counter()
    for r in packing.pack(rows, limits=limits, prompt="ask").collect():
        by_sequence[r["sequence_id"]] += r["loss_tokens"]
        assert r["doc_tokens"] == len(ids_by_library("w " * 900)) + 1 + (len(ids_by_library("p " * 300)) if r["doc_id"] % 2 else 0)
    assert max(by_sequence.values()) <= 500


def test_encoder_equals_the_library():
    texts = ["", "a b  c\n\n d", "x" * 5000, "<|endoftext|> and <|endoftext|>", " ".join(f"w{i}" for i in range(3000)), "  \n ", "é漢字 🙂 " * 50, "\t\t a\u00a0b\u3000c" * 9, "1234567" * 700]
    e = pretokens.Encoder(pretokens.tokenizer_path())
    assert [x.tolist() for x in e.batch(texts)] == [ids_by_library(t) for t in texts]


def test_pairs_of_the_largest_ids(spark):
    ids = [2**53, 2**53 + 1, 2**53 + 2, 2**53 + 3, 2**60 + 1, 2**60 + 2, 2**63 - 2, 2**63 - 1, -1, -2]
    rows = spark.createDataFrame([(i, 0, "assistant", str(i)) for i in ids], "conv_id long, turn int, role string, text string")
    got = {r["pair_id"]: (r["n_chosen"], r["n_rejected"], r["n_prompt"]) for r in chat_format.preferences(rows).collect()}
    assert got == {i // 2: ((1, 1, 0) if {2 * (i // 2), 2 * (i // 2) + 1} <= set(ids) else (1, None, 0) if i % 2 == 0 else (None, 1, 0)) for i in ids}


def test_very_long_texts_and_clashing_columns(spark):
    """Columns named as helper columns are, and a text far longer than a batch, with rows that repeat."""
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, long, 5, 6), (2, "short one", 5, 6), (2, "short one", 5, 6), (None, None, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int, removed int").withColumns({"given_doc_id": F.lit("x"), "node": F.lit(1), "span": F.lit(2), "_cuts": F.lit(3)})
    for out in (suffix_dedup.deduplicated(df, 240), jaccard_join.deduplicated(df), decontamination.clean(df, spark.createDataFrame([("i", "never seen words")], "item_id string, text string"), spans=True)):
        assert set(df.columns) <= set(out.columns)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {1, 2, None}
        assert {r["given_doc_id"] for r in out.collect()} == {"x"}
    assert jaccard_join.deduplicated(df).count() == 3
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(df).collect())[-1] == len(ids_by_library(long))
    scores = lm_scoring.score(df).collect()
    assert len(scores) == 4 and max(r["n_tokens"] for r in scores) == 200_001
    assert language_id.identify(df.withColumn("lang", F.lit("en")), language_id.learned(df.withColumn("lang", F.lit("en")))).count() == 4


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())


def test_hot_shingles_are_sent_in_parts(spark, monkeypatch):
    """Buckets larger than a task holds, lists longer than a block, and lists of equal nodes: the same components."""
    rng = random.Random(11)
    base, other = [f"b{i}" for i in range(60)], [f"c{i}" for i in range(60)]
    rows = [(i, edited(rng, base if i % 3 else other, rng.choice([0, 0, 1, 2, 4]))) for i in range(90)] + [(1000, None), (1001, " ".join(base))]
    for name, value in (("BLOCK", 8), ("BUCKET_ROWS", 40), ("HELD_ROWS", 50), ("HELD_PAIRS", 5)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df, 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 60])
def test_contaminated_rows_go_by_their_own_text(spark, block_bytes):
    words = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([("a", " ".join(words[:20])), ("b", " ".join(words[20:])), ("c", None)], "item_id string, text string")
    bad, other = " ".join(words[:13]), "nothing of the kind " * 5
    rows = [(1, bad), (1, other), (None, bad), (None, other), (2, None), (3, ""), (4, "x " * 241 + bad), (5, "x " * 247 + bad), (2, " ".join(words[20:33]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r"))
    kept = decontamination.clean(df, bench, block_bytes=block_bytes)
    # 13 of 254 words are one in twenty, 13 of 260 too; of row 5's 260 words 13 are hit, so it goes as well
    want = [r for r in rows if not (r[1] and len(plain_words(r[1])) <= 260 and any(b in r[1] for b in (bad, " ".join(words[20:33]))))]
    assert kept.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))


def test_toxicity_of_repeated_rows(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.learned(toxicity.labelled_training(docs, labels))
    twice = docs.select("doc_id", "text").limit(30)
    by_id = collections.defaultdict(set)
    rows = toxicity.score(twice.union(twice).union(twice.select(F.lit(None).cast("long"), "text")), model).collect()
    for r in rows:
        by_id[r["doc_id"]].add((r["score"], r["predicted"]))
    assert len(rows) == 90 and all(len(v) == 1 for k, v in by_id.items() if k is not None)
