"""Packing: vector bin packing of documents into training sequences.

Each example has three sizes: tokens, segments (1 for a piece) and loss-bearing tokens; a sequence has a limit on each.
Every task packs its own rows. Documents are cut from the front into pieces that keep the limits on tokens and on
loss-bearing tokens; pieces of the full length are sequences of their own. The others are placed, longest first, by the
dot-product rule: among a bounded number of open sequences that the piece fits in all three dimensions, take the one whose
remaining room has the largest dot product with the piece's sizes (each divided by its limit). A piece that fits nowhere
opens a sequence. At the end, sequences with room in all three dimensions are filled by pieces cut from the least full
sequences, since pieces may be cut freely.

No shuffle: a task needs its own rows only, so the work grows with the input and a lost task is simply run again on the
same rows (sequence ids are built from the partition and a running number).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm import bytesets
from barwright.llm.pretokens import encoder, tokenizer_path

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Limits:
    """Limits of a sequence. open_sequences bounds how many a task holds open; batch_tokens how many ids it holds at once.

    As many segments as tokens are no limit: documents of one id each fill a sequence then. Fewer may leave sequences of short
    documents mostly empty.
    """

    tokens: int = 2048
    segments: int = 2048
    loss_tokens: int = 2048
    open_sequences: int = 256
    batch_tokens: int = 4_000_000


def place(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """The sequence of each piece. sizes: rows of (tokens, segments, loss-bearing tokens), each within the limits."""
    limit = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    scaled = sizes / limit
    order = np.argsort(-sizes[:, 0], kind="stable")
    room = np.ones((limits.open_sequences, 3))
    names = np.arange(limits.open_sequences)
    made = opened = 0
    out = np.zeros(len(sizes), np.int64)
    slack = 1e-9
    for i in order:
        need = scaled[i]
        fits = (room[:opened] + slack >= need).all(axis=1)
        if fits.any():
            at = int(np.argmax(np.where(fits, room[:opened] @ need, -1.0)))
        elif opened < limits.open_sequences:
            at, opened = opened, opened + 1
            names[at], made = made, made + 1
            room[at] = 1.0
        else:
            at = int(np.argmin(room[:, 0]))  # the fullest one is closed
            names[at], made = made, made + 1
            room[at] = 1.0
        room[at] -= need
        out[i] = names[at]
    return out


def loss_of(prompt: int, start: int, n: int) -> int:
    """Loss-bearing tokens among the n from start on, of a document whose first `prompt` tokens bear none."""
    return max(0, start + n - max(start, prompt))


def longest(prompt: int, start: int, room: int) -> int:
    """Tokens from start on of which at most `room` bear loss."""
    return max(prompt - start, 0) + room


def packed(lengths: np.ndarray, prompts: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of so many tokens, of which the first `prompts` bear no loss."""
    out: list[tuple[int, int, int, int, int]] = []
    full = limits.tokens
    sequence = 0
    rest: list[tuple[int, int, int]] = []
    q = prompts.tolist()
    for d, length in enumerate(lengths.tolist()):
        start = 0
        while start < length:
            n = min(full, length - start, longest(q[d], start, limits.loss_tokens))
            if n == full:
                out.append((d, start, n, sequence, 0))
                sequence += 1
            else:
                rest.append((d, start, n))
            start += n
    if not rest:
        return out
    sizes = np.array([(n, 1, loss_of(q[d], start, n)) for d, start, n in rest])
    bins = place(sizes, limits)
    members: dict[int, list[list[int]]] = {}
    for piece, b in zip(rest, bins.tolist(), strict=True):
        members.setdefault(b, []).append(list(piece))
    used = {b: sum(x[2] for x in v) for b, v in members.items()}
    loss = {b: sum(loss_of(q[d], start, n) for d, start, n in v) for b, v in members.items()}
    fill = sorted(members, key=lambda b: (-used[b], b))
    low, high = 0, len(fill) - 1
    while low < high:  # the fullest first; the least full give pieces, cut to what is wanted
        b, giver = fill[low], fill[high]
        d, start, n = members[giver][-1]
        take = min(full - used[b], n, longest(q[d], start, limits.loss_tokens - loss[b]))
        if not take or len(members[b]) >= limits.segments:
            low += 1
            continue
        members[b].append([d, start, take])
        moved = loss_of(q[d], start, take)
        for held, sign in ((b, 1), (giver, -1)):
            used[held] += sign * take
            loss[held] += sign * moved
        if take == n:
            members[giver].pop()
        else:
            members[giver][-1] = [d, start + take, n - take]
        if not members[giver]:
            high -= 1
    for b in fill:
        if members[b]:
            at = 0
            for d, start, n in members[b]:
                out.append((d, start, n, sequence, at))
                at += n
            sequence += 1
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end_id: int = 1, prompt: str | None = None) -> DataFrame:
    """Pieces of all documents, packed into sequences that keep the limits.

    A document is the ids of its whole text and then end_id, all of which bear loss. For instruction data, `prompt` names a
    column with what stands before the text: its ids come first and bear no loss (null: none). Null and empty texts are
    documents of end_id alone; rows with equal doc_id are packed each for itself; an empty table gives no rows; columns other
    than doc_id, text and prompt are ignored. A null doc_id stays null.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path).batch
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        done = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        prompts: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, ids, names, prompts, held
            pieces = packed(np.array([len(x) for x in ids], np.int64), np.array(prompts, np.int64), limits)
            crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            columns = [
                [names[p[0]] for p in pieces],
                [p[1] for p in pieces],
                [p[2] for p in pieces],
                crc,
                [len(ids[p[0]]) for p in pieces],
                [base + done + p[3] for p in pieces],
                [p[4] for p in pieces],
                [loss_of(prompts[p[0]], p[1], p[2]) for p in pieces],
            ]
            done += max((p[3] for p in pieces), default=-1) + 1
            ids, names, prompts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES.fieldNames())

        for batch in bytesets.chunks(batches):
            texts = encode(batch.column("text").to_pylist())
            before = encode(batch.column("prompt").to_pylist()) if prompt else [np.zeros(0, "<u4")] * len(texts)
            for name, x, y in zip(batch.column("doc_id").to_pylist(), before, texts, strict=True):
                ids.append(np.concatenate([x, y, [end_id]]).astype("<u4"))
                names.append(name)
                prompts.append(len(x))
                held += len(ids[-1])
                if held >= limits.batch_tokens:
                    yield flush()
        if ids:
            yield flush()
        encoder.cache_clear()  # the worker is used again for other stages
        bytesets.give_back()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompt:
        columns.append(F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("prompt"))
    return docs.select(*columns).mapInArrow(run, PIECES)
