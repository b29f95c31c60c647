"""Motion-JPEG in AVI: baseline JPEG entropy coding and RIFF indexes, in numpy over many frames at once.

Frames that this module writes hold payload bytes losslessly: a block's 64 quantised coefficients (the format's own unit,
which its entropy coding keeps exactly) are the bytes plus 256, and every block is a restart interval. So all blocks of a
batch are decoded side by side, one coefficient of each at a time. The reader isn't tied to such frames: it takes its
Huffman and quantisation tables, restart interval and sizes from the markers, for one-component baseline frames.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK = 64
FRAME_BLOCKS = 32
MILLISECONDS = 40  # of a frame
OFFSET = 256  # payload bytes become coefficients 256 to 511: never 0, always of 9 bits
SIZE = 9


def zigzag() -> np.ndarray:
    """The place, row by row, of each coefficient in the order in which they are coded."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def frame_header(blocks: int) -> bytes:
    """All of a frame before its entropy-coded data: tables, size (a row of blocks) and a restart interval of one block."""
    huffman = lambda kind, symbols: bytes([kind, *([1] * len(symbols) + [0] * (16 - len(symbols))), *symbols])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([1] * 64)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * blocks, 1, 1, 0x11, 0)),
            _segment(0xC4, huffman(0x00, [SIZE])),
            _segment(0xC4, huffman(0x10, [SIZE, 0])),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def coded_blocks(payload: np.ndarray) -> np.ndarray:
    """Entropy-coded data of blocks of 64 bytes, 80 bytes a block: the 1-bit Huffman code 0 and 9 bits for every coefficient."""
    c = payload.reshape(-1, 16, 4).astype(np.uint16) + OFFSET
    c0, c1, c2, c3 = c[..., 0], c[..., 1], c[..., 2], c[..., 3]
    out = np.empty((len(c), 16, 5), np.uint8)
    out[..., 0] = c0 >> 2
    out[..., 1] = (c0 & 3) << 6 | c1 >> 4
    out[..., 2] = (c1 & 15) << 4 | c2 >> 6
    out[..., 3] = (c2 & 63) << 2 | c3 >> 8
    out[..., 4] = c3 & 255
    return out.reshape(-1, 80)


def frames_of(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """JPEG frames of so many blocks each, from the blocks' bytes end to end."""
    data = coded_blocks(payload)
    rows = np.empty((len(data), 82), np.uint8)
    rows[:, :80] = data
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    rows[:, 80] = 0xFF
    rows[:, 81] = 0xD0 + place % 8
    rows[ends - 1, 81] = 0xD9  # the end of the image instead of a restart
    stuffed = np.flatnonzero((data == 0xFF).any(axis=1))
    flat = rows.tobytes()
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        body = flat[(end - n) * 82 : end * 82]
        if len(stuffed) and np.searchsorted(stuffed, end - n) != np.searchsorted(stuffed, end):
            body = b"".join(rows[k, :80].tobytes().replace(b"\xff", b"\xff\x00") + rows[k, 80:].tobytes() for k in range(end - n, end))
        out.append(frame_header(n) + body)
    return out


def avi(frames: list[bytes], width: int, height: int = 8) -> bytes:
    """An AVI file of JPEG frames: headers, the frames, and their index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", MILLISECONDS * 1000, 0, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, MILLISECONDS, 1000, 0, len(frames), largest, -1, 0, 0, 0, width, height)
    kind = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    heads = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", kind)))
    index, body, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(chunk(b"00dc", f))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + heads + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


@dataclass(frozen=True)
class Video:
    frames: list[bytes]
    milliseconds: float  # of a frame


def parse_avi(data: bytes) -> Video:
    """The frames of an AVI file by its index (without one, by the chunks of its movi list) and the time of each.

    Raises ValueError if it is no AVI file; chunks that reach beyond the end are left out.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    micro, movi, index = MILLISECONDS * 1000, None, None
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, min(end, at + 8 + size))
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            micro = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"idx1":
            index = (at + 8, min(end, at + 8 + size))
        at += 8 + size + size % 2
    if movi is None:
        return Video([], micro / 1000)
    spans = []
    if index:
        for k in range(index[0], index[1] - 15, 16):
            name, _, offset, size = struct.unpack_from("<4sIII", data, k)
            if name[2:] in (b"dc", b"db"):
                spans.append((movi[0] + offset + 8 if data[movi[0] + offset : movi[0] + offset + 4] == name else offset + 8, size))  # some indexes count from the file's begin
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                spans.append((at + 8, size))
            at += 8 + size + size % 2
    return Video([data[b : b + n] for b, n in spans if b + n <= len(data)], micro / 1000)


@dataclass(frozen=True)
class Header:
    """What a frame's markers say, and where its entropy-coded data begin."""

    width: int
    height: int
    quantisation: tuple[int, ...]
    dc: tuple[np.ndarray, np.ndarray]
    ac: tuple[np.ndarray, np.ndarray]
    restart: int
    begin: int
    tables: bytes  # the chosen Huffman tables as they were written

    @property
    def blocks(self) -> int:
        return -(-self.width // 8) * -(-self.height // 8)


def _look_up(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that can follow: the symbol they begin with and its code's length (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            first = code << 16 - bits
            symbol[first : first + (1 << 16 - bits)] = symbols[k]
            length[first : first + (1 << 16 - bits)] = bits
            code += 1
            k += 1
        code <<= 1
    return symbol, length


@lru_cache(maxsize=256)
def _header(head: bytes) -> Header:
    at, size, quantisation, tables, restart, chosen, component = 2, None, {}, {}, 0, (0, 0), 0
    while True:
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisation[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (_look_up(body[1:17], body[17 : 17 + total]), body[1 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("frames of one component only")
            size, component = (width, height), body[8]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = (body[2] >> 4, 16 | body[2] & 15)
            break
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("baseline frames only")
    if size is None:
        raise ValueError("a frame without a size")
    return Header(*size, quantisation[component], tables[chosen[0]][0], tables[chosen[1]][0], restart, at, tables[chosen[0]][1] + b"/" + tables[chosen[1]][1])


def header(frame: bytes) -> Header:
    at = 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return _header(frame[: at + 2 + struct.unpack_from(">H", frame, at + 2)[0]])


def coefficients(frames: list[bytes]) -> list[np.ndarray]:
    """Quantised coefficients (blocks x 64, in coding order) of each frame. Frames with the same tables are decoded side by side."""
    heads = [header(f) for f in frames]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((h.restart, h.tables), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 64), np.int32)] * len(frames)
    for members in groups.values():
        for i, c in zip(members, _decoded([frames[i] for i in members], [heads[i] for i in members]), strict=True):
            out[i] = c
    return out


def _decoded(frames: list[bytes], heads: list[Header]) -> list[np.ndarray]:
    head = heads[0]
    data = np.frombuffer(b"".join(f[h.begin :] for f, h in zip(frames, heads, strict=True)), np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]  # restarts and ends of images
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    starts = np.concatenate([[0], marks + 2])
    starts = starts[np.append(True, starts[1:] < len(data))] if len(starts) else starts
    if keep.all():
        clean, begin = data, starts
    else:
        before = np.cumsum(keep) - keep
        clean, begin = data[keep], before[np.minimum(starts, len(data) - 1)]
    blocks = np.array([h.blocks for h in heads])
    each = [[min(h.restart or h.blocks, h.blocks - k) for k in range(0, h.blocks, h.restart or h.blocks)] if h.restart != 1 else None for h in heads]
    lanes = np.ones(int(blocks.sum()), np.int64) if head.restart == 1 else np.array([n for e in each for n in e], np.int64)
    if len(begin) != len(lanes):
        raise ValueError("restart intervals don't match the frame's size")
    padded = np.zeros(len(clean) + 8, np.uint8)
    padded[: len(clean)] = clean
    wide = padded[:-3].astype(np.uint32) << np.uint32(24) | padded[1:-2].astype(np.uint32) << np.uint32(16) | padded[2:-1].astype(np.uint32) << np.uint32(8) | padded[3:]
    longest = int(lanes.max(initial=0))
    first = np.cumsum(lanes) - lanes
    out = np.zeros((int(lanes.sum()), 64), np.int32)
    bit, previous, live = begin * 8, np.zeros(len(lanes), np.int64), np.arange(len(lanes))

    def value(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Signed numbers of `size` bits (at most 16)."""
        raw = (wide[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF) >> 16 >> (16 - size)
        return np.where((raw >> np.maximum(size - 1, 0) == 0) & (size > 0), raw - (1 << size) + 1, raw)

    for step in range(longest):
        live = live[lanes[live] > step]
        at = bit[live]
        peek = (wide[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        size = head.dc[0][peek]
        at = at + head.dc[1][peek]
        previous[live] += value(at, size)
        at = at + size
        row = first[live] + step
        out[row, 0] = previous[live]
        k = np.ones(len(live), np.int64)
        todo = np.arange(len(live))
        now = at
        while len(todo):
            peek = (wide[now >> 3] >> (16 - (now & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            symbol = head.ac[0][peek]
            now = now + head.ac[1][peek]
            size, run = symbol & 15, symbol >> 4
            place = k + run
            number = value(now, size)
            now = now + size
            some = (size > 0) & (place < 64)
            if some.all():
                out[row[todo], place] = number
            else:
                out[row[todo[some]], place[some]] = number[some]
            k = np.where((size == 0) & (run < 15), 64, place + 1)
            going = k < 64
            if not going.all():
                at[todo[~going]] = now[~going]
                todo, now, k = todo[going], now[going], k[going]
        bit[live] = at
    return np.split(out, np.cumsum(blocks)[:-1])


def pixels(coefs: np.ndarray, head: Header) -> np.ndarray:
    """8-bit samples (height x width) of a frame, by the inverse cosine transform."""
    place = zigzag()
    full = np.zeros((len(coefs), 64))
    full[:, place] = coefs * np.array(head.quantisation)
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    blocks = basis @ full.reshape(-1, 8, 8) @ basis.T
    wide = -(-head.width // 8)
    image = blocks.reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, wide * 8)
    return np.clip(np.round(image + 128), 0, 255).astype(np.uint8)[: head.height, : head.width]
