"""AVI files of intra-coded JPEG frames, written and read with numpy.

A frame is a grey baseline JPEG of ``FRAME_BLOCKS`` 8x8 blocks. Payload bytes are stored as its unit, the
quantised coefficients, which entropy coding keeps exactly (pixels are rounded, coefficients are not). A
byte ``b`` becomes the coefficient with magnitude category 8 whose eight magnitude bits are ``b``. With
one 8-bit Huffman code in each table, code and magnitude bits are a byte each, so whole frames are
written and read by reshaping arrays. A restart after every block keeps the DC values in range.

``luma`` reads any baseline JPEG, bit by bit: grey or colour, with subsampled colour, with its own quantisation and
Huffman tables or without the latter (as usual in motion JPEG, whose frames then mean the standard's tables).
"""

from __future__ import annotations

import struct

import numpy as np

BLOCKS_WIDE, BLOCKS_HIGH = 4, 4
FRAME_BLOCKS = BLOCKS_WIDE * BLOCKS_HIGH
FRAME_BYTES = 64 * FRAME_BLOCKS
FPS = 25
#: Code of the only symbol (run 0, category 8) in both tables: the first code of length 8.
CODE = 0x00
SYMBOL = 0x08


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(cls: int) -> bytes:
    counts = [0] * 16
    counts[7] = 1
    return bytes([cls << 4, *counts, SYMBOL])


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, *[1] * 64]))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * BLOCKS_HIGH, 8 * BLOCKS_WIDE, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _table(0))
    + _segment(0xC4, _table(1))
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _scans(payload: np.ndarray) -> np.ndarray:
    """Entropy-coded blocks, one row of 130 bytes each: code and byte 64 times, then a marker."""
    blocks = payload.reshape(-1, 64)
    out = np.full((len(blocks), 130), CODE, np.uint8)
    out[:, 1:128:2] = blocks
    out[:, 128] = 0xFF
    out[:, 129] = 0xD0 + np.arange(len(blocks)) % FRAME_BLOCKS % 8
    out[FRAME_BLOCKS - 1 :: FRAME_BLOCKS, 129] = 0xD9
    return out


def frames_of(payload: bytes) -> list[bytes]:
    """JPEG frames that hold the payload, whose length is a multiple of 64; the last is filled with zeros."""
    data = np.frombuffer(payload, np.uint8)
    n = -(-len(data) // FRAME_BYTES)
    data = np.concatenate([data, np.zeros(n * FRAME_BYTES - len(data), np.uint8)])
    rows = _scans(data).reshape(n, FRAME_BLOCKS, 130)
    if not (data == 0xFF).any():
        size = FRAME_BLOCKS * 130
        flat = rows.tobytes()
        return [HEAD + flat[i * size : (i + 1) * size] for i in range(n)]
    return [HEAD + b"".join(b[:128].tobytes().replace(b"\xff", b"\xff\x00") + b[128:].tobytes() for b in frame) for frame in rows]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI with the payload's frames, an idx1 index, and the payload's length in an INFO comment."""
    frames = frames_of(payload)
    width, height = 8 * BLOCKS_WIDE, 8 * BLOCKS_HIGH
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\x00" % len(payload)))
    sizes = np.array([len(f) for f in frames], np.uint32)
    index = np.zeros((len(frames), 4), np.uint32)
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    steps = 8 + sizes.astype(np.int64) + sizes % 2
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(steps)[:-1]])
    index[:, 3] = sizes
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    body = b"AVI " + hdrl + info + movi + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def chunks(data: bytes, at: int, end: int):
    """(name, start, size) of the chunks in a range of a RIFF file."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk ends beyond its parent")
        yield name, at + 8, size
        at += 8 + size + size % 2


#: Endings of the names of chunks that hold a frame.
VIDEO = (b"dc", b"db")


def read_avi(data: bytes) -> tuple[list[bytes], dict]:
    """Frames found through the idx1 index (or by walking movi if there is none), and what the headers say."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    head: dict = {}
    movi, index = None, None
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        for name, start, size in chunks(data, *todo.pop()):
            if name == b"LIST" and data[start : start + 4] == b"movi":
                movi = (start, size)
            elif name == b"LIST":
                todo.append((start + 4, start + size))
            elif name == b"strh":
                scale, rate = struct.unpack_from("<II", data, start + 20)
                if data[start : start + 4] == b"vids" and scale and rate:
                    head["fps"] = rate / scale
            elif name == b"ICMT" and data[start : start + 14] == b"payload_bytes=":
                head["payload_bytes"] = int(data[start + 14 : start + size].rstrip(b"\x00"))
            elif name == b"idx1":
                index = np.frombuffer(data, np.uint32, size // 4, start).reshape(-1, 4)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        found = [(start, size) for name, start, size in chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in VIDEO]
    else:
        # offsets count from the movi list or, in some files, from the file's beginning
        video = [(struct.pack("<I", r[0]), int(r[2]), int(r[3])) for r in index.tolist()]
        video = [(name, o, n) for name, o, n in video if name[2:] in VIDEO]
        base = 0 if video and data[video[0][1] : video[0][1] + 4] == video[0][0] else movi[0]
        found = [(base + o + 8, n) for _, o, n in video]
    if any(a + n > len(data) for a, n in found):
        raise ValueError("an index entry ends beyond the file")
    return [data[a : a + n] for a, n in found], head


def own_form(frames: list[bytes]) -> bool:
    """Whether all frames are as ``frames_of`` writes them, so that they can be read by reshaping."""
    return all(f.startswith(HEAD) for f in frames)


def coefficients(frames: list[bytes]) -> np.ndarray:
    """Quantised coefficients (frame, block, 64) of frames in the own form, DC differences resolved."""
    if frames and all(f.startswith(HEAD) and len(f) == len(HEAD) + 130 * FRAME_BLOCKS for f in frames):
        raw = np.frombuffer(b"".join(frames), np.uint8).reshape(len(frames), -1)[:, len(HEAD) :].reshape(len(frames), FRAME_BLOCKS, 130)
        b = raw[:, :, 1:128:2].astype(np.int16)
        return np.where(b < 128, b - 255, b)
    return np.stack([read_scan(f)[0] for f in frames])


def payload_of(coefs: np.ndarray) -> bytes:
    """The bytes that the coefficients hold."""
    return np.where(coefs < 0, coefs + 255, coefs).astype(np.uint8).tobytes()


#: The Huffman tables that frames without any mean, by the JPEG standard: for each class and number the counts of codes
#: by length, and the symbols that come first; the other symbols follow in ascending order. Fixed values.
STANDARD = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1), ""),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1), ""),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def huffman(counts: bytes | tuple[int, ...], symbols: bytes) -> dict[tuple[int, int], int]:
    """From (length, code) to symbol."""
    table, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def standard_tables() -> dict[int, dict[tuple[int, int], int]]:
    out = {}
    for number, (counts, first) in STANDARD.items():
        begin = bytes.fromhex(first)
        every = range(12) if number < 0x10 else sorted({run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0})
        out[number] = huffman(counts, begin + bytes(x for x in every if x not in begin))
    return out


def read_scan(jpeg: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quantised luma coefficients (block, 64) of a baseline JPEG, blocks in coded order, and their quantiser (64)."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, restart, tables, quantisers = 2, 0, {}, {}
    parts: list[tuple[int, int, int, int]] = []  # of each component: its name, blocks across and down in a unit, quantiser
    height = width = 0
    while True:
        while jpeg[at : at + 2] == b"\xff\xff":
            at += 1
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quantisers[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int32)
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = huffman(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            used = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            break
    if not parts or not height or not width or set(used) != {p[0] for p in parts}:
        raise ValueError("not one scan of all components")
    tables = standard_tables() | tables if not tables else tables
    if len(parts) == 1:  # a single component is coded block by block, whatever its sampling says
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    units = -(-width // (8 * across)) * -(-height // (8 * down))
    name, h, v, quantiser = parts[0]
    out = np.zeros((units * h * v, 64), np.int32)
    bits, last, row = _Bits(jpeg, at), [0] * len(parts), 0
    for unit in range(units):
        if restart and unit and unit % restart == 0:
            bits.restart()
            last = [0] * len(parts)
        for c, (name, h, v, _) in enumerate(parts):
            dc, ac = tables[used[name][0]], tables[0x10 | used[name][1]]
            for _ in range(h * v):
                block = out[row] if c == 0 else None
                row += c == 0
                last[c] += bits.value(bits.symbol(dc))
                if block is not None:
                    block[0] = last[c]
                k = 1
                while k < 64:
                    s = bits.symbol(ac)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        v_ = bits.value(s & 15)
                        if k > 63:
                            raise ValueError("a block of over 64 coefficients")
                        if block is not None:
                            block[k] = v_
                    k += 1
    return out, quantisers.get(quantiser, np.ones(64, np.int32))


def luma(jpeg: bytes) -> np.ndarray:
    """Decoded luma samples (block, 64) of a baseline JPEG. Blocks that only fill the last unit up are among them."""
    coefs, quantiser = read_scan(jpeg)
    return pixels(coefs * quantiser)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.n = data, at, 0, 0

    def bit(self) -> int:
        if not self.n:
            if self.at >= len(self.data):
                raise ValueError("the scan ends too early")
            self.held, self.n = self.data[self.at], 8
            self.at += 2 if self.held == 0xFF else 1  # a stuffed zero follows 0xFF
        self.n -= 1
        return self.held >> self.n & 1

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = 0
        for _ in range(size):
            v = v << 1 | self.bit()
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def restart(self) -> None:
        self.n = 0
        self.at += 2


def _basis() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c.astype(np.float32)


BASIS = _basis()


def pixels(coefs: np.ndarray) -> np.ndarray:
    """Decoded samples (..., block, 64), 0 to 255, of coefficients that the quantiser has been multiplied to."""
    grid = np.zeros(coefs.shape, np.float32)
    grid[..., ZIGZAG] = coefs
    grid = grid.reshape(*coefs.shape[:-1], 8, 8)
    shown = BASIS.T @ grid @ BASIS
    return np.clip(np.rint(shown + 128), 0, 255).astype(np.uint8).reshape(coefs.shape)
