"""md5 of many short texts at once, the digests that functions.draws sorts by."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_AT = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes that one block of md5 holds beside its padding.
ROOM = 55
#: Texts that are digested together: enough that the calls on their arrays cost little, and few enough for a core's cache.
STEP = 32_768


def _block(words: list[np.ndarray | None], n: int) -> list[np.ndarray]:
    """The four words of the digests of n one-block messages. words: 16 arrays, None where all are zero."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _K[i], out=f)
        w = words[_AT[kind](i)]
        if w is not None:
            np.add(f, w, out=f)
        turn = _TURN[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return [x + y for x, y in zip((a, b, c, d), _START)]


def md5_of(seeds: list[int], texts: pa.Array):
    """(seed, high, low) for each seed: the digests of "seed|text" as two unsigned halves, which sort as the hex digits do. Nulls count as empty."""
    raw = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_binary()), b"")])
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset :][: len(raw) + 1]
    data, sizes, n = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8), np.diff(offsets), len(raw)
    widths = {s: len(f"{s}|") for s in seeds}
    long = np.flatnonzero(sizes + max(widths.values(), default=0) > ROOM)
    short = np.where(sizes + max(widths.values(), default=0) > ROOM, 0, sizes)
    row = np.repeat(np.arange(n), short)
    col = np.arange(len(row)) - np.repeat(np.cumsum(short) - short, short)
    laid = {}
    for width in set(widths.values()):
        block = np.zeros((n, 64), dtype=np.uint8)
        block[row, width + col] = data[np.repeat(offsets[:-1], short) + col]
        block[np.arange(n), width + short] = 0x80
        block[:, 56:58] = ((width + short) * 8).astype("<u2").view(np.uint8).reshape(n, 2)
        words = np.ascontiguousarray(block.view("<u4").T)
        laid[width] = [w if w.any() else None for w in words]
    for seed in seeds:
        width, head = widths[seed], f"{seed}|".encode()
        first = np.frombuffer(head.ljust(-(-width // 4) * 4, b"\0"), dtype="<u4")
        digests = np.empty((n, 4), dtype="<u4")
        for lo in range(0, n, STEP):
            hi = min(lo + STEP, n)
            words = [None if w is None else w[lo:hi] for w in laid[width]]
            for k, x in enumerate(first):
                words[k] = (np.zeros(hi - lo, dtype=np.uint32) if words[k] is None else words[k]) | x
            for k, x in enumerate(_block(words, hi - lo)):
                digests[lo:hi, k] = x
        high, low = (digests.view(">u8")[:, k].astype(np.uint64) for k in range(2))
        for i in long.tolist():
            digest = hashlib.md5(head + data[offsets[i] : offsets[i + 1]].tobytes()).digest()
            high[i], low[i] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
        yield seed, high, low
