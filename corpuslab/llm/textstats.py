"""Counts over the whole texts of an Arrow batch, computed on its UTF-8 bytes.

A word is a run of anything but ASCII white space. Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes of text that are looked at together; their arrays take many times that.
STEP = 1 << 19


@dataclass
class Block:
    """Texts as one run of bytes. starts has one more entry than there are texts; words are runs of the list offsets."""

    data: np.ndarray
    starts: np.ndarray
    words: pa.DictionaryArray
    word_doc: np.ndarray
    word_starts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte over each text."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]


def pieces(texts: pa.Array, limit: int = STEP):
    """(first, last) rows whose texts hold at most about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    return zip(cuts[:-1], cuts[1:])


def block(texts: pa.Array) -> Block:
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pa.concat_arrays([whole])
    raw = whole.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=len(raw) + 1 + raw.offset)[raw.offset :]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, dtype=np.uint8)
    starts = offsets - offsets[0]
    lists = pc.ascii_split_whitespace(whole)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(whole)), counts)
    real = pc.greater(pc.binary_length(flat), 0)
    keep = real.to_numpy(zero_copy_only=False)
    flat, doc = flat.filter(real), doc[keep]
    word_starts = np.searchsorted(doc, np.arange(len(whole) + 1))
    return Block(data, starts, flat.dictionary_encode(), doc, word_starts)


def base_counts(b: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols."""
    space = _SPACE[b.data]
    return {
        "n_words": np.diff(b.word_starts).astype(np.int64),
        "word_chars": b.per_text(((b.data & 0xC0) != 0x80) & ~space),
        "n_symbols": b.per_text(_SYMBOL[b.data]),
    }


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines with a word that equal an earlier line, and lines with a word."""
    out = np.zeros((len(texts), 2), dtype=np.int64)
    for i, raw in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        lines = [x for x in (raw or b"").split(b"\n") if x and not x.isspace()]
        out[i] = len(lines) - len(set(lines)), len(lines)
    return out[:, 0], out[:, 1]


def repeated_words(b: Block, width: int = 3) -> np.ndarray:
    """For each text: words that stand in a window of `width` words found twice or more in the text."""
    index, doc = b.words.indices.to_numpy().astype(np.int64), b.word_doc
    m = len(index) - width + 1
    if m < 1:
        return np.zeros(b.n, dtype=np.int64)
    # Windows are numbered one word at a time, so equal numbers mean equal windows.
    key = index[: len(index)]
    for k in range(1, width):
        pair = key[: len(index) - k] * (len(b.words.dictionary) + 1) + index[k:]
        key = np.unique(pair, return_inverse=True)[1] if k < width - 1 else pair
    inside = doc[:m] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    covered = np.zeros(len(index), dtype=bool)
    for j in range(width):
        covered[hit + j] = True
    return np.bincount(doc[covered], minlength=b.n).astype(np.int64)
