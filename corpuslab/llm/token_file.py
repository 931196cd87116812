"""Token ids in patched frame-of-reference blocks.

A segment is one binary value that stands for itself:

    header      magic "PFR1", number of blocks (uint32), ids a block (uint32), number of ids (uint64)
    index       for each block its start in the payload (uint64)
    block       minimum (uint32), width (uint8), number of exceptions (uint16), the low `width` bits of (id - minimum) packed
                with the least bit first, positions of the exceptions (uint16), their (id - minimum) (uint32)

The width holds all but the largest tenth of a block's values; those are exceptions. The last block is padded with
its minimum. Segments are rows of a table, with the documents they hold, so Spark's committers
write them to any store and a lost task leaves nothing half written.

Edge cases: a null text is empty and leaves only the end id; documents come in ascending doc_id order, null first, rows
of one doc_id by the text's hash, so repeated rows stand together; a very long text is encoded whole, in a segment of its own; other columns
are ignored; an empty table writes an empty table.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.plans.scratch import new_path

BLOCK = 512
KEEP = 0.9
END = 1
MAGIC = b"PFR1"
#: Bytes of text that are encoded at once.
STEP = 8 << 20
#: Bytes of words and their ids that a worker remembers.
MEMORY = 48 << 20


#: Blocks whose bits are laid out at once.
TOGETHER = 256
#: What stands before the bits of a block.
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2")])


def low_bits(values: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each value, the least first, one packed row for each row of values."""
    kind = "<u2" if w <= 16 else "<u4"
    if w == 8 * np.dtype(kind).itemsize:
        return np.ascontiguousarray(values.astype(kind)).view(np.uint8)
    if w <= 16 and values.shape[1] % 8 == 0:
        # Eight values are w bytes: two words of four values each, laid out in 16 bytes.
        four = (values & np.uint32((1 << w) - 1)).astype("<u8").reshape(-1, 4)
        four = (four[:, 0] | four[:, 1] << np.uint64(w) | four[:, 2] << np.uint64(2 * w) | four[:, 3] << np.uint64(3 * w)).reshape(-1, 2)
        eight = np.stack((four[:, 0] | four[:, 1] << np.uint64(4 * w), four[:, 1] >> np.uint64(64 - 4 * w)), axis=1) if w else four
        return eight.view(np.uint8)[:, :w].reshape(len(values), -1)
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8)
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(values), values.shape[1], -1)[:, :, :w]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def from_bits(packed: np.ndarray, w: int, block: int) -> np.ndarray:
    """What low_bits packed."""
    kind = "<u2" if w <= 16 else "<u4"
    size = 8 * np.dtype(kind).itemsize
    if w < min(size, 16) and block % 8 == 0:
        eight = np.zeros((len(packed) * block // 8, 16), dtype=np.uint8)
        eight[:, :w] = packed.reshape(-1, w)
        eight = eight.view("<u8")
        four = np.stack((eight[:, 0], eight[:, 0] >> np.uint64(4 * w) | eight[:, 1] << np.uint64(64 - 4 * w)), axis=1)
        return (four[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(w)) & np.uint64((1 << w) - 1)).astype(np.uint32).reshape(len(packed), block)
    if w < size:
        bits = np.zeros((len(packed), block, size), dtype=np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, count=block * w, bitorder="little").reshape(len(packed), block, w)
        packed = np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(kind).astype(np.uint32)


def pack(ids: np.ndarray, block: int = BLOCK, keep: float = KEEP) -> bytes:
    n = len(ids)
    count = -(-n // block)
    full = np.zeros(count * block, dtype=np.uint32)
    full[:n] = ids
    if n % block:
        full[n:] = ids[(count - 1) * block :].min()
    rows = full.reshape(count, block)
    low = rows.min(axis=1) if count else np.zeros(0, dtype=np.uint32)
    rest = rows - low[:, None]
    at = min(block - 1, int(np.ceil(keep * block)) - 1)
    limit = np.partition(rest, at, axis=1)[:, at] if count else low
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    odd = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_odd = odd.sum(axis=1)
    heads = np.empty(count, dtype=HEAD)
    heads["low"], heads["width"], heads["odd"] = low, width, n_odd
    odd = np.flatnonzero(odd)
    ends, where, beyond = np.cumsum(n_odd).tolist(), (odd % block).astype("<u2").tobytes(), rest.ravel()[odd].astype("<u4").tobytes()
    heads, n_odd = heads.tobytes(), n_odd.tolist()
    parts: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        same = np.flatnonzero(width == w)
        for at in range(0, len(same), TOGETHER):
            own = same[at : at + TOGETHER]
            packed = low_bits(rest[own], w)
            size, packed = packed.shape[1], packed.tobytes()
            for k, i in enumerate(own.tolist()):
                hi, lo = ends[i], ends[i] - n_odd[i]
                parts[i] = heads[7 * i : 7 * i + 7] + packed[k * size : k * size + size] + where[2 * lo : 2 * hi] + beyond[4 * lo : 4 * hi]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1] if count else np.zeros(0)
    return MAGIC + struct.pack("<IIQ", count, block, n) + starts.astype("<u8").tobytes() + b"".join(parts)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; all by default), found by the index."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of packed ids")
    count, block, n = struct.unpack_from("<IIQ", data, 4)
    starts = np.frombuffer(data, "<u8", count, 20).astype(np.int64) + 20 + 8 * count
    last = count if last is None else min(last, count)
    starts = starts[first:last].tolist()
    heads = np.frombuffer(b"".join([data[s : s + 7] for s in starts]), HEAD)
    out = np.empty((len(heads), block), dtype=np.uint32)
    for w in np.unique(heads["width"]).tolist():
        same = np.flatnonzero(heads["width"] == w)
        if not w:
            out[same] = 0
            continue
        size = -(-block * w // 8)
        for at in range(0, len(same), TOGETHER):
            own = same[at : at + TOGETHER]
            packed = b"".join([data[starts[i] + 7 : starts[i] + 7 + size] for i in own.tolist()])
            out[own] = from_bits(np.frombuffer(packed, np.uint8).reshape(len(own), size), w, block)
    n_odd = heads["odd"].astype(np.int64)
    places = [(s + 7 + -(-block * w // 8), k) for s, w, k in zip(starts, heads["width"].tolist(), n_odd.tolist())]
    where = np.frombuffer(b"".join([data[at : at + 2 * k] for at, k in places]), "<u2")
    beyond = np.frombuffer(b"".join([data[at + 2 * k : at + 6 * k] for at, k in places]), "<u4")
    out[np.repeat(np.arange(len(heads)), n_odd), where] = beyond
    out += heads["low"][:, None]
    return out.ravel()[: n - first * block if last == count else None]


#: Classes of bytes: white space, letters, digits, apostrophe, other punctuation of ASCII, and the rest.
SPACE, LETTER, DIGIT, QUOTE, PUNCT, OTHER = range(6)
CLASS = bytes(SPACE if x in b"\t\n\v\f\r " else QUOTE if x == 39 else OTHER if not 32 < x < 127 else LETTER if chr(x).isalpha() else DIGIT if chr(x).isdigit() else PUNCT for x in range(256))
#: Latin letters of two bytes, the first of which is LEAD: all from 0xC0 to 0xFF but the signs of multiplication and division.
LEAD, SIGNS = 0xC3, (0x97, 0xB7)
LATIN = "".join(chr(x) for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))
#: Words of those letters and ASCII's, with a capital among them; words of small ones.
CAPITAL = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}][A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"
SMALL_ASCII, SMALL_LATIN = "^[a-z]+$", r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
#: How byte-level vocabularies write bytes from 0x80 on, in UTF-8: those that Latin-1 prints as that character, the others as further characters in turn.
PRINTED = [*range(161, 173), *range(174, 256)]
WRITTEN = np.array([list(chr(x if x in PRINTED else 256 + 34 + sum(y not in PRINTED for y in range(128, x))).encode()) for x in range(128, 256)], dtype=np.uint8)


def beginnings(pairs) -> bytes:
    """For each pair of classes, eight times the first and the second, whether a word begins between them; a table for bytes.translate."""
    own = {8 * a + b for a, b in pairs}
    return bytes(x in own for x in range(256))


BY_SPACE = beginnings((SPACE, b) for b in range(LETTER, OTHER + 1))
BY_PARTS = beginnings((a, b) for a in range(OTHER + 1) for b in range(LETTER, OTHER + 1) if SPACE == a or DIGIT in (a, b) or (a, b) in ((LETTER, QUOTE), (LETTER, PUNCT), (PUNCT, LETTER)))


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and where each begins and ends in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, dtype=np.int32)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int32)
    return np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def written(words: pa.Array) -> pa.Array:
    """The words as byte-level vocabularies write them: bytes from 0x80 on as WRITTEN."""
    data, offsets = pieces(words)
    high = data > 127
    if not high.any():
        return words
    wide = np.repeat(data, 1 + high)
    at = np.flatnonzero(high) + np.arange(high.sum())
    wide[at], wide[at + 1] = WRITTEN[data[high] - 128].T
    more = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(high, dtype=np.int32)))
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets + more[offsets]), pa.py_buffer(wide))


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    The tokenizer drops white space and joins nothing across it, so words between ASCII white space are encoded on their own,
    each distinct one once, and the ids of a text are those of its words one after the other. Where the tokenizer also parts letters of ASCII or
    Latin-1 from digits and punctuation of ASCII, whatever stands around them, words end there too: that makes fewer distinct words.
    """

    def __init__(self, path: str):
        # A worker is one of many on its machine: threads of its own would only take turns with theirs, and each keeps memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.lowers, self.lowers_more = self.parts_ascii(), self.lowers_ascii(), self.lowers_latin()
        self.plain = SMALL_LATIN if self.plain_latin() else SMALL_ASCII if self.plain_ascii() else None
        self.forget()

    def alike(self, some: list[str], others: list[str]) -> bool:
        """Whether texts have the same ids one by one."""
        return all(x.ids == y.ids for x, y in zip(*(self.tokenizer.encode_batch_fast(z, add_special_tokens=False) for z in (some, others))))

    def parts_ascii(self) -> bool:
        """Whether the tokenizer parts as BY_PARTS: each character of ASCII is tried between and beside letters, digits and others, each Latin letter
        beside each of ASCII."""
        tries = [a + c + b for c in map(chr, range(33, 127)) for a in ("ab", "7", "é", ".", "'", "(") for b in ("cd", "s", "8", "é", "\u0338", ".", "'s")]
        tries += [c + p + c for c in LATIN for p in map(chr, range(33, 127))]
        words, ends = self.cut(pa.array(tries, pa.string()), BY_PARTS)
        words, ends = words.to_pylist(), ends.tolist()
        return self.alike(tries, [" ".join(words[lo:hi]) for lo, hi in zip([0, *ends], ends)])

    def lowers_ascii(self) -> bool:
        """Whether ASCII letters are the same to the tokenizer in both cases."""
        tries = [f"{a}{b}" for a in map(chr, range(65, 91)) for b in ("", *map(chr, range(65, 91)))] + ["'S", "I'LL", "A.B"]
        return self.alike(tries, [x.lower() for x in tries])

    def lowers_latin(self) -> bool:
        """Whether words of letters of ASCII and Latin-1 are the same to the tokenizer in both cases."""
        tries = [x for a in LATIN for b in ("", "s", "S", "é", "É", "ß", "ÿ", "ne", "NE") for x in (a + b, b + a)]
        return self.alike(tries, [x.lower() for x in tries])

    def plain_ascii(self) -> bool:
        """Whether the model alone gives the ids of words of small ASCII letters: tried on pairs and triples of them, and on the vocabulary's own words."""
        few = "aeinstxz"
        tries = [a + b for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123))] + [a + b + c for a in few for b in few for c in few]
        tries += [w for w in (re.sub("[^a-z]", "", x) for x in itertools.islice(sorted(self.tokenizer.get_vocab()), 0, None, 25)) if w]
        return self.by_model(pa.array(tries)) == self.by_tokenizer(pa.array(tries))

    def plain_latin(self) -> bool:
        """Whether the model alone gives the ids of words of small letters of ASCII and Latin-1, their bytes as WRITTEN: tried on pairs of them."""
        if not self.plain_ascii():
            return False
        small = sorted(set(LATIN.lower()))
        tries = [a + b for a in small for b in (*small, "", "s", "ne")] + [a + b for a in ("s", "ne") for b in small]
        return self.by_model(pa.array(tries)) == self.by_tokenizer(pa.array(tries))

    def hold_special(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a special token."""
        out, data = np.zeros(len(texts), dtype=bool), pieces(texts)[0].tobytes()
        for x in self.special:
            # Most data hold none: then no text is looked at on its own.
            if x.encode() in data:
                out |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return out

    def cut(self, texts: pa.Array, law: bytes) -> tuple[pa.Array, np.ndarray]:
        """The texts' words, each with the white space after it, and how many words end with each text. Texts that hold a special token are
        parted by white space only. White space that begins a text is a word of its own."""
        data, offsets = pieces(texts)
        if not len(data):
            return pa.array([], pa.string()), np.zeros(len(texts), dtype=np.int64)
        kinds = np.frombuffer(bytearray(data.tobytes().translate(CLASS)), np.uint8)
        lead = np.flatnonzero(data == LEAD)
        lead = lead[~np.isin(data[lead + 1], SIGNS)]
        kinds[lead] = kinds[lead + 1] = LETTER
        pairs = kinds[:-1] << 3
        pairs |= kinds[1:]
        pairs = pairs.tobytes()
        begins = np.frombuffer(bytearray(b"\1" + pairs.translate(law)), bool)
        for k in np.flatnonzero(self.hold_special(texts)).tolist():
            lo, hi = offsets[k : k + 2].tolist()
            begins[lo + 1 : hi] = np.frombuffer(pairs[lo : hi - 1].translate(BY_SPACE), bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data))
        return words, np.searchsorted(begins[:-1], offsets[1:])

    def forget(self) -> None:
        """Known words, and where the ids of each begin in one run of ids."""
        self.words, self.flat, self.begin = pa.array([], pa.string()), np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int32)

    def by_model(self, words: pa.Array) -> tuple[list[int], list[int]]:
        """The ids of plain words one after the other, and how many each has. They are one piece to the tokenizer, so its model takes them as they are."""
        model = self.tokenizer.model.tokenize
        if not len(words):
            return [], []
        # One string that Python parts is made faster than many.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), written(words)), "\n")[0].as_py()
        ids, sizes = [], []
        for word in joined.split("\n"):
            own = [t.id for t in model(word)]
            ids += own
            sizes.append(len(own))
        return ids, sizes

    def by_tokenizer(self, words: pa.Array) -> tuple[list[int], list[int]]:
        """The same of any words, by the whole tokenizer."""
        own = [x.ids for x in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return list(itertools.chain.from_iterable(own)), [len(x) for x in own]

    def learn(self, words: pa.Array) -> np.ndarray:
        """Adds unknown words to the known ones; the number of each."""
        before, ids, sizes = len(self.words), [self.flat], []
        plain = pc.match_substring_regex(words, self.plain).to_numpy(zero_copy_only=False) & ~self.hold_special(words) if self.plain else np.zeros(len(words), dtype=bool)
        kinds = [(words.filter(pa.array(plain)), self.by_model), (words.filter(pa.array(~plain)), self.by_tokenizer)]
        for own, ids_of in kinds:
            for at in range(0, len(own), 4096):
                some, n = ids_of(own.slice(at, 4096))
                ids.append(np.array(some, dtype=np.uint32))
                sizes.append(np.array(n, dtype=np.int32))
        self.words = pa.concat_arrays([self.words, *(own for own, _ in kinds)])
        self.flat = np.concatenate(ids)
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int32)))
        return before - 1 + np.where(plain, np.cumsum(plain), plain.sum() + np.cumsum(~plain)).astype(np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """The number of each word among the known ones; unknown words are learned first."""
        found = pc.index_in(words, value_set=self.words)
        if not found.null_count:
            return found.to_numpy()
        new = pc.is_null(found)
        unknown = words.filter(new)
        if self.words.nbytes + self.flat.nbytes + self.begin.nbytes + unknown.nbytes > MEMORY:
            self.forget()
            return self.learn(words)
        out = pc.fill_null(found, 0).to_numpy().copy()
        out[new.to_numpy(zero_copy_only=False)] = self.learn(unknown)
        return out

    def lowered(self, words: pa.Array) -> pa.Array:
        """The words in small letters, where that makes no difference to the tokenizer."""
        small, ascii_ = words, pc.string_is_ascii(words)
        if self.lowers:
            small = pc.if_else(ascii_, pc.ascii_lower(words), words)
        if self.lowers_more:
            other = pc.invert(ascii_)
            some = words.filter(other)
            small = pc.replace_with_mask(small, other, pc.if_else(pc.match_substring_regex(some, CAPITAL), pc.utf8_lower(some), some))
        # What small letters would make a special token stays as it is.
        special = self.hold_special(small)
        return pc.if_else(pa.array(special), words, small) if special.any() else small

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's ids. Null counts as empty."""
        words, ends = self.cut(pc.fill_null(texts, "").cast(pa.string()), BY_PARTS if self.parts else BY_SPACE)
        coded = words.dictionary_encode()
        words = self.lowered(pc.ascii_trim_whitespace(coded.dictionary))
        distinct = words.dictionary_encode()
        own = self.places(distinct.dictionary)[distinct.indices.to_numpy()]
        index = coded.indices.to_numpy()
        begin, n = self.begin[own][index], (self.begin[own + 1] - self.begin[own])[index]
        after = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(n, dtype=np.int32)))
        at = np.repeat(begin - after[:-1], n)
        at += np.arange(after[-1], dtype=np.int32)
        return self.flat[at], np.diff(after[ends], prepend=0).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def steps(batch: pa.RecordBatch, column: int, limit: int = STEP):
    """Slices of the batch that hold at most about `limit` bytes in the column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(lo, hi - lo)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Writes the segments of docs (doc_id, text) to the table at path; their order is (part, segment)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)

    def encode(batches):
        from pyspark import TaskContext

        part, segment, before = TaskContext.get().partitionId(), 0, 0
        encoder = _ENCODERS.get(tokenizer)
        if encoder is None:
            encoder = _ENCODERS[tokenizer] = Encoder(tokenizer)
        for batch in batches:
            # What Arrow keeps of the piece before would add to what this one takes.
            for piece in steps(batch, 1) if batch.num_rows else []:
                pa.default_memory_pool().release_unused()
                ids, lengths = encoder.encode(piece.column(1))
                ends = np.cumsum(lengths + 1)
                whole = np.full(len(ids) + len(lengths), end, dtype=np.uint32)
                mask = np.ones(len(whole), dtype=bool)
                mask[ends - 1] = False
                whole[mask] = ids
                doc_ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                sizes = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), pa.array(lengths + 1, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([len(whole)], pa.int64()), doc_ids, sizes, pa.array([pack(whole)], pa.binary())], ["part", "segment", "in_part", "n_ids", "doc_ids", "sizes", "payload"])
                segment, before = segment + 1, before + len(whole)

    rows.mapInArrow(encode, "part int, segment int, in_part long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: from the segments at path. start counts the ids of all documents before."""
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row for each partition of the writer: that bounds the broadcast, and the payloads stay where they are read.
    parts = F.broadcast(parts.select("part", before.alias("before")))
    rows = segments.join(parts, "part").select((F.col("before") + F.col("in_part")).alias("first"), "doc_ids", "sizes", "payload")

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column(2)[i].values.to_numpy()
                raw = unpack(batch.column(3)[i].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                start = pa.array(ends - sizes + batch.column(0)[i].as_py(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, start, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: the documents' ids, read back from the segments at path."""

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column(1)[i].values.to_numpy()
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(unpack(batch.column(2)[i].as_py()).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, lists], ["doc_id", "ids"])

    return spark.read.parquet(path).select("doc_ids", "sizes", "payload").mapInArrow(decode, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes docs to a new table in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "token_ids")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
