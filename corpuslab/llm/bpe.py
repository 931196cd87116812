"""Byte-level BPE in Spark's own functions.

Text is split by the tokenizer's pattern into words. A word's bytes are merged by a fold: each step joins the first of the
adjacent pairs of the least rank, until no pair has a rank. The literal rank map takes a pair of ids to the id of the joined
piece: its cells are the map's rows laid over one another, so a lookup reads two array cells. Of each piece it
holds the one pair that byte-pair training joins it from: merging any text by ranks never meets a piece's other
halves, since what lies within the piece would have been merged in the piece's own order before. `pairs` recovers these
pairs from the ranks, and refuses a file that no byte-pair training can have left. So a piece is always joined later than
its parts, and equal pairs can be joined in one step: words of more than LONG bytes are folded so, and take as many steps as they
have different merges.

Distinct words of all documents are folded, each once. Documents stand in blocks; a block is packed as its distinct words and the places of
its words among them. The words of all blocks meet in buckets by their hash, and the ids of each block's words go back to the
block. Shuffled are packed blocks and each block's distinct words: a frequent word comes up once for each block, so
no key is hot.

Decoding concatenates the ids' pieces.

Edge cases: a null text counts as empty and has no tokens; letters, numbers and white space are told apart by Unicode's
properties as the Java runtime knows them; very long texts are encoded whole, and a block holds about BLOCK bytes at most, and one batch or document more;
an empty table gives an empty result; repeated rows are encoded alike; of the other columns those asked for are kept.
"""

from __future__ import annotations

import base64
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import few_rows, lean
from corpuslab.plans.scratch import cut

#: Bytes of words in a block, about.
BLOCK = 48 << 20
#: Words of blocks that meet in a bucket, on average; the number of buckets beyond which they grow, and how far.
BUCKET, BUCKETS, MOST = 400_000, 4096, 2_000_000
#: How hard blocks are compressed.
LEVEL = 6
#: Words whose ids are gathered at once.
STEP = 1 << 18
#: Bytes of a word above which equal pairs are joined together.
LONG = 192
#: An id takes this many bits in a key; the last value stands for no id.
BITS = 20
NONE = (1 << BITS) - 1

#: Unicode white space; Java's \s is ASCII only.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def java_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S meaning Unicode white space."""
    out = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
    return out.replace(r"\s", f"[{SPACE}]")


def read_ranks(path: str) -> list[bytes]:
    """Pieces in the order of their ranks."""
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    ranks = sorted((int(r), base64.b64decode(p)) for p, r in lines)
    if [r for r, _ in ranks] != list(range(len(ranks))) or len(ranks) >= NONE:
        raise ValueError("ranks must run from 0 without gaps, below 2 to the power of 20")
    return [p for _, p in ranks]


def pairs(pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(left, right, joined) ids: the pair that each piece of two bytes or more is joined from."""
    rank = {p: r for r, p in enumerate(pieces)}
    out = []
    for r, p in enumerate(pieces):
        parts = [p[i : i + 1] for i in range(len(p))]
        while len(parts) > 2:
            ranks = [rank.get(a + b, r) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == r:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and max(rank.get(x, r) for x in parts) < r:
            out.append((rank[parts[0]], rank[parts[1]], r))
        elif len(p) != 1:
            raise ValueError(f"rank {r} isn't joined from two pieces of lesser ranks")
    return out


def laid(entries: list[tuple[int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """shift and cells: the entry of a pair (left, right) stands in cell shift[left] + right, as its two ids and the joined one."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for left, right, joined in entries:
        rows.setdefault(left, []).append((right, joined))
    size = 8 * len(entries) + 2 * n + 1024
    free, cells, shift, at, width = np.ones(size, dtype=bool), np.full(size, 1 << 3 * BITS, dtype=np.int64), np.zeros(n, dtype=np.int64), 0, 1 << 30
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        rights = np.array([r for r, _ in rows[left]], dtype=np.int64)
        if len(rights) <= width // 2:  # the gaps that wider rows have left
            at, width = 0, len(rights)
        first = rights.min()
        while not (free[at] and free[rights + (at - first)].all()):
            at += 1
        shift[left] = at - first
        free[rights + shift[left]] = False
        for right, joined in rows[left]:
            cells[shift[left] + right] = left << 2 * BITS | right << BITS | joined
    return shift, cells[: int(np.flatnonzero(~free).max(initial=0)) + 1]


def bind(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def long(value: int) -> Column:
    return F.lit(value).cast("long")


class Tokenizer:
    """The rank map of a file, and columns that use it."""

    def __init__(self, path: str, pattern: str):
        self.pieces, self.pattern = read_ranks(path), java_pattern(pattern)
        self.shift, self.cells = laid(pairs(self.pieces), len(self.pieces))
        single = {p: r for r, p in enumerate(self.pieces) if len(p) == 1}
        if len(single) != 256:
            raise ValueError("every byte must have a rank")
        self.bytes = np.array([single[bytes([b])] for b in range(256)], dtype=np.int64)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def map(self, spark: SparkSession) -> Column:
        """The literal rank map: a struct that Spark puts into the plan in its own row format, which tasks read as bytes."""
        row = pa.table({k: pa.array([v], pa.list_(pa.int64())) for k, v in (("shift", self.shift), ("cells", self.cells), ("bytes", self.bytes))})
        return spark.createDataFrame(row).select(F.struct("shift", "cells", "bytes")).scalar()

    def hex(self, spark: SparkSession) -> Column:
        """The literal array of pieces, as hex digits."""
        row = pa.table({"hex": pa.array([[p.hex() for p in self.pieces]], pa.list_(pa.string()))})
        return spark.createDataFrame(row).select(F.struct("hex")).scalar()

    @staticmethod
    def pair(t: Column, left: Column, right: Column) -> Column:
        """The joined id of a pair, NONE without one, and below it the left id. t: the map. NONE has no pairs."""
        cell = F.get(t["cells"], (F.get(t["shift"], left.cast("int")) + right).cast("int"))
        key = F.shiftleft(left, 2 * BITS).bitwiseOR(F.shiftleft(right, BITS))
        return F.shiftleft(F.least(cell.bitwiseXOR(key), long(NONE)), BITS).bitwiseOR(left)

    def fold(self, word: Column, t: Column) -> Column:
        """The ids of a word as an array. t: the map."""

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(long(NONE))

        def paired(p: Column) -> Column:
            """Each id with the joined id of itself and the next, between two ends."""
            end = F.array(long(NONE << BITS | NONE))
            return F.concat(end, F.transform(p, lambda x, j: self.pair(t, x, F.coalesce(F.get(p, j + 1), long(NONE)))), end)

        def first(s: Column, m: Column) -> Column:
            """Joins the first pair m: it and the piece before have new pairs, and the piece after is dropped."""

            def at(i: Column) -> Column:
                joined = F.shiftright(m, BITS)
                before, own = self.pair(t, id_of(F.get(s, i - 2)), joined), self.pair(t, joined, id_of(F.get(s, i + 1)))
                return F.array_compact(F.transform(s, lambda x, j: F.when((j < i - 2) | (j > i), x).when(j == i - 2, before).when(j == i - 1, own)))

            return bind(F.array_position(s, m).cast("int"), at)

        def every(s: Column, m: Column) -> Column:
            """Joins all pairs m, from the left. They are of the same two pieces, so they are found in a text of a letter for each piece."""

            def of(right: Column) -> Column:
                marks = F.array_join(F.transform(s, lambda x: F.when(id_of(x) == id_of(m), "l").when(id_of(x) == right, "r").otherwise(".")), "")
                marked = F.split(F.replace(marks, F.when(id_of(m) == right, "ll").otherwise("lr"), F.lit("J-")), "")
                p = F.array_compact(F.zip_with(s, marked, lambda x, c: F.when(c == "J", F.shiftright(m, BITS)).when(c != "-", id_of(x))))
                return bind(bind(p, lambda q: F.slice(q, F.lit(2), F.size(q) - 2)), paired)

            return bind(id_of(F.get(s, F.array_position(s, m).cast("int"))), of)

        def folded(p: Column) -> Column:
            steps, ids = F.slice(p, F.lit(1), F.size(p) - 1), lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: id_of(x).cast("int"))

            def by(join) -> Column:
                step = lambda s, _: bind(F.array_min(s), lambda m: F.when(m >= long(NONE << BITS), s).otherwise(join(s, m)))
                return F.aggregate(steps, paired(p), step, ids)

            return F.when(F.size(p) <= LONG, by(first)).otherwise(by(every))

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return bind(F.transform(F.split(latin, ""), lambda c: F.get(t["bytes"], F.ascii(c))), folded)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: of each array first all lowest bytes, then all second ones, so that the high bytes, mostly zero, stand together."""
    import zstandard

    z = zstandard.ZstdCompressor(level=LEVEL).compressobj()
    heads = [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays]
    out = [struct.pack("<Q", 1 + sum(10 + a.nbytes for a in arrays)), z.compress(struct.pack("<B", len(arrays)) + b"".join(heads))]
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        out.extend(z.compress(np.ascontiguousarray(planes[:, k])) for k in range(a.itemsize) if len(a))
    return b"".join([*out, z.flush()])


def unsqueezed(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=struct.unpack_from("<Q", data)[0])
    count, out = raw[0], []
    at = 1 + 10 * count
    for i in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * i)
        size = np.dtype(kind.decode()).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view("<" + kind.decode()).ravel())
        at += n * size
    return out


def bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of words, and all their bytes."""
    words = pa.concat_arrays([words])
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :][: len(words) + 1]
    return np.diff(ends), np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]


def words_of(sizes: np.ndarray, data: np.ndarray) -> pa.StringArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def packed(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def slices(lists: pa.ListArray, limit: int):
    """(first, end) of runs of lists of words that hold about `limit` bytes, a list at least."""
    starts = lists.offsets.to_numpy()
    if starts[-1] == starts[0]:
        return [(0, len(lists))]
    ends = np.frombuffer(lists.values.buffers()[1], dtype=np.int32)[lists.values.offset :][starts].astype(np.int64)
    group = (ends[1:] - ends[0]) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    return list(zip(cuts[:-1], cuts[1:]))


def blocks(docs: DataFrame, tokenizer: Tokenizer, keep: list[str], limit: int = BLOCK) -> DataFrame:
    """block, n, rows, places, words: n distinct words, the most frequent first, the places of a block's words among them, and rows, the
    columns to keep with the number of each document's words; all packed."""

    def pack(batches):
        from pyspark import TaskContext

        lean()
        block = TaskContext.get().partitionId() << 32
        rows, codes, held = [], [], 0
        batch = part = lists = words = None

        def flush() -> pa.RecordBatch:
            unified = pa.chunked_array(codes).unify_dictionaries()
            codes.clear()
            words, chunks = unified.chunk(0).dictionary, [c.indices.to_numpy() for c in unified.chunks]
            order = np.argsort(-sum(np.bincount(c, minlength=len(words)) for c in chunks), kind="stable")
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            places, at = np.empty(len(unified), dtype=np.int32), 0
            for c in chunks:
                places[at : at + len(c)] = place[c]
                at += len(c)
            del unified, chunks, c
            own = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            data = [pa.array([x], pa.binary()) for x in (packed(own), squeezed(places), squeezed(*bytes_of(words.take(pa.array(order)))))]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(order)], pa.int64()), *data], ["block", "n", "rows", "places", "words"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi in slices(batch.column(batch.num_columns - 1), limit):
                part = batch.slice(lo, hi - lo)
                lists = part.column(part.num_columns - 1)
                words = lists.flatten()
                # The words themselves are kept once; the rest of the batch is let go.
                codes.append(words.dictionary_encode())
                rows.append(pa.RecordBatch.from_arrays([*part.columns[:-1], pc.list_value_length(lists).cast(pa.int32())], [*keep, "__sizes"]))
                held += int(bytes_of(words)[0].sum())
                if held >= limit:
                    yield flush()
                    block += 1
                    rows.clear()
                    held = 0
                    lean()
        if rows:
            yield flush()
            rows.clear()
        del words, part, lists, batch
        lean()

    return docs.select(*keep, tokenizer.words(F.col("text").cast("string")).alias("__words")).mapInArrow(pack, "block long, n long, rows binary, places binary, words binary")


def by_bucket(held: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, words: the words of a block that fall into a bucket by their hash, and the steps between their places, packed."""

    def deal(batches):
        lean()
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sizes, raw = unsqueezed(data.as_py())
                if not len(sizes):
                    continue
                ends = np.cumsum(sizes)
                view = memoryview(raw)
                own = (np.fromiter((zlib.crc32(view[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())), dtype=np.uint32, count=len(sizes)) % np.uint32(buckets)).astype(np.int32)
                words = words_of(sizes, raw)
                order = np.argsort(own, kind="stable").astype(np.int32)
                words, own = words.take(pa.array(order)), own[order]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                parts = [squeezed(np.diff(order[a:b], prepend=np.int32(0)), *bytes_of(words.slice(a, b - a))) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)])]
                yield pa.RecordBatch.from_arrays([pa.array(own[starts]), pa.array(np.full(len(starts), block)), pa.array(parts, pa.binary())], ["bucket", "block", "words"])

    return held.select("block", "words").mapInArrow(deal, "bucket int, block long, words binary")


def word_ids(dealt: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """block, ids: the ids of a block's words of one bucket, packed with the steps between their places. Each distinct word of a bucket is folded once."""

    def meet(table: pa.Table) -> pa.Table:
        lean()  # of what the bucket before took
        parts = [unsqueezed(x.as_py()) for x in table.column("words")]
        coded = pa.concat_arrays([words_of(sizes, data) for _, sizes, data in parts]).dictionary_encode()
        ends = np.cumsum([len(steps) for steps, _, _ in parts])
        which = np.split(coded.indices.to_numpy(), ends[:-1])
        own = [squeezed(steps, w) for (steps, _, _), w in zip(parts, which)]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"distinct": one(coded.dictionary), "block": one(table.column("block").combine_chunks()), "which": one(pa.array(own, pa.binary()))})

    def part(batches):
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                block, which, ids = (batch.column(k)[i].values for k in range(3))
                out = []
                for x in which:
                    steps, w = unsqueezed(x.as_py())
                    own = ids.take(pa.array(w))
                    out.append(squeezed(steps, pc.list_value_length(own).to_numpy().astype(np.int32), own.flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([block, pa.array(out, pa.binary())], ["block", "ids"])
                del out
                lean()

    met = dealt.groupBy("bucket").applyInArrow(meet, "distinct array<string>, block array<long>, which array<binary>")
    # The map is no column of the rows that run: used once, it is put in its place when the plan is optimised.
    with_map = met.withColumn("__map", tokenizer.map(dealt.sparkSession))
    ids = bind(F.col("__map"), lambda t: F.transform(F.col("distinct"), lambda w: tokenizer.fold(w, t)))
    return with_map.select("block", "which", ids.alias("ids")).mapInArrow(part, "block long, ids binary")


def encode(docs: DataFrame, tokenizer: Tokenizer, keep: list[str], limit: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """The columns `keep` of docs, and ids, the ids of the whole text."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    with few_rows(docs.sparkSession):
        held = cut(blocks(docs, tokenizer, keep, limit), "blocks")
    words, n_blocks = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Beyond BUCKETS buckets they grow, up to MOST words: parts of a block would become too small to pack.
    buckets = max(-(-words // MOST), min(-(-words // bucket), BUCKETS), 1)
    # As many partitions as buckets and blocks: what a task reads doesn't grow with their number.
    found = word_ids(by_bucket(held, buckets).repartition(buckets, "bucket"), tokenizer)

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the one row of a block. right: its words' ids, from each bucket."""
        lean()
        n, rows, places = (left.column(k)[0].as_py() for k in ("n", "rows", "places"))
        parts = [unsqueezed(x.as_py()) for x in right.column("ids")]
        none = np.zeros(0, dtype=np.int32)
        at = np.concatenate([none, *(np.cumsum(steps) for steps, _, _ in parts)]).astype(np.int64)
        lengths, flat = (np.concatenate([none, *(p[k] for p in parts)]) for k in (1, 2))
        sizes, begin = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        sizes[at], begin[at] = lengths, np.cumsum(lengths) - lengths
        (place,), own = unsqueezed(places), unpacked(rows)
        after = np.cumsum(sizes[place], dtype=np.int32)
        ends = np.concatenate(([0], np.cumsum(own.column(own.num_columns - 1).to_numpy())))
        offsets = np.concatenate(([0], after))[ends]
        ids = np.empty(offsets[-1], dtype=np.int32)
        of_word = steps = some = None
        for lo in range(0, len(place), STEP):
            some = place[lo : lo + STEP]
            first, of_word = after[lo - 1] if lo else 0, sizes[some]
            steps = np.cumsum(of_word)
            ids[first : first + steps[-1]] = flat[np.repeat((begin[some] - steps + of_word).astype(np.int32), of_word) + np.arange(steps[-1], dtype=np.int32)]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        del of_word, steps, some, place, after, parts, flat, lengths, at
        lean()
        return pa.table([*own.columns[:-1], lists], [*keep, "ids"])

    parts = max(n_blocks, 1)
    left, right = held.select("block", "n", "rows", "places").repartition(parts, "block"), found.repartition(parts, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(gather, schema)


def decode(coded: DataFrame, tokenizer: Tokenizer, ids: str = "ids") -> DataFrame:
    """coded with ids_text, its ids in decimals joined by one space, and decoded, the bytes of its ids. Pieces are joined as hex digits, since
    Spark joins strings and not bytes; they stand in a literal array by id."""
    with_pieces = coded.withColumn("__pieces", tokenizer.hex(coded.sparkSession))
    found = bind(F.col("__pieces"), lambda t: F.array_join(F.transform(F.col(ids), lambda i: F.get(t["hex"], i)), ""))
    return with_pieces.withColumns({"ids_text": F.array_join(F.col(ids).cast("array<string>"), " "), "decoded": F.unhex(found)}).drop("__pieces")
