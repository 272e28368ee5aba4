"""Operator 7 — token ids in one compressed wavelet-matrix file per shard.

A shard's tokens are stored as succinct bit-planes, most significant bit
first: each plane holds one bit of every token, with the tokens stably
reordered so that those with a zero bit come first. A plane is cut into blocks
of ``BLOCK_BITS`` bits, each compressed by itself, and the file holds a
directory of every block's place and ones. Access by position, counting in a
prefix and lookup of the k-th occurrence inflate one block a plane and count
inside it, so the file is never decoded whole and may stay in its store: what
a reader holds is the directory and the blocks it has touched last. Because
the end id is an ordinary vocabulary entry that texts may contain, the file
also keeps each document's id and length.

File format, little-endian: ``SGWM0003``, uint32 header length, JSON header
(counts, zero bits per plane, block size, section lengths), then zlib sections:
document ids (int64 deltas), document lengths (int64), ones by block (uint32,
plane after plane), compressed block sizes (uint32, likewise); then the blocks
of all planes (packed bits, lowest first), each a zstd frame.

Documents are range-partitioned by id and, among equal and null ids, by their
text's hash, so the files in order of (task, part) hold ascending ids and no id
fills a task. Every attempt of a task writes files of its own; the table of
files, which a task commits once, lists those that count.

Defined results: a null text is an empty document; null ids come first and are
read back as null; rows that repeat an id stand in order of their text's hash;
an empty table gives no files and an empty result; a text longer than a file's
size makes one large file. Only id and text are read, so further columns of
any name don't matter.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table, text_batches
from .word_bpe import encoder, tokenizer_path

MAGIC = b"SGWM0003"
END = 1
LEVELS = 16
FILE_TOKENS = 2_000_000  # a file is closed once it holds so many
BLOCK_BITS = 1 << 15  # of a plane, compressed together
KEPT_BLOCKS = 32  # inflated blocks that a plane keeps
ZSTD = pa.Codec("zstd", 1)  # of a block


class BitPlane:
    """Compressed blocks of bits with the ones before each block."""

    def __init__(self, fetch: Callable[[int, int], bytes], ones: np.ndarray, sizes: np.ndarray, at: int, n: int, block_bits: int) -> None:
        self.fetch, self.n, self.block_bits = fetch, n, block_bits
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        self.places = at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.inflated: OrderedDict[int, np.ndarray] = OrderedDict()

    def _inflate(self, raw: bytes, block: int) -> bytes:
        step = self.block_bits // 8
        return ZSTD.decompress(raw, decompressed_size=min(step, -(-self.n // 8) - block * step), asbytes=True)

    def _words(self, block: int) -> np.ndarray:
        if block not in self.inflated:
            raw = self._inflate(self.fetch(int(self.places[block]), int(self.places[block + 1] - self.places[block])), block)
            self.inflated[block] = np.frombuffer(raw.ljust(self.block_bits // 8, b"\0"), "<u8")
            if len(self.inflated) > KEPT_BLOCKS:
                self.inflated.popitem(last=False)
        self.inflated.move_to_end(block)
        return self.inflated[block]

    def bit(self, i: int) -> int:
        block, i = divmod(i, self.block_bits)
        return int(self._words(block)[i >> 6]) >> (i & 63) & 1

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        if i >= self.n:
            return int(self.before[-1])
        block, i = divmod(i, self.block_bits)
        words = self._words(block)
        part = int(words[i >> 6]) & ((1 << (i & 63)) - 1)
        return int(self.before[block]) + int(np.bitwise_count(words[: i >> 6]).sum(dtype=np.int64)) + part.bit_count()

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        ranks = self.before if bit else np.minimum(self.block_bits * np.arange(len(self.before)), self.n) - self.before
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        words = self._words(block) if bit else ~self._words(block)
        ends = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        k -= int(ranks[block])
        w = int(np.searchsorted(ends, k, side="right"))
        word = int(words[w])
        for _ in range(k - (int(ends[w - 1]) if w else 0)):
            word &= word - 1
        return block * self.block_bits + 64 * w + (word & -word).bit_length() - 1

    @cached_property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, and the ones before each: for many positions at once, as large as the tokens themselves."""
        start, last = int(self.places[0]), int(self.places[-1])
        raw, ends = self.fetch(start, last - start), (self.places - start).tolist()
        packed = b"".join(self._inflate(raw[a:z], i) for i, (a, z) in enumerate(zip(ends, ends[1:])))
        words = np.frombuffer(packed.ljust(8 * (len(packed) // 8 + 1), b"\0"), "<u8")
        return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.whole[0].view(np.uint8), bitorder="little", count=self.n).astype(bool)

    def bits_at(self, at: np.ndarray) -> np.ndarray:
        return (self.whole[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ranks1(self, at: np.ndarray) -> np.ndarray:
        words, before = self.whole
        word = np.minimum(at >> 6, len(words) - 1)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def selects(self, bit: int, ks: np.ndarray) -> np.ndarray:
        words, before = self.whole
        ranks = before if bit else 64 * np.arange(len(before)) - before
        w = np.searchsorted(ranks, ks, side="right") - 1
        word, left = (words[w] if bit else ~words[w]), ks - ranks[w]
        for _ in range(int(left.max(initial=0))):
            word = np.where(left > 0, word & (word - np.uint64(1)), word)
            left = left - 1
        return 64 * w + np.bitwise_count((word & -word) - np.uint64(1))


class WaveletMatrix:
    """Access, count and occurrence lookup over one shard's tokens."""

    def __init__(self, planes: list[BitPlane], zeros: list[int], n: int) -> None:
        self.planes, self.zeros, self.n = planes, zeros, n

    @staticmethod
    def pack(tokens: np.ndarray, levels: int = LEVELS) -> tuple[list[bytes], list[int]]:
        planes, zeros, now = [], [], pa.array(tokens)
        for level in range(levels - 1, -1, -1):
            one = (now.to_numpy() & tokens.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(one, bitorder="little").tobytes())
            mask = pa.BooleanArray.from_buffers(pa.bool_(), len(one), [None, pa.py_buffer(planes[-1])])
            zeros.append(len(one) - mask.true_count)
            now = pa.concat_arrays([now.filter(pc.invert(mask)), now.filter(mask)])
        return planes, zeros

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane, z in zip(self.planes, self.zeros):
            b = plane.bit(i)
            token = token << 1 | b
            i = z + plane.rank1(i) if b else i - plane.rank1(i)
        return token

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        lo, hi = 0, end
        for d, (plane, z) in enumerate(zip(self.planes, self.zeros)):
            a, b = plane.rank1(lo), plane.rank1(hi)
            lo, hi = (z + a, z + b) if token >> (len(self.planes) - 1 - d) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the token occurs before position ``end`` (everywhere by default)."""
        lo, hi = self._interval(token, self.n if end is None else end)
        return hi - lo

    def accesses(self, at: np.ndarray) -> np.ndarray:
        """``access`` at many positions, a plane at a time."""
        tokens = np.zeros(len(at), np.int64)
        for plane, z in zip(self.planes, self.zeros):
            b, ones = plane.bits_at(at), plane.ranks1(at)
            tokens = tokens << 1 | b
            at = np.where(b, z + ones, at - ones)
        return tokens

    def ranks(self, token: int, ends: np.ndarray) -> np.ndarray:
        """``rank`` at many positions, a plane at a time."""
        if token >> len(self.planes):
            return np.zeros(len(ends), np.int64)
        at = np.concatenate([[0], np.asarray(ends, np.int64)])
        for d, (plane, z) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.ranks1(at)
            at = z + ones if token >> (len(self.planes) - 1 - d) & 1 else at - ones
        return at[1:] - at[0]

    def selects(self, token: int, ks: np.ndarray) -> np.ndarray:
        """``select`` of many occurrences, a plane at a time."""
        lo, hi = self._interval(token, self.n)
        if len(ks) and not (0 <= ks.min() and ks.max() < hi - lo):
            raise IndexError(int(ks.max()))
        at = lo + np.asarray(ks, np.int64)
        for d in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - d) & 1
            at = self.planes[d].selects(bit, at - self.zeros[d] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        lo, hi = self._interval(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for d in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - d) & 1
            i = self.planes[d].select(bit, i - self.zeros[d] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order, plane by plane from the last."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one, back = plane.bits(), np.empty(self.n, kind)
            back[~one] = now[:z]
            back[one] = now[z:] | kind(1 << level)
            now = back
        return now


def to_bytes(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """One shard as a file's content."""
    known = np.array([i for i in ids if i is not None], np.int64)
    planes, zeros = WaveletMatrix.pack(tokens)
    step = BLOCK_BITS // 8
    cut = [p[a : a + step] for p in planes for a in range(0, len(p), step)]
    blocks = [ZSTD.compress(x, asbytes=True) for x in cut]
    ones = np.array([int.from_bytes(x, "little").bit_count() for x in cut], "<u4")
    heads = (np.diff(known, prepend=0).astype("<i8"), np.array(lengths, "<i8"), ones, np.array(list(map(len, blocks)), "<u4"))
    parts = [zlib.compress(x.tobytes(), 1) for x in heads]
    about = {"docs": len(ids), "null_ids": len(ids) - len(known), "tokens": len(tokens), "zeros": zeros, "block_bits": BLOCK_BITS, "sections": list(map(len, parts))}
    head = json.dumps(about).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts, *blocks])


def open_matrix(fetch: Callable[[int, int], bytes]) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, document lengths and the matrix of a file of which ``fetch(start, size)`` gives any part."""
    lead = fetch(0, 12)
    if lead[:8] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    n = struct.unpack("<I", lead[8:])[0]
    head, at, parts = json.loads(fetch(12, n)), 12 + n, []
    for size in head["sections"]:
        parts.append(zlib.decompress(fetch(at, size)))
        at += size
    deltas, lengths, ones, sizes = (np.frombuffer(p, kind) for p, kind in zip(parts, ("<i8", "<i8", "<u4", "<u4")))
    ids = [None] * head["null_ids"] + np.cumsum(deltas).tolist()
    each = -(-head["tokens"] // head["block_bits"])
    planes = []
    for i in range(len(head["zeros"])):
        own = slice(i * each, (i + 1) * each)
        planes.append(BitPlane(fetch, ones[own], sizes[own], at, head["tokens"], head["block_bits"]))
        at += int(sizes[own].sum(dtype=np.int64))
    return ids, lengths, WaveletMatrix(planes, head["zeros"], head["tokens"])


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """As ``open_matrix``, of a file that is in memory."""
    view = memoryview(raw)
    return open_matrix(lambda start, size: bytes(view[start : start + size]))


@contextmanager
def opened(uri: str):
    """As ``open_matrix``, of a file in its store, of which only the parts asked for are read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        yield open_matrix(lambda start, size: f.read_at(size, start))


def write_file(uri: str, raw: bytes) -> None:
    """Any store that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(raw)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes the files; one row a file: task, part, path, docs, tokens."""
    text_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context = encoder(path), TaskContext.get()
        task, part = context.partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            uri = f"{folder}/shard-{task:06d}-{part:04d}-{context.taskAttemptId()}.wm"
            write_file(uri, to_bytes(ids, lengths, tokens))
            return pa.RecordBatch.from_pylist([{"task": task, "part": part, "path": uri, "docs": len(ids), "tokens": len(tokens)}], schema)

        schema = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
        n = 0
        for b in batches:
            names, (tokens, sizes) = b.column(0).to_pylist(), enc.encode_column(b.column(1), end)
            while names:
                stops = np.cumsum(sizes)
                rows = min(int(np.searchsorted(stops, FILE_TOKENS - n)) + 1, len(names))  # through the document that fills the file
                cut = int(stops[rows - 1])
                ids += names[:rows]
                lengths += sizes[:rows].tolist()
                held.append(tokens[:cut])
                n += cut
                names, sizes, tokens = names[rows:], sizes[rows:], tokens[cut:]
                if n >= FILE_TOKENS:
                    yield flush()
                    part, n, ids, lengths, held = part + 1, 0, [], [], []
        if ids:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return materialise(ordered.mapInArrow(run, "task int, part int, path string, docs bigint, tokens bigint"), "files")


def based(files: DataFrame) -> DataFrame:
    """``(path, base)``: the tokens of all files before each, by prefix sums over tasks and over a task's parts."""
    tasks = files.groupBy("task").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("task", "path", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("own"))
    return own.join(tasks, F.col("task") == F.col("_task")).select("path", (F.col("_base") + F.col("own")).alias("base"))


def read_documents(files: DataFrame, end: int = END) -> DataFrame:
    """Of every document, from the files alone: doc_id, start, n_tokens and ids_crc32.

    Further answers come from the matrix's own operations: ``last_id`` (access
    to the last position), ``n_ends`` (occurrences of the end id, by rank) and
    ``first_end`` (place in the document of its first end id, by select).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(uri) as (ids, lengths, matrix):
                    decoded = matrix.tokens()
                    tokens = memoryview(decoded.astype("<u4").tobytes())
                    stops = np.cumsum(lengths)
                    starts = stops - lengths
                    crc = [zlib.crc32(tokens[4 * a : 4 * z]) for a, z in zip(starts.tolist(), stops.tolist())]
                    ranks = matrix.ranks(end, np.concatenate([starts, stops]))
                    before, through = ranks[: len(starts)], ranks[len(starts) :]
                    last, first = matrix.accesses(stops - 1), matrix.selects(end, before) - starts
                columns = [pa.array(ids, pa.int64()), pa.array(base + starts), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(last.astype(np.int32)), pa.array(through - before), pa.array(first)],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "n_ends", "first_end"],
                )

    n = max(1, files.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, last_id int, n_ends bigint, first_end bigint"
    return based(files).repartition(n, "path").mapInArrow(run, schema)


def op7_wavelet(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    files = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/tokens")
    return read_documents(files)
