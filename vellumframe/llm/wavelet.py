"""Token files as wavelet matrices: bit-planes with rank and select, one compressed file a shard.

A shard holds whole documents in ascending doc_id order. Its file stores ranks beside the bits and answers access, rank
(counts), select and occurrence look-ups from the chunks of bits they touch, and gives all tokens back exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged
from .subwords import default_path, encoder, vocabulary_size
from .words import batch, pieces

MAGIC = b"WVMX0002"
PACK = pa.Codec("zstd", compression_level=1)
BLOCK = 512  # bits between two stored ranks
CHUNK = 1 << 15  # bytes of a plane that are compressed together


class Plane:
    """One bit-plane: stored ranks before every BLOCK bits, and chunks of bits that are inflated when they are needed."""

    def __init__(self, n: int, ranks: np.ndarray, chunks: list):
        self.n, self.ranks, self.chunks, self.inflated = n, ranks, chunks, 0

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        full = np.zeros(-(-len(packed) * 8 // BLOCK) * BLOCK // 8, np.uint8)
        full[: len(packed)] = packed
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(full.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64))])
        return cls(len(bits), ranks.astype(np.uint32), [full[k : k + CHUNK] for k in range(0, len(full), CHUNK)])

    def chunk(self, k: int) -> np.ndarray:
        if isinstance(self.chunks[k], tuple):
            data, raw = self.chunks[k]
            self.chunks[k] = np.frombuffer(PACK.decompress(data, raw, asbytes=True), np.uint8)
            self.inflated += 1
        return self.chunks[k]

    def blocks(self, at: np.ndarray) -> np.ndarray:
        """(positions, BLOCK / 8) bytes of the given blocks."""
        each = CHUNK * 8 // BLOCK
        out = np.empty((len(at), BLOCK // 8), np.uint8)
        for k in np.unique(at // each).tolist():
            own = np.flatnonzero(at // each == k)
            out[own] = self.chunk(k).reshape(-1, BLOCK // 8)[at[own] - k * each]
        return out

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position (0 to n)."""
        block, inside = at // BLOCK, at % BLOCK
        out = self.ranks[block].astype(np.int64)
        some = np.flatnonzero(inside)
        for k in range(0, len(some), 4096):
            own = some[k : k + 4096]
            held, whole = self.blocks(block[own]), inside[own] >> 3
            rows = np.arange(len(own))
            held[rows, np.minimum(whole, BLOCK // 8 - 1)] &= ((1 << (inside[own] & 7)) - 1).astype(np.uint8)
            held[np.arange(BLOCK // 8)[None, :] > whole[:, None]] = 0
            out[own] += np.bitwise_count(held).sum(axis=1, dtype=np.int64)
        return out

    def bit(self, at: int) -> int:
        return int(self.chunk(at // 8 // CHUNK)[at // 8 % CHUNK] >> (at & 7) & 1)

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) ones or zeros: binary search in the stored ranks, then inside a block."""
        before = self.ranks.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, nth, side="right") - 1
        out = np.empty(len(nth), np.int64)
        for k in range(0, len(nth), 4096):
            own = block[k : k + 4096]
            seen = np.cumsum(np.unpackbits(self.blocks(own), axis=1, bitorder="little") == bit, axis=1, dtype=np.int32)
            out[k : k + 4096] = own * BLOCK + (seen <= (nth[k : k + 4096] - before[own])[:, None]).sum(axis=1)
        return out

    def all(self) -> np.ndarray:
        whole = np.concatenate([self.chunk(k) for k in range(len(self.chunks))]) if self.chunks else np.zeros(0, np.uint8)
        return np.unpackbits(whole, count=self.n, bitorder="little")


class WaveletMatrix:
    """Bit-planes from the highest bit down; each level is the previous one stably parted into zeros, then ones."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros, self.bits = n, planes, zeros, len(planes)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, cur = [], [], values.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = (cur & cur.dtype.type(1 << level)) != 0
            planes.append(Plane.of(one))
            low = cur[~one]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[one]])
        return cls(len(values), planes, zeros)

    def access(self, at: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, before = plane.bit(at), int(plane.ones(np.array([at]))[0])
            at = zeros + before if one else at - before
            value = value << 1 | one
        return value

    def span(self, value: int, ends: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the value's occurrences start in the last level, and where those before each of the ends stop."""
        at = np.append(ends, 0)
        for k, plane in enumerate(self.planes):
            ones = plane.ones(at)
            at = self.zeros[k] + ones if value >> (self.bits - 1 - k) & 1 else at - ones
        return int(at[-1]), at[:-1]

    def ranks(self, value: int, ends: np.ndarray) -> np.ndarray:
        """Occurrences of a value before each of the ends."""
        lo, hi = self.span(value, np.asarray(ends, np.int64))
        return hi - lo

    def rank(self, value: int, end: int) -> int:
        return int(self.ranks(value, np.array([end]))[0])

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def selects(self, value: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth occurrences (from 0) of a value."""
        lo, hi = self.span(value, np.array([self.n]))
        nth = np.asarray(nth, np.int64)
        if ((nth < 0) | (nth >= hi[0] - lo)).any():
            raise IndexError("the value does not occur so often")
        at = lo + nth
        for k in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - k) & 1
            at = self.planes[k].select(one, at - (self.zeros[k] if one else 0))
        return at

    def select(self, value: int, nth: int) -> int:
        return int(self.selects(value, np.array([nth]))[0])

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of a value, ascending."""
        return self.selects(value, np.arange(self.count(value)))

    def values(self) -> np.ndarray:
        """Every token: the levels joined again from the last to the first."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = self.planes[k].all().view(bool)
            up = np.empty_like(cur)
            up[~one] = cur[: self.zeros[k]]
            up[one] = cur[self.zeros[k] :] | cur.dtype.type(1 << (self.bits - 1 - k))
            cur = up
        return cur


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file: magic, counts, zeros per level, the document index, then every plane's ranks and chunks, each part
    compressed by itself behind its packed and its raw length."""
    head = MAGIC + struct.pack("<QQI", matrix.n, len(lengths), matrix.bits) + np.array(matrix.zeros, "<u8").tobytes()
    raw = [doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), lengths.astype("<i8").tobytes()]
    for p in matrix.planes:
        raw += [p.ranks.astype("<u4").tobytes(), *(p.chunk(k).tobytes() for k in range(len(p.chunks)))]
    parts = [PACK.compress(x, asbytes=True) for x in raw]
    return head + b"".join(struct.pack("<QQ", len(p), len(x)) + p for p, x in zip(parts, raw, strict=True))


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, doc_ids, which of them are not null, lengths in tokens. Planes stay compressed until they are asked."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet token file")
    n, docs, bits = struct.unpack_from("<QQI", data, 8)
    zeros = np.frombuffer(data, "<u8", bits, 28).astype(int).tolist()
    at, parts, whole = 28 + 8 * bits, [], memoryview(data)
    while at < len(data):
        size, raw = struct.unpack_from("<QQ", data, at)
        parts.append((whole[at + 16 : at + 16 + size], raw))
        at += 16 + size
    opened = lambda p, kind: np.frombuffer(PACK.decompress(*p, asbytes=True), kind)
    ids, known, lengths = (opened(p, t) for p, t in zip(parts[:3], ("<i8", "u1", "<i8"), strict=True))
    each = (len(parts) - 3) // bits
    planes = [Plane(n, opened(parts[3 + k * each], "<u4"), list(parts[4 + k * each : 3 + (k + 1) * each])) for k in range(bits)]
    return WaveletMatrix(n, planes, zeros), ids, known.astype(bool), lengths


def write_tokens(docs: DataFrame, name: str = "tokens", tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = 1 << 21) -> DataFrame:
    """Encode (doc_id, text) into shard files in the shared folder, in ascending doc_id order (nulls first).

    One file holds one shard, a row (shard, n_docs, n_tokens, payload) of which payload is the wavelet file. Spark
    commits the files, so a lost task leaves none behind. Null texts are the end id alone. Documents are never split;
    one of over `shard_tokens` tokens ends its shard. Returns the files as a table.
    """
    ready(docs.sparkSession)
    path = tokenizer or default_path()
    bits = max(1, (max(vocabulary_size(path), end_id + 1) - 1).bit_length())

    def run(batches):
        enc = encoder(path)
        number, ids_, lengths_, tokens = 0, [], [], []

        def shard():
            values = np.concatenate(tokens)
            known = np.array([d is not None for d in ids_])
            data = to_bytes(WaveletMatrix.build(values, bits), np.array([d or 0 for d in ids_], np.int64), known, np.array(lengths_))
            key = TaskContext.get().partitionId() << 32 | number
            return batch(shard=pa.array([key], pa.int64()), n_docs=pa.array([len(ids_)], pa.int64()), n_tokens=pa.array([len(values)], pa.int64()), payload=pa.array([data], pa.binary()))

        held = 0
        for b in pieces(batches, 512):
            ids, off = enc.encode(b.column(1))
            own = np.insert(ids, off[1:], end_id).astype(np.uint32)
            sizes = np.diff(off) + 1
            ends = np.cumsum(sizes)
            first = 0
            for k, d in enumerate(b.column(0).to_pylist()):
                ids_.append(d)
                lengths_.append(int(sizes[k]))
                held += int(sizes[k])
                if held >= shard_tokens:
                    tokens.append(own[first : ends[k]])
                    first = int(ends[k])
                    yield shard()
                    number, held, ids_, lengths_, tokens = number + 1, 0, [], [], []
            if first < len(own):
                tokens.append(own[first:])
        if ids_:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(run, "shard long, n_docs long, n_tokens long, payload binary"), name, maxRecordsPerFile=1)


def read_documents(files: DataFrame, end_id: int = 1) -> DataFrame:
    """Read shard files back: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, and n_ends, the
    occurrences of the end id in the document, by rank."""
    totals = files.select("shard", "n_tokens", F.shiftright("shard", 32).alias("_p"))
    parts = totals.groupBy("_p").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_p").orderBy("shard")) - F.col("n_tokens")
    bases = totals.withColumn("_in", inside).join(parts, "_p").select("shard", (F.col("_in") + F.col("_base")).alias("_base"))

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                matrix, ids, known, lengths = from_bytes(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                n_ends = np.diff(matrix.ranks(end_id, np.append(0, ends)))
                raw = matrix.values().astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield batch(shard=pa.array([shard] * len(ids), pa.int64()), doc_id=pa.array(ids, pa.int64(), mask=~known), at=pa.array(ends - lengths, pa.int64()), n_tokens=pa.array(lengths, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), n_ends=n_ends)

    read = files.select("shard", "payload").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long, n_ends long")
    return read.join(bases, "shard").select("doc_id", (F.col("at") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32", "n_ends")


def look_up(files: DataFrame, token: int) -> DataFrame:
    """Occurrences of a token per document, found in the files without decoding them: doc_id, n, positions."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                matrix, ids, known, lengths = from_bytes(data.as_buffer().to_pybytes())
                at = matrix.occurrences(token)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, side="right")
                for d in np.unique(doc).tolist():
                    own = at[doc == d] - (ends[d] - lengths[d])
                    yield batch(doc_id=pa.array([int(ids[d]) if known[d] else None], pa.int64()), n=pa.array([len(own)], pa.int64()), positions=pa.array([own.tolist()], pa.list_(pa.int64())))

    return files.select("payload").mapInArrow(run, "doc_id long, n long, positions array<long>")
