"""Token ids in wavelet-matrix files, one per shard (dealt operator 7).

Documents are encoded with a byte-level BPE file, an end id is appended to each, and the ids
are laid out in ascending document order over range partitions. Every partition becomes one
shard file: the shard's distinct ids are numbered 0..k-1, and ceil(log2 k) bit planes hold
the numbers from their highest bit down, each plane stably partitioned by the plane before
it (a wavelet matrix). A plane is compressed in blocks of 65,536 bits, and the file holds the
ones before each block and the block's place. From these counts (rank) and binary search over
them (select) a file tells the id at a position, how often an id occurs in a range, and where
its j-th occurrence is, by decompressing one or two blocks of each plane, whatever its size.

Files are rows of a Parquet table in the shared scratch folder (one row, one file per shard),
so that any file system Spark writes to will do. A file's byte layout:

    magic "WVM2", then a header of little-endian 64-bit numbers (tokens, documents, distinct
    ids, planes, bytes of each section), then the sections: distinct ids (uint32), document ids
    (int64), their null flags (uint8) and document starts (int64, documents + 1), each compressed
    with zstd; and each plane: with b = ceil(tokens / 65,536) blocks, the ones before each block
    and in all (int64, b + 1), the blocks' offsets and their end (int64, b + 1), then the blocks
    (packed bits, lowest bit first), each compressed with zstd.

Defined cases: null and empty texts are a lone end id; rows with equal doc_id stay separate
rows, ordered by the text's hash; a null doc_id sorts first; an empty table gives no rows;
only the named columns are read, whatever else the table has."""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailcast.llm import bpe
from trailcast.llm.scratch import Scratch

MAGIC = b"WVM2"
BLOCK = 1 << 16          # bits of a plane that are compressed together
OPEN_BLOCKS = 256        # decompressed blocks an open file keeps (8 KB each)
SHARD_BYTES = 24 << 20
PIECE = 3 << 20          # text encoded at once: more of it has fewer distinct words to merge
CODEC = "zstd"


def _pack(raw: bytes) -> bytes:
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec=CODEC, asbytes=True) if raw else b""


def _unpack(blob: bytes) -> bytes:
    if not blob:
        return b""
    return pa.decompress(blob[8:], decompressed_size=struct.unpack("<q", blob[:8])[0], codec=CODEC, asbytes=True)


def _plane_section(bit: np.ndarray) -> bytes:
    """A plane's counts, offsets and compressed blocks."""
    packed = np.packbits(bit, bitorder="little")
    cuts = np.arange(0, len(packed), BLOCK // 8)
    ones = np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(packed), cuts, dtype=np.int64))]) if len(cuts) else np.zeros(1)
    blocks = [_pack(packed[a:a + BLOCK // 8].tobytes()) for a in cuts.tolist()]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]) if blocks else np.zeros(1)
    return b"".join([ones.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), *blocks])


def build_file(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """A shard's file. ``ids``: all its tokens; ``starts``: documents + 1 token offsets."""
    present = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
    number = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint32)
    number[present] = np.arange(len(present))
    planes = max(1, (len(present) - 1).bit_length()) if len(present) else 0
    codes = number[ids].astype(np.uint16 if planes <= 16 else np.uint32)
    packed = [_pack(part) for part in (present.astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.astype("<i8").tobytes())]
    for b in reversed(range(planes)):
        bit = (codes >> b & 1).astype(bool)
        packed.append(_plane_section(bit))
        if b:
            codes = np.concatenate([codes[~bit], codes[bit]])
    head = struct.pack(f"<{4 + len(packed)}q", len(ids), len(doc_ids), len(present), planes, *map(len, packed))
    return b"".join([MAGIC, head, *packed])


class TokenFile:
    """A shard's file, decompressed section by section, and plane by plane in blocks, as they are
    needed."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix token file")
        self.n, self.n_docs, self.n_distinct, self.planes = struct.unpack_from("<4q", blob, 4)
        sizes = struct.unpack_from(f"<{4 + self.planes}q", blob, 36)
        at = 36 + 8 * len(sizes)
        self._sections = []
        for size in sizes:
            self._sections.append(blob[at:at + size])
            at += size
        self._blocks: OrderedDict = OrderedDict()
        self.alphabet = np.frombuffer(_unpack(self._sections[0]), "<u4")
        held = -(-self.n // BLOCK) + 1
        self._ones = [np.frombuffer(p, "<i8", held) for p in self._sections[4:]]
        self._offsets = [np.frombuffer(p, "<i8", held, 8 * held) for p in self._sections[4:]]
        self._body = 16 * held

    @property
    def starts(self) -> np.ndarray:
        return np.frombuffer(_unpack(self._sections[3]), "<i8")

    @property
    def doc_ids(self) -> list:
        ids = np.frombuffer(_unpack(self._sections[1]), "<i8").tolist()
        null = _unpack(self._sections[2])
        return [None if z else i for i, z in zip(ids, null)]

    def _block(self, level: int, k: int) -> np.ndarray:
        """Packed bits of a plane's k-th block."""
        found = self._blocks.pop((level, k), None)
        if found is None:
            a, b = (self._body + self._offsets[level][k:k + 2]).tolist()
            found = np.frombuffer(_unpack(self._sections[4 + level][a:b]), np.uint8)
        self._blocks[level, k] = found
        if len(self._blocks) > OPEN_BLOCKS:
            self._blocks.popitem(last=False)
        return found

    def _bits(self, level: int) -> np.ndarray:
        """A whole plane."""
        if not self.n:
            return np.empty(0, bool)
        at = (self._body + self._offsets[level]).tolist()
        packed = b"".join(_unpack(self._sections[4 + level][a:b]) for a, b in zip(at, at[1:]))
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)

    def _zeros(self, level: int) -> int:
        return self.n - int(self._ones[level][-1])

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        k, at = divmod(i, BLOCK)
        before = int(self._ones[level][k])
        if not at:
            return before
        packed = self._block(level, k)
        rest = int(packed[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return before + int(np.bitwise_count(packed[:at // 8]).sum()) + rest.bit_count()

    def _select(self, level: int, one: bool, j: int) -> int:
        """Position of the j-th (from 0) one or zero of a plane."""
        before = self._ones[level]
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        k = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self._block(level, k), count=min(BLOCK, self.n - k * BLOCK), bitorder="little")
        return k * BLOCK + int(np.flatnonzero(bits == one)[j - int(before[k])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.planes):
            ones = self._rank1(level, i)
            bit = int(self._block(level, i // BLOCK)[i % BLOCK // 8]) >> i % 8 & 1
            i = self._zeros(level) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int):
        code = int(np.searchsorted(self.alphabet, token))
        if code >= self.n_distinct or self.alphabet[code] != token:
            return None
        path = []
        for level in range(self.planes):
            bit = code >> (self.planes - 1 - level) & 1
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            zeros = self._zeros(level)
            path.append((bit, zeros))
            lo, hi = (zeros + a, zeros + b) if bit else (lo - a, hi - b)
        return lo, hi, path

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs at positions lo..hi-1."""
        found = self._range(token, lo, self.n if hi is None else hi)
        return found[1] - found[0] if found else 0

    def locate(self, token: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of ``token``."""
        found = self._range(token, 0, self.n)
        if not found or not 0 <= j < found[1] - found[0]:
            raise IndexError(j)
        i = found[0] + j
        for level in reversed(range(self.planes)):
            bit, zeros = found[2][level]
            i = self._select(level, bool(bit), i - zeros if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last to the first."""
        codes = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in reversed(range(self.planes)):
            bit = self._bits(level)
            zeros = self._zeros(level)
            upper = codes[zeros:] | codes.dtype.type(1 << (self.planes - 1 - level))
            out = np.empty_like(codes)
            out[~bit] = codes[:zeros]
            out[bit] = upper
            codes = out
        return self.alphabet[codes] if self.n else np.empty(0, np.uint32)


FILES = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("file", T.BinaryType())])
ENTRIES = "shard long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 0, shard_bytes: int = SHARD_BYTES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode whole texts and write the shard files: rows (shard, n_tokens, n_docs, file)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = narrow.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ordered = (narrow.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
               .repartitionByRange(shards, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text"))

    def run(batches):
        vocab = bpe.vocabulary(path)
        end = np.array([end_id], np.int32)
        small = max(len(vocab.tokens) - 1, end_id) < 1 << 16
        chunks, doc_ids, sizes = [], [], []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            for _, _, ids, at in bpe._encoded(batch.column(1), vocab, limit=PIECE):
                ids = np.insert(ids, at[1:], end)
                chunks.append(ids.astype(np.uint16) if small else ids)
                sizes.append(np.diff(at) + 1)
        if not doc_ids:
            return
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        ids = np.concatenate(chunks)
        del chunks
        file = build_file(ids, doc_ids, starts)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([file], pa.binary())], names=FILES.names)

    return scratch.write(ordered.mapInArrow(run, FILES), "files", codec="uncompressed")


def read_entries(files: DataFrame) -> DataFrame:
    """Per document of the files: shard, its place in it, local_start, n_tokens and the CRC-32
    of its ids as little-endian unsigned 32-bit integers, all from the files' bytes."""

    def run(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = TokenFile(blob.as_py())
                starts = file.starts
                raw = memoryview(file.tokens().astype("<u4")).cast("B")
                at = (4 * starts).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                n = len(crc)
                yield pa.record_batch([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(file.doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["shard", "place", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return files.select("shard", "file").mapInArrow(run, ENTRIES)


def shard_starts(files: DataFrame) -> DataFrame:
    """Tokens in all shards before each shard (one narrow row per shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))


def index_of_documents(docs: DataFrame, path: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files and give, read back from them, doc_id, start (tokens of all documents
    before it), n_tokens (end id included) and ids_crc32."""
    scratch = Scratch(docs.sparkSession, "token-files")
    files = write_files(docs, path, scratch, end_id, shard_bytes)
    rows = read_entries(files).join(shard_starts(files), "shard")
    return rows.select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
