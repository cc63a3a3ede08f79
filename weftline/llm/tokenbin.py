"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with the ids of some
documents, then two skippable frames: an index of the documents by frame, and
the seek table of the public seekable format (sizes and a checksum of each
frame, the low 32 bits of XXH64 of its contents). A reader takes the table from
the end of the file and decompresses only the frames that it wants. Documents
longer than a frame go on in the next.

Contents of a frame: u32 number of parts; of each part i64 doc id, u32 ids, u8
flags (1: goes on from the frame before, 2: goes on in the next, 4: the id is
null); then all ids, u16 if the vocabulary allows, else u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut, new_folder
from weftline.llm.files import create, open_file
from weftline.llm.text import slices
from weftline.llm.tokens import ENCODED_ROWS, encoder

FRAME_IDS = 1 << 16
#: Pre-tokens in each generation of a writing worker's cache.
CACHED = 1_000_000
_INDEX_MAGIC, _TABLE_MAGIC, _FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_FOOT = struct.Struct("<IBI")
_PART = np.dtype([("doc", "<i8"), ("n", "<u4"), ("flags", "u1")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
_SPAN = np.dtype([("first", "<i8"), ("last", "<i8"), ("ids", "<u8"), ("parts", "<u4"), ("flags", "u1")])
NULL, BEFORE, AFTER = 4, 1, 2


class Writer:
    """Appends documents in order; ``close`` writes index and table."""

    def __init__(self, f, width: int = 2, level: int = 1):
        self.f, self.width, self.level = f, width, level
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.parts: list[tuple[int, int, int]] = []
        self.ids: list[np.ndarray] = []
        self.held = self.total = self.docs = 0
        self.entries: list[tuple[int, int, int]] = []
        self.spans: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs += 1
        at, first = 0, True
        while first or at < len(ids):
            take = ids[at : at + FRAME_IDS - self.held]
            more = at + len(take) < len(ids)
            flags = (0 if first else BEFORE) | (AFTER if more else 0) | (NULL if doc is None else 0)
            self.parts.append((doc or 0, len(take), flags))
            self.ids.append(take)
            self.held += len(take)
            at, first = at + len(take), False
            if self.held >= FRAME_IDS:
                self._frame()

    def _frame(self) -> None:
        parts = np.array(self.parts, _PART)
        data = struct.pack("<I", len(parts)) + parts.tobytes() + np.concatenate(self.ids).astype(f"<u{self.width}").tobytes()
        packed = self.pack.compress(data)
        self.f.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.spans.append((int(parts["doc"][0]), int(parts["doc"][-1]), self.held, len(parts), int(parts["flags"][0] & (BEFORE | NULL) | parts["flags"][-1] & AFTER)))
        self.total += self.held
        self.parts, self.ids, self.held = [], [], 0

    def close(self) -> None:
        if self.parts:
            self._frame()
        index = struct.pack("<B", self.width) + np.array(self.spans, _SPAN).tobytes()
        self.f.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        table = np.array(self.entries, _ENTRY).tobytes() + _FOOT.pack(len(self.entries), 0x80, _FOOT_MAGIC)
        self.f.write(struct.pack("<II", _TABLE_MAGIC, len(table)) + table)
        self.f.close()


class Reader:
    """Reads the table from the end of the file, and single frames on demand; a wrong checksum raises ValueError."""

    def __init__(self, f):
        self.f = f
        end = f.size()
        f.seek(end - _FOOT.size)
        n, kind, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != _FOOT_MAGIC or not kind & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = end - _FOOT.size - n * _ENTRY.itemsize
        f.seek(start - 8)
        if struct.unpack("<II", f.read(8)) != (_TABLE_MAGIC, end - start):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(f.read(n * _ENTRY.itemsize), _ENTRY)
        self.offsets = np.concatenate(([0], np.cumsum(self.table["packed"].astype(np.int64))))
        f.seek(int(self.offsets[-1]))
        magic, size = struct.unpack("<II", f.read(8))
        if magic != _INDEX_MAGIC:
            raise ValueError("the index is damaged")
        index = f.read(size)
        self.width, self.spans = index[0], np.frombuffer(index, _SPAN, offset=1)
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(parts, ids) of frame k."""
        self.f.seek(int(self.offsets[k]))
        try:
            data = self.unpack.decompress(self.f.read(int(self.table["packed"][k])))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged: {e}") from None
        if len(data) != self.table["size"][k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table["sum"][k]:
            raise ValueError(f"the checksum of frame {k} is wrong")
        (n,) = struct.unpack_from("<I", data)
        parts = np.frombuffer(data, _PART, n, 4)
        return parts, np.frombuffer(data, f"<u{self.width}", offset=4 + n * _PART.itemsize)

    def parts(self, frames: Iterator[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, flags, ids) of all parts of the frames in order."""
        for k in range(len(self.table)) if frames is None else frames:
            parts, ids = self.frame(k)
            at = 0
            for doc, n, flags in parts.tolist():
                yield None if flags & NULL else doc, flags, ids[at : at + n]
                at += n

    def read(self, doc: int) -> list[np.ndarray]:
        """The ids of each document of this id; decompresses only its frames."""
        s = self.spans
        frames = np.flatnonzero(((s["first"] <= doc) | (s["flags"] & NULL > 0)) & (s["last"] >= doc))
        out: list[list[np.ndarray]] = []
        for d, flags, ids in self.parts(frames.tolist()):
            if d == doc:
                if not flags & BEFORE:
                    out.append([])
                out[-1].append(ids)
        return [np.concatenate(x) for x in out]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One file per range of ids, ids ascending within and between files; (path, first_doc, last_doc, docs, ids) per file.

    Rows with equal ids, null ones too, may lie in several files that follow each
    other, so an id that many rows have is no task's alone.

    Only finished attempts are listed, so lost executors and second attempts
    leave no trace in what is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange("d", "turn").sortWithinPartitions("d", "turn").select("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, first, last = encoder(vocabulary, CACHED), None, None, None
        width = 2 if max(enc.library.get_vocab_size(with_added_tokens=True) - 1, end_id) < 65536 else 4
        end = np.uint32(end_id).tobytes()
        for part in slices(batches, ENCODED_ROWS):
            for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                if out is None:
                    uri, f = create(folder, ".tok.zst")
                    out, first = Writer(f, width), doc
                out.add(doc, np.frombuffer(ids + end, np.uint32))
                last = doc
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([out.docs], pa.int64()), pa.array([out.total], pa.int64())], names=["path", "first_doc", "last_doc", "docs", "ids"])

    return cut(rows.mapInArrow(run, "path string, first_doc long, last_doc long, docs long, ids long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files; start counts on from file to file."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), F.col("last_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, files.count())
    based = files.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))  # a row per file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as f:
                    rows: list[tuple] = []
                    n = crc = 0
                    for doc, flags, ids in Reader(f).parts():
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        n += len(ids)
                        if not flags & AFTER:
                            rows.append((doc, at, n, crc))
                            at, n, crc = at + n, 0, 0
                            if len(rows) >= 10_000:
                                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                                rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return based.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Encodes all texts, writes them in ascending id order, and returns what the files hold.

    Null texts are empty: their only id is ``end_id``. Rows with equal ids
    follow each other in no set order and are each kept; null ids come first. Other columns are not
    read. An empty table makes no file and gives an empty result.
    """
    return read_token_files(write_token_files(docs, vocabulary, end_id, new_folder(docs.sparkSession)))
