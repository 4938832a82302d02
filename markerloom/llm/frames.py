"""Token ids in files of independent zstandard frames with a seek table (operator 6).

A file is a row of zstandard frames, then one frame with the index of its
documents, then a skippable frame with the seek table: for each frame its
compressed and plain size and the low 32 bits of the XXH64 of its plain bytes,
closed by the number of frames and a magic number. A reader takes the table
from the end, then the index, and decompresses only the frames it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, attempt_name, fresh_folder, keyed_texts, open_file, stored, write_once
from markerloom.llm.tokens import VOCABULARY, encoder, vocabulary_path

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
#: One document in the index: key, whether it has one, number of ids.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("keyed", "u1"), ("n", "<i8")])

FRAME_IDS = 1 << 16
END_ID = 0
MANIFEST = "part int, path string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes ids of one document after another to an open stream."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = 3) -> None:
        import zstandard

        self.stream, self.frame_ids = stream, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.n_held, self.entries, self.index, self.n_ids = [], 0, [], [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.index.append((key or 0, key is not None, len(ids)))
        self.n_ids += len(ids)
        at = 0
        while at < len(ids):
            piece = ids[at : at + self.frame_ids - self.n_held]
            self.held.append(piece)
            self.n_held += len(piece)
            at += len(piece)
            if self.n_held == self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held).astype("<u4").tobytes())
            self.held, self.n_held = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = self.compressor.compress(plain)
        self.stream.write(packed)
        self.entries.append((len(packed), len(plain), _checksum(plain)))

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, dtype=DOCUMENT).tobytes())
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER.size))
        self.stream.write(table + FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC))
        self.stream.close()


class FrameReader:
    """Reads a file by its seek table; every frame's checksum is compared."""

    def __init__(self, stream) -> None:
        import zstandard

        self.stream, self.plain = stream, zstandard.ZstdDecompressor()
        size = stream.size()
        n_frames, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("not a file of frames with a seek table")
        length = n_frames * ENTRY.size
        self.entries = list(ENTRY.iter_unpack(self._at(size - FOOTER.size - length, length)))
        self.places = list(accumulate((e[0] for e in self.entries), initial=0))
        self.index = np.frombuffer(self.frame(n_frames - 1), dtype=DOCUMENT)
        self.ends = np.cumsum(self.index["n"])
        self.id_places = np.array(list(accumulate((e[1] // 4 for e in self.entries[:-1]), initial=0)))

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def frame(self, number: int) -> bytes:
        packed, size, checksum = self.entries[number]
        plain = self.plain.decompress(self._at(self.places[number], packed), max_output_size=size)
        if len(plain) != size or _checksum(plain) != checksum:
            raise ValueError(f"frame {number} does not match its checksum")
        return plain

    def documents(self, wanted: Sequence[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``key, ids before it in the file, ids`` of the documents at ``wanted`` positions, or of all.

        A frame is decompressed once for all that follow each other in it.
        """
        held, ids = -1, np.zeros(0, dtype="<u4")
        for i in range(len(self.index)) if wanted is None else wanted:
            end = int(self.ends[i])
            at = start = end - int(self.index["n"][i])
            parts = []
            while at < end:
                number = int(np.searchsorted(self.id_places, at, side="right")) - 1
                if number != held:
                    held, ids = number, np.frombuffer(self.frame(number), dtype="<u4")
                first = int(self.id_places[number])
                piece = ids[at - first : end - first]
                parts.append(piece)
                at += len(piece)
            key = int(self.index["doc_id"][i]) if self.index["keyed"][i] else None
            yield key, start, np.concatenate(parts) if parts else ids[:0]


def write_frames(
    documents: DataFrame,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Encodes all texts, writes them in ascending key order, and lists the files.

    Ranges of the key become files, so their order is that of ``part``. Ties
    are ordered by the text's hash, which also spreads rows that share a key or
    have none; null keys come first; null and empty texts have ``end_id`` alone;
    equal rows are written as often as they occur; no documents give no files.
    A file counts only if it is in the list, so repeated attempts do no harm.
    """
    spark = documents.sparkSession
    path = vocabulary or vocabulary_path(VOCABULARY)
    folder = folder or fresh_folder(spark, "frames")
    target = arrow_schema(spark, MANIFEST)

    def run(batches: Batches) -> Batches:
        part, writer, where = TaskContext.get().partitionId(), None, ""
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                lot = batch.slice(begin, 500)
                if writer is None:
                    stream, where = write_once(folder, attempt_name(part, ".zst"))
                    writer = FrameWriter(stream, frame_ids)
                texts = lot.column(1).to_pylist()
                for doc, ids in zip(lot.column(0).to_pylist(), encoder(path).encode(texts), strict=True):
                    writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            row = {"part": [part], "path": [where], "n_docs": [len(writer.index)], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row, schema=target)

    tied = keyed_texts(documents, key, text).withColumn("tie", F.xxhash64("text"))
    ranged = tied.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST), "frame-files")


def read_frames(files: DataFrame) -> DataFrame:
    """``doc_id, start`` (ids of all documents before it), ``n_tokens, ids`` of every document in the files.

    One row per file reaches the driver, for the sums of what lies before each.
    """
    spark = files.sparkSession
    listed = sorted(files.collect())
    before = accumulate((f["n_ids"] for f in listed), initial=0)
    specs = [(f["path"], b) for f, b in zip(listed, before, strict=False)]
    target = arrow_schema(spark, DOCUMENTS)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for doc, start, ids in FrameReader(stream).documents():
                        rows.append((doc, base + start, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held > 1_000_000 or len(rows) >= 2000:
                            yield _batch(rows, target)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, target)

    if not specs:
        return spark.createDataFrame([], DOCUMENTS)
    return spark.createDataFrame(specs, "path string, base long").repartition(len(specs), "path").mapInArrow(run, DOCUMENTS)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
