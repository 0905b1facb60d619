"""Length-delimited binary records of token ids, with a separate offset index.

A file begins with ``HEADER`` and the width of an id in one byte. A record is its length (8 bytes, little endian), the masked
CRC-32 of these 8 bytes, the data, and the masked CRC-32 of the data. The data are one byte (1: the id is known), doc_id (8 bytes)
and the ids. The index beside it (``.idx``) holds the offset of every record and of the end, 8 bytes each, so
that records can be read in any order. CRC-32 is used, as Python has no fast CRC-32C; the mask is the usual rotation and addition.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.sources.scratch import scratch_path

from .shared import stored, tidy, whole_text
from .tokens import encoded, encoder, shared_folder, vocabulary_path

HEADER = b"TOKENREC"
END_ID = 2
_READ = 8 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + struct.pack("<I", masked_crc(length)) + data + struct.pack("<I", masked_crc(data))


def unframe(buffer: bytes, at: int = 0) -> tuple[bytes, int]:
    """(data, end) of the record at ``at``; a damaged record is an error."""
    length = buffer[at:at + 8]
    size, (mark,) = int.from_bytes(length, "little"), struct.unpack_from("<I", buffer, at + 8)
    data = buffer[at + 12:at + 12 + size]
    if masked_crc(length) != mark or len(data) < size or struct.unpack_from("<I", buffer, at + 12 + size)[0] != masked_crc(data):
        raise ValueError(f"damaged record at {at}")
    return data, at + 16 + size


def write_records(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Write the ids of all texts, each with the end id, in ascending order of doc_id (null first).

    Gives the manifest (part, file, records, ids): parts ascend as the ids do, and each has one file. The one shuffle moves texts to
    ranges of ids; a file is written by one task, under a name of that attempt.
    """
    path = path or vocabulary_path()
    rows = (whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
            .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(path, False, sizes), TaskContext.get()
        system, root = shared_folder(folder)
        file, end = f"{root}/records-{task.partitionId():05d}-{task.taskAttemptId()}", np.array([end_id], coder.dtype).tobytes()
        offsets, ids = [len(HEADER) + 1], 0
        with system.open_output_stream(file) as out:
            out.write(HEADER + bytes([coder.dtype.itemsize]))
            for batch in batches:
                for doc_id, data in encoded(batch, coder):
                    record = frame(struct.pack("<?q", doc_id is not None, doc_id or 0) + data + end)
                    out.write(record)
                    offsets.append(offsets[-1] + len(record))
                    ids += len(data) // coder.dtype.itemsize + 1
        if sizes:
            coder.forget()
        with system.open_output_stream(f"{file}.idx") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([file]), pa.array([len(offsets) - 1], pa.int64()),
                                              pa.array([ids], pa.int64())], ["part", "file", "records", "ids"])

    return stored(rows.mapInArrow(write, "part int, file string, records long, ids long"), "record-manifest")


def read_offsets(system: pa.fs.FileSystem, file: str) -> np.ndarray:
    with system.open_input_file(f"{file}.idx") as source:
        return np.frombuffer(source.read(), "<i8")


def read_record(system: pa.fs.FileSystem, file: str, begin: int, end: int) -> bytes:
    """The data of the record between two offsets of the index."""
    with system.open_input_file(file) as source:
        return unframe(source.read_at(end - begin, begin))[0]


def read_records(system: pa.fs.FileSystem, file: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every record in order, a few megabytes at a time."""
    offsets = read_offsets(system, file)
    with system.open_input_file(file) as source:
        head = source.read_at(len(HEADER) + 1, 0)
        if head[:-1] != HEADER:
            raise ValueError(f"{file} is no record file")
        first = 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _READ, "right")) - 1)
            buffer = source.read_at(int(offsets[last] - offsets[first]), int(offsets[first]))
            for i in range(first, last):
                data, _ = unframe(buffer, int(offsets[i] - offsets[first]))
                known, doc_id = struct.unpack_from("<?q", data)
                yield (doc_id if known else None), np.frombuffer(data, f"<u{head[-1]}", offset=9)
            first = last


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files; start counts the ids of all before it.

    The manifest's window has a row for each file; files are then read in parallel.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = shared_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                for doc_id, ids in read_records(system, row["file"]):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, path: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Write all documents as records and read them back: (doc_id, start, n_tokens, ids_crc32).

    ``sizes`` is how many pieces an encoder remembers and how many bytes it cuts at a time; where it is given, an encoder remembers
    none from one task to the next. Results don't depend on it.

    A null or empty text has the end id alone. Null ids come first; rows with one id are in order of text, and repeated rows
    are records of their own. An empty table gives no file and no rows.
    """
    folder = scratch_path(docs.sparkSession, "records")
    return read_digests(write_records(docs, folder, path, sizes=sizes), folder)
