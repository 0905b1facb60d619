"""Files that cannot be read are found, named and left out, so that one of them does not end a job over many."""

import bz2
import warnings
import zlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.sources.files import failed_file, plain

PROBE_BYTES = 128 << 20  # larger compressed files are only found out when they are read
_PIECE = 16 << 10
_COMPRESSED = {".gz": lambda: zlib.decompressobj(31), ".bz2": bz2.BZ2Decompressor, ".deflate": zlib.decompressobj}

T = TypeVar("T")


class _Stream:
    """A compressed file that is unpacked piece by piece and thrown away; several streams may follow each other."""

    def __init__(self, name: str):
        self.start = next(v for k, v in _COMPRESSED.items() if name.lower().endswith(k))
        self.now, self.error, self.begun = self.start(), None, False

    def add(self, piece: bytes) -> None:
        while piece and self.error is None:
            if self.now.eof:
                self.now = self.start()
            try:
                self.now.decompress(piece)
            except (zlib.error, OSError, EOFError, ValueError) as error:
                self.error = str(error)
            self.begun = True
            piece = self.now.unused_data if self.now.eof else b""

    def verdict(self) -> str | None:
        return self.error or (None if self.now.eof else "ends before its stream does" if self.begun else "is empty")


def damaged_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, reason) of the compressed files that don't unpack to their end.

    They are unpacked in tasks, a piece at a time; errors are rows, not failures.
    """
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, found = None, None, []

        def close() -> None:
            reason = stream.verdict() if stream else None
            if reason:
                found.append((name, reason))

        for batch in batches:
            for file, piece in zip(batch.column("path").to_pylist(), batch.column("piece")):
                if file != name:
                    close()
                    name, stream = file, _Stream(file)
                stream.add(piece.as_buffer().to_pybytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], ["file", "reason"])

    packed = [f for f in files if f.lower().endswith(tuple(_COMPRESSED))]
    if not packed:
        return spark.createDataFrame([], "file string, reason string")
    content = spark.read.format("binaryFile").load(packed).where(F.col("length") <= PROBE_BYTES).select("path", "content")
    starts = F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1)), F.lit(_PIECE))
    pieces = content.select("path", "content", F.explode(starts).alias("at")).select("path", F.substring("content", F.col("at"), F.lit(_PIECE)).alias("piece"))
    return pieces.mapInArrow(probe, "file string, reason string")


def readable(spark: SparkSession, files: list[str]) -> list[str]:
    """The files (named in the form of ``plain``) without those that are known to be damaged, each of which is warned about by name."""
    bad = {plain(r["file"]): r["reason"] for r in damaged_files(spark, files).collect()}
    for file, reason in sorted(bad.items()):
        warnings.warn(f"Skipped {file}: {reason}")
    return [f for f in files if f not in bad]


def past_failures(files: list[str], scan: Callable[[list[str]], T]) -> tuple[list[str], T | None]:
    """What a scan of whole files gives, and the files that are left, without those that Spark fails to read.

    Each failed attempt names a file, which is warned about. Damage that ``readable`` can find costs no attempt.
    """
    while files:
        try:
            return files, scan(files)
        except (PySparkException, Py4JJavaError) as error:
            failed = failed_file(error)
            left = [f for f in files if failed is None or f != plain(failed)]
            if len(left) == len(files):
                raise
            warnings.warn(f"Skipped {failed}: FAILED_READ_FILE")
            files = left
    return files, None
