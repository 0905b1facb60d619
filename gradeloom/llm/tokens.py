"""Token ids of texts, flat token files, and the scan that finds document ends in them."""

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.sources.scratch import scratch_path

from .shared import stored, whole_text

VOCABULARY = "byte_bpe_50k.json"
SEPARATOR = 50256  # <|endoftext|>, which encoding never gives here
BLOCK_BYTES = 4 << 20

_CACHED = 300_000  # pieces in each of two generations
_CALL_BYTES = 2 << 20  # of text that is cut into pieces at a time
SMALL = (200_000, 1 << 20)  # the same two for workers with little memory to spare: 100 MB less each, and a fifth more time
#: Texts that are not cut into pieces have other blanks or the markers used below, two blanks in a row, or special tokens.
_UNEVEN = ("[\\x00\\x01\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}"
           "\\x{3000}\\x{feff}]|  |\n\n| \n|\n |<\\|")
#: Between a Latin letter and ASCII punctuation there is always a cut.
_WORD_END = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known:
    """Pieces and their ids, one after the other in an array."""

    def __init__(self, dtype: np.dtype):
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces))))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the pieces at some places."""
        begins, lengths = self.ends[places], self.ends[places + 1] - self.ends[places]
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(begins - before, lengths) + np.arange(lengths.sum())], lengths


class Encoder:
    """Encodes texts with the tokenizers library, remembering what it gave for pieces.

    Byte-level pre-tokenisation always splits before a single blank between other characters, around a line end between such, and
    between a Latin letter and ASCII punctuation, so the ids of a text are those of its pieces, one after the other. Columns
    of texts are cut and their different pieces found by Arrow; the library is asked once for each that isn't known. Texts where the cuts
    aren't plain are encoded whole. Memory is bounded: when a generation of pieces is full, it becomes the old one, from which
    pieces still in use are taken over.
    """

    def __init__(self, path: str, plain_specials: bool, sizes: tuple[int, int] | None = None):
        self.cached, self.call_bytes = sizes or (_CACHED, _CALL_BYTES)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, written = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.blank = written(" ")[0][0]  # as the vocabulary's bytes write it
        self.letters = {i: written(chr(i))[0][0] for i in range(128, 256)}
        self.line_end, = self._library(["\n"])[0]
        self.young, self.old = self._empty(), _Known(self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, self.dtype) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _empty(self) -> _Known:
        """What lines can't hold: nothing, a blank at the end of a text, a line end."""
        known, blank = _Known(self.dtype), self._library([" "])[0]
        known.add(["\1", "", "\0"], np.append(blank, self.line_end).astype(self.dtype), np.array([0, len(blank), 1]))
        return known

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none), as little-endian bytes of ``dtype``."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        sizes, out, row = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)), [], 0
        while row < len(column):
            done = int(sizes[row - 1]) if row else 0
            end = max(row + 1, int(np.searchsorted(sizes, done + self.call_bytes, "right")))
            out += self._column(column.slice(row, end - row))
            row = end
        pa.default_memory_pool().release_unused()  # a worker keeps for other tasks what Arrow doesn't give back
        return out

    def forget(self) -> None:
        """Drop the pieces met so far: the worker that holds this encoder may do other work for long."""
        self.young, self.old = self._empty(), _Known(self.dtype)

    def _column(self, column: pa.Array) -> list[bytes]:
        uneven = pc.match_substring_regex(column, _UNEVEN)
        whole = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if len(whole):
            texts = column.take(pa.array(whole)).to_pylist()
            column = pc.if_else(uneven, "", column)
        marked = pc.replace_substring_regex(pc.binary_join_element_wise("\1", column, ""), _WORD_END, "\\1 \1\\2")
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \0 \1"), " ")
        pieces = pc.dictionary_encode(lists.flatten())
        places = self._places(pieces.dictionary.to_pylist())  # may begin a new generation
        ids, lengths = self.young.take(places[pieces.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = [ids[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
        if len(whole):
            for row, found in zip(whole, self._library(texts)):
                out[row] = found.tobytes()
        return out

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the young generation has these different pieces, once it has learnt them."""
        if len(self.young.place) > self.cached:
            self.young, self.old = self._empty(), self.young
        young, old = self.young.place, self.old.place
        known = list(map(young.get, pieces))
        if None not in known:
            return np.array(known, np.int64)
        missing = [p for p, place in zip(pieces, known) if place is None]
        kept = [p for p in missing if p in old]
        if kept:
            self.young.add(kept, *self.old.take(np.array([old[p] for p in kept])))
            missing = [p for p in missing if p not in old]
        words = [p for p in missing if p.isalpha() and max(p) <= "ÿ"]
        if words:
            # Nothing splits words of letters: the library's model alone gives their ids.
            found = [[token.id for token in self.model.tokenize(self.blank + p.translate(self.letters))] for p in words]
            self.young.add(words, np.array(list(chain.from_iterable(found)), self.dtype), np.fromiter(map(len, found), np.int64, len(found)))
            missing = [p for p in missing if p not in young]
        for at in range(0, len(missing), 4096):
            some = missing[at:at + 4096]
            # One to a line; a line end between other characters is split from both.
            found, = self._library(["\n".join([p[1:] if p[0] == "\1" else " " + p for p in some]) + "\n"])
            ends = np.flatnonzero(found == self.line_end)
            if len(ends) != len(some):
                raise ValueError("The library joined pieces that were taken to be split.")
            self.young.add(some, np.delete(found, ends), np.diff(ends, prepend=-1) - 1)
        return np.fromiter(map(young.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(4)
def encoder(path: str, plain_specials: bool = False, sizes: tuple[int, int] | None = None) -> Encoder:
    """One encoder for each worker process, kept over tasks."""
    return Encoder(path, plain_specials, sizes)


def encoded(batch: pa.RecordBatch, coder: Encoder) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each row of a batch."""
    yield from zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")))


def shared_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder that all tasks share; the folder is made where missing."""
    system, path = pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")
    system.create_dir(path, recursive=True)
    return system, path


def write_flat_tokens(docs: DataFrame, folder: str, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Write the ids of all texts, each followed by the separator, to flat files without any index.

    Gives (part, file, ordinal, doc_id, length): a row per document in order of its file, and a row with ordinal -1 per file
    with its length in ids. Files carry the task attempt in their names; those of failed attempts are not in the table.
    """
    path = path or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(path, True), TaskContext.get()
        system, root = shared_folder(folder)
        file, part = f"{root}/tokens-{task.partitionId():05d}-{task.taskAttemptId()}", task.partitionId()
        end, length, ordinal = np.array([separator], coder.dtype).tobytes(), 0, 0
        with system.open_output_stream(file) as out:
            for batch in batches:
                ids = []
                for doc_id, data in encoded(batch, coder):
                    out.write(data + end)
                    length += len(data) // coder.dtype.itemsize + 1
                    ids.append(doc_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([file] * len(ids)), pa.array(range(ordinal, ordinal + len(ids)), pa.int64()),
                     pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int64())], names)
                ordinal += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([-1], pa.int64()),
                                          pa.array([None], pa.int64()), pa.array([length], pa.int64())], names)

    names = ["part", "file", "ordinal", "doc_id", "length"]
    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return stored(rows.mapInArrow(write, "part int, file string, ordinal long, doc_id long, length long"), "token-files")


def scan_documents(files: DataFrame, folder: str, dtype: str = "<u2", separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(part, ordinal, start, n_tokens, ended) of every document in flat token files (part, file, length).

    Blocks of the files are searched for the separator independently, each as one vector comparison. Only a block's first
    document can begin earlier: a prefix scan over the blocks' summaries (ends found, last end) gives where, and how
    many documents came before. Ids after a file's last separator are a document that has not ended. Empty files have no document.
    """
    width = np.dtype(dtype).itemsize
    step = max(1, block_bytes // width)
    blocks = (files.where("length > 0")
              .select("part", "file", "length", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("length") - 1) / step).cast("long"))).alias("block"))
              .repartition(F.col("part"), F.col("block")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = shared_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["block"] * step
                with system.open_input_file(row["file"]) as source:
                    ids = np.frombuffer(source.read_at(min(step, row["length"] - begin) * width, begin * width), dtype)
                at = np.flatnonzero(ids == separator) + begin
                known = pa.array(at[:-1]) if len(at) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["part"], np.int32)), pa.array(np.full(len(at), row["block"])), pa.array(np.arange(len(at))),
                     pa.array(at), pa.concat_arrays([pa.nulls(min(1, len(at)), pa.int64()), known])], ["part", "block", "k", "at", "since"])

    ends = blocks.mapInArrow(search, "part int, block long, k long, at long, since long")
    ends = stored(ends, "token-ends")
    summary = ends.groupBy("part", "block").agg(F.count("*").alias("found"), F.max("at").alias("last"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = summary.select("part", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("_ordinals"),
                          F.coalesce(F.max("last").over(before), F.lit(-1)).alias("_since"))
    start = F.coalesce("since", "_since") + 1
    closed = ends.join(scan, ["part", "block"]).select(
        "part", (F.col("_ordinals") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = summary.groupBy("part").agg(F.sum("found").alias("found"), F.max("last").alias("last"))
    begin = F.coalesce("last", F.lit(-1)) + 1
    open_end = (files.where("length > 0").select("part", "length").join(totals, "part", "left").where(begin < F.col("length"))
                .select("part", F.coalesce("found", F.lit(0)).alias("ordinal"), begin.alias("start"), (F.col("length") - begin).alias("n_tokens"), F.lit(False).alias("ended")))
    return closed.unionByName(open_end)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, part, start, n_tokens): the ids of every document, counted between separators in flat token files.

    Null and empty texts have no ids; repeated rows and null ids each count on their own; an empty table gives no rows.
    ``n_tokens`` leaves the separator out.
    """
    folder = scratch_path(docs.sparkSession, "flat-tokens")
    path = path or vocabulary_path()
    written = write_flat_tokens(docs, folder, path)
    files = written.where("ordinal = -1").select("part", "file", "length")
    found = scan_documents(files, folder, Encoder(path, True).dtype.str)
    names = written.where("ordinal >= 0").select("part", "ordinal", "doc_id")
    return names.join(found, ["part", "ordinal"]).select("doc_id", "part", "start", "n_tokens")
