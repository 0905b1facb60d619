"""Near-duplicate documents by MinHash bands and odd sketches.

A document's MinHash samples are cut into bands; documents that share one are candidates. The samples are also folded into a bitmap
in which each flips one bit (odd sketch; Mitzenmacher, Pagh and Pham, 2014): the XOR of two has a bit for about every sample that
differs, so its population count tells high similarities apart far better than the bands. Pairs that it lets pass are
compared by their full shingle sets.
"""

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .filters import id_bitmap, maybe_in
from .shared import bounded_batches, release, stored, text_slices, whole_text
from .words import distinct, mix, range_hash, shingle_hashes, word_hashes

BANDS, ROWS = 40, 5  # a pair of similarity 0.85 shares none of the bands once in 10**10
SAMPLES = BANDS * ROWS
BITS = 512  # of a sketch
MISS = 1e-12  # chance that the sketches of a pair at the threshold are taken for too different
SKETCH_CHUNK, SET_CHUNK = 8192, 4096  # members of a block that one task compares with one another
CHUNK_BYTES = 16 << 20  # of the sets of a chunk, about

_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(1 << 32))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i are hashes[first[i]:first[i + 1]], sorted."""
    hashes, text = distinct(*shingle_hashes(*word_hashes(data, offsets), size))
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def minhash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples (one row per set, none of them empty) of sets that begin at ``starts``."""
    out = np.empty((len(starts), SAMPLES), np.uint64)
    for i in range(SAMPLES if len(starts) else 0):
        out[:, i] = np.minimum.reduceat(hashes * _FACTORS[i] + _SHIFTS[i], starts)
    return mix(out)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS))
    for i in range(ROWS):
        keys = mix(keys + samples[:, i::ROWS])
    return keys


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Sketches, one row of 64-bit words each: every sample, with its number, flips the bit it hashes to."""
    places = (mix(samples + _FACTORS) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    flips = np.bincount((places + BITS * np.arange(len(samples))[:, None]).ravel(), minlength=BITS * len(samples))
    return np.packbits((flips & 1).astype(np.uint8).reshape(-1, BITS), axis=1, bitorder="little").view(np.uint64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity that the sketches suggest."""
    odd = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-2 * np.minimum(odd, BITS / 2 - 1) / BITS)


@cache
def odd_bits(percent: int) -> int:
    """The most odd bits that a pair of this similarity has but once in 1 / ``MISS`` cases.

    A sample differs with the chance 1 - percent / 100 and then flips a bit for either side; the number of odd bits is a Markov chain
    over flips.
    """
    differ = 1 - percent / 100
    chance = np.zeros(BITS + 1)  # of so many odd bits after the flips so far
    chance[0] = 1
    up, down = 1 - np.arange(BITS + 1) / BITS, np.arange(BITS + 1) / BITS
    total, weight = np.zeros(BITS + 1), (1 - differ) ** SAMPLES
    for different in range(SAMPLES + 1):
        total += weight * chance
        weight *= (SAMPLES - different) / (different + 1) * (differ / (1 - differ) if differ < 1 else 0)
        for _ in range(2):
            chance = np.concatenate([[0], (chance * up)[:-1]]) + np.concatenate([(chance * down)[1:], [0]])
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > MISS).max(initial=0))


def sketch_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, c1, c2, bands, sketch) of every document: set size, 128-bit hash of the set, band keys and odd sketch."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, end, data, offsets in text_slices(batch):
                hashes, first = shingle_sets(data, offsets, size)
                n, rows = np.diff(first), end - begin
                marks = [range_hash(mix(hashes + np.uint64(k)), first[:-1], first[1:]).view(np.int64) if len(hashes) else np.zeros(rows, np.int64)
                         for k in range(2)]
                samples = minhash(hashes, first[:-1][n > 0])
                lengths = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                                 pa.array(band_keys(samples).ravel().view(np.int64)))
                sketches = iter(odd_sketch(samples))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, rows), pa.array(n), *map(pa.array, marks), bands,
                    pa.array([next(sketches).tobytes() if k else b"" for k in n], pa.binary())], ["doc_id", "n", "c1", "c2", "bands", "sketch"])

    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(make, "doc_id long, n long, c1 long, c2 long, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, data): the sorted shingles of the documents with these ids, from their whole texts."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_slices(batch):
                hashes, first = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(
                    [hashes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["id", "data"])

    wanted = ids.select(F.col("id").alias("doc_id"))
    texts = maybe_in(whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")), "doc_id", id_bitmap(wanted, "doc_id"))
    return texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(make, "id long, data binary").where("length(data) > 0")


def sketches_near(most: int) -> Callable:
    """Comparison of sketches: at most so many odd bits."""
    def prepare(data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        words = np.frombuffer(b"".join(data), np.uint64).reshape(len(data), -1)
        return lambda i, others: np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64) <= most

    return prepare


def sets_similar(percent: int) -> Callable:
    """Comparison of sets: 100 * intersection >= percent * union."""
    def prepare(data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = [np.frombuffer(d, np.uint64) for d in data]
        sizes = np.array([len(s) for s in sets])

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            fits = (100 * sizes[others] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[others])
            for at in np.flatnonzero(fits):
                other = sets[others[at]]
                place = np.minimum(np.searchsorted(sets[i], other), sizes[i] - 1)
                shared = np.count_nonzero(sets[i][place] == other)
                fits[at] = 100 * shared >= percent * (sizes[i] + len(other) - shared)
            return fits

        return similar

    return prepare


def spanning_links(names: np.ndarray, groups: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what ``linked`` accepts, without any within one group; every pair of different groups is asked or joined."""
    _, groups = np.unique(groups, return_inverse=True)
    found = []
    for i in range(len(names) - 1):
        others = i + 1 + np.flatnonzero(groups[i + 1:] != groups[i])
        if not len(others):
            continue
        hits = others[linked(i, others)]
        new, at = np.unique(groups[hits], return_index=True)
        found += [(int(names[i]), int(names[hits[a]])) for a in at]
        groups[np.isin(groups, new)] = groups[i]
    return found


def _join(prepare: Callable) -> Callable:
    """Joins groups of rows (block, i, j, id, known, data) that come group by group; known names what is joined already."""
    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        names, known, data = (list(c) for c in zip(*rows))
        found = spanning_links(np.array(names), np.array(known), prepare(data))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "i", "j", "id", "known", "data")]
            for k, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if k != key:
                    yield from links(held)
                    key, held = k, []
                held.append(row)
        yield from links(held)

    return join


def links_in_blocks(members: DataFrame, rows: DataFrame, prepare: Callable, chunk: int) -> DataFrame:
    """Links (a, b) that join, in each block of members (block, id), what the comparison accepts of rows (id, data).

    Blocks of more members than a chunk, or of many bytes, are dealt into chunks. Each chunk is joined with the block's smallest member in it; chunks of
    near copies are then one component for the most part. Only where a block is more than that, every two of its chunks that are
    not one component meet, in a task of their own. So a group of near copies takes time in proportion to its size, no pair of
    different components is left out, and no task holds more than two chunks.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # comparing costs far more than its bytes tell

    def compared(placed: DataFrame) -> DataFrame:
        joined = placed.join(rows.hint("merge"), "id").repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "id")
        return joined.select("block", "i", "j", "id", "known", "data").mapInArrow(_join(prepare), "a long, b long")

    sized = members.join(rows.select("id", F.length("data").alias("_size")).hint("merge"), "id")
    counts = sized.groupBy("block").agg(
        F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("_size") / CHUNK_BYTES)).cast("int").alias("chunks"), F.min("id").alias("hub"))
    dealt = stored(members.join(counts.hint("merge"), "block").withColumn("own", F.pmod(F.xxhash64("id"), "chunks").cast("int")), "chunks")
    everywhere = F.explode(F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own")))
    near = stored(compared(dealt.withColumn("i", everywhere).select("block", "i", F.col("i").alias("j"), "id", F.col("id").alias("known"))), "chunk-links")
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return near
    joined = connected_components(near)
    named = stored(large.join(joined.hint("merge"), large["id"] == joined["node"], "left").select(
        "block", "id", "own", F.coalesce("component", "id").alias("known")), "chunk-members")
    spans = named.groupBy("block", "own").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    x, y = (spans.select("block", *[F.col(c).alias(p + c) for c in ("own", "low", "high")]) for p in "xy")
    open_pairs = x.join(y.hint("merge"), "block").where("xown < yown and not (xlow = xhigh and ylow = yhigh and xlow = ylow)")
    sides = open_pairs.select("block", F.col("xown").alias("i"), F.col("yown").alias("j"), F.explode(F.array("xown", "yown")).alias("own"))
    return near.union(compared(sides.join(named.hint("merge"), ["block", "own"]).select("block", "i", "j", "id", "known")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    The set of a document is its distinct shingles of ``size`` words (A-Z in lower case); one with fewer words has its whole sequence, one
    without words or text nothing and is linked with nothing. Two documents link when 100 * intersection >= percent *
    union, confirmed on the full sets; component_id is the smallest doc_id reachable, kept tells whether that is the document
    itself. Equal sets are one class from the start, whatever their number. Rows with one doc_id are one document with several
    sets. Rows with a null id reach their class's smallest id, or null, and are not kept. Empty table: no rows. Other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    wide = stored(sketch_rows(docs, size), "sketches")
    rows = stored(wide.select("doc_id", "n", "c1", "c2"), "shingle-counts")
    classes = stored(wide.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sketch-classes")
    release(wide)
    # Classes that share a band meet in the block of the smallest of them, once however many bands lead there.
    bands = classes.select("rep", F.explode("bands").alias("band"))
    leads = bands.groupBy("band").agg(F.min("rep").alias("block"), F.max("rep").alias("_last")).where("block < _last").drop("_last")
    members = stored(bands.join(leads.hint("merge"), "band").select("block", F.col("rep").alias("id")).distinct(), "band-members")
    sketches = classes.select(F.col("rep").alias("id"), F.col("sketch").alias("data")).join(
        members.select("id").distinct().hint("merge"), "id", "left_semi")
    candidates = connected_components(links_in_blocks(members, stored(sketches, "candidate-sketches"), sketches_near(odd_bits(percent)), SKETCH_CHUNK))
    blocks = stored(candidates.select(F.col("component").alias("block"), F.col("node").alias("id")), "candidates")
    sets = stored(full_sets(docs, blocks, size), "candidate-sets")
    links = links_in_blocks(blocks, sets, sets_similar(percent), SET_CHUNK)
    names = stored(classes.select("c1", "c2", "rep"), "class-names")
    release(classes)
    named = rows.where("n > 0").join(names.hint("merge"), ["c1", "c2"], "left")
    # Rows with one id but different sets tie their classes together.
    several = rows.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("a"))
    ties = named.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(several.hint("merge"), "a", "left_semi")
    found = connected_components(links.union(ties))
    filled = named.join(found.hint("merge"), named["rep"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    every = filled.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
