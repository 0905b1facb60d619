"""SimHash fingerprints, and the search within a Hamming radius by block tables probed with a few bits flipped."""

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import SLICE_BYTES, stored, string_slices, whole_text
from .words import mix, shingle_hashes, word_hashes

SHINGLE = 2
RADIUS = 17  # 97 % of the pairs of texts that share 80 % of their five-word shingles differ in so few bits
BLOCKS = 6  # of 21 or 22 bits, three in each half
FLIPS = RADIUS // BLOCKS  # two fingerprints within the radius differ in so few bits in one block at least
CUTS = [128 * i // BLOCKS for i in range(BLOCKS + 1)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """128-bit SimHash of each text, as rows of two unsigned 64-bit halves.

    Terms are runs of ``SHINGLE`` lower-cased words, a shorter text being one term. Each term votes with its number of
    occurrences on every bit, for its hash's 1 and against its 0; a tie is 0. A text without words is 0 throughout.
    """
    out = np.zeros((len(texts), 2), np.uint64)
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= SLICE_BYTES // 4:
            size += len(texts[end])
            end += 1
        out[begin:end] = _votes(*string_slices(texts[begin:end]))
        begin = end
    return out


def _votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    hashes, text = shingle_hashes(*word_hashes(data, offsets), SHINGLE)
    if not len(hashes):
        return out
    terms = np.bincount(text, minlength=len(out))
    full = np.flatnonzero(terms)
    starts = (np.cumsum(terms) - terms)[full]
    for half in range(2):
        bits = np.unpackbits(mix(hashes + np.uint64(half)).view(np.uint8).reshape(-1, 8), axis=1)
        for_one = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full, half] = np.packbits(2 * for_one > terms[full, None], axis=1).view(np.uint64).ravel()
    return out


def edited(text: str, after: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


_MADE = "n_chars long, edited_sha256 string, a long, b long, ea long, eb long, na long, nb long"
_FIELDS = [f.split()[0] for f in _MADE.split(", ")]


def _digests(texts: list[str], after: list[str]) -> list[pa.Array]:
    changed = [edited(t, n).encode() for t, n in zip(texts, after)]
    own, of_edited, of_next = (fingerprints(x) for x in ([t.encode() for t in texts], changed, [n.encode() for n in after]))
    return _columns(texts, changed, own, of_edited, of_next)


def _columns(texts: list[str], changed: list[bytes], *prints: np.ndarray) -> list[pa.Array]:
    halves = [pa.array(p.view(np.int64)[:, i]) for p in prints for i in range(2)]
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), *halves]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a partition's rows but the last, which needs the next partition; and both ends with their texts."""
    part, last = TaskContext.get().partitionId(), None
    names = ["kind", "part", "doc_id", "text", *_FIELDS]

    def end(kind, row):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
            [kind, part, *row, *[None] * len(_FIELDS)],
            [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6])], names)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if not ids:
            continue
        if last is None:
            yield end(1, (ids[0], texts[0]))
        else:
            ids, texts = [last[0], *ids], [last[1], *texts]
        last = (ids[-1], texts[-1])
        own = fingerprints([t.encode() for t in texts])
        changed = [edited(t, n).encode() for t, n in zip(texts, texts[1:])]
        n = len(changed)
        columns = _columns(texts[:n], changed, own[:n], fingerprints(changed), own[1:])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(ids[:n], pa.int64()), pa.nulls(n, pa.string()), *columns], names)
    if last is not None:
        yield end(2, last)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = _digests(batch.column("text").to_pylist(), batch.column("after").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_FIELDS])


def neighbour_digests(docs: DataFrame) -> DataFrame:
    """Fingerprints (as signed halves) of every text, of its edited form and of the next text in descending order of id.

    One sort by ranges of the id; what a range's last document needs of the next range comes from a table of both ends of each.
    Null ids come last; rows with one id are in order of their texts.
    """
    rows = (whole_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
            .repartitionByRange(F.col("doc_id").desc_nulls_last())
            .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text"))
    found = stored(rows.mapInArrow(_neighbours, f"kind int, part int, doc_id long, text string, {_MADE}"), "simhash")
    heads, tails = found.where("kind = 1"), found.where("kind = 2")
    every = Window.orderBy(F.col("doc_id").desc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = F.lead("part").over(Window.orderBy(F.col("doc_id").desc_nulls_last(), "part"))
    follows = heads.select("part", F.coalesce(onward, F.first("part").over(every)).alias("next"))
    ends = (tails.select("part", "doc_id", "text").join(follows, "part")
            .join(heads.select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after"))
    return found.where("kind = 0").select("doc_id", *_FIELDS).unionByName(ends.mapInArrow(_finish, f"doc_id long, {_MADE}"))


def _distance(a: str, b: str, c: str, d: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(c))) + F.bit_count(F.col(b).bitwiseXOR(F.col(d)))


def _block(i: int, a: Column, b: Column) -> Column:
    return F.shiftrightunsigned(a if CUTS[i] < 64 else b, CUTS[i] % 64).bitwiseAND(F.lit((1 << CUTS[i + 1] - CUTS[i]) - 1))


def _flips(width: int) -> Column:
    """All masks of so many bits with ``FLIPS`` ones at most."""
    return F.array(*[F.lit(sum(1 << i for i in ones)).cast("long") for n in range(FLIPS + 1) for ones in combinations(range(width), n)])


def block_table_search(queries: DataFrame, index: DataFrame) -> DataFrame:
    """All pairs (a, b) of queries and (c, d) of index, tables of distinct fingerprints, within the radius.

    There is a table for each of the ``BLOCKS`` blocks, keyed by its bits. The index has an entry in each; a query asks each for its own
    bits and all that differ from them in ``FLIPS`` bits at most, so it meets what lies within the radius in one table at least, and in each
    table once. Of the tables in which a pair meets, only the first one gives it, and what lies beyond the radius never leaves the join.
    """
    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        entries = [_block(i, F.col(a), F.col(b)) * 8 + i for i in range(BLOCKS)]
        return df.select(a, b, F.explode(F.array(*entries)).alias("k"))

    widths = [end - start for start, end in zip(CUTS, CUTS[1:])]
    wide = F.col("k").bitwiseAND(F.lit(7)).isin([i for i, w in enumerate(widths) if w > min(widths)])
    flips = F.when(wide, _flips(max(widths))).otherwise(_flips(min(widths)))
    left = (tables(queries, "a", "b").select("a", "b", "k", F.explode(flips).alias("_flip"))
            .select("a", "b", F.col("k").bitwiseXOR(F.col("_flip") * 8).alias("k")))
    right = tables(index.select(F.col("a").alias("c"), F.col("b").alias("d")), "c", "d")
    x, y = F.col("a").bitwiseXOR(F.col("c")), F.col("b").bitwiseXOR(F.col("d"))
    table = F.lit(BLOCKS - 1)
    for i in reversed(range(BLOCKS - 1)):
        table = F.when(F.bit_count(_block(i, x, y)) <= FLIPS, i).otherwise(table)
    meets = (left["k"] == right["k"]) & (_distance("a", "b", "c", "d") <= RADIUS) & (left["k"].bitwiseAND(F.lit(7)) == table)
    return left.join(right.hint("merge"), meets).select("a", "b", "c", "d")


def document_fingerprints(docs: DataFrame, step: int = 50) -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and how many documents lie near it.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (32 hex digits), near_edited and near_next (share
    of equal bits), and n_near: for ids divisible by ``step``, the documents within the radius of its fingerprint, itself
    included; else null. Null texts are empty: no characters, fingerprint 0. A single document is its own next one;
    rows with one id, and rows that are equal, follow each other in order of text; an empty table gives no rows.
    """
    made = stored(neighbour_digests(docs), "fingerprints")
    counts = made.groupBy("a", "b").agg(F.count("*").alias("n"))
    queries = made.where(F.col("doc_id") % step == 0).select("a", "b").distinct()
    near = (block_table_search(queries, counts)
            .join(counts.select(F.col("a").alias("c"), F.col("b").alias("d"), "n").hint("merge"), ["c", "d"])
            .groupBy("a", "b").agg(F.sum("n").alias("n_near")))
    word = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    like = lambda c, d: 1 - _distance("a", "b", c, d) / 128
    digest = made.select("doc_id", "n_chars", "edited_sha256", word("a", "b").alias("fingerprint"), word("ea", "eb").alias("edited_fingerprint"),
                         like("ea", "eb").alias("near_edited"), like("na", "nb").alias("near_next"), "a", "b")
    asked = F.coalesce(F.col("doc_id") % step == 0, F.lit(False))
    found = digest.where(asked).join(near.hint("merge"), ["a", "b"], "left").drop("a", "b")
    return found.unionByName(digest.where(~asked).drop("a", "b").withColumn("n_near", F.lit(None).cast("long")))
