"""N-gram Jaccard join by signature trees."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .filters import id_bitmap, maybe_in, without_ids
from .shared import release, stored, text_slices, tidy, whole_text
from .words import distinct, mix, range_hash, shingle_hashes, word_hashes

LEVEL_BITS = 18  # counters of how often shingles occur
FAN = 8  # children of a tree node
CHUNK = 2048  # members of a block that are joined with as many others at a time


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): the distinct shingles of each text, sorted by both."""
    return distinct(*shingle_hashes(*word_hashes(data, offsets), size))


def shingle_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For 2**18 hash cells of shingles, how common those in the cell are, as a logarithmic level in a byte.

    Each task counts into one fixed array, and the arrays are added up in 64 slices. The levels only order the shingles,
    rare ones first; any order gives the same links.
    """
    slices, cells = 64, (1 << LEVEL_BITS) // 64

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << LEVEL_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch):
                hashes, _ = shingle_sets(data, offsets, size)
                total += np.bincount((hashes >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in total.reshape(slices, cells)])], ["slice", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in part["counts"])
        return pd.DataFrame({"slice": part["slice"][:1], "counts": [total.tobytes()]})

    found = whole_text(docs).mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    total = np.zeros((slices, cells))
    for row in found:
        total[row[0]] = np.frombuffer(bytes(row[1]), np.int64)
    return np.minimum(8 * np.log2(total.ravel() + 1), 255).astype(np.uint8)


def prefix_rows(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, c1, c2, prefix, map) of every document: set size, 128-bit hash of the set, its rarest shingles, its bitmap.

    Two sets with percent * union <= 100 * intersection share one of the first n - ceil(percent * n / 100) + 1 shingles of
    either in any fixed order.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels)

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, end, data, offsets in text_slices(batch):
                hashes, text = shingle_sets(data, offsets, size)
                n = np.bincount(text, minlength=end - begin)
                first = np.concatenate([[0], np.cumsum(n)])
                marks = [range_hash(mix(hashes + np.uint64(k)), first[:-1], first[1:]).view(np.int64) if len(hashes) else np.zeros(end - begin, np.int64) for k in range(2)]
                order = np.lexsort((hashes, held.value[(hashes >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)], text))
                keep = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                place = np.arange(len(hashes)) - first[:-1][text]
                ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[order][place < keep[text]].view(np.int64)))
                maps = pa.array([bitmap(hashes[a:b]).tobytes() for a, b in zip(first, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(n), *map(pa.array, marks), lists, maps], ["doc_id", "n", "c1", "c2", "prefix", "map"])

    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(make, "doc_id long, n long, c1 long, c2 long, prefix array<long>, map binary")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set, as bytes: a power of two of bits, 256 at least and twice as many as shingles (65,536 at most)."""
    width = 1 << min(max(8, int(2 * len(hashes) - 1).bit_length()), 16)
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


class SignatureTree:
    """Nodes over sets in a given order: OR-combined bitmaps, size ranges, and the most shingles beyond a set's bits.

    Level 0 has the sets, each node of a level above ``FAN`` nodes of the one below. Shorter bitmaps are repeated to the
    longest one's length, and the bits that two nodes share are counted once for the repeats that both have at least.
    """

    def __init__(self, maps: list[np.ndarray], sizes: np.ndarray):
        width = max(len(m) for m in maps)
        spare = sizes - np.array([np.bitwise_count(m).sum(dtype=np.int64) for m in maps])
        wide = np.stack([np.tile(m, width // len(m)) for m in maps]).view(np.uint64)
        repeats = np.array([width // len(m) for m in maps])
        self.levels = [(wide, sizes, sizes, spare, repeats)]
        while len(self.levels[-1][0]) > 1:
            wide, low, high, spare, repeats = self.levels[-1]
            at = np.arange(0, len(wide), FAN)
            self.levels.append((np.bitwise_or.reduceat(wide, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(spare, at), np.minimum.reduceat(repeats, at)))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether any set below node x and any below node y can be similar enough, by sizes and by the most they can share."""
        wide, low, high, spare, repeats = self.levels[level]
        good = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        x, y = x[good], y[good]
        shared = np.bitwise_count(wide[x] & wide[y]).sum(axis=1, dtype=np.int64) // np.minimum(repeats[x], repeats[y]) + np.minimum(spare[x], spare[y])
        good[good] = (100 + percent) * shared >= percent * (low[x] + low[y])
        return good

    def components(self, percent: int, linked) -> np.ndarray:
        """Labels of the components of the pairs that ``linked(i, j)`` accepts among those the bounds allow.

        Dual traversal from the root: a pair of nodes goes on only if its bound allows a link and it is not inside one component
        already. Neighbours in the order are tried first, which joins most copies before the descent.
        """
        counts = [len(level[0]) for level in self.levels]
        labels = np.arange(counts[0])

        def attempt(pairs) -> None:
            for i, j in pairs:
                if labels[i] != labels[j] and linked(i, j):
                    labels[labels == labels[j]] = labels[i]

        near = np.arange(counts[0] - 1)
        near = near[self.possible(0, near, near + 1, percent)]
        attempt((i, i + 1) for i in near.tolist())
        pending = [(len(counts) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while pending:
            level, x, y = pending.pop()
            if len(x) > 4096:
                pending += [(level, x[4096:], y[4096:]), (level, x[:4096], y[:4096])]
                continue
            edges = np.arange(0, counts[0], FAN ** level)
            low, high = np.minimum.reduceat(labels, edges), np.maximum.reduceat(labels, edges)
            keep = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
            x, y = x[keep], y[keep]
            keep = self.possible(level, x, y, percent)
            x, y = x[keep], y[keep]
            if level == 0:
                attempt(zip(x.tolist(), y.tolist()))
            elif len(x):
                pairs = np.arange(FAN * FAN)
                u, v = (x[:, None] * FAN + pairs // FAN).ravel(), (y[:, None] * FAN + pairs % FAN).ravel()
                inside = (u < counts[level - 1]) & (v < counts[level - 1]) & ((u < v) | ((u == v) & (level > 1)))
                pending.append((level - 1, u[inside], v[inside]))
        return labels


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` Jaccard similarity."""
    union = len(np.union1d(a, b))
    return 100 * (len(a) + len(b) - union) >= percent * union


def _join_blocks(percent: int, exact: bool):
    """Joins blocks, rows (block, i, j, id, n, data) that come block by block; gives a spanning forest of each.

    data holds bitmaps, and pairs that the bounds allow are candidates; or, if exact, sets, which are compared.
    """
    def links(ids: list[int], sizes: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(ids) < 2:
            return
        sets = [np.frombuffer(d, np.uint64) for d in data] if exact else []
        maps = [bitmap(s) for s in sets] if exact else [np.frombuffer(d, np.uint8) for d in data]
        order = sorted(range(len(ids)), key=(lambda i: (int(sets[i][0]), sizes[i])) if exact else (lambda i: (sizes[i], ids[i])))
        tree = SignatureTree([maps[i] for i in order], np.array([sizes[i] for i in order]))
        labels = tree.components(percent, (lambda i, j: similar(sets[order[i]], sets[order[j]], percent)) if exact else (lambda i, j: True))
        names = np.array(ids)[order]
        other = names != names[labels]
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[labels][other])], ["a", "b"])

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, ([], [], [])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j"))))
            for k, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("id", "n", "data"))):
                if k != key:
                    yield from links(*block)
                    key, block = k, ([], [], [])
                for column, value in zip(block, row):
                    column.append(value)
        yield from links(*block)

    return join


def join_in_blocks(members: DataFrame, rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) found in the blocks of members (block, id), whose data are in rows (id, n, data).

    Blocks of more than ``CHUNK`` members are cut into chunks, and every two chunks are joined by a task of their own, so that no task
    holds more than two chunks whatever the block.
    """
    counts = members.groupBy("block").agg(F.count("*").alias("m"))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    placed = members.join(counts.hint("merge"), "block").select("block", "id", chunks.alias("c"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("own"))
    others = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda o: o != F.col("own"))
    placed = placed.select("block", "id", "own", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(others)).alias("_other")).select(
        "block", "id", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"))
    # An explicit number: joining blocks costs far more than their bytes let adaptive execution expect.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (placed.join(rows.hint("merge"), "id").repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j")
              .select("block", "i", "j", "id", "n", "data"))
    return blocks.mapInArrow(_join_blocks(percent, exact), "a long, b long")


def similar_links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components of similar classes (rep, n, prefix, map).

    Classes that share a prefix shingle meet in the block named after the smallest of them, each class once in a block however
    many shingles lead there. There, signature trees over the bitmaps leave the pairs that may be similar. Their components are the blocks of
    the second join, which compares the sets; only texts of these are read again, and each set is shuffled once.
    """
    tokens = classes.select("rep", F.explode("prefix").alias("token"))
    leads = tokens.groupBy("token").agg(F.min("rep").alias("block"), F.max("rep").alias("_last")).where("block < _last").drop("_last")
    members = stored(tokens.join(leads.hint("merge"), "token").select("block", F.col("rep").alias("id")).distinct(), "block-members")
    maps = classes.select(F.col("rep").alias("id"), "n", F.col("map").alias("data"))
    candidates = connected_components(join_in_blocks(members, maps, percent, exact=False))
    members = stored(candidates.select(F.col("component").alias("block"), F.col("node").alias("id")), "candidates")
    held = members.select(F.col("id").alias("doc_id"))
    texts = maybe_in(whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")), "doc_id", id_bitmap(held, "doc_id"))

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_slices(batch):
                hashes, text = shingle_sets(data, offsets, size)
                first = np.searchsorted(text, np.arange(end - begin + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(np.diff(first)), pa.array(
                    [hashes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["id", "n", "data"])

    shingles = texts.join(held.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "id long, n long, data binary").where("n > 0")
    return join_in_blocks(members, shingles, percent, exact=True)


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    The set of a document is its distinct shingles of ``size`` words (A-Z in lower case); one with fewer words has its whole sequence, one
    without words or text nothing and is linked with nothing. Two documents link when 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable. Equal sets are one class from the start, whatever their number. Rows with one
    doc_id are one document with several sets. Rows with a null id reach their class's smallest id, or null. Empty table: no rows.
    """
    wide = stored(prefix_rows(docs, size, percent, shingle_levels(docs, size)), "shingle-prefixes")
    rows = stored(wide.select("doc_id", "n", "c1", "c2"), "shingle-counts")
    classes = stored(wide.where("n > 0").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("map").alias("map")), "shingle-classes")
    release(wide)
    links = stored(similar_links(docs, classes.where("rep is not null"), size, percent), "similar-links")
    names = stored(classes.select("c1", "c2", "rep"), "class-names")
    release(classes)
    named = rows.where("n > 0").join(names.hint("merge"), ["c1", "c2"])
    # Rows with one id but different sets tie their classes together.
    several = rows.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("a"))
    ties = named.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(several.hint("merge"), "a", "left_semi")
    found = connected_components(links.union(ties))
    filled = named.join(found.hint("merge"), named["rep"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return filled.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


def drop_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, but of each component only the one with the smallest doc_id.

    Rows are told apart by numbers of their own: of rows with one id, or of null ids, that belong to one component, one stays; a
    null id counts as the largest. Documents without words are like nothing and all stay. An empty table gives none.
    """
    name = "number" + "_" * max(map(len, docs.columns))  # no column of the input
    rows = stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(rows.select(F.col(name).alias("doc_id"), "text"), size, percent)
    members = stored(found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("component")), "members")
    several = members.where("id != component").select("component").distinct()
    named = members.join(several.hint("merge"), "component", "left_semi").join(
        rows.select(F.col(name).alias("id"), "doc_id").hint("merge"), "id")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"))
    gone = named.join(first.hint("merge"), "component").where("id != first.id").select("id")
    return without_ids(rows, name, stored(gone, "similar-ids")).drop(name)
