"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors are sorted along a Hilbert curve and written as Parquet blocks, each with the least and greatest value of every
dimension. The score of an anchor with any vector of a block then lies between two sums (interval arithmetic), and blocks
whose interval misses what the anchor still looks for are not read for it.

A shelf is what one task sorted, at most ``SHELVES`` of them; a cell is a part of a shelf that a task holds in memory.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import bounded_batches, release, stored

BLOCK = 256  # rows of a block
CELL_BYTES = 16 << 20  # of values in a cell
SHELVES, SHELF_ROWS = 1024, 4096  # at most so many shelves, of so many rows at least
KEY_DIMS, KEY_BITS = 64, 4  # leading components that place a vector on the curve, and bits of each
SLICE = 1 << 16  # anchors that visit one copy of a cell, about
NEAREST = 8  # shelves with the highest bounds, of which a cell is searched before all others
POSITIVES, NEGATIVES = 5, 3
_FAR = 1 << 62  # beyond any score

_POINT = "vec_id long, label long, dims int, vector binary, key binary"
_BLOCK = ("shelf int, cell int, block long, rows int, dims int, ids binary, labels binary, vectors binary, lows binary, highs binary, "
          "square double")
_ASK = "shelf int, cell int, ask long, anchor_id long, label long, dims int, vector binary"
_FOUND = "ask long, slot int, score long, id long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of grid points on the Hilbert curve, as rows of bytes in curve order (Skilling's transform, 2004)."""
    x = cells.astype(np.uint32)
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(dims):
            high = (x[:, i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> bit) & 1 == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip[:, None]
    planes = [(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def _unpack(data: bytes, rows: int, dims: int) -> np.ndarray:
    """Integers of the width that their number tells."""
    width = len(data) // max(1, rows * dims)
    return np.frombuffer(data, f"<i{width or 1}").reshape(rows, dims).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    most = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def points(vectors: DataFrame) -> DataFrame:
    """The rows that take part, as integers and with their place on the curve.

    Left out: a null vec_id, label or vector, a null or non-finite component, and vectors whose squares sum to 2**62 or more, whose
    scores may not fit 64 bits. A shorter vector counts as one that ends in zeros, an empty one scores 0.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, keys, dims, data = [], [], [], [], []
            for at, (name, label, vector) in enumerate(zip(*(batch.column(c) for c in range(3)))):
                values = vector.values
                if values.null_count:
                    continue
                x = np.floor(256 * values.to_numpy(zero_copy_only=False).astype(np.float64))
                with np.errstate(over="ignore", invalid="ignore"):
                    square = float(x @ x)
                if not square < _FAR:
                    continue
                ids.append(name.as_py())
                labels.append(label.as_py())
                dims.append(len(x))
                data.append(_pack(x.astype(np.int64)))
                keys.append(x[:KEY_DIMS] / np.sqrt(square / len(x) if square else 1))
            cells = np.full((len(keys), KEY_DIMS), 1 << (KEY_BITS - 1))
            for row, key in enumerate(keys):
                cells[row, :len(key)] = np.clip(np.floor((key + 2) * (1 << KEY_BITS) / 4), 0, (1 << KEY_BITS) - 1)
            placed = [k.tobytes() for k in hilbert_key(cells, KEY_BITS)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary()),
                pa.array(placed, pa.binary())], ["vec_id", "label", "dims", "vector", "key"])

    label = F.col("label").cast("long")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(make, _POINT)


def hilbert_blocks(rows: DataFrame) -> DataFrame:
    """Points sorted along the curve and cut into blocks with their zone maps; lies in the shared folder as Parquet."""
    rows = stored(rows, "hilbert-points")
    shelves = min(SHELVES, 1 + rows.count() // SHELF_ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, number, held, cell, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def block(part: list[tuple]) -> pa.RecordBatch:
            nonlocal number, cell, size
            dims = max(r[2] for r in part)
            x = np.zeros((len(part), dims), np.int64)
            for i, (_, _, n, data) in enumerate(part):
                x[i, :n] = _unpack(data, 1, n)
            if size and size + x.nbytes // 2 > CELL_BYTES:
                cell, size = cell + 1, 0
            number, size = number + 1, size + x.nbytes // 2
            values = [shelf, cell, number - 1, len(part), dims, np.array([r[0] for r in part], "<i8").tobytes(),
                      np.array([r[1] for r in part], "<i8").tobytes(), _pack(x), x.min(axis=0).astype("<i8").tobytes(),
                      x.max(axis=0).astype("<i8").tobytes(), float((x.astype(float) ** 2).sum(axis=1).max())]
            schema = pa.schema([(n, t) for n, t in zip(_names(_BLOCK), _types(_BLOCK))])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in range(4)))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    ordered = rows.repartitionByRange(shelves, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    blocks = stored(ordered.mapInArrow(cut, _BLOCK), "hilbert-blocks")
    release(rows)
    return blocks


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return [kinds[field.split()[1]] for field in schema.split(", ")]


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of the blocks whose vec_id is divisible by ``every``, with the cell they lie in; ``ask`` tells them apart."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shelf, cell, block, rows, dims, ids, labels, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels, x = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), _unpack(vectors, rows, dims)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), shelf, np.int32)), pa.array(np.full(len(at), cell, np.int32)),
                    pa.array((shelf << 40) + block * BLOCK + at), pa.array(ids[at]), pa.array(labels[at]),
                    pa.array(np.full(len(at), dims, np.int32)), pa.array([_pack(v) for v in x[at]], pa.binary())], _names(_ASK))

    return blocks.select("shelf", "cell", "block", "rows", "dims", "ids", "labels", "vectors").mapInArrow(pick, _ASK)


class Zones:
    """Zone maps of several boxes, and the scores that anchors can have in them."""

    def __init__(self, dims: list[int], lows: list[bytes], highs: list[bytes]):
        self.low, self.high = (np.zeros((len(dims), max(dims, default=0))) for _ in range(2))
        for i, (n, low, high) in enumerate(zip(dims, lows, highs)):
            self.low[i, :n], self.high[i, :n] = np.frombuffer(low, "<i8"), np.frombuffer(high, "<i8")

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible score of every anchor (row) in every box (column), widened by what doubles may lose."""
        n = min(anchors.shape[1], self.low.shape[1])
        above, below = np.maximum(anchors[:, :n], 0), np.minimum(anchors[:, :n], 0)
        low, high = self.low[:, :n], self.high[:, :n]
        lost = np.abs(anchors[:, :n]) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12
        return above @ low.T + below @ high.T - lost, above @ high.T + below @ low.T + lost


def _best(slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each slot: higher scores first, ties by smaller id; in slot order."""
    order = np.lexsort((ids, -scores, slots))
    ranked = slots[order]
    first = np.searchsorted(ranked, ranked)
    return order[np.arange(len(order)) - first < k]


def search_cell(blocks: list[tuple], anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, floors: np.ndarray, tops: np.ndarray,
                k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, score, id) of the first k rows of the cell for every window of every anchor.

    blocks: (ids, labels, vectors, dims, lows, highs, largest square). A window i, w has the scores floors[i, w] to tops[i, w] and the
    slot i * windows + w. Blocks go by falling bounds; a window's floor rises to its k-th score so far, and a block is
    scored only for anchors with a window that its interval meets.
    """
    floors, width = floors.copy(), floors.shape[1]
    least, most = Zones([b[3] for b in blocks], [b[4] for b in blocks], [b[5] for b in blocks]).bounds(anchors)
    square = (anchors.astype(float) ** 2).sum(axis=1).max(initial=0)
    found = [np.zeros(0, np.int64)] * 3
    waiting: list[list[np.ndarray]] = [[], [], []]

    def settle() -> None:
        nonlocal found, waiting
        found = [np.concatenate([a, *b]) for a, b in zip(found, waiting)]
        waiting = [[], [], []]
        best = _best(*found, k)
        found = [a[best] for a in found]
        full = np.flatnonzero(np.bincount(found[0], minlength=floors.size) == k)
        floors.ravel()[full] = np.maximum(floors.ravel()[full], found[1][np.searchsorted(found[0], full, "right") - 1])

    for b in np.argsort(-most.max(axis=0, initial=-np.inf), kind="stable"):
        names, kinds, x, dims = blocks[b][:4]
        rows = np.flatnonzero(((most[:, b, None] >= floors) & (least[:, b, None] <= tops) & (floors <= tops)).any(axis=1))
        if not len(rows):
            continue
        n = min(dims, anchors.shape[1])
        exact = np.float64 if square * blocks[b][6] < 2.0 ** 104 else np.int64  # sums below 2**52 are exact in doubles
        scores = (anchors[rows, :n].astype(exact) @ x[:, :n].T.astype(exact)).astype(np.int64)
        fits = (labels[rows, None] == kinds) & (ids[rows, None] != names) if same else labels[rows, None] != kinds
        for w in range(width):
            i, j = np.nonzero(fits & (scores >= floors[rows, w, None]) & (scores <= tops[rows, w, None]))
            for column, part in zip(waiting, (rows[i] * width + w, scores[i, j], names[j])):
                column.append(part)
        if sum(map(len, waiting[0])) > 4 * k * floors.size + 4096:
            settle()
    settle()
    return tuple(found)


def _windows(column: pa.Array, empty: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), empty, np.int64)
    for row, values in zip(out, lists):
        row[:len(values)] = values
    return out


def _matrix(dims: list[int], vectors: list[bytes]) -> np.ndarray:
    out = np.zeros((len(dims), max(dims, default=0)), np.int64)
    for row, n, data in zip(out, dims, vectors):
        row[:n] = _unpack(data, 1, n)
    return out


def search(blocks: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """(ask, slot, score, id): for each window (floors[slot] to tops[slot]) of each ask the first k rows of the cell that it visits.

    Blocks of a cell come before the asks in a task's rows; the task holds the blocks and streams the asks. Where very many visit
    one cell, they are dealt to several copies of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("slice", "shelf", "cell", "kind"))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                column = lambda name: part.column(name).to_pylist()
                if keys[begin][:3] != key:
                    key, held = keys[begin][:3], []
                if keys[begin][3] == 0:
                    for rows, dims, ids, labels, vectors, low, high, square in zip(*map(column, (
                            "rows", "dims", "ids", "labels", "vectors", "lows", "highs", "square"))):
                        held.append((np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), _unpack(vectors, rows, dims).astype(
                            np.int32 if square < 2.0 ** 60 else np.int64), dims, low, high, square))
                    continue
                floors, tops = _windows(part.column("floors"), 1), _windows(part.column("tops"), 0)
                if not floors.shape[1]:
                    continue
                slots, scores, ids = search_cell(
                    held, _matrix(column("dims"), column("vectors")), np.array(column("label")), np.array(column("anchor_id")), floors, tops, k, same)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(column("ask"))[slots // floors.shape[1]]), pa.array((slots % floors.shape[1]).astype(np.int32)),
                    pa.array(scores), pa.array(ids)], _names(_FOUND))

    copies = 1 + asks.count() // SLICE
    wide = blocks.withColumns({"kind": F.lit(0), "slice": F.explode(F.array(*[F.lit(i) for i in range(copies)]))})
    seen = asks.withColumnRenamed("vector", "vectors").withColumns({"kind": F.lit(1), "slice": F.pmod(F.xxhash64("ask"), F.lit(copies)).cast("int")})
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = wide.unionByName(seen, allowMissingColumns=True).repartition(parts, "slice", "shelf", "cell")
    return both.sortWithinPartitions("slice", "shelf", "cell", "kind", "block").mapInArrow(run, _FOUND)


def shelf_boxes(blocks: DataFrame) -> list[tuple]:
    """(shelf, cells, dims, lows, highs) of every shelf: gathered on the driver, ``SHELVES`` rows at most."""
    def merge(part: pd.DataFrame) -> tuple:
        zones = Zones(part["dims"].tolist(), part["lows"].tolist(), part["highs"].tolist())
        return (int(part["shelf"].iloc[0]), int(part["cell"].max()), zones.low.shape[1],
                zones.low.min(axis=0).astype("<i8").tobytes(), zones.high.max(axis=0).astype("<i8").tobytes())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([merge(part) for _, part in batch.groupby("shelf")], columns=list(batch.columns))

    schema = "shelf int, cell int, dims int, lows binary, highs binary"
    found = blocks.select(*_names(schema)).mapInPandas(partial, schema).groupBy("shelf").applyInPandas(
        lambda part: pd.DataFrame([merge(part)], columns=_names(schema)), schema)
    return sorted((r[0], r[1] + 1, r[2], bytes(r[3]), bytes(r[4])) for r in found.collect())


def route(asks: DataFrame, boxes: list[tuple], nearest: bool) -> DataFrame:
    """Each ask once for every cell, other than its own, of the shelves whose box meets one of its windows.

    The first cells of the ``NEAREST`` shelves by upper bound are one part of these, all others the other part.
    """
    held = asks.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves = held.value
        zones = Zones([b[2] for b in shelves], [b[3] for b in shelves], [b[4] for b in shelves])
        for batch in batches:
            column = lambda name: batch.column(name).to_pylist()
            least, most = zones.bounds(_matrix(column("dims"), column("vector")))
            floors, tops = _windows(batch.column("floors"), 1), _windows(batch.column("tops"), 0)
            home = list(zip(column("shelf"), column("cell")))
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, np.argsort(-most, axis=1, kind="stable")[:, :NEAREST], True, axis=1)
            for at, (shelf, cells, *_) in enumerate(shelves):
                meets = ((most[:, at, None] >= floors) & (least[:, at, None] <= tops) & (floors <= tops)).any(axis=1)
                for cell in range(cells):
                    wanted = meets & (first[:, at] & (cell == 0) if nearest else ~first[:, at] | (cell > 0))
                    rows = [i for i in np.flatnonzero(wanted).tolist() if home[i] != (shelf, cell)]
                    if rows:
                        taken = batch.take(pa.array(rows))
                        fixed = {"shelf": shelf, "cell": cell}
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([fixed[n]] * len(rows), pa.int32()) if n in fixed else taken.column(n) for n in taken.schema.names],
                            taken.schema.names)

    return asks.mapInArrow(run, asks.schema)


def first_k(blocks: DataFrame, boxes: list[tuple], asks: DataFrame, k: int, same: bool) -> DataFrame:
    """(ask, slot, score, id, rank): the first k rows of all blocks in each window of each ask.

    The cell that an anchor lies in and a few with high bounds are searched first. The k-th score there is the floor with which the
    zone maps of the shelves choose where else to look, and below which no cell returns a row.
    """
    order = Window.partitionBy("ask", "slot").orderBy(F.desc("score"), "id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = stored(ranked(search(blocks, asks.union(route(asks, boxes, True)), k, same)), "near-rows")
    reached = near.where(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_reached"))
    raised = asks.join(reached.hint("merge"), "ask", "left").withColumn("floors", F.transform(
        "floors", lambda floor, i: F.greatest(floor, F.coalesce(F.try_element_at("_reached", i), floor)))).select(*asks.columns)
    return ranked(near.drop("rank").union(search(blocks, route(raised, boxes, False), k, same)))


def window_bounds(score: str) -> tuple[Column, Column]:
    """Least and greatest s with 50 * score <= 100 * s <= 95 * score, in whole numbers that cannot overflow."""
    rest = f"pmod({score}, 100)"
    return F.expr(f"{score} - shiftright({score}, 1)"), F.expr(f"({score} - {rest}) div 100 * 95 + {rest} * 95 div 100")


def hard_negatives(vectors: DataFrame, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by ``every``. See ``points`` for the rows that take part; where vec_id is divisible by 7
    the label is the next one modulo 10. Rows with the anchor's own vec_id are never its positives. A repeated row counts as often as
    it occurs: as anchor, positive and negative. Anchors without positives, and positives without negatives in their window, have no
    rows; an empty table gives none. Other columns are not looked at.
    """
    bounded_batches(vectors.sparkSession)
    blocks = hilbert_blocks(points(vectors))
    boxes = shelf_boxes(blocks)
    anchors = stored(anchors_of(blocks, every), "anchors")
    asks = anchors.withColumns({"floors": F.array(F.lit(-_FAR)), "tops": F.array(F.lit(_FAR))})
    positives = stored(first_k(blocks, boxes, asks, POSITIVES, True).select(
        "ask", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = window_bounds("positive_score")
    ranges = positives.select("ask", F.struct("slot", low.alias("low"), high.alias("high")).alias("range")).groupBy("ask").agg(
        F.array_sort(F.collect_list("range")).alias("ranges"))
    asks = stored(anchors.join(ranges.hint("merge"), "ask").select(
        *anchors.columns, F.col("ranges.low").alias("floors"), F.col("ranges.high").alias("tops")), "windows")
    mined = first_k(blocks, boxes, asks, NEGATIVES, False)
    named = positives.join(anchors.select("ask", "anchor_id").hint("merge"), "ask")
    return mined.join(named.hint("merge"), ["ask", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
