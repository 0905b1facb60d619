"""Removal of repeated byte strings, by suffix arrays of anchor positions in deep-shallow order.

A string of ``length`` bytes that occurs twice has the same bytes around the same anchor: the position of the smallest hash of
``GRAM`` bytes in it. Runs of windows with one anchor are segments. Segments with an anchor gram of their own hold nothing
repeated, and equal segments are repeated throughout; only what remains is sorted. There, the suffixes that begin at the
anchors and the reversed texts before them are put in order with their common prefixes; the window that begins d bytes before an anchor
is repeated if another anchor shares d bytes to the left and length - d to the right.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .filters import id_bitmap, maybe_in
from .shared import release, stored, text_slices, whole_text
from .words import mix, range_hash

LENGTH = 400
GRAM = 32
SHALLOW = 16  # bytes to which strings are quicksorted before blind tries take over
HOT = 10_000  # different segments at one anchor gram beyond which windows are counted by digest over all tasks

_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_OTHER = mix(np.arange(1001, 1257, dtype=np.uint64))


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, from running minima of blocks to the right and to the left."""
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(values) - width + 1], onward[width - 1:len(values)])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of all texts: text, first window, number of windows, distance to the anchor, hash of its gram and of the bytes."""
    gram = min(GRAM, length)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "first", "windows", "anchor", "gram", "bytes")}
    if len(data) < length:
        return empty
    at = np.arange(len(data) - gram + 1)
    grams = range_hash(_BYTES[data], at, at + gram)
    best = _window_minimum((grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), length - gram + 1)
    window = np.arange(len(data) - length + 1)
    text = np.searchsorted(offsets, window, "right") - 1
    inside = window + length <= offsets[text + 1]
    window, text, anchor = window[inside], text[inside], (best[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(window):
        return empty
    begins = np.ones(len(window), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    i = np.flatnonzero(begins)
    count = np.diff(np.append(i, len(window)))
    first = window[i]
    return {"text": text[i], "first": first - offsets[text[i]], "windows": count, "anchor": anchor[i] - first,
            "gram": grams[anchor[i]].view(np.int64), "bytes": range_hash(_OTHER[data], first, first + count - 1 + length).view(np.int64)}


def _common(a: bytes, b: bytes, low: int) -> int:
    """Length of the common prefix of two strings that agree on ``low`` bytes."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[tuple[int, int]]:
    """(string, common prefix with the one before) in order, for different strings that agree on ``depth`` bytes.

    Nodes know only the position where their strings part and the byte there. A string goes down blindly to some leaf; one comparison
    with that leaf tells where it branches off.
    """
    def byte(i: int, at: int) -> int:
        return strings[i][at] if at < len(strings[i]) else -1

    root: int | tuple[int, dict] = group[0]
    for i in group[1:]:
        node = root
        while not isinstance(node, int):
            at, children = node
            node = children.get(byte(i, at)) or next(iter(children.values()))
            if isinstance(node, list):
                node = node[0]
        common = _common(strings[i], strings[node], depth)
        parent, node = None, root
        while not isinstance(node, int) and node[0] < common:
            key = byte(i, node[0])
            parent, node = (node[1], key), node[1][key][0]
        if not isinstance(node, int) and node[0] == common:
            node[1][byte(i, common)] = [i]
            continue
        leaf = node
        while not isinstance(leaf, int):
            leaf = next(iter(leaf[1].values()))[0]
        made = (common, {byte(leaf, common): [node], byte(i, common): [i]})
        if parent is None:
            root = made
        else:
            parent[0][parent[1]] = [made]
    out, stack = [], [(root, depth)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, int):
            out.append((node, common))
        else:
            children = sorted(node[1].items())
            stack += [(child[0], common if k == 0 else node[0]) for k, (_, child) in reversed(list(enumerate(children)))]
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """(string, length of the common prefix with the one before it) of different strings, in order; the first has 0.

    Multikey quicksort parts the strings byte by byte into smaller, equal and larger ones until they agree on ``shallow`` bytes; groups
    that still agree are ordered by a blind trie.
    """
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, common = stack.pop()  # common: with the string before the group
        if len(group) == 1:
            out.append((group[0], common))
        elif depth >= shallow:
            ordered = _blind_trie(strings, group, depth)
            out.append((ordered[0][0], common))
            out += ordered[1:]
        elif group:
            middle = strings[group[len(group) // 2]][depth:depth + 1]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for i in group:
                c = strings[i][depth:depth + 1]
                parts[0 if c < middle else 2 if c > middle else 1].append(i)
            held = [(p, depth + (k == 1 and middle != b"")) for k, p in enumerate(parts) if p]
            stack += [(p, d, common if k == 0 else depth) for k, (p, d) in reversed(list(enumerate(held)))]
    return out


def _ordered(strings: list[bytes], shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes) of strings that may be equal."""
    same: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        same.setdefault(s, []).append(i)
    kinds = list(same)
    order, common = [], []
    for kind, lcp in deep_shallow_order(kinds, shallow):
        members = same[kinds[kind]]
        order += members
        common += [lcp] + [len(kinds[kind])] * (len(members) - 1)
    return np.array(order), np.array(common)


def _repeated_windows(groups: list[list[tuple[int, int, bytes]]], length: int, shallow: int) -> np.ndarray:
    """For groups of segments (anchor distance, windows, bytes) with one anchor gram each: which windows are repeated, by [row, d]."""
    rows = [r for g in groups for r in g]
    n, base = len(rows), 0
    high = np.array([r[0] for r in rows])
    low = high - np.array([r[1] for r in rows]) + 1
    sides = []
    for side in range(2):
        order, common, base = np.empty(n, np.int64), np.empty(n, np.int64), 0
        for g in groups:
            strings = [r[2][r[0]:] if side == 0 else r[2][:r[0]][::-1] for r in g]
            # Right sides of a group begin with its gram: the quicksort starts to tell them apart behind it.
            o, c = _ordered(strings, shallow + (GRAM if side == 0 else 0))
            c[0] = -1
            order[base:base + len(g)], common[base:base + len(g)] = base + o, c
            base += len(g)
        sides.append((order, common))
    found = np.zeros((n, length), bool)
    classes = np.empty((2, n), np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        live = np.flatnonzero((low <= d) & (d <= high))
        for side, need in ((0, length - d), (1, d)):
            order, common = sides[side]
            classes[side, order] = np.cumsum(common < need)
        key = classes[0, live] * (n + 1) + classes[1, live]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        found[live, d] = count[which] > 1
    return found


_OUT = ["doc", "t", "start", "stop"]


def _sort_groups(length: int, shallow: int):
    """Byte ranges (doc, t, start, stop) of repeated windows in segments that come by anchor gram."""
    def ranges(groups):
        rows = [r for g in groups for r in g]
        found = _repeated_windows([[r[3:] for r in g] for g in groups], length, shallow)
        edge = np.zeros((len(rows), 1), np.int8)
        steps = np.diff(np.concatenate([edge, found.astype(np.int8), edge], axis=1), axis=1)
        begin, end = np.nonzero(steps == 1), np.nonzero(steps == -1)
        place = np.array([r[2] + r[3] for r in rows])  # of the anchor
        doc, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        i = begin[0]
        return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(t[i]), pa.array(place[i] - end[1] + 1), pa.array(place[i] - begin[1] + length)], _OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, gram = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "doc", "t", "first", "anchor", "windows", "data")]
            for g, *row in zip(*columns):
                if g != gram:
                    if held > 4000:
                        yield ranges(groups)
                        groups, held = [], 0
                    groups.append([])
                    gram = g
                groups[-1].append(tuple(row))
                held += 1
        if groups:
            yield ranges(groups)

    return run


def _window_digests(length: int):
    """Every window of hot segments, as (k1, k2, doc, t, start)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, first, windows, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "first", "windows", "data"))):
                data, at = np.frombuffer(raw, np.uint8), np.arange(windows)
                keys = [pa.array(range_hash(x[data], at, at + length).view(np.int64)) for x in (_BYTES, _OTHER)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(windows, doc)), pa.array(np.full(windows, t)), pa.array(first + at)], ["k1", "k2", "doc", "t", "start"])

    return run


def repeated_ranges(rows: DataFrame, length: int = LENGTH, shallow: int = SHALLOW, hot: int = HOT) -> DataFrame:
    """(doc, t, start, stop): byte ranges, overlapping or not, that together are all repeated bytes of rows (doc, t, text).

    rows with the same doc and t have the same text, and count as often as they stand there.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(c).to_numpy() for c in ("doc", "t"))
            for begin, _, data, offsets in text_slices(batch, 1 << 19):
                s = segments(data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[begin + s["text"]]), pa.array(t[begin + s["text"]]), *[pa.array(s[c].astype(np.int32)) for c in ("first", "windows", "anchor")],
                     pa.array(s["gram"]), pa.array(s["bytes"])], ["doc", "t", "first", "windows", "anchor", "gram", "bytes"])

    places = rows.mapInArrow(cut, "doc long, t long, first int, windows int, anchor int, gram long, bytes long")
    places = stored(places.withColumn("id", F.monotonically_increasing_id()), "segments")
    kinds = places.groupBy("gram", "bytes").agg(F.count("*").alias("n"), F.min("id").alias("lead"))
    grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("places")).where("places > 1").select("gram", "kinds")
    grams = stored(grams, "repeated-grams")
    near = maybe_in(places, "gram", id_bitmap(grams, "gram")).join(grams.hint("merge"), "gram")
    near = stored(near, "repeated-segments")
    release(places, grams)
    # Stored, so that the join below is a plain one, whose skewed keys Spark can split.
    kinds = stored(near.groupBy("gram", "bytes").agg(F.count("*").alias("n"), F.min("id").alias("lead")), "repeated-kinds")
    known = stored(near.join(kinds.hint("merge"), ["gram", "bytes"]), "known-segments")
    release(near, kinds)
    whole = known.where("n > 1").select("doc", "t", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") - 1 + length).cast("long").alias("stop"))
    # What is left to sort: single segments among others with their gram, and one of each repeated kind there.
    open_ = known.where("kinds > 1 and (n = 1 or id = lead)")
    wanted = open_.groupBy("doc", "t").agg(F.collect_list(F.struct("gram", "first", "windows", "anchor", "kinds")).alias("parts"))
    wanted = stored(wanted, "open-segments")
    texts = maybe_in(rows, "t", id_bitmap(wanted, "t")).dropDuplicates(["doc", "t"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, out = batch.slice(k, 64), []
                for doc, t, text, parts in zip(*(part.column(c).to_pylist() for c in ("doc", "t", "text", "parts"))):
                    data = text.encode()
                    out += [(p["gram"], doc, t, p["first"], p["anchor"], p["windows"], p["kinds"], data[p["first"]:p["first"] + p["windows"] - 1 + length]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), [pa.int64()] * 7 + [pa.binary()])],
                                                 ["gram", "doc", "t", "first", "anchor", "windows", "kinds", "data"])

    strings = (texts.join(wanted.hint("merge"), ["doc", "t"])
               .mapInArrow(fetch, "gram long, doc long, t long, first long, anchor long, windows long, kinds long, data binary"))
    strings = stored(strings, "open-strings")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = "doc long, t long, start long, stop long"
    sorted_ = (strings.where(F.col("kinds") <= hot).repartition(parts, "gram").sortWithinPartitions("gram", "doc", "t", "first")
               .mapInArrow(_sort_groups(length, shallow), out))
    windows = strings.where(F.col("kinds") > hot).mapInArrow(_window_digests(length), "k1 long, k2 long, doc long, t long, start long")
    twice = windows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    counted = windows.join(twice.hint("merge"), ["k1", "k2"]).select("doc", "t", "start", (F.col("start") + length).alias("stop"))
    return whole.unionByName(sorted_).unionByName(counted)


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by ranges (start, stop)."""
    out: list[list[int]] = []
    for r in sorted((r["start"], r["stop"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [tuple(r) for r in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, shallow: int = SHALLOW, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document after its repeated bytes are removed.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same document or another, overlaps
    counted; all strings are judged on the input. Texts are UTF-8; null ones are empty, and like all shorter than ``length`` keep
    everything. Repeated rows are repeats of each other. ``kept`` holds the remaining bytes. Empty table: no rows.
    """
    keyed = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("t"), "text")
    found = repeated_ranges(keyed.where(F.octet_length("text") >= length).select("doc", "t", "text"), length, shallow, hot)
    ranges = stored(found.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "repeated-ranges")
    bitmap = id_bitmap(ranges, "t")
    touched = maybe_in(keyed, "t", bitmap).join(ranges.hint("merge"), ["doc", "t"], "left").select("doc_id", "text", "ranges")
    rest = maybe_in(keyed, "t", bitmap, inside=False).select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("ranges"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for text, spans in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    data, spans = text.encode(), merged(spans or [])
                    kept = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)]))
                    out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), [pa.int64()] * 3 + [pa.string(), pa.binary()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return touched.union(rest).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
