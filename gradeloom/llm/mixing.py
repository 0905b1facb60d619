"""Mixing sources to target weights, in fixed-length blocks of words."""

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import running_start, stored, tidy, whole_text

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 32
SHARD_BLOCKS = 4096
TASK_SLOTS = 100_000
GROUP = 4096  # sources that are drawn together
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # of all words, to be taken
REPEATS = 2.0  # times its size, the most that is taken of a source


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, number, source_size, target): what to take of each source.

    Sources in code-point order, null last, have the weights in turn. They share ``share`` times all words; none
    gets more than ``repeats`` times its size. With the sources sorted by the level at which they fill up, those before
    the first that stays below its limit are full, and it and all later ones share the rest by weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = total.withColumn("number", number)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(turn, (F.col("number") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * repeats).withColumn("fills", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills", "number")
    every = Window.partitionBy()
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(onward)).withColumn("place", F.row_number().over(order))
    below = F.col("level") < F.col("fills")
    rows = rows.withColumn("level", F.min_by("level", F.when(below, F.col("place"))).over(every))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return rows.select("source", F.col("number").cast("int").alias("number"), "source_size", target.alias("target"))


def permuted(index: np.ndarray, size: int, seed: tuple[int, ...]) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, applied to ``index``: a four-round Feistel network, walked until inside."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(seed).generate_state(4, np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(40)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def draw_counts(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(number, shard, start, count): how many blocks each output shard takes from each source, and from which slot on.

    Every shard draws its blocks' sources from a multinomial distribution with the sources' shares; with many sources it first
    draws groups of them, then the sources of each group, which is the same distribution. A shard's draw depends on the seed and its number
    alone, so that lost tasks and reruns give the same. What a source is drawn beyond its slots is left out, and what it was
    drawn too rarely goes to shards behind the others, so the totals are the slots. plan: (number, slots).
    """
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = -(-total // shard_blocks)
    groups = plan.where("slots > 0").groupBy((F.col("number") / GROUP).cast("long").alias("group")).agg(
        F.sum("slots").alias("slots"), F.sort_array(F.collect_list(F.struct("number", "slots"))).alias("members"))
    known = sorted((r["group"], r["slots"]) for r in groups.select("group", "slots").collect())  # one row for ``GROUP`` sources
    share = np.array([n for _, n in known]) / max(total, 1)

    def draw_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                size = min(shard_blocks, total - shard * shard_blocks)
                counts = np.random.default_rng((seed, shard)).multinomial(size, share)
                yield pd.DataFrame({"shard": shard, "group": [g for g, _ in known], "drawn": counts}).query("drawn > 0")

    def draw_sources(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                slots = np.array([m["slots"] for m in row.members])
                counts = np.random.default_rng((seed, row.shard, row.group)).multinomial(row.drawn, slots / slots.sum())
                yield pd.DataFrame({"number": [m["number"] for m in row.members], "shard": row.shard, "count": counts}).query("count > 0")

    in_groups = plan.sparkSession.range(shards).mapInPandas(draw_groups, "shard long, group long, drawn long")
    drawn = in_groups.join(groups.select("group", "members").hint("merge"), "group").select("shard", "group", "drawn", "members").mapInPandas(
        draw_sources, "number int, shard long, count long")
    placed = stored(running_start(drawn, "number", ["shard"], F.col("count"), "start"), "mixing-draws")
    limits = plan.select("number", "slots").hint("merge")
    inside = placed.join(limits, "number").where("start < slots").select(
        "number", "shard", "start", F.least("count", F.col("slots") - F.col("start")).alias("count"))
    sums = placed.groupBy("number").agg(F.sum("count").alias("_drawn"))
    lacking = plan.select("number", "slots").join(sums.hint("merge"), "number", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    parts = F.sequence(F.lit(0).cast("long"), ((F.col("slots") - F.col("_drawn") - 1) / shard_blocks).cast("long"))
    extra = lacking.where("slots > _drawn").select("number", "slots", "_drawn", F.explode(parts).alias("_part")).select(
        "number", (F.lit(shards) + F.col("_part")).alias("shard"), (F.col("_drawn") + F.col("_part") * shard_blocks).alias("start"),
        F.least(F.lit(shard_blocks).cast("long"), F.col("slots") - F.col("_drawn") - F.col("_part") * shard_blocks).alias("count"))
    return inside.union(extra)


def draw_blocks(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(number, shard, slot, copy, block): the blocks that every output shard takes from every source.

    A slot becomes a block through the permutation of its source and round: each round passes over every block once before any comes again.
    plan: (number, blocks, slots).
    """
    slots = plan.agg(F.sum("slots")).first()[0] or 0

    @tidy
    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, blocks, shard, start, count in part.itertuples(index=False, name=None):
                slot = np.arange(start, start + count, dtype=np.int64)
                copy, index = slot // blocks, slot % blocks
                block = np.empty_like(index)
                for c in np.unique(copy):
                    block[copy == c] = permuted(index[copy == c], blocks, (seed, number, int(c)))
                yield pd.DataFrame({"number": number, "shard": shard, "slot": slot, "copy": copy, "block": block})

    counts = draw_counts(plan, shard_blocks, seed).join(plan.select("number", "blocks").hint("merge"), "number")
    # An explicit number, as the few bytes of the draws say nothing about the slots they grow to.
    return (counts.select("number", "blocks", "shard", "start", "count").repartition(max(1, -(-slots // TASK_SLOTS)), "number", "shard")
            .mapInPandas(place, "number int, shard long, slot long, copy long, block long"))


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0, **targets) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix of the sources to their targets.

    documents: (doc_id, source, size, mark, number, source_size, target, start), mark being a hash of the text and start the document's
    place in its source's stream of words. pieces: (number, start, first, words, block, times, first_shard, last_shard), the part of a
    block that lies in the document starting there, how often the mix takes that block, and the first and last output shard that does. A source's slots come to target / source_size
    times its blocks, rounded; a full source takes all its blocks ``repeats`` times, hence no document more.
    """
    sized = stored(whole_text(docs, "doc_id", "source").select(
        "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("mark")), "mixing-sizes")
    plan = source_targets(sized, **targets)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    plan = plan.withColumn("blocks", blocks).withColumn(
        "slots", F.when(blocks > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan, "mixing-plan")
    named = sized.join(plan.select("source", "number", "source_size", "target"), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = stored(running_start(named, "number", ["doc_id", "size", "mark"], F.col("size"), "start"), "mixing-places")
    taken = draw_blocks(plan, seed=seed).groupBy("number", "block").agg(
        F.count("*").alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    last = ((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    spans = (placed.where("size > 0")
             .select("number", "start", "size", F.explode(F.sequence((F.col("start") / block_words).cast("long"), last)).alias("block")))
    begin = F.greatest("start", F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = (spans.select("number", "block", "start", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))
              .join(taken.hint("merge"), ["number", "block"]))
    return placed, pieces


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, last_shard) of every document: words it has, its source has, is to give, and the
    mix takes, and between which output shards these lie (null if none are taken).

    Null or empty texts have size 0 and nothing taken; a null source is a source of its own, the last. Rows with the same
    doc_id are mixed each on its own. Without words all targets are 0; an empty table gives no rows.
    """
    placed, pieces = mixture(docs, **options)
    taken = pieces.groupBy("number", "start").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    # Documents with words start at places of their own.
    placed = placed.withColumn("_at", F.when(F.col("size") > 0, F.col("start")))
    joined = placed.join(taken.withColumnRenamed("start", "_at").hint("merge"), ["number", "_at"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, block_words: int = 256, **options) -> DataFrame:
    """The mix as documents: each with the words that its blocks take, times over as often as they are taken.

    Keeps the columns of ``docs``; ``text`` holds one pass over the taken blocks after the other (the second has what is
    taken twice), as they stand in the document, and ``n_chars``, if there, follows it. Documents of which nothing is taken go,
    and so do those without words.
    """
    placed, pieces = mixture(docs, block_words, **options)
    piece = F.struct("first", "words", "times")
    taken = pieces.groupBy("number", "start").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    key = ["doc_id", "source", "size", "mark"]
    cut = placed.where("size > 0").join(taken.hint("merge"), ["number", "start"])
    # The input travels in one column, so that none of its names can clash. Rows with one id, source and text pair up by rank.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))
    rank = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    left = rows.where("size > 0").withColumn("rank", rank([F.xxhash64("row")])).alias("d")
    right = cut.select(*key, "pieces", rank(["start"]).alias("rank")).alias("c")
    same = reduce(Column.__and__, [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*key, "rank"]])
    joined = left.join(right.hint("merge"), same).select("d.row.*", F.struct("c.pieces").alias("_cut" + "_" * max(map(len, docs.columns))))
    word, fields = re.compile(WORD), docs.columns

    @tidy
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(word, text, cut["pieces"]) for text, cut in zip(batch.column("text").to_pylist(), batch.column(len(fields)).to_pylist())]
            columns = {c: batch.column(c) for c in fields}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = docs.select([F.col(c).cast("long") if c == "n_chars" else F.col(f"`{c}`") for c in fields]).schema
    return joined.mapInArrow(rewrite, schema)


def _cut(word: re.Pattern, text: str, pieces: list[dict]) -> str:
    starts = [m.start() for m in word.finditer(text)] + [len(text)]
    passes = []
    for copy in range(max(p["times"] for p in pieces)):
        passes.append("".join(text[starts[p["first"]]:starts[p["first"] + p["words"]]] for p in pieces if p["times"] > copy).rstrip())
    return "\n".join(passes)
