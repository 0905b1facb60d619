"""Benchmark decontamination: pigeonhole pieces found exactly, verified with Myers' bit-parallel distance."""

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import parts, tidy, whole_text

ERROR_EVERY = 12  # characters of an item for each allowed edit
MIN_CHARS = 1  # of an item
WHOLE_WORDS = 40  # characters below which an item counts only between word boundaries, as it may be part of an ordinary word or phrase
CHUNK_CHARS = 16 << 20  # of benchmark text that one automaton holds

_NAMES = ["doc_id", "item_id", "distance", "start", "end"]
_BLANKS = "\t\n\v\f\r"


def normalised(text: str) -> str:
    """Every letter in lower case and ASCII blanks as spaces; positions stay.

    U+0130, the one code point with a longer lower case, becomes i; a final sigma is a sigma, as the case of its capital depends on its place.
    """
    text = text.replace("\u0130", "i").lower().replace("ς", "σ")
    for blank in _BLANKS:
        text = text.replace(blank, " ")
    return text


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into errors + 1 pieces (offset, piece) of nearly equal length: a match with so few edits has one unchanged."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distances(pattern_bits: dict[str, int], length: int, text: str) -> Iterator[tuple[int, int]]:
    """(distance, end) of the best approximate occurrence of a pattern that ends there, for every end in a text from 1 on.

    pattern_bits maps each character to the positions where the pattern has it. One column of the edit matrix is two bit vectors
    of vertical differences, advanced by a few integer operations per character (Myers, 1999).
    """
    mask, high = (1 << length) - 1, 1 << length - 1
    plus, minus, score = mask, 0, length
    for i, c in enumerate(text, 1):
        match = pattern_bits.get(c, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (~(diagonal | plus) & mask), plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        vertical = match | minus
        plus, minus = down | (~(vertical | up) & mask), up & vertical
        yield score, i


def myers(pattern_bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best approximate occurrence of a pattern anywhere in the text, the leftmost such end."""
    return min(chain([(length, 0)], distances(pattern_bits, length, text)))


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a stretch neither begins nor ends inside a word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(start) and not inside(end)


def _bits(text: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(text):
        out[c] |= 1 << i
    return dict(out)


class Matcher:
    """Finds the items of one chunk of the benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], error_every: int):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            errors = len(text) // error_every
            for offset, piece in pieces(text, errors):
                found[piece].append((len(self.items), offset))
            self.items.append((item_id, text, errors, _bits(text), _bits(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item within its budget; leftmost end, then nearest start."""
        text = normalised(text)
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text) if len(self.automaton) else ():
            for number, offset in places:
                _, item, errors, _, _ = self.items[number]
                begin = last + 1 - size - offset
                low, high = max(0, begin - errors), min(len(text), begin + len(item) + errors)
                held = windows[number]
                # Hits come by their end, so one of a later piece may begin before windows that are there already.
                while held and low <= held[-1][1]:
                    before = held.pop()
                    low, high = min(low, before[0]), max(high, before[1])
                held.append((low, high))
        for number, spans in windows.items():
            item_id, item, errors, forward, backward = self.items[number]
            whole = len(item) < WHOLE_WORDS
            hits = []
            for low, high in spans:
                found = ((d, low + end) for d, end in distances(forward, len(item), text[low:high]) if d <= errors)
                hits += [(d, end, low) for d, end in found] if whole else [(d, end, low) for d, end in [min(found, default=(errors + 1, 0))] if d <= errors]
            for distance, end, low in sorted(hits):
                _, back = myers(backward, len(item), text[low:end][::-1])
                if not whole or _bounded(text, end - back, end):
                    yield item_id, distance, end - back, end
                    break


def _chunks(benchmark: DataFrame, min_chars: int, chunk_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about ``chunk_chars`` characters of them on the driver and in the tasks at a time.

    Null texts, texts without a letter or digit and items below ``min_chars`` are left out; rows with one id are items of their own.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        (F.length("text") >= min_chars) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-2 * total // chunk_chars)) if total > chunk_chars else 1
    for chunk in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect()
        yield sorted(((r.item_id, normalised(r.text)) for r in rows), key=lambda r: (r[0] is not None, r))


def leaks(docs: DataFrame, benchmark: DataFrame, error_every: int = ERROR_EVERY, min_chars: int = MIN_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best occurrence of every benchmark item in every document that has it.

    An item of n characters occurs where a stretch of the whole text, letters in lower case and blanks alike, is within floor(n / ``error_every``)
    edits of it; for an item below ``WHOLE_WORDS`` characters it may neither begin nor end inside a word. start and end are code points. Every piece hit opens a window that holds any match with that piece in
    place; overlapping windows are verified as one. Of equal distances the leftmost end counts. Null and empty texts
    have no leak; repeated documents have theirs each. A benchmark beyond ``chunk_chars`` is matched chunk by chunk.
    """
    rows, context = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")), docs.sparkSession.sparkContext
    found = None
    for items in _chunks(benchmark, min_chars, chunk_chars):
        held = context.broadcast(items)

        @tidy
        def match(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, error_every)
            for batch in parts(batches):
                out = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in matcher.find(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], _NAMES)

        part = rows.mapInArrow(match, ", ".join(f"`{n}` long" for n in _NAMES))
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_every: int = ERROR_EVERY, min_chars: int = MIN_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item occurs. See ``leaks`` for what occurs means.

    Null and empty texts stay, repeated rows stay or go together, an empty table or benchmark drops nothing.
    """
    for items in _chunks(benchmark, min_chars, chunk_chars):
        held = docs.sparkSession.sparkContext.broadcast(items)

        @tidy
        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, error_every)
            for batch in parts(batches):
                yield batch.filter(pa.array([next(matcher.find(t or ""), None) is None for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
