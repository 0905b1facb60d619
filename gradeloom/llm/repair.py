"""Repair of conversation structure: the cheapest edits that make roles alternate, by a Viterbi search that emits as it goes.

A repaired conversation is empty or has an optional system row and then pairs of user and assistant. The search keeps the best
path into each of four states in a tree of back pointers with reference counts. As soon as all surviving paths
share an ancestor, the edits up to it are final: they are emitted and their nodes go. Conversations are cut into segments, so
that one of any length is searched by many tasks: a segment gives its best edits between every two states, and the same
search over segments, which are far fewer, chooses among them.
"""

import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_batches, stored

BLANKS = " \t\n\x0b\x0c\r"
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 20  # of a segment, about
# The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that an inserted or re-roled row takes
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_END = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # insertions that complete a conversation
# What it costs at most to go on from the second state as the first one would. A dearer first state can't win, not even by a tie.
_INSTEAD = {(START, USER): DELETE + INSERT, (START, ASSISTANT): DELETE, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 0,
            (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT}
_PAIRS = ("su", "ua", "au")


class _Node:
    __slots__ = ("parent", "label", "kids", "refs")

    def __init__(self, parent, label):
        self.parent, self.label, self.kids, self.refs = parent, label, [], 0


class Survivors:
    """The best path into each state, of least cost and among these least in order.

    Edits of one path are told from another's by the whole texts that are not final yet. Two texts of the same rows differ before
    either ends (both end with an edit of the last row), so their order stays what it is when they are continued: it is carried
    along as a rank, with which a tie is decided by the complete unresolved suffixes without reading them again.
    """

    def __init__(self, state: int = START):
        self.root = _Node(None, None)
        self.root.refs = 1
        self.paths = {state: (0, 0, self.root)}  # state -> cost, rank, node

    def step(self, options) -> Iterator:
        """Lengthen all paths by what options[state] offers, (next state, cost, order, label); yields the labels that become final.

        order compares the labels that lead from one state to several.
        """
        best = {}
        for state, (cost, rank, node) in self.paths.items():
            for target, more, order, label in options[state]:
                key = (cost + more, rank, order)
                if target not in best or key < best[target][0]:
                    best[target] = (key, node, label)
        for state, other in _INSTEAD:
            if state in best and other in best and best[other][0][0] + _INSTEAD[state, other] < best[state][0][0]:
                del best[state]
        before, self.paths = self.paths, {}
        for rank, (state, (key, parent, label)) in enumerate(sorted(best.items(), key=lambda x: x[1][0][1:])):
            node = _Node(parent, label)
            parent.kids.append(node)
            parent.refs += 1
            node.refs = 1
            self.paths[state] = (key[0], rank, node)
        for _, _, node in before.values():
            self._drop(node)
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.label

    def _drop(self, node: _Node) -> None:
        """Take one reference from a node, and remove what nothing refers to any more."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node = parent

    def pending(self, state: int) -> list:
        """The labels of a state's path that are not final yet."""
        labels, node = [], self.paths[state][2]
        while node is not self.root:
            labels.append(node.label)
            node = node.parent
        return labels[::-1]

    def finish(self) -> tuple[int, int, list]:
        """(state, cost, labels not final yet) of the best complete path."""
        state = min(self.paths, key=lambda s: (self.paths[s][0] + INSERT * len(_END[s]), self.paths[s][1]))
        return state, self.paths[state][0] + INSERT * len(_END[state]), self.pending(state)


def _row_options(initial: str, forced: bool, truncated: bool) -> dict[int, list[tuple]]:
    """What may be done with a row in each state; a row that may not stay can only be deleted."""
    offers = {}
    for state in range(4):
        offers[state] = [(state, DELETE, "D", "D")]
        for at, cost, before in () if forced else ((state, 0, ""), (_TURN[state], INSERT, "I")):
            cost += TRUNCATED if truncated else 0
            if (at, initial) in _KEEP:
                offers[state].append((_KEEP[at, initial], cost, before + "K", before + "K"))
            offers[state].append((_TURN[at], cost + REROLE, before + "R", before + "R"))
    return offers


_ROW_OPTIONS = {(c, f, t): _row_options(c, f, t) for c in ("s", "u", "a", "") for f in (False, True) for t in (False, True)}


def edits_between(rows: list[tuple], starts: Iterable[int] = range(4)) -> dict[tuple[int, int], tuple[int, int, str]]:
    """(from, to) -> cost, rank among the ends of one start, edits; rows: (initial, to be deleted, truncated) in order."""
    found = {}
    for start in starts:
        paths, final = Survivors(start), []
        for initial, forced, truncated in rows:
            final += paths.step(_ROW_OPTIONS[initial if initial in ("s", "u", "a") else "", forced, truncated])
        for state, (cost, rank, _) in paths.paths.items():
            found[start, state] = (cost, rank, "".join(final + paths.pending(state)))
    return found


def best_edits(rows: list[tuple]) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    paths, final = Survivors(), []
    for initial, forced, truncated in rows:
        final += paths.step(_ROW_OPTIONS[initial if initial in ("s", "u", "a") else "", forced, truncated])
    state, cost, rest = paths.finish()
    return cost, "".join(final + rest) + _END[state]


def repaired(rows: Iterable[tuple[str, str]], edits: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits, which begin in a state."""
    rows = iter(rows)
    for edit in edits:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = _KEEP[state, role[:1]] if edit == "K" else _TURN[state]
        yield role if edit == "K" else _ROLE[state], text


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): conversations with the faults that crc32 of ``conv_id:turn`` modulo 20 gives them.

    0 drops the row (times 0), 1 empties its text, 2 takes out its marks .!?, 3 repeats it (times 2), 4 makes its role user. Nulls
    of role and text, and of conv_id and turn in the checksum, count as one space.
    """
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times, fault) in order of conv_id and turn over all partitions.

    Equal rows of a turn become one with their number before they are sorted. fault is that of the first of them: blank, duplicate (its
    role and text stand in an earlier turn) or truncated, else null; the others are duplicates. What is a duplicate is found out
    without the texts and comes to the row as a marker (null text) that sorts before it.
    """
    said = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), "role", "text"))
    order = ["conv_id", "turn", "role", "said"]
    small = rows.where("times > 0").select("conv_id", "turn", "role", said.alias("said")).distinct()
    first = small.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    later = small.join(first.hint("merge"), "said").where(~F.col("turn").eqNullSafe(F.col("first.turn")))
    markers = later.select(*order, F.lit(None).cast("string").alias("text"), F.lit(0).alias("times"), F.lit("duplicate").alias("fault"))
    grouped = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").cast("int").alias("times"))
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(rest == "", "blank").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "truncated")
    marked = grouped.select("conv_id", "turn", "role", said.alias("said"), "text", "times", fault.alias("fault"))
    both = marked.unionByName(markers).repartitionByRange(*order)
    return both.sortWithinPartitions(*order, F.col("text").isNotNull()).drop("said")


class _Segment:
    """Consecutive rows of one conversation and what can be told of them without the others."""

    def __init__(self):
        self.rows, self.texts, self.size, self.count = [], [], 0, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.cut = [], False  # first, last, number of different ones; whether the conversation goes on in another segment

    def add(self, turn: int | None, role: str, text: str, times: int, fault: str | None) -> None:
        for copy in range(times):
            kind = fault if copy == 0 or fault == "blank" else "duplicate"
            if kind:
                self.count[kind] += 1
            if self.rows and self.rows[-1][0] + role[:1] not in _PAIRS:
                self.count["illegal"] += 1
            self.rows.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
            self.texts.append((role, text))
            self.size += len(role) + len(text)
        if times and turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.size >= SEGMENT_BYTES


_RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string",
           "repaired_sha256": "string"}
_BODY = {"conv_id": "long", "part": "int", "number": "int", "body": "binary"} | _RESULT
_LINE = {"conv_id": "long", "position": "long", "role": "string", "text": "string"}
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def _batch(fields: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, kind in zip(columns, fields.values())], list(fields))


def _packed(segment: _Segment, begins: bool) -> bytes:
    """A segment as bytes; one that surely begins its conversation needs no other start."""
    table = [[*k, *v] for k, v in edits_between(segment.rows, (START,) if begins else range(4)).items()]
    ends = [segment.rows[0][0], segment.rows[-1][0]] if segment.rows else None
    return json.dumps([segment.texts, segment.count, segment.turns, ends, table]).encode()


def segments(rows: DataFrame, limit: int = SEGMENT_ROWS, finish: bool = False) -> DataFrame:
    """(conv_id, part, number, body): the segments, of about ``limit`` rows at most, of the conversations, part and number being their order.

    With finish, a conversation that surely is one whole segment gets its result instead (the other columns of ``repair``) and no body.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, number, first, segment, out, size, marked = None, 0, True, None, [], 0, False

        def close(last: bool = False) -> None:
            """The first conversation of a task may have begun in another one, and its last may go on there."""
            nonlocal size
            if segment is not None:
                body = _packed(segment, number == 0 and not first)
                if finish and number == 0 and not first and not last and not segment.cut:
                    whole = _Conversation()
                    whole.add(body)
                    out.append((key, part, number, None, *whole.result()))
                else:
                    out.append((key, part, number, body, *[None] * len(_RESULT)))
                size += len(body)

        for batch in batches:
            for conv, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    marked = True
                    continue
                if segment is None or conv != key or segment.full(limit):
                    more = segment is not None and conv == key
                    if more:
                        segment.cut = True
                    close()
                    first = first and (segment is None or more)
                    number = number + 1 if more else 0
                    key, segment = conv, _Segment()
                segment.add(turn, role, text, times, "duplicate" if marked and fault != "blank" else fault)
                marked = False
                if size > SEGMENT_BYTES:
                    yield _batch(_BODY, out)
                    out, size = [], 0
        close(last=True)
        if out:
            yield _batch(_BODY, out)

    bounded_batches(rows.sparkSession)
    return ordered_rows(rows).mapInArrow(cut, _schema(_BODY))


def in_order(parts: DataFrame) -> DataFrame:
    """Segments dealt by conversation, each conversation's in order."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "body")


class _Conversation:
    """The search over the segments of one conversation; segments are held until the edits of theirs are final."""

    def __init__(self):
        self.paths, self.held, self.state, self.turns, self.last = Survivors(), deque(), START, [], None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0

    def add(self, body: bytes) -> None:
        texts, count, turns, ends, table = json.loads(body)
        for name, n in count.items():
            self.count[name] += n
        if turns:
            new = turns[2] - (1 if self.turns and self.turns[1] == turns[0] else 0)
            self.turns = [self.turns[0], turns[1], self.turns[2] + new] if self.turns else turns
        if not ends:
            return
        if self.last is not None and self.last + ends[0] not in _PAIRS:
            self.count["illegal"] += 1
        self.last = ends[1]
        options = {state: [] for state in range(4)}
        for start, state, cost, rank, edits in table:
            options[start].append((state, cost, rank, (state, edits)))
        self.held.append(texts)
        for label in self.paths.step(options):
            self._emit(*label)

    def _emit(self, state: int, edits: str) -> None:
        self._write(repaired(map(tuple, self.held.popleft()), edits, self.state))
        self.audit.append(edits)
        self.state = state

    def _write(self, rows: Iterable[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def result(self) -> tuple:
        state, cost, rest = self.paths.finish()
        for label in rest:
            self._emit(*label)
        self._write(repaired((), _END[state], state))
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return gaps, *self.count.values(), cost, "".join(self.audit) + _END[state], self.sha.hexdigest()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations, whose segments come in order."""
    key, now = None, None
    for batch in batches:
        done = []
        for conv, body in zip(batch.column("conv_id").to_pylist(), batch.column("body")):
            if now is None or conv != key:
                if now is not None:
                    done.append((key, *now.result()))
                key, now = conv, _Conversation()
            now.add(body.as_py())
        yield _batch({"conv_id": "long"} | _RESULT, done)
    if now is not None:
        yield _batch({"conv_id": "long"} | _RESULT, [(key, *now.result())])


def repair(rows: DataFrame, limit: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    rows: conv_id, turn, role, text (not null) and times, how often the row stands there; a conversation of which all rows have times 0 is
    empty, with zeros. Rows go by turn, nulls first, those of one turn by role and then in an order that their text fixes;
    repeated rows stand together. A null conv_id is a conversation as well. An empty table gives no rows. Segments of about ``limit``
    rows don't change results. Only conversations that are long, or that lie at an end of a task's rows, are joined from segments; the
    digest needs their rows one after the other, and they stream through a task.
    """
    parts = stored(segments(rows, limit, finish=True), "conversation-segments")
    whole = parts.where("body is null").select("conv_id", *_RESULT)
    return whole.union(in_order(parts.where("body is not null")).mapInArrow(_joined, _schema({"conv_id": "long"} | _RESULT)))


def repaired_rows(rows: DataFrame, limit: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves. See ``repair`` for rows."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            out = []
            for conv, body in zip(batch.column("conv_id").to_pylist(), batch.column("body")):
                if now is None or conv != key:
                    out += now.rest() if now else []
                    key, now = conv, _Written(conv)
                now.add(body.as_py())
                out += now.take()
            yield _batch(_LINE, out)
        yield _batch(_LINE, now.rest() if now else [])

    return in_order(segments(rows, limit)).mapInArrow(write, _schema(_LINE))


class _Written(_Conversation):
    """Gives the repaired rows as they become final."""

    def __init__(self, conv):
        super().__init__()
        self.conv, self.out = conv, []

    def _write(self, rows: Iterable[tuple[str, str]]) -> None:
        for role, text in rows:
            self.out.append((self.conv, self.lines, role, text))
            self.lines += 1

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def rest(self) -> list[tuple]:
        self.result()
        return self.take()
