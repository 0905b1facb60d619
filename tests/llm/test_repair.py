"""Conversation repair against a search over all edits, from the last row to the first."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from gradeloom.llm import repair
from tests.llm.reference import WORD

SCHEMA = "conv_id long, turn long, role string, text string, times string, fault int, said string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, edits, repaired rows) of (role, text, forced, truncated) rows: all edits, least cost first, then least text of edits."""
    @cache
    def best(i, state, inserts):
        options = []
        if inserts < 3:
            for letter in "ua":
                if (state, letter) in NEXT:
                    cost, edits, tail = best(i, letter, inserts + 1)
                    options.append((cost + 5, "I" + edits, ((NAMES[letter], ""), *tail)))
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, forced, truncated = rows[i]
            cost, edits, tail = best(i + 1, state, 0)
            options.append((cost + 2, "D" + edits, tail))
            extra = 5 if truncated else 0
            for letter, name, more, edit in [(role[:1], role, 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")]:
                if not forced and (state, letter) in NEXT:
                    cost, edits, tail = best(i + 1, NEXT[state, letter], 0)
                    options.append((cost + more + extra, edit + edits, ((name, text), *tail)))
        return min(options) if options else (10 ** 9, "", ())

    for i in range(len(rows), 0, -1):  # keeps the recursion shallow
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def expected(rows):
    """What repair gives for (conv_id, turn, role, text) rows, damaged in plain Python."""
    conversations = {}
    for conv, turn, role, text in rows:
        damaged = conversations.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        damaged += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    found = {}
    for conv, damaged in conversations.items():
        # Ties of a turn in the order that the operator states: by role, then by a hash of conversation, role and text.
        said = lambda r: hashlib.md5(f"{'-' if conv is None else conv}:{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), said(r)))
        seen, marked, kinds = set(), [], []
        for _, role, text in damaged:
            words = WORD.findall(text)
            kind = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append(kind)
            marked.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        turns = {t for t, _, _ in damaged if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, tail = cheapest(tuple(marked))
        text = "\n".join(f"{r}:{t}" for r, t in tail)
        found[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
                       hashlib.sha256(text.encode()).hexdigest(), tail)
    return found


def conversations(seed, count=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "What?", " \n", "", None, "A b c!\x0b", "dé.  ", f"Row {rng.randint(0, 9)}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "user", "Hi."), (None, 2, "assistant", "x" * 100_000 + ".")]
    rows += rows[5:9] * 2
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.fixture
def many_tasks(spark):
    """Rows of one conversation go to several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("limit", [1, 7, 1024])
def test_repair_equals_a_search_over_all_edits(spark, many_tasks, limit):
    rows = conversations(limit)
    want = expected(rows)
    found = repair.repair(repair.damaged(frame(spark, rows)), limit).collect()
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id][:-1], r.conv_id
    lines = repair.repaired_rows(repair.damaged(frame(spark, rows)), limit).collect()
    for conv, values in want.items():
        assert [(r.role, r.text) for r in sorted((x for x in lines if x.conv_id == conv), key=lambda x: x.position)] == list(values[-1])


def test_long_conversations_are_cut(spark, many_tasks):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "user", "assistant"]), f"Row {i}.") for i in range(400)] + [(2, 5, "user", "Same.")] * 500
    want = expected(rows)
    for r in repair.repair(repair.damaged(frame(spark, rows)), 16).collect():
        assert tuple(r)[1:] == want[r.conv_id][:-1]


def test_repair_of_an_empty_table(spark):
    assert repair.repair(repair.damaged(frame(spark, []))).count() == 0
    assert repair.repaired_rows(repair.damaged(frame(spark, []))).count() == 0


def test_edits_are_final_early_and_ties_go_by_whole_texts():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "t"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        named = tuple(({"s": "system", "t": "tool"}.get(c) or NAMES[c], "x", forced, cut and not forced) for c, forced, cut in rows)
        assert repair.best_edits([(r[0][:1], r[2], r[3]) for r in named]) == cheapest(named)[:2]
    # An alternating conversation is emitted as it comes: what is held does not grow.
    paths, held = repair.Survivors(), []
    for i in range(1000):
        list(paths.step(repair._ROW_OPTIONS["ua"[i % 2], False, False]))
        held.append(max(len(paths.pending(s)) for s in paths.paths))
    assert max(held) <= 4
    # All rows of one role: two histories stay, and the tree holds no more than these.
    paths = repair.Survivors()
    for _ in range(1000):
        list(paths.step(repair._ROW_OPTIONS["u", False, False]))
    assert len(paths.paths) <= 3
