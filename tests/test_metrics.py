import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import metrics as M
from gradeloom.functions.similarity import embedding_f1
from gradeloom.functions.text import py_round, strip, tokens
from helpers import values

P, R = F.col("p"), F.col("r")
PAIR = "p string, r string"


def test_substring(spark):
    rows = [("The answer is 42 cookies.", "42"), ("ANSWER: yes", "Yes"), ("The answer is 99.", "42"), ("", "42"),
            ("42", ""), ("a  b", "a b"), ("x", " x\n"), (None, "x"), ("x", None)]
    assert values(spark, rows, PAIR, M.substring_match(P, R)) == [1, 1, 0, 0, 0, 0, 1, 0, 0]


def test_numeric_close(spark):
    rows = [("36.36", "36"), ("37", "36"), ("1,000", "1000"), ("yes", "42"), ("", "42"), ("36.5", "36"), (" 7 ", "7"),
            ("1_000", "1000"), ("1e3", "1000"), ("1d", "1"), ("inf", "inf"), ("nan", "1"), (".5", "0"), ("5.", "5"),
            ("-0.5", "0"), ("1__0", "10")]
    assert values(spark, rows, PAIR, M.numeric_close(P, R)) == [1, 0, 1, 0, 0, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 0]
    assert values(spark, [("36.36", "36")], PAIR, M.numeric_close(P, R, tolerance=0.01)) == [0]


OVERLAP = [
    ("the quick brown fox", "the quick brown fox", 1.0, 1.0),
    ("alpha beta", "gamma delta", 0.0, 0.0),
    ("the dog ran", "the dog jumped", 2 / 3, 2 / 3),
    ("", "anything", 0.0, 0.0),
    ("anything", "", 0.0, 0.0),
    ("a b c", "a c b", 1.0, 2 / 3),
    ("a b c", "x y z", 0.0, 0.0),
    ("a a a", "a", 0.5, 0.5),
    ("Étude, ÉTUDE!", "étude", 2 / 3, 2 / 3),
    ("", "", 0.0, 0.0),
]


def test_token_f1_and_rouge_l(spark):
    rows = [o[:2] for o in OVERLAP]
    got = values(spark, rows, PAIR, M.token_f1(tokens(P), tokens(R)), M.rouge_l(tokens(P), tokens(R)))
    for (f1, rouge), (_, _, want_f1, want_rouge) in zip(got, OVERLAP):
        assert f1 == pytest.approx(want_f1) and rouge == pytest.approx(want_rouge)


def table_lcs(a, b):
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                best[i, j] = 0
            elif a[i - 1] == b[j - 1]:
                best[i, j] = best[i - 1, j - 1] + 1
            else:
                best[i, j] = max(best[i - 1, j], best[i, j - 1])
    return best[len(a), len(b)]


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    many = [f"w{i}" for i in range(500)]
    for _ in range(3):  # more shared words than are counted one by one
        rows.append(tuple(" ".join(rng.choice(many) for _ in range(900)) for _ in range(2)))
    for _ in range(300):
        words = "a b c d e f g h".split()[: rng.randint(1, 8)]
        rows.append(tuple(" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(2)))
    got = values(spark, rows, PAIR, M.common_tokens(tokens(P), tokens(R)), M.lcs_length(tokens(P), tokens(R)),
                 M.token_f1(tokens(P), tokens(R)), M.rouge_l(tokens(P), tokens(R)))
    for (p, r), (common, lcs, f1, rouge) in zip(rows, got):
        a, b = p.split(), r.split()
        assert common == sum((Counter(a) & Counter(b)).values())
        assert lcs == table_lcs(a, b)
        assert rouge <= f1 <= 1.0
        if len(b) == 1:
            assert rouge == f1


def test_tokens_are_unicode_words(spark):
    texts = ["Ça va? naïve_1 – 42nd", "汉字 test", "don't", "x²y", "", "__a__"]
    got = values(spark, [(t,) for t in texts], "t string", tokens(F.col("t")))
    assert got == [re.findall(r"\w+", t.lower()) for t in texts]


def test_strip_removes_what_python_strips(spark):
    blanks = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    texts = [f"{b}x y{b}" for b in blanks] + ["".join(blanks), "​x"]
    got = values(spark, [(t,) for t in texts], "t string", strip(F.col("t")))
    assert got == [t.strip() for t in texts]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rounding_is_pythons(spark, digits):
    rng = random.Random(digits)
    numbers = [i / 10 ** (digits + 1) for i in range(0, 4000)]
    numbers += [rng.random() * 10 ** rng.randint(-3, 5) for _ in range(2000)]
    numbers += [2 * s / n for n in range(2, 200) for s in range(1, 20) if 2 * s <= n]
    numbers += [0.25, 0.15, 0.35, 1 / 32, 3 / 32, -0.25, -0.15, 219.625]
    got = values(spark, [(n,) for n in numbers], "x double", py_round(F.col("x"), digits))
    assert [(n, g) for n, g in zip(numbers, got) if g != round(n, digits)] == []


def test_embedding_f1(spark):
    same = [1.0, 0.0, 0.0, 1.0]
    rows = [(same, same), (same, [0.0, 2.0, 3.0, 0.0]), ([1.0, 0.0], [1.0, 1.0]), (None, same), ([], same),
            ([0.0, 0.0], [1.0, 0.0])]
    got = values(spark, rows, "p array<double>, r array<double>", embedding_f1(P, R, 2))
    assert got[:2] == [pytest.approx(1.0), pytest.approx(1.0)]
    assert got[2] == pytest.approx(0.5 ** 0.5)
    assert got[3:] == [None, None, 0.0]


def test_overlap_of_short_arrays_needs_no_search(spark):
    rng = random.Random(4)
    words = lambda: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
    rows = [(words(), words()) for _ in range(600)] + [(None, ["a"]), (["a"], None), (None, None)]

    def lcs(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            before = line
            line = [0]
            for j, y in enumerate(b):
                line.append(before[j] + 1 if x == y else max(line[j], before[j + 1]))
        return line[-1]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, r array<string>")
    p, r = F.col("p"), F.col("r")
    easy = df.withColumn("easy", M.evident_lcs(p, r)).withColumn("common", M.common_tokens(p, r))
    found = easy.withColumn("lcs", M.lcs_length(p, r, F.col("easy"))).orderBy("i").collect()
    for row, (a, b) in zip(found, rows):
        if a is None or b is None:
            assert row.easy is None and row.lcs is None
            continue
        assert row.lcs == lcs(a, b) and row.easy in (None, row.lcs)
        assert row.common == sum((Counter(a) & Counter(b)).values())
    plain = spark.createDataFrame([(["the", "total", "is", "7"], ["add", "the", "items", "7"])], "p array<string>, r array<string>")
    assert plain.select(M.evident_lcs(p, r)).first()[0] == 2
