from pyspark.sql import functions as F

from gradeloom.functions import extract as E
from helpers import values

T = F.col("t")


def check(spark, function, cases):
    got = values(spark, [(c[0],) for c in cases], "t string", function(T))
    assert dict(zip((c[0] for c in cases), got)) == dict(cases)


def test_numeric_answers(spark):
    check(spark, E.numeric_answer, [
        ("Step 1: ... #### 42", "42"),
        ("The answer is 45. John drove for 4 hours.", "45"),
        ("#### 1,000", "1000"),
        ("Step 1: 12 + 30 = 42. Step 2: This equals 42 cookies.\nAnswer: 42\nSome trailing chatter mentioning 99 "
         "unrelated things.", "42"),
        ("Working out... #### 7\nAnswer: 8", "8"),
        ("", ""),
        ("nothing here", ""),
        ("5-3", "-3"),
        ("+5", "+5"),
        ("36.00", "36.00"),
        ("1,2,3", "123"),
        ("Answer: none\n#### 3", "3"),          # no number on the answer line
        ("also 5 then 6", "5"),                  # keyword inside a word beats a later number
        ("the reason -3 is 8", "-3"),
        ("so much more was said than 3, or 8", "8"),  # no number within reach of the keyword
        ("so -3 or 8", "-3"),
        ("Answer: the answer: 5", "5"),
        ("Answer:\n\n 12 apples", "12"),         # blanks after the colon may cross lines
        ("#### 5 #### none 6", "6"),
        ("####5####", "5"),
        ("a#####7", "7"),
        ("ANSWER = 1\nanswer: 2,", "2"),
        ("total was about more than it was 77", "77"),
        ("Answer: 7", "7"),
    ])


def test_boolean_answers(spark):
    check(spark, E.boolean_answer, [
        ("Long reasoning ... so the answer is yes.", "yes"),
        ("I cannot determine this.", ""),
        ("Long winding reasoning that ends inconclusively.\nAnswer: No", "no"),
        ("Therefore yes seems plausible.\nAnswer: No", "no"),
        ("", ""),
        ("Answer: True", "yes"),
        ("Answer: false.", "no"),
        ("**Answer:** No", "no"),
        ("Answer: No, because yes was wrong", "yes"),    # only a bare first token counts
        ("Answer: No because", "no"),
        ("Answer: maybe. The answer is not known", "no"),
        ("answer is no, yet the answer is yes", "yes"),
        ("therefore, no", "no"),
        ("it is so: yes!?", "yes"),
        ("eyes", ""),
        ("casino", ""),
        ("no", "no"),
        ("yes\n .", "yes"),
        ("yes or no or y_no", "no"),
        ("a yesé b", ""),                      # é is part of the word
        ("x no-one", "no"),
    ])


def test_answer_line(spark):
    check(spark, E.answer_line, [
        ("none", None),
        ("Answer: a\nanswer = b .!", "b"),
        ("Answer: the answer: 5", "the answer: 5"),
        ("answer:   ", ""),
        ("Answer:\n\n", None),
        ("Answer: x,\t.", "x,"),
    ])


def test_null_text_has_no_answer(spark):
    assert values(spark, [(None,)], "t string", E.numeric_answer(T), E.boolean_answer(T)) == [("", "")]


def test_gold_and_dispatch(spark):
    rows = [("gsm8k", "Add.\n#### 1,234", "Answer: 5"), ("strategyqa", "true", "no"), ("strategyqa", "True", "yes"),
            ("strategyqa", "false", "Answer: 5"), ("strategyqa", "other", "")]
    ds = F.col("d")
    gold = E.gold_answer(F.col("a"), ds)
    got = values(spark, rows, "d string, a string, g string", gold, E.extract_answer(F.col("g"), ds),
                 E.gold_text(F.col("a"), gold, ds))
    assert got == [("1234", "5", "Add.\n#### 1,234"), ("yes", "no", "yes"), ("yes", "yes", "yes"), ("no", "", "no"),
                   ("no", "", "no")]
