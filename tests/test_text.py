import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import kernels, lexicon
from lexloom.functions import text as T


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").withColumn("out", expression(F.col("t")))
    return [r["out"] for r in rows.orderBy("i").collect()]


def test_clean(spark):
    got = column(spark, ["@someUSER hi #tag", "bhaiyapic.twitter.com/FvLEv3onxZ", "see https://x.y/z  now\n", "www.a.b t.co/1 bit.ly/2 x", None, "  "], T.clean)
    assert got == ["someUSER hi tag", "bhaiya", "see now", "x", "", ""]


def test_tokens_match_python_split(spark):
    texts = ["a b c", "A\x1cB c", "", " lead trail ", "\t\n"]
    assert column(spark, texts, T.tokens) == [t.lower().split() for t in texts]


def test_number_like_and_non_linguistic(spark):
    assert column(spark, ["5g", "1kg", "4050", "24x7", "laptop", ""], T.is_number_like) == [True, True, True, True, False, False]
    kinds = column(spark, ["", "http://a", "@a", "#a", "12.5kg", "...", "café", "बहुत", "ok"], T.non_linguistic_kind)
    assert kinds == ["empty", "url", "mention", "hashtag", "number", "marks", "charset", None, None]


def test_parse_json_fallbacks(spark):
    values = ['{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'it is {"a": 1} ok', "none", None]
    assert column(spark, values, lambda t: F.to_json(T.parse_json(t))) == ['{"a":1}'] * 3 + [None, None]


def test_repair_and_noise(spark):
    assert column(spark, ["“a” é ﬁ", None], T.repair_unicode) == ['"a" é fi', None]
    assert column(spark, ["Mera Balance"], lambda t: T.noise(t, 2)) == ["mr blnc"]


def reference_distance(a, b):
    """Plain dynamic program of the weighted distance."""
    single = lambda c: 0.2 if c in lexicon.VOWELS else 1.0

    def swap(x, y):
        if x == y:
            return 0.0
        if {x, y} in [set(p) for p in lexicon.CLOSE_PAIRS]:
            return 0.1
        return 0.2 if x in lexicon.VOWELS and y in lexicon.VOWELS else 1.0

    row = [0.0]
    for c in b:
        row.append(row[-1] + single(c))
    for x in a:
        new = [row[0] + single(x)]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + single(x), new[j] + single(y), row[j] + swap(x, y)))
        row = new
    return row[-1]


def test_weighted_distance_is_the_plain_program():
    draw = random.Random(3)
    words = ["".join(draw.choices("aeiovwzjkt", k=draw.randint(0, 9))) for _ in range(200)]
    for key in ["khabar", "ho", "", "zvaw"]:
        assert kernels.weighted_distances(words, key).tolist() == [reference_distance(w, key) for w in words]
    pairs = list(zip(words, reversed(words)))
    assert kernels.pair_distances(*map(list, zip(*pairs))).tolist() == pytest.approx([reference_distance(a, b) for a, b in pairs])


@pytest.mark.parametrize("a, b, sim", [("achi", "ho", 0.65), ("aapka", "aap", 0.76), ("kr", "kaise", 0.68), ("hai", "ho", 0.8667), ("h", "ho", 0.9)])
def test_similarity_goldens(a, b, sim):
    assert round(float(kernels.similarities([a], b)[0]), 4) == sim


def test_common_subsequence():
    draw = random.Random(5)
    for _ in range(100):
        a, b = ("".join(draw.choices("abc ", k=draw.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert kernels.common_subsequence(a, b) == row[-1]
        assert (kernels.ratio_at_least(a, b, 60) >= 0) == (not (a or b) or 200 * row[-1] / (len(a) + len(b)) >= 60)


def test_matcher_ratio(spark):
    out = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(kernels.matcher_ratio(F.col("a"), F.col("b"))).first()[0]
    assert out == pytest.approx(100 * difflib.SequenceMatcher(None, "abcd", "bcde").ratio())


def test_patterns_are_portable():
    for p in (T.URL, T.NUMBER_UNIT, T.SANE, T.NO_LETTER):
        assert not re.search(r"\\[wds](?![a-z])", p)
