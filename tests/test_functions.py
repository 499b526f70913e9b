import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import codes
from skein.functions.analysis import Analyzer, common_prefix, edit_distance_compat, snippet, tokens, trigrams
from skein.functions.scoring import NO_WINDOW, min_window
from skein.functions.stemmer import stem

STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist
consistently consist consolation consol consolatory consolatori consolidate consolid conspicuous conspicu conspiracy conspiraci
constables constabl constancy constanc knack knack knackeries knackeri knavish knavish kneaded knead kneel kneel knightly knight
knocked knock knots knot jumps jump lazy lazi hopping hop hoping hope tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky cries cri ties tie dies die gas gas this this kiwis kiwi agreed agre feed feed luxuriated luxuri
generously generous communism communism relational relat conditional condit rational ration valency valenc digitizer digit
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format formalize formal electrical electr goodness good
revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac
adoption adopt activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll
skis ski news news proceeding proceed inning inning say say boy boy enjoy enjoy""".split()


def test_stems():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))


@given(st.text("abcdefghilmnoprstuvy", max_size=12))
@settings(max_examples=300, deadline=None)
def test_a_stem_is_no_longer_than_the_word_but_by_one(word):
    assert len(stem(word)) <= len(word) + 1


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, tokens(F.col("t")), t="The quick brown, fox_2!") == ["the", "quick", "brown", "fox", "2"]
    assert one(spark, tokens(F.col("t")), t="K") == [] == one(spark, tokens(F.col("t")), t=None) == one(spark, tokens(F.col("t")), t="")
    sentence = "The quick brown, fox jumps over the lazy dog!!!"
    assert " ".join(one(spark, Analyzer().terms(F.col("t")), t=sentence)) == "the quick brown fox jump over the lazi dog"
    assert one(spark, Analyzer().terms(F.col("t")), t=None) == []


@pytest.mark.parametrize("a, b, n", [("hello", "hell", 4), ("abc", "xyz", 0), ("", "", 0), ("apple", "appetizer", 3), ("rust", "rust", 4), ("a", "", 0)])
def test_common_prefix(spark, a, b, n):
    assert one(spark, common_prefix(F.col("a"), F.col("b")), a=a, b=b) == n


@pytest.mark.parametrize("a, b, n", [("hello", "hello", 0), ("hello", "", 5), ("", "", 0), ("cat", "cats", 1), ("abc", "xyz", 3), ("xyhello", "ahellozz", 3), ("da", "b", 2), ("b", "da", 2)])
def test_compat_distance(spark, a, b, n):
    assert one(spark, edit_distance_compat(F.col("a"), F.col("b")), a=a, b=b) == n


def plain_compat(a, b):
    """A table as large as both words, the shorter in rows, whose first column is filled one row late."""
    if len(a) > len(b):
        a, b = b, a
    cell = {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        cell[i - 1, 0] = i - 1
        for j in range(1, len(b) + 1):
            best = min(cell.get((i - 1, j - 1), 0), cell.get((i, j - 1), 0), cell.get((i - 1, j), 0))
            cell[i, j] = cell.get((i - 1, j - 1), 0) if a[i - 1] == b[j - 1] else 1 + best
    return cell[len(a), len(b)]


def test_compat_distance_of_random_words(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(7)))
    pairs = [(word(), word()) for _ in range(2000)]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edit_distance_compat(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == plain_compat(r.a, r.b) for r in found)


def test_trigrams_and_snippet(spark):
    assert one(spark, trigrams(F.col("t")), t="hell") == ["hel", "ell"] and one(spark, trigrams(F.col("t")), t="he") == []
    assert one(spark, snippet(F.col("t")), t="x" + "é" * 100) == "x" + "é" * 74 + "..." and one(spark, snippet(F.col("t")), t="é" * 75) == "é" * 75
    assert one(spark, snippet(F.col("t")), t="x" * 151) == "x" * 150 + "..." and one(spark, snippet(F.col("t")), t="x" * 150) == "x" * 150


def test_codes(spark):
    assert [one(spark, codes.gamma_bits(F.col("n")), n=n) for n in (0, 6)] == [1, 5]
    assert [one(spark, codes.vbyte_bits(F.col("n")), n=n) for n in (0, 1023)] == [8, 16]
    assert spark.range(1).select(codes.gaps(F.array(*map(F.lit, (1, 3, 6)))).alias("x")).first().x == [1, 2, 3]


def test_codes_and_back(spark):
    df = spark.createDataFrame([(n, t) for n, t in zip((0, 1, 6, 126, 127, 16382, 16383, 2**40), ("", "a", "é", "word", "x" * 127, "x" * 200, "☃", "0"))], "n bigint, t string")
    g, v, x = codes.gamma_code(F.col("n")), codes.vbyte_code(F.col("n")), codes.text_code(F.col("t"))
    for r in df.select("n", "t", g.alias("g"), v.alias("v"), codes.gamma_value(g).alias("ng"), codes.vbyte_value(v).alias("nv"), codes.gamma_bits(F.col("n")).alias("lg"), codes.vbyte_bits(F.col("n")).alias("lv"), codes.text_value(x).alias("nt")).collect():
        assert (r.n, r.n, len(r.g), len(r.v), r.t) == (r.ng, r.nv, r.lg, r.lv, r.nt)
        assert r.n != 6 or r.g == "11011"


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2)), max_size=12, unique=True))
@settings(max_examples=15, deadline=None)
def test_min_window(spark, places):
    places = sorted(places)
    want = NO_WINDOW
    for a, _ in places:
        for b, _ in places:
            if a <= b and {i for p, i in places if a <= p <= b} == {0, 1, 2}:
                want = min(want, b - a + 1)
    df = spark.createDataFrame([(places, 3)], "o array<struct<pos: int, i: int>>, n bigint")
    assert df.select(min_window(F.col("o"), F.col("n")).alias("w")).first().w == want
