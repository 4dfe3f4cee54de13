import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays, draws, text


def test_sliding_windows(one):
    xs = F.array(*[F.lit(i) for i in (1, 2, 3, 4)])
    row = one(*[arrays.sliding(xs, n).alias(f"w{n}") for n in range(1, 6)])
    assert row.w1 == [[1], [2], [3], [4]]
    assert row.w2 == [[1, 2], [2, 3], [3, 4]]
    assert row.w3 == [[1, 2, 3], [2, 3, 4]]
    assert row.w4 == [[1, 2, 3, 4]]
    assert row.w5 == []


def spans(*pairs):
    return F.array(*[F.struct(F.lit(b).alias("b"), F.lit(e).alias("e")) for b, e in pairs])


def test_contiguous(one):
    row = one(
        arrays.contiguous(spans((1, 4), (4, 5), (5, 10))).alias("yes"), arrays.contiguous(spans((1, 2), (4, 5))).alias("no")
    )
    assert row.yes and not row.no


def test_draws_agree_between_engines(one):
    row = one(draws.mix(F.lit(987654321).cast("bigint"), F.sequence(F.lit(0), F.lit(999))).alias("d"))
    assert row.d == draws.mix_numpy(987654321, np.arange(1000)).tolist()


def test_draws_are_uniform():
    u = draws.to_unit(draws.mix_numpy(5, np.arange(200_000)))
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    assert np.histogram(u, 20, (0, 1))[0].min() > 9_500


def test_top_indexes_first_wins_ties(one):
    xs = F.array(*[F.lit(float(x)) for x in (1, 3, 3, 0, 3, 2)])
    row = one(arrays.top_indexes(xs, 4).alias("t"), arrays.top_indexes(xs, 50).alias("all"), arrays.argmax(xs).alias("m"))
    assert row.t == [1, 2, 4, 5] and row.all == [1, 2, 4, 5, 0, 3] and row.m == 1


def test_softmax(one):
    row = one(arrays.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p"))
    assert row.p == [0.5, 0.5]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("  x　 ", "x"),
        ("\t a b\u0085\n", "a b"),
        ("", ""),
        (" ", ""),
    ],
)
def test_strip_is_unicode_aware(one, raw, expected):
    assert one(text.strip_unicode(F.lit(raw)).alias("x")).x == expected == raw.strip()


def test_words_and_offsets(one):
    ctx = F.lit(" 안녕 a b　c\n끝")
    row = one(text.words(ctx).alias("w"), *[text.word_at(ctx, F.lit(i)).alias(f"p{i}") for i in range(10)])
    assert row.w == ["안녕", "a", "b　c", "끝"]
    assert [row[f"p{i}"] for i in range(10)] == [-1, 0, 0, 0, 1, 1, 2, 2, 2, 2]


def test_byte_offsets(one):
    s = "가a😀é"
    sizes = [len(c.encode()) for c in s]
    starts = [sum(sizes[:i]) for i in range(len(s) + 1)]
    row = one(*[text.byte_to_char(F.lit(s), F.lit(b)).alias(f"c{i}") for i, b in enumerate(starts)])
    assert list(row) == [0, 1, 2, 3, 4]


def test_strip_tags(one):
    # removing <b> leaves a <div>, whose turn is over, and an <abbr>, whose turn comes
    raw = '<title>a\tb</title><td rowspan="2" colspan="3">x</td><di<b>v>y<ab<b>br>  <p class="q">[편집]\n\n<title>a\nb</title>'
    assert one(text.strip_tags(F.lit(raw)).alias("x")).x == ' <td r2" c3">x</td><div>y <p class="q">\n<title>a\nb</title>'


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("The <b>Cat</b>, (sat)!", "thecatsat"),
        ("《漢字》 ‘x’ 　y", "漢字xy"),
        ("a &lt; b &amp;copy; &#44032;&#x1F600; &nosuch; &", "abcopy가😀nosuch"),
        ("<script>var x</script>1<!-- c -->2", "12"),
        ("1 < 2 > 0", "120"),
        ("...", ""),
    ],
)
def test_normalise_answer(one, raw, expected):
    assert one(text.normalise_answer(F.lit(raw)).alias("x")).x == expected


def test_char_f1(one):
    f1 = lambda a, b: text.char_f1(F.lit(a), F.lit(b))
    row = one(f1("aab", "ab").alias("x"), f1("", "").alias("empty"), f1("ab", "cd").alias("none"), f1("abc", "abc").alias("same"))
    assert row.x == pytest.approx(0.8) and row.empty == 0.0 and row.none == 0.0 and row.same == 1.0
