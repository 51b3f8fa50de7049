import random
import re

import pandas as pd
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from moodlark.functions import lexicon, text
from moodlark.operators import features


def column_of(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row.out for row in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def noise(seed, pieces, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(n)]


PIECES = [
    "a", "the", "Don't", "can't", "I'll", "cannot", "gonna", "lemme", "wanna", "'tis", "d'ye", "more'n", "n't", "'s", "'", "''", '"', "http://t.co/a,b", "https",
    "www.x.y", "awww", "Zoë", "É", "12", "1,5", "a,b", ":", "3:4", ",", ".", "..", "...", "--", "-", "!", "?", "(", ")",
    "]", "“", "”", "’", "«", " ", " ", " ", "\n", "\t", "\r", "\u00a0", "\u2003", "\x1c", "🙂", "x-y", "U.S.", "end.", "mr.",
]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Awww nice one", "a one"),
        ("see http://t.co/a,b now!", "see now"),
        ("see HTTP://T.CO now", "see now"),
        ("tab\there", "tabhere"),
        ("don't 12 go\nnow", "dont go now"),
        ("xhttps://q z", "x z"),
        ("http\u00a0x", "httpx"),
        ("http", "http"),
        ("www", "www"),
        ("www.x.y z", "z"),
        ("www\nx y", "www x y"),
        ("a \n\n b", "a b"),
        (" \n A \r B\n", "a b"),
        ("Zo\u00eb \u00c9", "zo"),
        ("\u2003mid\u2003dle", "middle"),
        ("", ""),
        ("!?", ""),
    ],
)
def test_cleaning(spark, raw, expected):
    assert column_of(spark, [raw], text.clean_text) == [expected]


def test_cleaned_text_is_plain(spark):
    """Whatever comes in: only small letters and single blanks, no link, and cleaning again changes nothing."""
    cleaned = column_of(spark, noise(1, PIECES), text.clean_text)
    for value in cleaned:
        assert set(value) <= set("abcdefghijklmnopqrstuvwxyz ")
        assert value == value.strip() and "  " not in value
    # A link's head may form anew from what stood around something deleted.
    kept = [v for v in cleaned if "http" not in v and "www" not in v]
    assert len(kept) > 100
    assert column_of(spark, kept, text.clean_text) == kept


def test_commas_and_first_token(spark):
    assert column_of(spark, ["a,b,,c", None], text.drop_commas) == ["abc", None]
    labels = ["Call of Duty", "  Positive", "", "  ", None, " x y"]
    assert column_of(spark, labels, text.first_token) == ["Call", "Positive", None, None, None, "x"]


def test_display_text_equals_pandas(spark):
    values = ["x" * 49, "x" * 50, "a\nb", "a\tb\rc", "y" * 45 + "\n" * 3, None, "Zoë " * 20]
    shown = [pd.DataFrame({3: [float("nan") if v is None else v]}).iloc[0:1, 0].to_string() for v in values]
    expected = [re.sub(r"^0 +", "", line) for line in shown]
    assert column_of(spark, values, text.display_text) == expected


def python_word_tokens(value, abbreviations=()):
    """Chunk by chunk: the same rules, told without look-around."""
    alone = set(""";@#$%&?!*()[]{}<>"«»“”‘’„`""")
    closers = set("""])}>"'»”’""")
    starts = r"\b(?:can(?=not\b)|gon(?=na\b)|got(?=ta\b)|wan(?=na$)|gim(?=me\b)|lem(?=me\b)|d(?='ye\b)|more(?='n\b))"
    tokens = []
    for chunk in value.lower().split():
        pieces, word, i = [], "", 0
        while i < len(chunk):
            c = chunk[i]
            dots = len(chunk[i:]) - len(chunk[i:].lstrip("."))
            step, mark = 1, None
            if c in alone:
                mark = c
            elif c in ",:" and not (i + 1 < len(chunk) and chunk[i + 1] in "0123456789"):
                mark = c
            elif dots >= 2:
                mark, step = "." * dots, dots
            elif c == "." and i > 0 and chunk[i - 1] != "." and set(chunk[i + 1 :]) <= closers:
                mark = None if chunk[:i] in abbreviations else c
            elif chunk.startswith("--", i):
                mark, step = "--", 2
            if mark is None:
                word += chunk[i : i + step]
            else:
                pieces += [word, mark]
                word = ""
            i += step
        pieces.append(word)
        for piece in filter(None, pieces):
            for clitic in ("n't", "'s", "'m", "'d", "'ll", "'re", "'ve", "'"):
                head = piece[: -len(clitic)]
                if piece.endswith(clitic) and head and head[-1] != "'":
                    parts = [head, clitic]
                    break
            else:
                parts = [piece]
            for part in parts:
                tokens += re.sub(rf"{starts}|^'t(?=(?:is|was)\b)", r"\g<0> ", part).split()
    return tokens


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Don't stop.", ["do", "n't", "stop", "."]),
        ("I cannot, can't go: 12:30!", ["i", "can", "not", ",", "ca", "n't", "go", ":", "12:30", "!"]),
        ("first one. second (two.) 3.5", ["first", "one", ".", "second", "(", "two", ".", ")", "3.5"]),
        ("https://x well-known", ["https", ":", "//x", "well-known"]),
        ("wait... what--now", ["wait", "...", "what", "--", "now"]),
        ("gonna gotta lemme", ["gon", "na", "got", "ta", "lem", "me"]),
        ("'Tis what 'twas", ["'t", "is", "what", "'t", "was"]),
        ("D'ye want more'n that", ["d", "'ye", "want", "more", "'n", "that"]),
        ("cannot-do uncannot cannots", ["can", "not-do", "uncannot", "cannots"]),
        ("wanna wanna-be x-gimme", ["wan", "na", "wanna-be", "x-gim", "me"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_word_tokens(spark, raw, expected):
    assert column_of(spark, [raw], text.word_tokens) == [expected]
    assert python_word_tokens(raw) == expected


def test_word_tokens_equal_plain_python(spark):
    values = noise(2, PIECES)
    assert column_of(spark, values, text.word_tokens) == [python_word_tokens(v) for v in values]


def test_abbreviations_keep_their_period(spark):
    values = ["Mr. Smith met dr. No. Then (mr. x) left mr.", *noise(3, PIECES, 100)]
    found = column_of(spark, values, lambda v: text.word_tokens(v, ("mr", "dr")))
    assert found[0][:3] == ["mr.", "smith", "met"]
    plain = [v for v in values if "mr." not in v]
    kept = [f for f, v in zip(found, values, strict=True) if "mr." not in v]
    assert kept == [python_word_tokens(v, ("mr", "dr")) for v in plain]


def test_alphabetic_and_stop_words_keep_order_and_repeats(spark):
    rows = spark.createDataFrame([(["cat", "the", "c3", "cat", "é", ""],)], "w array<string>")
    alphabetic = rows.select(text.alphabetic_tokens(F.col("w")).alias("w"))
    assert alphabetic.first().w == ["cat", "the", "cat"]
    assert alphabetic.select(text.without_words(F.col("w")).alias("w")).first().w == ["cat", "cat"]


def test_stop_lists(spark):
    assert list(lexicon.ML_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
    assert len(lexicon.DASHBOARD_STOP_WORDS) == len(set(lexicon.DASHBOARD_STOP_WORDS)) == 179


def test_model_tokens_filtered_words_and_bigrams(spark, posts_of):
    rows = posts_of([(1, "s", "t", "The  quick  brown"), (2, "s", "t", ""), (3, "s", "t", "one"), (4, "s", "t", None)])
    out = {row.id: row for row in features.with_bigrams(rows).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].tk == ["the", "", "quick", "", "brown"]
    assert out[1].filtered_words == ["", "quick", "", "brown"]
    assert out[1].ngrams == [" quick", "quick ", " brown"]
    assert (out[2].tk, out[2].ngrams) == ([""], [])
    assert out[3].ngrams == []


def test_lemma_forms(spark):
    rows = spark.createDataFrame([("boxes",), ("women",), ("cat",), ("s",)], "v string")
    forms = [set(row.f) for row in rows.select(text.lemma_forms(F.col("v")).alias("f")).collect()]
    assert forms == [{"boxes", "boxe", "box"}, {"women", "woman"}, {"cat"}, {"s", ""}]


def test_display_words(spark):
    rows = spark.createDataFrame([(["a", "", "b"],)], "w array<string>")
    assert rows.select(text.display_words(F.col("w")).alias("o")).first().o == "a :  : b"
