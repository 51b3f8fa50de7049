"""Text expressions. All are built-in functions on Columns; none is a UDF."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodlark.functions.lexicon import BLANKS, DASHBOARD_STOP_WORDS, NARROW_BLANKS, NOUN_ENDINGS, WIDE_BLANKS

# What cleaning deletes, tried in this order at each position.
NOT_LETTER = r"[^A-Za-z\n ]"
LINK = rf"http[^{BLANKS}]+"
# The character after www may be a blank: "awww nice one" becomes "a one".
WEB_NAME = rf"www[^\n][^{BLANKS}]+"
DELETED = f"{NOT_LETTER}|{LINK}|{WEB_NAME}"

# The display form keeps 46 characters of texts of 50 and more.
DISPLAY_WIDTH = 50
DISPLAY_KEPT = 46
DISPLAY_NULL = "NaN"


def clean_text(text: Column) -> Column:
    """Lower case; drop links and everything that is not a letter; single blanks.

    Links start with a letter, so deleting them first and the other characters
    after that deletes the same as one pass over DELETED. What is kept is
    collected run by run, which is several times faster in the JVM than
    looking for each single character to drop.
    """
    unlinked = F.regexp_replace(F.lower(text), f"{LINK}|{WEB_NAME}", "")
    letters = F.array_join(F.regexp_extract_all(unlinked, F.lit(r"[A-Za-z\n ]+"), 0), "")
    return F.trim(F.regexp_replace(letters, r"\n[\n ]*| [\n ]+", " "))


def drop_commas(text: Column) -> Column:
    return F.translate(text, ",", "")


def first_token(label: Column) -> Column:
    """First blank-separated token; null when there is none."""
    return F.nullif(F.regexp_extract(label, rf"[^{BLANKS}]+", 0), F.lit(""))


def display_text(text: Column) -> Column:
    """The shortened one-line form in which the replayer used to send texts.

    Line breaks and tabs become two-character escapes, long texts keep their
    head, null becomes ``NaN``. Only the compat mode of the replay uses it.
    """
    one_line = text
    for raw, escape in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        one_line = F.replace(one_line, F.lit(raw), F.lit(escape))
    head = F.concat(F.substring(one_line, 1, DISPLAY_KEPT), F.lit("..."))
    short = F.when(F.length(one_line) >= DISPLAY_WIDTH, head).otherwise(one_line)
    return F.coalesce(short, F.lit(DISPLAY_NULL))


# A blank, told so that the JVM tests a letter against one bit set and one range.
_BLANK = rf"[{NARROW_BLANKS}[\x{{1680}}-\x{{3000}}&&[{WIDE_BLANKS}]]]"
# Characters that always stand alone as a token.
_ALONE = r"""[;@#$%&?!*()\[\]{}<>"`«»“”‘’„]"""
# The first characters of anything that is spaced out; most letters fail here.
_MARK = r"""[-.,:;@#$%&?!*()\[\]{}<>"`«»\x{100}-\x{10ffff}]"""
# What may stand between a sentence's final period and the following blank.
_CLOSERS = r"""[\])}>"'»”’]*"""
# Where a word ends: no letter, digit or underscore beyond.
_ENDS = r"(?![\p{L}\p{N}_])"
# First parts of words that are written together, each before its second part.
_PARTS = [
    ("can", f"not{_ENDS}"),
    ("gon", f"na{_ENDS}"),
    ("got", f"ta{_ENDS}"),
    ("wan", f"na{_BLANK}"),
    ("gim", f"me{_ENDS}"),
    ("lem", f"me{_ENDS}"),
    ("d", f"'ye{_ENDS}"),
    ("more", f"'n{_ENDS}"),
]
# Letters are compared first; only then is it looked at what stands before the word.
_FUSED = "|".join(
    [
        *[rf"{first}(?={second})(?<![\p{{L}}\p{{N}}_]{first})" for first, second in _PARTS],
        rf"'t(?=(?:is|was){_ENDS})(?<={_BLANK}'t)",
    ]
)
_FUSED = f"(?=[cgwldm'])(?:{_FUSED})"


# A private-use character for the period of an abbreviation.
_KEPT = "\ue002"


def _spaced(text: Column) -> Column:
    """Lower case, with a blank at both ends, so that every chunk has one on each side."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def chunks_of(text: Column) -> Column:
    """What stands between blanks, lower case; empty at the ends of a text that has blanks there."""
    return F.split(F.lower(text), f"{_BLANK}+")


def ended_words(text: Column) -> Column:
    """The distinct chunks that a period ends, without it: what may be abbreviations there."""
    dotted = F.filter(chunks_of(text), lambda chunk: chunk.contains("."))
    words = F.transform(dotted, lambda chunk: F.regexp_extract(chunk, rf"\A(.*[^.])\.{_CLOSERS}\z", 1))
    return F.array_distinct(F.array_remove(words, ""))


def _with_kept_periods(text: Column, abbreviations: Column) -> Column:
    """The text with the private-use character for the final period of each of its abbreviations."""
    ended = rf"\.({_CLOSERS})\z"

    def marked(chunk: Column) -> Column:
        word = F.regexp_extract(chunk, rf"\A(.*[^.]){ended}", 1)
        return F.when(F.array_contains(abbreviations, word), F.regexp_replace(chunk, ended, f"{_KEPT}$1")).otherwise(chunk)

    chunks = F.array_join(F.transform(chunks_of(text), marked), " ")
    return F.when(F.size(abbreviations) > 0, chunks).otherwise(text)


def word_tokens(text: Column, abbreviations: Sequence[str] | Column = ()) -> Column:
    """Linguistic tokens of a text, lower case.

    Punctuation, brackets and quotes become tokens of their own; ``,`` and
    ``:`` do unless a digit follows; the period that ends a sentence does, one
    inside a chunk or after one of ``abbreviations`` does not. Clitics and the
    six fused verbs are split: "don't" gives "do", "n't", "gonna" gives "gon",
    "na". Three regex passes and one split, whatever the length of the text;
    each pattern starts with the rarest thing it can test.

    ``abbreviations`` may be a column with those of each text, as
    ``operators.abbreviations`` learns and attaches them.
    """
    if isinstance(abbreviations, Column):
        tokens = word_tokens(_with_kept_periods(text, abbreviations))
        return F.when(F.size(abbreviations) > 0, F.transform(tokens, lambda t: F.translate(t, _KEPT, "."))).otherwise(tokens)
    abbreviated = rf"(?<!{_BLANK}(?:{'|'.join(abbreviations)})\.)" if abbreviations else ""
    period = rf"\.(?<=[^.{BLANKS}]\.){abbreviated}(?={_CLOSERS}{_BLANK})"
    punctuation = rf"(?={_MARK})(?:{_ALONE}|[:,](?![0-9])|\.\.+|{period}|--)"
    stem = f"[^'{BLANKS}]"
    clitic = rf"[n'](?:(?<=n)'t(?<={stem}n't)|(?<=')(?<={stem}')(?:s|m|d|ll|re|ve)?)(?={_BLANK})"
    spaced = F.regexp_replace(_spaced(text), punctuation, " $0 ")
    spaced = F.regexp_replace(spaced, clitic, " $0")
    spaced = F.regexp_replace(spaced, _FUSED, "$0 ")
    return F.array_remove(F.split(spaced, f"{_BLANK}+"), "")


def is_alphabetic(word: Column) -> Column:
    return word.rlike(r"\A[a-zA-Z]+\z")


def alphabetic_tokens(tokens: Column) -> Column:
    return F.filter(tokens, is_alphabetic)


def without_words(tokens: Column, words: Sequence[str] = DASHBOARD_STOP_WORDS) -> Column:
    """Drop listed words, keeping order and repeats."""
    return F.filter(tokens, lambda token: ~token.isin(*words))


def lemma_forms(word: Column) -> Column:
    """A word and its possible noun stems."""
    stems = [
        F.when(word.endswith(ending), F.concat(F.left(word, F.length(word) - len(ending)), F.lit(stem)))
        for ending, stem in NOUN_ENDINGS
    ]
    return F.array_compact(F.array(word, *stems))


def has_noun_ending(word: Column) -> Column:
    return word.rlike(f"(?:{'|'.join(ending for ending, _ in NOUN_ENDINGS)})$")


def display_words(words: Column) -> Column:
    return F.array_join(words, " : ")
