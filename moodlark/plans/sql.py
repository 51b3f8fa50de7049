"""SQL fragments that the comparison queries share."""

from collections.abc import Iterable

from moodlark.functions.lexicon import CLASS_NAMES, ML_STOP_WORDS

# Fixed values, written here once more: what cleaning deletes, and the blanks of its patterns.
BLANKS = r" \t\n\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DELETED = rf"[^A-Za-z\n ]|http[^{BLANKS}]+|www[^\n][^{BLANKS}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: Iterable[str]) -> str:
    return ", ".join(quoted(word) for word in words)


POSTS = """posts AS (
  SELECT d.doc_id AS id, d.source, d.text AS tweet,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Positive'
              WHEN l.quality = 0 AND l.toxic = 0 THEN 'Neutral'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'Negative'
              ELSE 'Irrelevant' END AS target
  FROM documents d JOIN labels l USING (doc_id))"""

_INDEX = " ".join(f"WHEN '{name}' THEN {index}" for index, name in enumerate(CLASS_NAMES))
PREDICTIONS = f"""labelled AS (
  SELECT *, CASE target {_INDEX} END AS k FROM posts),
predictions AS (
  SELECT id, tweet, target, k::DOUBLE AS label, ((k + (id % 5) % 2) % 4)::DOUBLE AS prediction,
         id // 50 AS batch_id, id AS seq
  FROM labelled)"""


# Metrics of the predictions: scores(f1, accuracy).
F1 = """classes AS (SELECT DISTINCT label AS class FROM predictions),
per_class AS (
  SELECT class, count(*) FILTER (WHERE label = class) AS actual,
         count(*) FILTER (WHERE prediction = class) AS predicted,
         count(*) FILTER (WHERE label = class AND prediction = class) AS hit
  FROM classes CROSS JOIN predictions GROUP BY class),
scores AS (
  SELECT sum(2.0::DOUBLE * hit / (actual + predicted) * actual) / sum(actual) AS f1,
         sum(hit) / sum(actual) AS accuracy
  FROM per_class)"""


def cleaned(column: str) -> str:
    kept = f"regexp_replace(lower({column}), {quoted(DELETED)}, '', 'g')"
    return f"trim(regexp_replace({kept}, '[\\n ]+', ' ', 'g'))"


# Blanks that the model's tokenizer splits on.
_SPACE = r"[ \t\n\x0b\f\r]"


def ml_tokens(column: str) -> str:
    text = f"lower({column})"
    ended = f"regexp_replace({text}, '{_SPACE}+$', '')"
    return (
        f"CASE WHEN regexp_full_match({text}, '{_SPACE}+') THEN []::VARCHAR[] "
        f"ELSE regexp_split_to_array({ended}, '{_SPACE}') END"
    )


def without_ml_stop_words(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: w NOT IN ({listed(ML_STOP_WORDS)}))"


def bigrams(tokens: str) -> str:
    return (
        f"CASE WHEN len({tokens}) < 2 THEN []::VARCHAR[] ELSE "
        f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]) END"
    )


def tokens_cte(source: str = "posts") -> str:
    """tokens(id, target, tk), filtered(id, words), pairs(id, ngrams)."""
    return f"""tokens AS (SELECT id, {ml_tokens("tweet")} AS tk FROM {source}),
filtered AS (SELECT id, {without_ml_stop_words("tk")} AS words FROM tokens),
pairs AS (SELECT id, {bigrams("words")} AS ngrams FROM filtered)"""


_ALONE = r"""[;@#$%&?!*()\[\]{}<>"«»“”‘’„`]"""
_CLOSERS = r"""[\])}>"'»”’]*"""
# Private-use characters that stand for a comma and a colon before a digit.
_COMMA, _COLON = "chr(57344)", "chr(57345)"


_EDGE = r"[^\pL\pN_]"
_FUSED = [
    *[(first, second, _EDGE, _EDGE) for first, second in (
        ("can", "not"), ("gon", "na"), ("got", "ta"), ("gim", "me"), ("lem", "me"), ("d", "'ye"), ("more", "'n"),
    )],
    ("wan", "na", _EDGE, f"[{BLANKS}]"),
    ("'t", "is", f"[{BLANKS}]", _EDGE),
    ("'t", "was", f"[{BLANKS}]", _EDGE),
]


_OPENED, _CLOSED = r"""^[\[({<"'«“‘`]+""", r"""[\])}>"'»”’,;:!?]+$"""
# A private-use character that stands for the period of an abbreviation.
_KEPT = "chr(57346)"


def abbreviation_scores(texts: str, column: str) -> str:
    """counts(word, with_period, without_period) and scores(..., log_likelihood, score) of the texts' words."""
    core = f"regexp_replace(regexp_replace(chunk, {quoted(_OPENED)}, ''), {quoted(_CLOSED)}, '')"
    ends = r"regexp_matches(core, '[^.]\.$')"
    return f"""cores AS (
  SELECT {core} AS core FROM (SELECT unnest(regexp_split_to_array(lower({column}), '[{BLANKS}]+')) AS chunk FROM {texts})),
counts AS (
  SELECT CASE WHEN {ends} THEN left(core, length(core) - 1) ELSE core END AS word,
         count(*) FILTER (WHERE {ends}) AS with_period, count(*) FILTER (WHERE NOT {ends}) AS without_period
  FROM cores WHERE core <> '' GROUP BY 1),
share AS (SELECT sum(with_period) / sum(with_period + without_period) AS p FROM counts),
candidates AS (
  SELECT counts.*, p, length(replace(word, '.', '')) AS plain FROM counts CROSS JOIN share
  WHERE with_period > 0 AND regexp_matches(word, '\\pL')),
likely AS (
  SELECT *, -2 * (with_period * ln(p) + CASE WHEN without_period > 0 THEN without_period * ln(1 - p) ELSE 0 END
    - with_period * ln(0.99::DOUBLE) - CASE WHEN without_period > 0 THEN without_period * ln(1 - 0.99::DOUBLE) ELSE 0 END)
    AS log_likelihood FROM candidates),
scores AS (
  SELECT *, log_likelihood * exp(-plain::DOUBLE) * (length(word) - plain + 1) * pow(plain::DOUBLE, -without_period) AS score
  FROM likely)"""


def with_kept_periods(column: str, words: str) -> str:
    """The text, whose chunks that a period ends keep it as another character if the list ``words`` has them."""
    ended = rf"\.({_CLOSERS})$"
    word = f"regexp_extract(c, {quoted('^(.*[^.])' + ended)}, 1)"
    marked = f"CASE WHEN list_contains({words}, {word}) THEN regexp_replace(c, {quoted(ended)}, {_KEPT} || '\\1') ELSE c END"
    return f"array_to_string(list_transform(regexp_split_to_array(lower({column}), '[{BLANKS}]+'), lambda c: {marked}), ' ')"


def word_tokens(column: str) -> str:
    """Linguistic tokens without look-around: protect, space out, restore, split."""
    text = f"' ' || lower({column}) || ' '"
    text = f"regexp_replace({text}, ',([0-9])', {_COMMA} || '\\1', 'g')"
    text = f"regexp_replace({text}, ':([0-9])', {_COLON} || '\\1', 'g')"
    period = rf"([^.{BLANKS}])\.({_CLOSERS})([{BLANKS}])"
    text = f"regexp_replace({text}, {quoted(period)}, '\\1 . \\2\\3', 'g')"
    punctuation = rf"(--|\.\.+|[:,]|{_ALONE})"
    text = f"regexp_replace({text}, {quoted(punctuation)}, ' \\1 ', 'g')"
    text = f"replace(replace({text}, {_COMMA}, ','), {_COLON}, ':')"
    clitic = rf"([^'{BLANKS}])('s|'m|'d|'ll|'re|'ve|'|n't)([{BLANKS}])"
    text = f"regexp_replace({text}, {quoted(clitic)}, '\\1 \\2\\3', 'g')"
    # Twice, since two neighbours share the character between them.
    for first, second, before, after in _FUSED * 2:
        fused = rf"({before})({first})({second})({after})"
        text = f"regexp_replace({text}, {quoted(fused)}, '\\1\\2 \\3\\4', 'g')"
    return f"list_filter(regexp_split_to_array(replace({text}, {_KEPT}, '.'), '[{BLANKS}]+'), lambda w: w <> '')"


def lemma_cte(words: str) -> str:
    """lemmas(word, lemma) for the distinct values of ``word`` in a CTE."""
    rules = " UNION ALL ".join(
        f"SELECT word, left(word, length(word) - {len(ending)}) || '{stem}' AS form "
        f"FROM known WHERE word LIKE '%{ending}'"
        for ending, stem in (
            ("s", ""),
            ("ses", "s"),
            ("ves", "f"),
            ("xes", "x"),
            ("zes", "z"),
            ("ches", "ch"),
            ("shes", "sh"),
            ("men", "man"),
            ("ies", "y"),
        )
    )
    return f"""known AS (SELECT DISTINCT word FROM {words}),
forms AS (SELECT word, word AS form FROM known UNION ALL {rules}),
lemmas AS (
  SELECT word, form AS lemma FROM forms WHERE form IN (SELECT word FROM known)
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(form), form <> word, form) = 1)"""
