"""Word lists, class names, suffix rules, character classes."""

# The English stop words of Spark's StopWordsRemover, in its order.
ML_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
    we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
    mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
    """.split()
)

# The public English stop-word list used by the dashboard word counts.
DASHBOARD_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom
    this that that'll these those am is are was were be been being have has had having do does did doing a an the
    and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn
    hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Class name of each index on the dashboard.
CLASS_NAMES = ("Negative", "Positive", "Neutral", "Irrelevant")

# Classes that get a top-words chart, lower case.
CHARTED_SENTIMENTS = ("positive", "negative", "neutral")

# Columns of the entity chart.
CHART_COLUMNS = ("Positive", "Neutral", "Negative")

# Noun endings and what replaces them.
NOUN_ENDINGS = (
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

# Characters that count as blank in cleaned text (Unicode white space).
NARROW_BLANKS = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x{85}\x{a0}"
WIDE_BLANKS = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = NARROW_BLANKS + WIDE_BLANKS
