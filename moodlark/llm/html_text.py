"""Main text of web pages: structure first, repeated passages of the host where it is silent.

Markup that says what it is (menus, footers, adverts, forms, an article) is
believed. Text it says nothing about is judged as one of the token streams of
its host: the suffixes of all streams are brought together by their first
words, which sorts the host's suffix array to that depth, and a run of words
that distinct pages share is boilerplate. Only the runs that are left are kept.
"""

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlark.llm.tokens import as_bytes
from moodlark.llm.urls import host_of
from moodlark.workspace import written

# Words from which a repeated run may be boilerplate.
RUN_WORDS = 8
# Pages of different content that must share it, at least: of whole blocks, two that are a quarter of the
# host's; inside of blocks, three that are more than half of them. A host with fewer pages than the last shares nothing.
RUN_PAGES, RUN_SHARE = 2, 0.25
INNER_PAGES, INNER_SHARE = 3, 0.5
HOST_PAGES = 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
# Elements whose text is never part of an article, whatever is inside.
_ASIDE = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe math menu nav noembed noframes noscript "
    "object script select style svg template textarea title video".split()
)
_CONTENT = frozenset(["article", "main"])
_CLOSED_BY_BLOCK = "p"
_ROLES = frozenset("banner navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Names, in class or id, of what surrounds an article; a name may have a number or these words at its end.
_NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs "
    "comment comments commentlist disqus consent cookie cookies gdpr footer header masthead menu menus nav navbar navigation "
    "newsletter notice notices notification overlay popup modal promo promotion promoted recommended related "
    "reply replies respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription "
    "tracking widget widgets toolbar topbar".split()
)
_TAILS = frozenset("area bar block box container content form link links list section top bottom left right wrap wrapper message".split())
_HEADS = frozenset("site page main global user reader post blog top bottom left right cookie social".split())


def _named(value: str) -> bool:
    """Whether a class or id is made of such a name, alone or with words that only say where it stands."""
    for name in value.lower().split():
        parts = [p.rstrip("0123456789") for p in name.replace("_", "-").split("-")]
        parts = [p for p in parts if p]
        core = [p for p in parts if p not in _TAILS and p not in _HEADS] or parts
        if core and all(p in _NAMES for p in core):
            return True
    return False


class _Page(HTMLParser):
    """Blocks of text with the part of the page they stand in."""

    CONTENT, UNSURE, CHROME = 0, 1, 2

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements: name, and whether it began a part that is no article, or an article.
        self.open: list[tuple[str, bool, bool]] = []
        self.aside = self.content = 0
        self.blocks: list[tuple[int, str]] = []
        self.pieces: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            part = self.CHROME if self.aside else self.CONTENT if self.content else self.UNSURE
            self.blocks.append((part, text))

    def _pop(self, n: int) -> None:
        while len(self.open) > n:
            _, aside, content = self.open.pop()
            if aside or content:
                self.flush()
            self.aside -= aside
            self.content -= content

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
            if tag != "br" and self.open:
                # An open paragraph ends where another block begins.
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == _CLOSED_BY_BLOCK:
                        self._pop(i)
                        break
                    if self.open[i][0] in _BLOCK:
                        break
        if tag in _VOID:
            return
        given = {k: v or "" for k, v in attrs}
        aside = (
            tag in _ASIDE
            or given.get("role", "").lower() in _ROLES
            or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true"
            or "display:none" in given.get("style", "").replace(" ", "").lower()
            or (tag not in ("html", "body", "article", "main") and (_named(given.get("class", "")) or _named(given.get("id", ""))))
        )
        content = not aside and tag in _CONTENT
        if aside or content:
            self.flush()
        self.open.append((tag, aside, content))
        self.aside += aside
        self.content += content

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "br"):
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in _BLOCK:
                    self.flush()
                self._pop(i)
                break
            # A stray end of an inline element closes no block.
            if tag not in _BLOCK and self.open[i][0] in _BLOCK:
                break

    def handle_data(self, data: str) -> None:
        if not self.aside or self.open[-1][0] not in ("script", "style"):
            self.pieces.append(data)

    def finish(self) -> list[tuple[int, str]]:
        self.close()
        self.flush()
        return self.blocks


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(part, text) of each block, in page order."""
    page = _Page()
    page.feed(html)
    return page.finish()


def heads_of(words: list[str], run: int = RUN_WORDS) -> list[int]:
    """Hash of the first ``run`` words of each suffix that has so many."""
    joined = [" ".join(words[i : i + run]) for i in range(len(words) - run + 1)]
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in joined], dtype=np.uint64)
    return hashes.view(np.int64).tolist()


def _covered(starts: list[int], run: int, words: int) -> np.ndarray:
    """How many of the runs that begin at ``starts`` cover each word."""
    covered = np.zeros(words + run + 1, dtype=np.int64)
    for at in starts:
        covered[at] += 1
        covered[at + run] -= 1
    return np.cumsum(covered)


def _uncovered(blocks: list[str], sure: list[bool], shared: list[int], most: list[int], run: int) -> str:
    """The words of ``blocks`` less blocks that the runs at ``shared`` cover whole, and what those at ``most`` cover.

    Blocks that are ``sure`` stay; they are not part of the stream of words in which the runs stand.
    """
    words = [block.split() for block in blocks]
    total = sum(len(block) for block, stays in zip(words, sure, strict=True) if not stays)
    whole, inner = _covered(shared, run, total), _covered(most, run, total)
    kept, at = [], 0
    for block, stays in zip(words, sure, strict=True):
        if stays:
            kept += block
            continue
        if not whole[at : at + len(block)].all():
            kept += [word for i, word in enumerate(block, at) if not inner[i]]
        at += len(block)
    return " ".join(kept)


def _judged(blocks: list[tuple[int, str]], run: int) -> list[bool]:
    """Which blocks beside an article are judged: plain ones, if they or others around them have a run.

    Plain blocks that stand together are one body: its headings and short
    paragraphs go with it. Where all are short, no run can tell, and they are not
    part of the article.
    """
    found: list[bool] = []
    for part, together in groupby(blocks, key=lambda b: b[0]):
        body = list(together)
        found += [part == _Page.UNSURE and any(len(text.split()) >= run for _, text in body)] * len(body)
    return found


def _parse(html: str, run: int) -> tuple[str, list[str], list[bool], list[int], int]:
    blocks = blocks_of(html)
    content = [text for part, text in blocks if part == _Page.CONTENT]
    unsure = _judged(blocks, run) if content else [part == _Page.UNSURE for part, _ in blocks]
    judged = [text for (_, text), open_ in zip(blocks, unsure, strict=True) if open_]
    rest = [text for (part, text), open_ in zip(blocks, unsure, strict=True) if not open_ and part != _Page.CONTENT]
    texts = [(text, not open_) for (part, text), open_ in zip(blocks, unsure, strict=True) if open_ or part == _Page.CONTENT] if judged else []
    # Streams of unsure blocks come first, so that a suffix's place is its place in them.
    stream = [word for text in judged + rest for word in text.split()]
    # Copies of a page, under whatever url, have one content.
    same = xxhash.xxh64_intdigest("\n".join(f"{part} {text}" for part, text in blocks))
    return " ".join(content), [t for t, _ in texts], [sure for _, sure in texts], heads_of(stream, run), same - (same >> 63 << 64)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", run_words: int = RUN_WORDS) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (code points).

    The text of a page is its article: blocks in page order, white space made
    one space, joined by one space, character references decoded. Plain blocks
    beside it stay as well, less what the host repeats, where a body of them has a
    block of at least ``run_words`` words. Without an
    ``article`` or ``main`` element it is all plain text outside of menus,
    headers, footers, sidebars, notices, adverts, forms and comments, less what
    the host repeats in runs of at least ``run_words`` words: whole blocks that
    are on two pages or more and a quarter of the host's, and runs inside of
    blocks that are on three pages or more and over half of the host's. Pages
    count once for each different content, so copies of a page share nothing
    with each other, and a passage that few articles quote stays. Two pages
    cannot tell boilerplate from a passage, so a host of two keeps both. On a
    host of three to eight pages a block that two of them have whole is taken
    for boilerplate. Nothing else is left out. A null html is empty and gives an
    empty text; a page without a host shares that of all such pages. Columns
    ``text`` and ``n_chars`` are replaced.

    Articles are not moved. What is moved are hashes of word runs outside of
    them, added up by host and run before the exchange.
    """
    kept = F.struct(*[c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")])
    read = pages.select(kept.alias("whole"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    texts = [("content", pa.string()), ("unsure", pa.list_(pa.string())), ("sure", pa.list_(pa.bool_())), ("heads", pa.list_(pa.int64())), ("same", pa.int64())]
    schema = T.StructType([*read.schema.fields[:2]])
    schema = schema.add("content", T.StringType()).add("unsure", T.ArrayType(T.StringType())).add("sure", T.ArrayType(T.BooleanType())).add("heads", T.ArrayType(T.LongType())).add("same", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [_parse(t.decode(), run_words) for t in as_bytes(batch.column(2))]
            made = [pa.array([p[i] for p in parsed], kind) for i, (_, kind) in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["whole", "host", *(n for n, _ in texts)])

    numbered = read.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    parsed = written(numbered, "pages")
    # Contents are counted, not pages: copies of a page count once.
    hosts = parsed.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("of"))
    suffixes = parsed.select("host", "same", F.explode("heads").alias("head"))
    counted = suffixes.distinct().groupBy("host", "head").agg(F.count("*").alias("pages")).where(F.col("pages") >= RUN_PAGES)
    inner = (F.col("pages") >= INNER_PAGES) & (F.col("pages") > F.col("of") * INNER_SHARE)
    shared = counted.join(hosts.where(F.col("of") >= HOST_PAGES), "host").where(F.col("pages") >= F.col("of") * RUN_SHARE)
    shared = written(shared.select("host", "head", inner.alias("inner")), "page-runs")
    unsure = parsed.where(F.size("unsure") > 0)
    starts = (
        unsure.select("host", "row", F.posexplode("heads").alias("at", "head"))
        .join(shared, ["host", "head"])
        .groupBy("row")
        .agg(F.collect_list("at").alias("repeated"), F.collect_list(F.when(F.col("inner"), F.col("at"))).alias("most"))
    )
    out = pa.schema([("row", pa.int64()), ("left", pa.string())])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), []
            for blocks, sure, *runs in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = sum(len(x.split()) for x, stays in zip(blocks, sure, strict=True) if not stays)
                texts.append(_uncovered(blocks, sure, *([at for at in r or [] if at < words] for r in runs), run_words))
            yield pa.record_batch([rows, texts], schema=out)

    judged = unsure.join(starts, "row", "left").select("row", "unsure", "sure", "repeated", "most").mapInArrow(left, "row long, left string")
    plain = parsed.where(F.size("unsure") == 0).select("whole", F.col("content").alias("main"))
    settled = unsure.select("whole", "row").join(judged, "row").select("whole", F.col("left").alias("main"))
    found = plain.union(settled)
    return found.select("whole.*", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
