import math
import random
import re

import pytest
from pyspark.sql import functions as F

from moodlark.llm import html_text, urls
from moodlark.llm.html_text import blocks_of, main_text
from moodlark.llm.queries import URL_RULES
from moodlark.llm.registry import QUERIES, ship

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def spark(spark):
    ship(spark)
    return spark


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://a.example.org/en/1?x=/es/", "a.example.org", "/en/1", "example.org/en/1", "block"),
        ("http://EXAMPLE.ORG/es/a#b", "example.org", "/es/a", "example.org/es/", "block"),
        ("http://notexample.org/es/a", "notexample.org", "/es/a", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://x.com/FR/", "x.com", "/FR/", None, "allow"),
        ("x://y.com/fr/://z.org/", "y.com", "/fr/://z.org/", "com/fr/", "allow"),
        ("http://É.com/de/ä?", "É.com", "/de/ä", "com/de/", "block"),
        ("//no.scheme/en/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("a\nb://h.org\n/x", "h.org\n", "/x", None, "allow"),
        ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None)], PAGES)
    found = urls.judge_urls(pages, URL_RULES).collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == [(host, path, rule, verdict)]


def test_longest_rule_wins_and_blocks_win_ties(spark):
    rules = [("allow", "com/a"), ("block", "com/b"), ("allow", "x.com/"), ("block", "x.com/a/long")]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(["h://x.com/a/longer", "h://x.com/a/lon", "h://y.com/b"])], PAGES)
    found = urls.judge_urls(pages, rules).orderBy("page_id").collect()
    assert [r["rule"] for r in found] == ["x.com/a/long", "x.com/", "com/b"]
    both = urls.judge_urls(pages, [("allow", "com/b"), ("block", "com/b")]).where("page_id = 2").first()
    assert both["verdict"] == "block"


def test_tree_generalises_merges_and_rejects(spark):
    rows = [f"http://h.net/spam/{i}/x.html" for i in range(40)] + [f"http://h.net/news/{i}.html" for i in range(60)]
    rows += [f"http://h.net/shop/{'abcdefgh'[i % 8] * 3}" for i in range(40)] + [f"http://other.net/{i}" for i in range(5)]
    # Labels for some of the urls: the first twenty of spam are blocked by name, of news allowed.
    rules = [("block", f"h.net/spam/{i}/") for i in range(20)] + [("allow", f"h.net/news/{i}.") for i in range(40)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], PAGES)
    found = urls.judge_urls(pages.union(pages), rules).collect()
    assert len(found) == 2 * len(rows)
    by = {r["url"]: r for r in found}
    assert by["http://h.net/spam/33/x.html"]["template"] == "/spam/#/x.html"
    assert by["http://h.net/spam/33/x.html"]["verdict"] == "block"
    assert by["http://h.net/news/55.html"]["template"] == "/news/#.@"
    assert by["http://h.net/news/55.html"]["verdict"] == "allow"
    assert by["http://h.net/shop/aaa"]["template"] == "/shop/aaa"
    shops = {by[u]["purity"] for u in rows if "/shop/" in u}
    assert len(shops) == 1
    assert by["http://other.net/3"]["verdict"] == "allow"


def tree_by_hand(paths):
    """The tree of one host, path by path: (path, n, good, bad) to (template, branch)."""
    out = {}
    state = [(p, (p[1:] if p[:1] == "/" else p).split("/"), n, g, b, "", "") for p, n, g, b in paths]
    while state:
        nodes = {}
        for row in state:
            nodes.setdefault(row[6], []).append(row)
        state = []
        for rows in nodes.values():
            total, lists = sum(r[2] for r in rows), [r[1] for r in rows]
            low, high = min(lists), max(lists)
            common = 0
            while common < min(len(low), len(high)) and low[common] == high[common]:
                common += 1
            ends = total < urls.MIN_SUPPORT or low == high
            cut = lambda left, ends=ends, common=common: len(left) if ends else min(max(common, 1), len(left))
            counts = {}
            for r in rows:
                counts.setdefault("/".join(r[1][: cut(r[1])]), []).append(r)
            part = {}
            for segment, own in counts.items():
                n = sum(r[2] for r in own)
                shape = re.sub(r"[^\W\d_]+", "@", re.sub(r"[0-9]+", "#", segment))
                part[segment] = segment if n >= urls.MIN_SUPPORT and n >= urls.MIN_SHARE * total else shape
            labels = {}
            for segment, own in counts.items():
                g, m = labels.get(part[segment], (0, 0))
                labels[part[segment]] = (g + sum(r[3] for r in own), m + sum(r[3] + r[4] for r in own))
            all_g, all_m = (sum(x[k] for x in labels.values()) for k in (0, 1))

            def differs(g, m, all_g=all_g, all_m=all_m):
                if not m or not all_m - m or all_g in (0, all_m):
                    return False
                p = all_g / all_m
                return abs(g / m - (all_g - g) / (all_m - m)) / math.sqrt(p * (1 - p) * (1 / m + 1 / (all_m - m))) > urls.DIFFERENT

            merged = [name for name, (g, m) in labels.items() if not differs(g, m)]
            for segment, own in counts.items():
                name = "*" if part[segment] in merged and len(merged) > 1 else part[segment]
                for p, left, n, g, b, template, branch in own:
                    row = (p, left[cut(left) :], n, g, b, f"{template}/{part[segment]}", f"{branch}/{name}")
                    if row[1]:
                        state.append(row)
                    else:
                        out[p] = row[5:]
    return out


def test_tree_against_one_made_by_hand(spark):
    draw = random.Random(3)
    words = ["news", "spam", "a1", "b22", "c", "", "x.html", "7", "88", "999"]
    paths = {}
    for _ in range(600):
        path = "/" + "/".join(draw.choice(words[: draw.choice([3, 10])]) for _ in range(draw.randrange(1, 9)))
        n = draw.choice([1, 1, 2, 7])
        label = draw.choice([0, 1, 2]) if "spam" not in path else draw.choice([0, 2, 2])
        paths[path] = (path, n, n * (label == 1), n * (label == 2))
    deep = "/" + "/".join(["same"] * 300)
    for end in ("one", "two"):
        paths[deep + "/" + end] = (deep + "/" + end, 9, 0, 0)
    paths |= {"": ("", 6, 1, 0), "/": ("/", 1, 0, 0), "no/slash": ("no/slash", 3, 0, 1)}
    rows = [("h", *row) for row in paths.values()] + [("i", "/spam", 1, 0, 1)]
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, n long, good long, bad long")).collect()
    assert {r["path"]: (r["template"], r["branch"]) for r in found if r["host"] == "h"} == tree_by_hand(list(paths.values()))
    assert len(found) == len(rows)


def test_deep_paths_are_told_apart(spark):
    rows = [f"http://h.net/2020/01/02/en/{kind}/{i:02d}" for kind in ("spam", "news") for i in range(40)]
    rules = [("block", f"h.net/2020/01/02/en/spam/{i:02d}") for i in range(20)] + [("allow", f"h.net/2020/01/02/en/news/{i:02d}") for i in range(20)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], PAGES)
    found = {r["url"]: r for r in urls.judge_urls(pages, rules).collect()}
    held_out = [u for u in rows if found[u]["rule"] is None]
    assert len(held_out) >= 30
    assert all(found[u]["verdict"] == ("block" if "/spam/" in u else "allow") for u in rows)


def test_merged_branches_share_what_lies_below(spark):
    # Languages do not differ; what lies below them is one tree, so few labels of each language tell spam.
    rows = [f"http://h.net/{lang}/{kind}/{i}" for lang in ("de", "en", "fr", "it") for kind in ("spam", "news") for i in range(10)]
    rules = [(v, f"h.net/{lang}/{kind}/{i}") for lang in ("de", "en", "fr", "it") for v, kind in (("block", "spam"), ("allow", "news")) for i in range(3)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], PAGES)
    found = urls.judge_urls(pages, rules).collect()
    wrong = [r["url"] for r in found if r["verdict"] != ("block" if "/spam/" in r["url"] else "allow")]
    assert wrong == []
    assert len({r["purity"] for r in found if "/spam/" in r["url"]}) == 1


def test_very_long_urls(spark):
    rows = ["http://h.org/" + "a/" * 5000, "http://h.org/" + "x" * 200_000, "http://h.org/" + "a/" * 4999 + "b"] * 4
    found = urls.judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], PAGES), URL_RULES).collect()
    assert len(found) == 12 and {r["verdict"] for r in found} == {"allow"}


def test_query_judges_every_page(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["url"] or "" for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    found = QUERIES["op6_url_filter"](spark, folder).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    for r in found:
        parts = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r["page_id"]])
        host = re.sub("[A-Z]", lambda c: c[0].lower(), parts[1]) if parts else ""
        path = parts[2] if parts else ""
        fits = [(len(rule), v, rule) for v, rule in URL_RULES for name, _, start in [rule.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"] if fits else None) == ((max(fits)[2], max(fits)[1]) if fits else (None, None))


def test_urls_keep_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h")], PAGES).withColumns({"n": F.lit(1), "Host": F.lit("old"), "ruled": F.lit(2)})
    found = urls.judge_urls(pages, URL_RULES)
    assert found.columns == ["page_id", "url", "html", "n", "ruled", "host", "path", "rule", "template", "purity", "verdict"]
    assert found.first()["host"] == "a.org"
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0


ARTICLE = "<article><h1>Title&amp;</h1><p>One <b>bold<br>two&nbsp;\n three<p>&lt;next&gt; p<script>x</p></script><div class='ad'>buy</div></p></article>"


@pytest.mark.parametrize(
    "html,text",
    [
        (ARTICLE, "Title& One bold two three <next> p"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>menu</ul></nav>{ARTICLE}<footer>&copy; f</footer>", "Title& One bold two three <next> p"),
        ("<main>a<aside>side</aside>b<form>f<input>g</form><section class='comments'><p>c</section><p>d</main> tail", "a b d"),
        ("<article><div id=cookie-notice>n<div>m</div></div>in<b>li</b>ne<header>h</header></article>", "inline"),
        ("<article><p>a</b></i></div>b</article>c", "ab"),
        ("<article>un<p>closed <i>x", "un closed x"),
        ("<article>a</article><p>x</p><article>b</article>", "a b"),
        ("<article><!-- no --><p hidden>h</p><p style='display: none'>s</p><p class='loading'>l</p><p class='share-links'>q</p></article>", "l"),
        ("<article><pre> a\n\n b </pre>&#x41;&eacute;&zzz;&not;&#128512;</article>", "a b Aé&zzz;¬😀"),
        ("plain text < 3 & more", "plain text < 3 & more"),
        ("", ""),
        (None, ""),
        ("<nav>only</nav>", ""),
    ],
)
def test_main_text(spark, html, text):
    found = main_text(spark.createDataFrame([(1, "http://h/", html)], PAGES)).collect()
    assert [(r["text"], r["n_chars"]) for r in found] == [(text, len(text))]


def test_unclosed_parts_end_with_their_parents():
    assert blocks_of("<body><div class=sidebar><p>s<div>t</div></div><article>a<nav><ul><li>m</nav>b</article>") == [(2, "s"), (2, "t"), (0, "a"), (2, "m"), (0, "b")]


def covered_by_brute_force(streams, run):
    """Words of each stream that no run shared with another stream covers."""
    grams = [{tuple(s[i : i + run]) for i in range(len(s) - run + 1)} for s in streams]
    left = []
    for k, stream in enumerate(streams):
        others = set().union(*(g for j, g in enumerate(grams) if j != k))
        covered = {i + d for i in range(len(stream) - run + 1) if tuple(stream[i : i + run]) in others for d in range(run)}
        left.append(" ".join(w for i, w in enumerate(stream) if i not in covered))
    return left


def test_repeated_runs_of_a_host_go(spark):
    legal = "all rights reserved by the owner of this site whatever it may be"
    teaser = "read this great story about things that never happened to anyone"
    bodies = [f"<div>{legal}</div><p>{' '.join(f'w{i}x{j}' for j in range(30))}</p><div>{teaser if i % 2 else 'short end'}</div>" for i in range(6)]
    rows = [(i, f"http://site{i // 4}.org/{i}", b) for i, b in enumerate(bodies)] + [(9, "http://alone.org/", bodies[0]), (10, None, bodies[1])]
    rows.append((11, "http://site1.org/x", f"<article>{legal}</article>"))
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[11] == legal
    streams = {i: " ".join(t for _, t in blocks_of(b)).split() for i, _, b in rows}
    for host in ([0, 1, 2, 3], [4, 5], [9], [10]):
        expected = covered_by_brute_force([streams[i] for i in host], html_text.RUN_WORDS)
        assert [found[i] for i in host] == expected
    assert "rights" not in found[0] and "rights" in found[9] and "short end" in found[0]


def test_pages_keep_columns_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://h/", ARTICLE)] * 2, PAGES).withColumns({"content": F.lit("c"), "row": F.lit("r"), "Text": F.lit("old")})
    found = main_text(pages)
    assert found.columns == ["page_id", "url", "content", "row", "text", "n_chars"]
    assert found.count() == 2 and found.first()["row"] == "r"
    assert main_text(pages.limit(0)).count() == 0


def test_copies_and_quoted_passages_stay(spark):
    quote = "it was the best of times and it was the worst of times they say"
    legal = "all rights reserved by the owner of this site whatever it may be"
    own = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(6)]
    bodies = [f"<p>{text} {quote if i < 2 else ''} end{i}</p><div>{legal} page {i}</div>" for i, text in enumerate(own)]
    rows = [(i, f"http://a.org/{i}", b) for i, b in enumerate(bodies)]
    # Copies, under one url and two; and a host of two pages that quote the same.
    rows += [(10 + i, f"http://a.org/{i % 2}", bodies[0]) for i in range(4)]
    rows += [(20 + i, f"http://b.org/{i}", bodies[0]) for i in range(3)]
    rows += [(30 + i, "http://c.org/", f"<p>{own[i]} {quote} end{i}</p>") for i in range(2)]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(6):
        assert found[i] == " ".join(f"{own[i]} {quote if i < 2 else ''} end{i}".split()) + " " + f"{i}", i
    assert {found[10 + i] for i in range(4)} == {found[0]}
    assert {found[20 + i] for i in range(3)} == {f"{own[0]} {quote} end0 {legal} page 0"}
    assert [found[30 + i] for i in range(2)] == [f"{own[i]} {quote} end{i}" for i in range(2)]


def test_a_body_beside_a_teaser_article_stays(spark):
    legal = "all rights reserved by the owner of this site whatever it may be"
    body = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(3)]
    rows = [(i, f"http://a.org/{i}", f"<article>teaser {i}</article><div>{b}</div><div>{legal}</div><main>last</main>menu") for i, b in enumerate(body)]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {i: f"teaser {i} {b} last" for i, b in enumerate(body)}


def test_headings_and_short_paragraphs_of_a_body_stay(spark):
    body = "<h2>Short heading</h2><p>" + " ".join(f"w{j}" for j in range(20)) + "</p><p>seven words are not enough for runs</p>"
    page = f"<article>teaser</article><div>{body}</div><nav>menu</nav><p>lost alone</p>"
    found = main_text(spark.createDataFrame([(1, "http://a.org/", page)], PAGES)).first()["text"]
    assert found == "teaser Short heading " + " ".join(f"w{j}" for j in range(20)) + " seven words are not enough for runs"


def test_two_pages_of_a_host_keep_what_they_share(spark):
    shared = "one block of twelve words that both pages of this host have"
    rows = [(i, f"http://a.org/{i}", f"<p>{shared}</p><p>own{i} text</p>") for i in range(2)]
    rows += [(10 + i, f"http://b.org/{i}", f"<p>{shared}</p><p>own{i} text</p>") for i in range(3)]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {0: f"{shared} own0 text", 1: f"{shared} own1 text", 10: "own0 text", 11: "own1 text", 12: "own2 text"}


def test_very_long_html(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    rows = [(0, "http://a.org/", f"<div><p>{words}</p></div>"), (1, "http://a.org/x", "<div>" * 3000 + f"<article>{words}</article>"), (2, None, None)]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {0: words, 1: words, 2: ""}
