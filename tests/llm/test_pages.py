"""URL verdicts and main text of pages."""

import collections
import itertools
import math

import numpy as np
import pytest

from opinara.llm.html_blocks import blocks_of, features
from opinara.llm.html_text import MAIN, Field, Settings, extract_text, fit, labelled_sequences, own_labels, render, train, training_rows
from opinara.llm.url_filter import Settings as UrlSettings
from opinara.llm.url_filter import judge_urls, url_tokens

URLS = [
    ("http://a.ORG/x?y#z", "a.org", "/x", "org/", "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://xorg/", "xorg", "/", None, "allow"),
    ("https://sub.example.org/es/1", "sub.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/ES/1", "example.org", "/ES/1", "org/", "allow"),
    ("https://example.org/en/19", "example.org", "/en/19", "example.org/en/1", "block"),
    ("https://example.org?/en/1", "example.org", "", None, "allow"),
    ("ftp://u.com/fr/é", "u.com", "/fr/é", "com/fr/", "allow"),
    ("ftp://É.com/de/#", "É.com", "/de/", "com/de/", "block"),
    ("x://y://z/w", "y:", "//z/w", None, "allow"),
    ("no scheme.org/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "url string, bad boolean")


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "x", "y") for i, (u, *_) in enumerate(URLS)]
    pages = spark.createDataFrame(rows + rows[:2], "page_id long, url string, tokens string, confidence string")
    got = [tuple(r)[:5] for r in judge_urls(pages, labelled(spark, [])).collect()]
    want = [(i, *rest) for i, (_, *rest) in enumerate(URLS)]
    assert sorted(got, key=str) == sorted(want + want[:2], key=str)
    assert judge_urls(pages.limit(0), labelled(spark, [("http://a.b/", True), (None, None)])).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(3)
    known = []
    for i in range(400):
        host = ["good", "bad", "odd"][int(rng.integers(3))]
        part = ["news", "pills"][int(rng.integers(2))]
        risk = {("bad", "pills"): 0.9, ("odd", "pills"): 0.6}.get((host, part), 0.1)
        known.append((f"http://{host}.net/{part}/{i}?id={i}", bool(rng.random() < risk)))
    known.append((None, True))
    s = UrlSettings(support=0.02, least_rows=5, confidence=0.55, longest=3)
    frame = labelled(spark, known)
    tokens = {r.url: r.t for r in frame.select("url", url_tokens(frame["url"]).alias("t")).collect()}
    counts, bad = collections.Counter(), collections.Counter()
    for url, y in known:
        for n in (1, 2, 3):
            for c in itertools.combinations(tokens[url], n):
                counts[c] += 1
                bad[c] += y
    least = max(s.least_rows, math.ceil(s.support * len(known)))
    rules = {c: bad[c] / counts[c] for c in counts if bad[c] >= least and bad[c] / counts[c] >= s.confidence}
    assert rules
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(known)], "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, labelled(spark, known), (), s).collect()}
    for i, (url, _) in enumerate(known):
        want = max((v for c, v in rules.items() if set(c) <= set(tokens[url])), default=None)
        assert got[i].confidence == want and got[i].verdict == ("allow" if want is None else "block")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


# ---- pages ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>a</p><svg><path></p><p>rest</p></article>", ["a", "rest"]),
        ("<p>a<svg><path><p>b<p>c <svg><title>x</title></svg>d", ["a", "b", "c d"]),
        ("<p>a<svg><foreignObject><div>x</div></foreignObject></svg>b", ["ab"]),
        ("<p>a<svg><g>x</g></svg> <select><option>x</select>b<canvas>x</canvas>", ["a b"]),
        ("<p>a <select><b>b</b><p>c", ["a b", "c"]),
        ("<p>a <canvas>b<p>c <template>d<p>e<title>f", ["a b", "c d", "ef"]),
        ("<p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> <object>b</object> c", ["a x+1 b c"]),
        ("<title>x</title><p>a<iframe>x</iframe><noscript>x</noscript>", ["a"]),
        ("<p>a<svg/>b<p>c<script>x<p>y", ["ab", "c"]),
        ("<p>a<style>x<p>y", ["a"]),
        ("<p>A &<b>lt;</b> B &l<!-- -->t; &lt;i&gt; &amp;amp;&nbsp;C", ["A &lt; B &lt; <i> &amp; C"]),
    ],
)
def test_no_text_is_lost_to_open_elements(page, want):
    assert [b.text for b in blocks_of(page)] == want


def test_many_open_elements_take_one_look():
    page = "<p>" + "<svg>a <select>" * 20_000
    assert [b.text for b in blocks_of(page)] == [" ".join("a" * 20_000)]


def test_blocks_of_broken_markup():
    texts = lambda h: [b.text for b in blocks_of(h)]
    assert texts(None) == texts("") == texts("<!-- only <p>this</p> --><style>p{}</style>") == []
    assert texts("<p>a<b>b</b> c<br>d<p>e &amp; f&nbsp;g") == ["ab c d", "e & f g"]
    assert texts('<script>var t="</p>";</script>x<!-- y') == ["x"]
    assert texts("1 < 2 <p title='a>b'>ok</p> <") == ["1 < 2", "ok", "<"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts('<p class="x>never closed') == ["never closed"] or texts('<p class="x>never closed') == []
    assert texts("<div>" * 5000 + "deep") == ["deep"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]


def page(rng, n):
    words = lambda k: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(k))
    body = "".join(f"<p>{words(30)}.</p>" for _ in range(n))
    return f"<html><body><nav><a href=x>{words(2)}</a></nav><article><h1>{words(5)}</h1>{body}</article><footer>{words(4)}</footer></body></html>"


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(1)
    rows = [x for i in range(60) for x in labelled_sequences(page(rng, i % 5 + 1), i, Settings())]
    return train(rows, Settings())


def test_other_layouts_are_read(trained):
    rng = np.random.default_rng(99)
    right = total = 0
    for i in range(60):
        blocks = blocks_of(page(rng, i % 6 + 1))
        labels = own_labels(blocks)
        texts = lambda y: [b.text for b, l in zip(blocks, labels) if l == y]
        drawn = blocks_of(render(texts(1), texts(0), rng))
        found = trained.decode(features(drawn))
        right += sum(a == bool(b.gold) for a, b in zip(found, drawn))
        total += len(drawn)
    assert right >= 0.97 * total


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = Field({str(i): i for i in range(6)}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
    for _ in range(50):
        blocks = [[str(rng.integers(6)), str(rng.integers(6))] for _ in range(int(rng.integers(1, 7)))]
        e = field.emissions(blocks)
        score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert math.isclose(score(field.decode(blocks)), score(best))
    assert field.decode([]) == []


def test_extraction(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"u{i}", page(rng, i % 4 + 1)) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (None, "u", rows[0][2]), (3, "u3", rows[3][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in extract_text(pages, Settings(pages=30)).collect()}
    for key, url, source in rows:
        blocks = blocks_of(source)
        labels = own_labels(blocks) if blocks else []
        want = " ".join(b.text for b, y in zip(blocks, labels) if y == MAIN)
        assert (got[key, url].text, got[key, url].n_chars) == (want, len(want))
    assert extract_text(pages).count() == len(rows)
    assert extract_text(pages.limit(0)).count() == 0
    assert fit(pages.where("html IS NULL").select("html"), Settings()) is None


def test_copies_and_unlabelled_pages_do_not_thin_the_sample(spark):
    rng = np.random.default_rng(6)
    distinct = [page(rng, i % 4 + 1) for i in range(30)]
    # marked pages that have no labels of their own
    bare = [f"<main>only {i}</main>" for i in range(300)]
    rows = [(h,) for h in distinct * 100 + bare]
    sampled = training_rows(spark.createDataFrame(rows, "html string"), Settings(pages=10, layouts=0))
    assert sampled.select("sequence").distinct().count() == 10
    copies = spark.createDataFrame([(h,) for h in distinct[:3] * 1000], "html string")
    sampled = training_rows(copies, Settings(pages=10, layouts=0))
    assert sampled.select("sequence").distinct().count() == 3
