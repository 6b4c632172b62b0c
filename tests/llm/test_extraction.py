"""The parser on awkward markup, the messages against enumeration, and the model on pages not learnt from."""

import itertools

import numpy as np
import pytest

from notewright.llm import extraction as X
from notewright.llm.labelled_pages import labelled_pages
from notewright.llm.markup import parsed


@pytest.fixture(scope="module")
def model():
    return X.fitted(labelled_pages(X.SAMPLE))


def runs(page):
    return [t for t in parsed(page).text if t]


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]), ("a < b and 1<2", ["a < b and 1<2"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]), ("<p>a<b>b<i>c</b>d</i>e", ["abcde"]),
        ("x<script>if (a</b) '</p>'</script>y", ["x y"]), ("<style>p{}</style><p>t", ["t"]), ("<title>no</title>yes", ["yes"]),
        ("<!-- <p>no</p> -->yes<!-->also", ["yesalso"]), ("<p>cut <a href='x", ["cut"]), ("one<br>two\n\t three", ["one two three"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<P CLASS=x>UP</P>", ["UP"]), ("&copy; &#233;&#x41; &am &zzz; &notin; &notx &nbsp;y", ["© éA &am &zzz; ∉ ¬x y"]),
        ("<p title='a>b'>t</p>", ["t"]), ("<p it's>t's</p>", ["t's"]), ("</p></div>t", ["t"]), ("<svg><title>n</title><svg></svg></svg>t", ["t"]),
        ("<dl><dt>a<dd>b</dl><h1>c</h2>d", ["a", "b", "c", "d"]), ("<p>a <button>b</button> c</p>", ["a", "b", "c"]),
    ],
)
def test_runs_of_text(page, expected):
    assert runs(page) == expected


def test_deep_wide_and_long_pages_are_read(model):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert runs(deep) == ["deep"]
    assert runs("<a href=" * 50_000) == [] and runs("<b>" * 20_000 + "x") == ["x"] and runs("<!" * 50_000) == []
    long = "<article><p>" + "It was a word, and it was said. " * 60_000 + "</article>"
    assert X.main_texts([long, deep], model)[0] == ("It was a word, and it was said. " * 60_000).strip()


def test_marginals_are_those_of_enumeration():
    r = np.random.default_rng(1)
    page = "<body><div class=nav><a href=/>x</a></div><article><p>One, two.<p>three</article>tail"
    forest = X.Forest([parsed(page), parsed(""), parsed("<p>x")])
    weights, pair = r.normal(size=X.N_FEATURES), r.normal(size=(X.N_KINDS, 2, 2))
    unary, n = forest.scores(weights), len(forest.parent)
    states = np.array(list(itertools.product((0, 1), repeat=n)))
    weight = states @ unary
    for k, p in enumerate(forest.parent.tolist()):
        if p >= 0:
            weight = weight + pair[forest.kind[k], states[:, p], states[:, k]]
    share = np.exp(weight - np.logaddexp.reduce(weight))
    p, both, total = X.marginals(forest, weights, pair)
    assert np.allclose(p, share @ states) and np.isclose(total, np.logaddexp.reduce(weight))
    for k, above in enumerate(forest.parent.tolist()):
        for a, b in itertools.product((0, 1), repeat=2):
            if above >= 0:
                assert np.isclose(both[k, a, b], share[(states[:, above] == a) & (states[:, k] == b)].sum())


def test_slope_is_that_of_the_likelihood():
    pages = labelled_pages(3, seed=5)
    trees = [parsed(p) for p in pages]
    forest, y = X.Forest(trees), X.labels_of(trees)
    r = np.random.default_rng(2)
    w, pair = r.normal(size=X.N_FEATURES) / 10, r.normal(size=(X.N_KINDS, 2, 2))

    def likelihood(w):
        return forest.scores(w) @ y - X.marginals(forest, w, pair)[2]

    slope = forest.counts(y.astype(float)) - forest.counts(X.marginals(forest, w, pair)[0])
    for k in [0, 5, len(X.TAGS) + 3, *range(X.N_FEATURES - 2 * X.NUMBERS, X.N_FEATURES, 5)]:
        step = np.zeros(X.N_FEATURES)
        step[k] = 1e-5
        assert np.isclose((likelihood(w + step) - likelihood(w - step)) / 2e-5, slope[k], atol=1e-3)


def test_pages_not_learnt_from(model):
    pages = labelled_pages(200, seed=77)
    trees = [parsed(p) for p in pages]
    forest, y = X.Forest(trees), X.labels_of(trees)
    found = X.marginals(forest, *model)[0] > 0.5
    assert (found == y)[forest.is_run].mean() > 0.98


def test_a_page_of_another_site(model):
    page = """<html><body><div id="site-header"><a href=/>Logo</a><ul class="main-nav"><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></div>
<div class="cookie-banner">We use cookies to make this site work. By going on you agree. <button>OK</button></div>
<div class="wrapper"><div class="col-left"><h1>The river</h1><p>It rose in the night, and by dawn the lower road was gone.</p>
<div class="ad-slot">Buy two boats, get one free!</div><p>Nobody was hurt. <a href=/x>Earlier floods</a> were worse.</p>
<ul><li>Bridge closed<li>School open</ul></div><aside><h3>Related</h3><p>Older floods of the valley, year by year.</p></aside>
<div id="comments"><div class="comment"><p>I saw it from my window. It was frightening, really.</p></div></div></div>
<form action=/s><label>Search</label><input name=q><button>Go</button></form><div class="footer">&copy; 2024 The Paper. All rights reserved.</div>"""
    assert X.main_texts([page], model) == [
        "The river It rose in the night, and by dawn the lower road was gone. Nobody was hurt. Earlier floods were worse. Bridge closed School open"
    ]


def test_rows_of_any_kind(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, parent string"
    rows = [(1, "u", "<article><p>Some words, and more words.</p></article>", "clash", 1, "x")] * 2
    rows += [(2, None, None, None, None, None), (None, "u", "", "t", 2, "y"), (3, "u", "<nav><a href=/>Home</a></nav>", "", 0, "")]
    out = X.main_text(spark.createDataFrame(rows, schema), X.own_labelled_pages(spark, 120), 120)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=repr)
    one = (1, "u", "Some words, and more words.", 27)
    assert got == sorted([one, one, (2, None, "", 0), (None, "u", "", 0), (3, "u", "", 0)], key=repr)
    assert X.main_text(spark.createDataFrame([], schema), X.own_labelled_pages(spark, 20)).collect() == []
