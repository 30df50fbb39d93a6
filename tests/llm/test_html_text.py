"""The field against all labellings, the reader against small pages, the extractor against known articles."""

import html as entities
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyspark.llm import crf, html_text, labelled_pages, pages, queries
from tallyspark.llm.common import ship

DATA = "/root/testdata/sf0.001"
ROWS = T.StructType(
    [T.StructField(n, T.LongType() if n == "page_id" else T.StringType()) for n in ("page_id", "url", "html", "text", "labels")]
)


def drawn(rng, kinds=3, features=5):
    sequences = [
        [[f for f in range(features) if rng.random() < 0.4] for _ in range(rng.randint(1, 5))] for _ in range(6)
    ]
    labels = [[rng.randrange(kinds) for _ in s] for s in sequences]
    return sequences, labels


def total_score(weights, first, steps, sequence, path):
    score = first[path[0]] + sum(weights[f][y] for item, y in zip(sequence, path, strict=True) for f in item)
    return score + sum(steps[a][b] for a, b in itertools.pairwise(path))


def test_likelihood_and_gradient_against_all_labellings():
    rng = random.Random(4)
    sequences, labels = drawn(rng)
    loss = crf.Likelihood(sequences, labels, 5, 3, 0.3)
    x = np.random.default_rng(1).normal(size=loss.size)
    weights, first, steps = loss.parts(x)
    wanted = 0.15 * (x @ x)
    for sequence, path in zip(sequences, labels, strict=True):
        every = [
            total_score(weights, first, steps, sequence, p) for p in itertools.product(range(3), repeat=len(sequence))
        ]
        wanted += np.logaddexp.reduce(every) - total_score(weights, first, steps, sequence, path)
    value, gradient = loss(x)
    assert value == pytest.approx(wanted)
    for i in range(loss.size):
        step = np.zeros(loss.size)
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(x + step)[0] - loss(x - step)[0]) / 2e-5, abs=1e-4)


def test_decoding_against_all_labellings():
    rng = np.random.default_rng(2)
    for n in range(1, 7):
        first, steps, scores = rng.normal(size=3), rng.normal(size=(3, 3)), rng.normal(size=(n, 3))
        model = crf.Crf({}, tuple(first), tuple(map(tuple, steps)))
        best = max(
            itertools.product(range(3), repeat=n),
            key=lambda p: first[p[0]] + sum(scores[i][y] for i, y in enumerate(p)) + sum(steps[a][b] for a, b in itertools.pairwise(p)),
        )
        assert model.decode(scores.tolist()) == list(best)
    assert crf.Crf({}, (0.0, 0.0), ((0.0, 0.0), (0.0, 0.0))).decode([[0.0, 0.0]] * 3) == [0, 0, 0]
    assert model.decode([]) == []


def test_fitting_reaches_the_minimum():
    rng = random.Random(8)
    sequences, labels = drawn(rng, 2)
    loss = crf.Likelihood(sequences, labels, 5, 2, 0.5)
    x = crf.minimise(loss, np.zeros(loss.size), 200)
    value, gradient = loss(x)
    assert np.abs(gradient).max() < 0.05
    assert all(loss(x + d)[0] >= value - 1e-6 for d in np.random.default_rng(0).normal(scale=0.1, size=(50, loss.size)))


def read(html):
    return [block.text for block in pages.blocks(html)]


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b</p>c<div>d<div>e</div>f</div>", ["a", "b", "c", "d", "e", "f"]),
        ("<p><b>one<br><p>two &amp; three &lt;4&gt; &eacute;&#233;&nbsp;x", ["one", "two & three <4> éé x"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td><table><tr><td>3</table>4</table>", ["1", "2", "3", "4"]),
        ("a<!-- <p>no</p> -->b<!-->c<!doctype x>d<?php e ?>f</>g", ["abcdfg"]),
        ("<script>if (a < b) '<p>'</script>x<STYLE>p{}</Style >y<textarea><p>z</textarea>", ["xy"]),
        ("<head><title>t</title></head><body>x</body>", ["x"]),
        ("<html><head><meta charset=x><body class='a\">b'><p title='>'>x</p>", ["x"]),
        ("1 < 2 <3 <p>x<template><p>no</p></template>", ["1 < 2 <3", "x"]),
        ("x<i>y</i>z<span>&am</span>p; a</p>b", ["xyz&amp; a", "b"]),
        ("<p>open <a href='x>seen <a href=y", ["open seen"]),
        ("<p>open <!-- never", ["open"]),
        ("<script>never", []),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", ["a", "b", "c", "1", "2"]),
        ("<h1>a</h1> \t <h2>b</h2></div></section>c", ["a", "b", "c"]),
        ("</p></br>a<br/>b<wbr>c<img src=x>d", ["a bcd"]),
    ],
)
def test_leaf_blocks(html, wanted):
    assert read(html) == wanted


def test_hostile_pages_take_linear_time():
    for piece in ("<div>", "<p>", "<b>", "<a b='", "<li>x", "</b>", "<", "<!--", "&", "<table><tr><td>", "<p><i></b><td>"):
        pages.blocks(piece * 50_000)
    deep = "<div>" * 5_000 + "x" + "</div>" * 5_000 + "<p>y"
    assert read(deep) == ["x", "y"]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(html_text.labelled_table(spark))


def test_labels_of_pages_that_were_not_learned(model):
    extractor = html_text.Extractor(model)
    wrong = total = 0
    for html, labels in labelled_pages.labelled_pages(200, seed=77):
        found = pages.blocks(html)
        if len(found) == len(labels):
            wrong += sum(a != b for a, b in zip(extractor.labels(found), labels, strict=True))
            total += len(labels)
    assert total > 3_000 and wrong / total < 0.02


def article(html):
    """The blocks of the one article of a test page."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = [entities.unescape(re.sub(r"</?b>", "", part)) for part in re.split(r"</?(?:p|h1)>|<br>", inner)]
    return "\n".join(" ".join(part.split()) for part in parts if part.strip())


def sentence(i):
    return f"Sentence {i} says something about the matter, and goes on for a while."


PAGES = {
    "all parts": (
        "<header class='site-header'><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='cookie-notice'><p>We use"
        " cookies, as all do, to make things better for you.</p><button>OK</button></div><main><article><h1>Title</h1><p class="
        f"byline>By One</p><p>{sentence(1)}</p><div class=advert>{sentence(2)}</div><p>{sentence(3)}</p><ul><li>x<li>y</ul><form>"
        "<label>Name</label><input><button>Send</button></form><section id=comments><h2>Comments</h2><div class=comment><p>"
        f"{sentence(4)}</p></div></section></article></main><aside class=sidebar><p>{sentence(5)}</p></aside><footer>&copy; Site",
        f"Title\nBy One\n{sentence(1)}\n{sentence(3)}\nx\ny",
    ),
    "plain names": (
        f"<div id=menu><ul><li><a href=a>One</a></ul></div><div id=content><h1>Head</h1><p>{sentence(1)}<p>{sentence(2)}</div>"
        f"<div id=sidebar><p>{sentence(3)}</p></div><div class=comments><p>{sentence(4)}</p></div><div id=footer>Imprint</div>",
        f"Head\n{sentence(1)}\n{sentence(2)}",
    ),
    "only paragraphs": (f"<p>{sentence(1)}</p><p>{sentence(2)}</p>", f"{sentence(1)}\n{sentence(2)}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_known_articles(model, name):
    html, wanted = PAGES[name]
    assert html_text.Extractor(model).text(f"<html><body>{html}") == wanted


def test_edge_rows(spark, model):
    good = f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{sentence(1)}</p></article>"
    long = "<article>" + "".join(f"<p>{sentence(i)}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", good), (4, "u", good), (None, "u", good), (5, "u", long)]
    frame = spark.createDataFrame([(*row, "mine", "mine") for row in rows], ROWS).repartition(2)
    got = html_text.extract(frame, model).collect()
    text = f"Title\n{sentence(1)}"
    whole = "\n".join(sentence(i) for i in range(20_000))
    wanted = [(1, "u", ""), (2, None, ""), (4, "u", text), (4, "u", text), (None, "u", text), (5, "u", whole)]
    assert sorted([tuple(r) for r in got if r.page_id != 3], key=repr) == sorted(wanted, key=repr)
    assert len(got) == len(rows)
    assert html_text.extract(frame.limit(0), model).collect() == []
    empty = html_text.fit(spark.createDataFrame([(None, None), ("<p>x", [1, 0])], "html string, labels array<int>"))
    assert [r.text for r in html_text.extract(frame.where("page_id = 4"), empty).collect()] == ["", ""]


def test_query_finds_the_articles(spark):
    ship(spark)
    wanted = {r.page_id: article(r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op11_html_text(spark, DATA).collect()
    assert {r.page_id: r.text for r in got} == wanted
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(wanted)
