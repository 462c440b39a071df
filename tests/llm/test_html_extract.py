"""Blocks, the trained field on held-out page designs, and edge cases."""

import html
import re

import pytest

from quire.llm import html_extract as H


@pytest.fixture(scope="module")
def field():
    return H.trained()


def test_blocks_of_broken_markup():
    text = [t for t, _ in H.blocks("<p>a <b>b<br>c<p>d&amp;e &nbsp; f<script>x</script><!-- y --></p><ul><li>g<li>h</ul>tail")]
    assert text == ["a b c", "d&e f", "g", "h", "tail"]
    assert H.blocks(None) == [] and H.blocks("") == [] and H.blocks("<style>p{}</style>") == []


def test_held_out_designs(field):
    wrong = total = 0
    for page, labels in H.labelled_pages(200, seed=99):
        got = field.decode([f for _, f in H.blocks(page)])
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_finds_the_best_path(field):
    from itertools import product

    feats = [f for _, f in H.blocks(H.labelled_pages(1, seed=5)[0][0])][:9]

    def value(path):
        emit = sum(field.weights.get(f, (0, 0))[y] for block, y in zip(feats, path) for f in block)
        return emit + sum(field.pairs[a][b] for a, b in zip(path, path[1:]))

    assert tuple(field.decode(feats)) == max(product((0, 1), repeat=len(feats)), key=value)


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in H.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("part", [
    '<nav><ul><li><a href="/">Menu entry</a></li></ul></nav>', '<div class="ad">Buy this now.</div>', "<aside><p>Other things to read.</p></aside>",
    '<div class="cookie-notice"><p>We use cookies on this site.</p></div>', "<form><label>Your name</label><button>Send</button></form>",
    '<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much.</p></div></section>',
    "<footer>&copy; somebody. All rights.</footer>", "<header><h2>The site</h2><p>its claim</p></header>"])
def test_parts_that_are_not_the_article(field, part):
    article = "<article><h1>Title here</h1><p>First sentence of it.</p><p>Be.</p></article>"
    want = "Title here\nFirst sentence of it.\nBe."
    assert H.main_text(f"<html><body>{part}{article}</body></html>", field) == want
    assert H.main_text(f"<html><body>{article}{part}</body></html>", field) == want


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (3, "u", "<p>"), (None, "u", "<article><p>A text of its own.</p></article>")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got][:4] == [(1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
