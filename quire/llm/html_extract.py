"""Main text of web pages by a linear-chain conditional random field.

A page is read into leaf blocks: runs of text between block-level tags, each
with the tags and class names of its ancestors.  Features of a block are its
ancestors' tags, the words in their class and id names, its own tag, the nearest
sectioning ancestor, and its text (length, share of link text, closing
punctuation, signs of a notice).  The field has two labels, article and rest,
with weights per feature and per pair of neighbouring labels; it is trained on
labelled pages by maximum likelihood (forward-backward, all pages at once) and
decoded by Viterbi.  The article's blocks, white space turned into one space,
are joined in page order by a line break.

The labelled pages (``TRAIN_PAGES`` of them, a documented bound) are laid out
here from a grammar of page designs with known labels; their words are drawn
from syllables, so no word of any table is learned.

Cases: a null or empty page, or one without text, has the empty text; broken
markup is read as far as it goes (open elements end with their parent); markup,
scripts, styles and comments are never text; pages of any length are read whole;
repeated pages get a row each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 600
TRAIN_STEPS = 200
SEED = 7

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT_TAGS = frozenset("script style template noscript iframe object svg math canvas".split())
SECTIONS = frozenset("article main header footer nav aside form section table figure".split())
#: an open element of the second kind ends where one of the first begins
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
_LISTS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_NAME = re.compile(r"[a-z]+")


class _Blocks(HTMLParser):
    """Leaf blocks of a page: (text, features)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[str, list[str]]] = []
        self.text: list[str] = []
        self.linked = 0
        self.silent = 0
        self.links = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.features(text)))
            self.text, self.linked = [], 0

    def features(self, text: str) -> list[str]:
        out = set()
        near, leaf, plain, above = "none", "none", True, set()
        for tag, names in self.open:
            out.add("in " + tag)
            out.update(names)
            if tag in SECTIONS:
                above.add(tag)
            if tag in SECTIONS:
                near, plain = tag, not names
            elif names:
                plain = False
            if tag in BLOCK_TAGS:
                leaf = tag
        words = text.count(" ") + 1
        share = self.linked / len(text)
        low = text[:200].casefold()
        if plain:
            out.add("plain " + " ".join(sorted(above)))
        out |= {f"near {near}", f"leaf {leaf}", f"words {min(words.bit_length(), 7)}",
                f"links {0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
                f"end {text[-1] in '.!?…:;»”。'}"}
        if "©" in low or "copyright" in low:
            out.add("rights")
        return sorted(out)

    def pop_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.silent -= tag in SILENT_TAGS
            self.links -= tag == "a"
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            for at in range(len(self.open) - 1, -1, -1):  # what this tag ends
                other = self.open[at][0]
                if other == "p" or other in _ENDS.get(tag, ()):
                    self.pop_to(at)
                    if other != "p":
                        break
                elif other in _LISTS.get(tag, ()) or other in BLOCK_TAGS and tag not in _ENDS:
                    break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID_TAGS:
            return
        names = tuple(sorted({"name " + w for k, v in attrs if k in ("class", "id", "role") and v
                              for w in _NAME.findall(v.lower())}))
        self.open.append((tag, names))
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag in SILENT_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.pop_to(at)
                return
            if tag not in BLOCK_TAGS and self.open[at][0] in BLOCK_TAGS:
                return  # an inline end tag does not reach over a block

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of every leaf block in page order."""
    reader = _Blocks()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


class Field:
    """The conditional random field: weights by feature and label, and by pair
    of labels (0 rest, 1 article)."""

    def __init__(self, weights: dict[str, tuple[float, float]], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not feats:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back, a, b = [], 0.0, 0.0
        for i, block in enumerate(feats):
            x = y = 0.0
            for f in block:
                w = get(f, none)
                x += w[0]
                y += w[1]
            if i:
                from0, from1 = (a + p00 >= b + p10), (a + p01 >= b + p11)
                a, b = (a + p00 if from0 else b + p10), (a + p01 if from1 else b + p11)
                back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = a + x, b + y
        labels = [int(b > a)]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = TRAIN_STEPS, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by Adam steps over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for feats, _ in pages for b in feats for f in b}))}
    n, long = len(pages), max(len(p[0]) for p in pages)
    rows, cols, ids = [], [], []
    gold, live = np.zeros((n, long), int), np.zeros((n, long), bool)
    for r, (feats, labels) in enumerate(pages):
        gold[r, :len(labels)], live[r, :len(labels)] = labels, True
        for c, block in enumerate(feats):
            for f in block:
                rows.append(r), cols.append(c), ids.append(names[f])
    flat, ids = np.array(rows) * long + np.array(cols), np.array(ids)
    w, pairs = np.zeros((len(names), 2)), np.zeros((2, 2))
    target_w = np.stack([np.bincount(ids, (gold.ravel()[flat] == k), len(names)) for k in (0, 1)], axis=1)
    both = live[:, 1:]
    target_pairs = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    peak = lambda x, axis: x.max(axis=axis, keepdims=True)
    for step in range(1, steps + 1):
        score = np.stack([np.bincount(flat, w[ids, k], n * long).reshape(n, long) for k in (0, 1)], axis=2)
        fore, backw = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        fore[:, 0] = score[:, 0]
        for t in range(1, long):
            x = fore[:, t - 1, :, None] + pairs[None]
            m = peak(x, 1)
            fore[:, t] = score[:, t] + (m + np.log(np.exp(x - m).sum(axis=1, keepdims=True)))[:, 0]
        for t in range(long - 2, -1, -1):
            x = pairs[None] + (score[:, t + 1] + backw[:, t + 1])[:, None, :]
            m = peak(x, 2)
            step_back = (m + np.log(np.exp(x - m).sum(axis=2, keepdims=True)))[..., 0]
            backw[:, t] = np.where(live[:, t + 1, None], step_back, 0.0)
        joint = fore + backw
        m = peak(joint, 2)
        prob = np.exp(joint - m)
        prob = prob / prob.sum(axis=2, keepdims=True) * live[..., None]
        pair = fore[:, :-1, :, None] + pairs[None, None] + (score[:, 1:] + backw[:, 1:])[:, :, None, :]
        m = pair.max(axis=(2, 3), keepdims=True)
        pair = np.exp(pair - m)
        pair = (pair / pair.sum(axis=(2, 3), keepdims=True) * both[..., None, None]).sum(axis=(0, 1))
        expect = np.stack([np.bincount(ids, prob[..., k].ravel()[flat], len(names)) for k in (0, 1)], axis=1)
        for k, (value, grad) in enumerate(((w, target_w - expect - ridge * w), (pairs, target_pairs - pair - ridge * pairs))):
            a, b = moment[2 * k], moment[2 * k + 1]
            a *= 0.9
            a += 0.1 * grad
            b *= 0.999
            b += 0.001 * grad * grad
            value += 0.1 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-9)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, pairs)


# ---- labelled pages -------------------------------------------------------

_SYLLABLES = "ba lo ti ren sa mo ku der vi fan gel zu pro mi tas ner ola que est han ir du".split()
#: fixed values: names that page designs give to their parts
_NAMES = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs tabs pagination pager toc links".split(),
    "header": "header masthead banner branding logo top topbar site".split(),
    "side": "sidebar side aside widget related recommended popular trending more teaser promo rail recent tags archive categories".split(),
    "ad": "ad ads advert advertisement adsense sponsored sponsor banner promo promotion commercial partner adbox adslot".split(),
    "notice": "cookie cookies notice alert consent gdpr newsletter subscribe paywall popup modal overlay toast disclaimer message".split(),
    "share": "share social sharing follow meta byline author toolbar actions buttons".split(),
    "form": "form search login signup contact newsletter subscribe feedback".split(),
    "comments": "comment comments commentlist reply replies respond discussion disqus reviews thread feedback".split(),
    "footer": "footer bottom foot copyright legal imprint credits colophon".split(),
    "main": "content article post entry story main body text page single blog news".split(),
}


class _Design:
    """Random page designs with a label for every leaf block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, end: str = "") -> str:
        text = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return text.capitalize() + end

    def leaf(self, tag: str, text: str, label: int, inline: bool = True) -> None:
        if inline and label and self.r.random() < 0.3:
            text = f"<{(t := self.r.choice(['b', 'i', 'em', 'strong', 'span']))}>{text}</{t}> {self.word()}."
        elif inline and label and self.r.random() < 0.2:
            text += f' <a href="#">{self.word()}</a> {self.words(1, 6, ".")}'
        close = "" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>"
        self.html.append(f"<{tag}>{text}{close}")
        self.labels.append(label)

    def open(self, tag: str, kind: str | None = None) -> str:
        attr = ""
        if kind and (tag in ("div", "section", "p") or kind in ("ad", "notice", "share", "comments") or self.r.random() < 0.5):
            name = self.r.choice(_NAMES[kind])
            if self.r.random() < 0.4:
                name += self.r.choice(["-", "_", " "]) + self.r.choice(["box", "wrap", "container", "inner", "list", "area", "item"])
            attr = f' {self.r.choice(["class", "class", "id"])}="{name}"'
        self.html.append(f"<{tag}{attr}>")
        return tag

    def within(self, tag: str, kind: str | None, fill) -> None:
        self.open(tag, kind)
        fill()
        self.html.append(f"</{tag}>")

    def link_list(self, kind: str) -> None:
        for _ in range(self.r.randint(2, 7)):
            self.leaf("li", f'<a href="#">{self.words(1, 3)}</a>', 0, False)

    def menu(self) -> None:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        self.within(tag, "menu", lambda: self.within("ul", None, lambda: self.link_list("menu")) if tag != "ul" else self.link_list("menu"))

    def header(self) -> None:
        def fill():
            self.leaf(self.r.choice(["h1", "h2", "div", "p"]), self.words(1, 4), 0, False)
            if self.r.random() < 0.5:
                self.leaf("p", self.words(3, 8), 0, False)
            if self.r.random() < 0.4:
                self.menu()

        self.within(self.r.choice(["header", "header", "div"]), "header", fill)

    def box(self, kind: str, tags: list[str]) -> None:
        def fill():
            if self.r.random() < 0.4:
                self.leaf(self.r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0, False)
            shape = self.r.random()
            if shape < 0.4:
                self.within("ul", None, lambda: self.link_list(kind))
            else:
                for _ in range(self.r.randint(1, 3)):
                    end = self.r.choice(["", "."])
                    text = self.words(2, 25, end)
                    self.leaf(self.r.choice(["p", "div", "span"]) if shape < 0.8 else "p",
                              f'<a href="#">{text}</a>' if self.r.random() < 0.3 else text, 0, False)

        def bare():
            self.html.append(self.words(2, 20, self.r.choice(["", "."])))
            self.labels.append(0)

        # a box of spans is one block of inline text
        self.within(self.r.choice(tags), kind, bare if self.r.random() < 0.5 else fill)

    def form(self) -> None:
        def fill():
            for _ in range(self.r.randint(1, 3)):
                self.leaf("label", self.words(1, 4), 0, False)
                self.html.append('<input type="text">')
            self.leaf("button", self.words(1, 2), 0, False)

        self.within("form", "form", fill)

    def comments(self) -> None:
        def one():
            self.leaf(self.r.choice(["h4", "div", "p"]), self.words(1, 3), 0, False)
            for _ in range(self.r.randint(1, 3)):
                self.leaf("p", self.words(3, 40, "."), 0, False)

        def fill():
            self.leaf(self.r.choice(["h2", "h3"]), self.words(1, 3), 0, False)
            for _ in range(self.r.randint(1, 4)):
                self.within(self.r.choice(["div", "li", "article", "section"]), "comments", one)

        self.within(self.r.choice(["section", "div", "ol", "aside"]), "comments", fill)

    def footer(self) -> None:
        def fill():
            if self.r.random() < 0.5:
                self.html.append(self.r.choice(["&copy; ", "Copyright ", ""]) + self.words(2, 14, self.r.choice(["", "."])))
                self.labels.append(0)
            else:
                self.leaf("p", self.r.choice(["&copy; ", "Copyright ", ""]) + self.words(2, 14, "."), 0, False)
                if self.r.random() < 0.5:
                    self.within("ul", None, lambda: self.link_list("footer"))

        self.within(self.r.choice(["footer", "footer", "div"]), "footer", fill)

    def body_text(self, inside: bool) -> None:
        r = self.r
        if r.random() < 0.9:
            def title():
                self.leaf(r.choice(["h1", "h1", "h2"]), self.words(1, 12, r.choice(["", "."])), 1, False)

            self.within("header", None, title) if inside and r.random() < 0.15 else title()
        for _ in range(r.randint(1, 12)):
            k = r.random()
            if k < 0.66:
                self.leaf("p", " ".join(self.words(1, 18, ".") for _ in range(r.randint(1, 6))), 1)
            elif k < 0.74:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.words(1, 8), 1, False)
            elif k < 0.82:
                self.within(r.choice(["ul", "ol"]), None, lambda: [self.leaf("li", self.words(1, 20, r.choice(["", "."])), 1)
                                                                   for _ in range(r.randint(2, 5))])
            elif k < 0.87:
                self.leaf("blockquote", self.words(5, 30, "."), 1)
            elif k < 0.9:
                self.leaf("pre", self.words(3, 30), 1, False)
            elif k < 0.93:
                self.within("figure", None, lambda: self.leaf("figcaption", self.words(2, 12, "."), 1, False))
            elif k < 0.96:
                self.within("table", None, lambda: self.within("tr", None, lambda: [
                    self.leaf(r.choice(["td", "th"]), self.words(1, 4), 1, False) for _ in range(r.randint(2, 4))]))
            elif r.random() < 0.7:
                self.box(r.choice(["ad", "ad", "share", "notice", "side"]), ["div", "div", "aside"])
            else:
                self.form()

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html += [f"<html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body>"]
        self.labels.append(0)
        before = [self.menu, self.header, lambda: self.box("ad", ["div"]), lambda: self.box("notice", ["div", "section", "p"]), self.form]
        for part in r.sample(before, r.randint(0, 4)):
            part()
        if r.random() < 0.25:
            self.box("side", ["aside", "div"])
        shape = r.random()
        if shape < 0.5:
            self.within("article", "main", lambda: self.body_text(True))
        elif shape < 0.65:
            self.within("main", "main", lambda: self.body_text(True))
        elif shape < 0.75:
            self.within("main", None, lambda: self.within("article", "main", lambda: self.body_text(True)))
        elif shape < 0.92:
            self.within(r.choice(["div", "section"]), "main", lambda: self.body_text(False))
        else:
            self.body_text(False)
        after = [self.comments, lambda: self.box("side", ["aside", "div"]), lambda: self.box("share", ["div"]), self.form,
                 lambda: self.box("ad", ["div"]), lambda: self.box("notice", ["div"]), self.menu]
        for part in r.sample(after, r.randint(0, 4)):
            part()
        if r.random() < 0.85:
            self.footer()
        self.html.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.html), self.labels


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """(html, labels of its leaf blocks): pages whose blocks are read back one
    for one."""
    out, k = [], 0
    while len(out) < n:
        html, labels = _Design(1_000_003 * seed + k).page()
        k += 1
        if len(blocks(html)) == len(labels):
            out.append((html, labels))
    return out


@lru_cache(maxsize=4)
def trained(n: int = TRAIN_PAGES, seed: int = SEED) -> Field:
    """The field trained on ``n`` labelled pages."""
    return train([([f for _, f in blocks(html)], labels) for html, labels in labelled_pages(n, seed)])


def main_text(html: str | None, field: Field) -> str:
    found = blocks(html)
    return "\n".join(text for (text, _), label in zip(found, field.decode([f for _, f in found])) if label)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every page."""
    shared = df.sparkSession.sparkContext.broadcast(trained(train_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
