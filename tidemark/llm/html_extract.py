"""HTML extraction: gradient-boosted trees over DOM blocks, decoded as a tree.

The trees give each block the odds that it holds some of the article. Decoding goes up the page once:
a block is worth its own odds plus what its children are worth, or nothing with all below it left
out; so no text is chosen whose ancestor is not. The trees are trained here on PAGES pages that a
seeded generator lays out in many ways and labels; the table's own pages teach nothing, so a page's
text is the same in any table.

Text within math, noscript, object, video, canvas or a button is text like other and goes with its block.
Defined cases: null and empty html give an empty text; repeated rows are each extracted; null ids and
addresses stay null; a page cut off anywhere is read as far as it goes; pages of any length are read whole; extra columns play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import N_FEATURES, Block, blocks, features

PAGES, TREES, DEPTH, RATE, BINS, SEED, CLIP = 700, 90, 4, 0.25, 32, 29, 6.0


class Forge:
    """Lays out one labelled page: data-gold marks the blocks that hold the article's text."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.noise = rng.choice(["", "", "", "%%%", "&amp;", "***", "$$$", "1."])
        self.plain = rng.random() < 0.25  # without class names

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abcdefghijklmnoprstuvwzéüß") for _ in range(r.randint(2, 9))) + (self.noise if r.random() < 0.5 else "") + ("," if r.random() < 0.08 else "") for _ in range(r.randint(a, b)))

    def prose(self, most: int = 60) -> str:
        return " ".join(self.words(1, 12).capitalize() + "." for _ in range(max(1, self.r.randint(1, most) // 8)))

    def box(self, tag: str, names: str, inside: str, gold: bool = False, always: bool = False) -> str:
        telling = tag in ("nav", "footer", "header", "aside", "article", "main", "form") and self.r.random() < 0.5
        mark = self.r.choice(names.split()) if names and not telling and (always or not self.plain) else ""
        kind = f' {self.r.choice(["class", "class", "id"])}="{mark}{self.r.choice(["", "", "-1", " box", " wide"])}"' if mark else ""
        return f"<{tag}{kind}{' data-gold' if gold else ''}>{inside}</{tag}>"

    def menu(self, few: int = 2, most: int = 12) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(few, most))) + "</ul>"

    def some(self) -> str:
        """What boxes beside an article hold: links, a line, or prose as long as the article's."""
        r = self.r
        return r.choice([lambda: self.prose(24), lambda: self.prose(60), lambda: f"<p>{self.prose(40)}</p>", lambda: f"<h3>{self.words(1, 4)}</h3>{self.menu()}", lambda: f"<p>{self.prose(60)}</p><p>{self.prose(60)}</p>", lambda: f'<a href="/x">{self.words(2, 6)}</a>'])()

    def advert(self) -> str:
        return self.box(self.r.choice(["div", "div", "aside", "ins", "section"]), "ad ads advert advertisement sponsored promo banner", self.some(), always=True)

    def boilerplate(self) -> str:
        r, box = self.r, self.box
        return r.choice([
            lambda: self.advert(),
            lambda: box("nav", "nav menu navigation breadcrumbs", self.menu()),
            lambda: box("div", "nav navbar menu breadcrumb pagination", self.menu(), always=True),
            lambda: box("aside", "sidebar related widget", self.some()),
            lambda: box("div", "sidebar related widget popular trending", self.some(), always=True),
            lambda: box("div", "cookie notice consent alert popup", f"<p>{self.prose(30)}</p><button>OK</button>", always=True),
            lambda: box("form", "search subscribe newsletter login", f"<label>{self.words(1, 3)}</label><input><p>{self.prose(20)}</p>"),
            lambda: box("div", "share social newsletter subscribe", self.some(), always=True),
        ])()

    def part(self) -> str:
        r = self.r
        lead = f"<b>{self.words(1, 9)}</b> " if r.random() < 0.1 else ""
        link = f' <a href="/x">{self.words(1, 4)}</a>' if r.random() < 0.15 else ""
        return r.choice([
            *[lambda: f"<p data-gold>{lead}{self.prose()}{link}</p>"] * 9,
            lambda: f"<noscript><p data-gold>{self.prose()}</p></noscript>",
            lambda: f"<p data-gold>{self.prose(24)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {self.prose(24)}</p>",
            lambda: f"<p data-gold>{self.words(1, 4)} <button>{self.words(1, 2)}</button> {self.prose(16)}</p>",
            lambda: f"<p data-gold>{self.words(1, 2)}.</p>",
            lambda: f"<p data-gold>{self.prose(400)}<br>{self.prose(30)}</p>",
            lambda: f"<h2 data-gold>{self.words(1, 6)}</h2>",
            lambda: "<ul data-gold>" + "".join(f"<li data-gold>{self.words(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
            lambda: f"<blockquote data-gold>{self.prose()}</blockquote>",
            lambda: f"<pre data-gold>{self.words(3, 30)}</pre>",
            lambda: "<table data-gold>" + "".join(f"<tr data-gold><td data-gold>{self.words(1, 3)}</td><td data-gold>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>",
            lambda: f"<figure data-gold><img><figcaption data-gold>{self.words(3, 12)}</figcaption></figure>",
            lambda: f"<div data-gold>{self.prose()}</div>",
        ])()

    def article(self) -> str:
        r = self.r
        title = f"<h1 data-gold>{self.words(2, 10)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.1:
            title = f"<header data-gold>{title}</header>"
        if r.random() < 0.2:  # one sentence, its paragraph perhaps cut off
            line = self.words(1, 9).capitalize() + "."
            said = r.choice([line, f"<b>{line}<br>", f"<b>{line}</b>", self.prose(12)])
            return self.box(*r.choice([("article", "post entry"), ("article", "post entry"), ("main", "content"), ("div", "article-body story")]), f"<h1 data-gold>{line}</h1><p data-gold>{said}" + r.choice(["", "</p>"]), gold=True)
        parts = [self.part() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 15, 25]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), self.boilerplate())
        inside = title + "".join(parts)
        if r.random() < 0.2:
            inside = self.box("div", "content body entry-content article-body text", inside, gold=True)
        form = r.random()
        if form < 0.55:
            return self.box("article", "post story entry hentry article", inside, gold=True)
        if form < 0.7:
            return self.box("main", "main content", inside, gold=True)
        if form < 0.95:
            return self.box(r.choice(["div", "div", "section", "td"]), "content post entry article-body story main maincontent text", inside, gold=True)
        return inside

    def page(self) -> str:
        r, box = self.r, self.box
        if r.random() < 0.03:
            return f"<p data-gold>{self.prose(200)}</p>" * r.randint(1, 3)
        top, bottom = [], []
        if r.random() < 0.5:
            top.append(box("header", "header masthead site-header", f"<h1>{self.words(1, 4)}</h1>" + r.choice(["", f"<p>{self.words(2, 9)}</p>", self.menu()])))
        elif r.random() < 0.3:
            top.append(box("div", "header masthead topbar logo", self.some(), always=True))
        top += [self.boilerplate() for _ in range(r.choice([0, 1, 1, 2, 3]))]
        if r.random() < 0.3:
            each = "".join(box(r.choice(["div", "li", "article"]), "comment reply", f"<p>{self.prose(r.choice([20, 60, 120]))}</p>", always=True) for _ in range(r.randint(1, 6)))
            bottom.append(box(r.choice(["section", "div", "ol"]), "comments commentlist discussion respond reviews", f"<h3>{self.words(1, 2)}</h3>" + each, always=True))
        bottom += [self.boilerplate() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.8:
            bottom.append(box(*r.choice([("footer", "footer bottom"), ("footer", "site-footer"), ("div", "footer copyright bottom legal")]), r.choice([f"&copy; {self.words(2, 9)}", f"&copy; {self.words(1, 2)} &middot; {self.prose(48)}", self.prose(60), f"<p>{self.prose(40)}</p>", self.menu() + self.words(2, 5)]), always=True))
        inside = self.article()
        if r.random() < 0.2:
            inside += self.boilerplate()
        body = "".join(top) + inside + "".join(bottom)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body = box("div", "wrapper container page site row", body, gold=True)
        return f"<html data-gold><head><title>{self.words(2, 6)}</title></head><body data-gold>{body}</body></html>"


def gold(page: list[Block]) -> np.ndarray:
    """Marked blocks, and the runs of text right under them; the root holds the article."""
    marked = [b.attrs.rstrip().endswith("data-gold") for b in page]
    return np.array([b.up < 0 or m or (b.tag == "#text" and (b.up == 0 or marked[b.up])) for b, m in zip(page, marked, strict=True)])


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boosted trees of full depth for the weighted logistic loss: feature and threshold of each inner node, value of each leaf."""
    cuts = [np.array([0.5]) if set(np.unique(c)) <= {0, 1} else np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)])  # bin > k: value > cuts[k]
    flags = np.array([len(c) == 1 for c in cuts])
    on, rest = (binned[flags] > 0).astype(np.float32), np.flatnonzero(~flags)
    odds, trees, rows = np.zeros(len(y)), [], np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        grad, hess, node = (y - p) * weight, p * (1 - p) * weight, np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            wide, first = 2**level, 2**level - 1
            total = [np.bincount(node, w, wide) for w in (grad, hess)]
            gains, places = np.full((wide, x.shape[1]), -np.inf), np.zeros((wide, x.shape[1]), np.int64)

            def gain(g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return g**2 / (h + 1) + (a - g) ** 2 / (b - h + 1) - a**2 / (b + 1)

            spread = np.zeros((len(y), 2 * wide), np.float32)
            spread[rows, node], spread[rows, wide + node] = grad, hess
            above = on @ spread
            gains[:, flags] = gain(above[:, :wide].T, above[:, wide:].T, total[0][:, None], total[1][:, None])
            for f in rest:
                key = node * BINS + binned[f]
                g, h = (np.bincount(key, w, wide * BINS).reshape(wide, BINS).cumsum(1) for w in (grad, hess))
                each = gain(g, h, total[0][:, None], total[1][:, None])[:, : len(cuts[f])]
                places[:, f] = each.argmax(1)
                gains[:, f] = each.max(1)
            for k, f in enumerate(gains.argmax(1)):
                if gains[k, f] > 1e-9:
                    feature[first + k], threshold[first + k] = f, cuts[f][places[k, f]]
            node = 2 * node + (x[rows, feature[first + node]] > threshold[first + node])
        value = RATE * np.bincount(node, grad, 2**DEPTH) / (np.bincount(node, hess, 2**DEPTH) + 1)
        odds += value[node]
        trees.append((feature, threshold, value))
    return trees


@lru_cache(maxsize=1)
def model() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of the generated pages; the same in every process. A block weighs less, the more siblings it has."""
    rng = random.Random(SEED)
    pages = [blocks(Forge(rng).page()) for _ in range(PAGES)]
    rows = [features(p) for p in pages]
    weights = [np.array([p[max(b.up, 0)].kids for b in p]) ** -0.5 for p in pages]
    return grow(np.concatenate(rows), np.concatenate([gold(p) for p in pages]).astype(float), np.concatenate(weights))


def odds_of(trees: list, x: np.ndarray) -> np.ndarray:
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        out += value[node - (2**DEPTH - 1)]
    return out


def decode(page: list[Block], odds: np.ndarray) -> list[str]:
    """Texts of the best choice in which no block is kept below one that is not."""
    worth = np.clip(odds, -CLIP, CLIP).tolist()
    keep = [True] * len(page)
    for i in range(len(page) - 1, 0, -1):
        if worth[i] > 0:
            worth[page[i].up] += worth[i]
        else:
            keep[i] = False
    for i in range(1, len(page)):
        keep[i] = keep[i] and keep[page[i].up]
    return [b.text for b, k in zip(page, keep, strict=True) if k and b.text]


def main_texts(trees: list, pages: list[str]) -> list[str]:
    parsed = [blocks(h) for h in pages]
    odds, at, out = odds_of(trees, np.concatenate([features(p) for p in parsed]) if parsed else np.zeros((0, N_FEATURES))), 0, []
    for p in parsed:
        out.append(" ".join(decode(p, odds[at : at + len(p)])))
        at += len(p)
    return out


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    trees = pages.sparkSession.sparkContext.broadcast(model())  # TREES trees of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                texts = main_texts(trees.value, [h.as_py() or "" for h in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(column).cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
