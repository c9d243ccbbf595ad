"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text block is a node with one of three states: wrapper (holds both kinds), content,
boilerplate. A node's own evidence is a softmax over its tag, its parent's tag, the words of its
class, id and role, and its length and share of linked text; parent-child potentials say how states
follow one another down the tree. Sum-product messages, up and then down, give each node's marginals,
exact on a tree; the text blocks whose content marginal is the greater of content and boilerplate are
the main text, in page order.

Evidence and potentials are trained from labelled pages: ``labelled_pages`` writes a fixed set of
pages of different build with their regions marked (a ``data-y`` attribute that the model never sees).

Edge cases: a null or empty page has an empty text; plain text without tags is one block; unclosed
and cut-off markup is read as far as it goes; repeated pages are treated alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.htmltree import Page, parse

STATES = ("wrapper", "content", "boilerplate")
_LABELS = {"1": 1, "0": 2}
_PROSE = "the model of a long and careful report on rivers, towns, people, weather and trade was read with interest by many who had asked for it".split()


def _features(page: Page) -> list[list[str]]:
    """Names of each node's features."""
    n = len(page.tag)
    size, linked, blocks = [0] * n, [0] * n, [0] * n
    for k, text in page.text.items():
        size[k], linked[k], blocks[k] = len(text), min(page.linked[k], len(text)), 1
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        size[up], linked[up], blocks[up] = size[up] + size[k], linked[up] + linked[k], blocks[up] + blocks[k]
    out = []
    for k in range(n):
        tag, up = page.tag[k], page.tag[page.parent[k]] if k else "#none"
        density = 10 * linked[k] // size[k] if size[k] else 11
        share = f"d{min(density, 9) // 3}" if density < 11 else "none"
        own = ["bias", f"t={tag}", f"t={tag}<{up}", f"len={min(size[k], 4095).bit_length()}", f"link={share}"]
        own += [f"n={w}" for w in page.names[k]] or ["unnamed"]
        if tag == "#text":
            own.append("leaf")
            own += [f"leaf.len={min(size[k], 4095).bit_length() // 2}", f"leaf.{share}", "leaf.stop" if page.text[k][-1] in ".!?:;\"'" else "leaf.open"]
        else:
            own.append(f"mean={min(size[k] // max(1, blocks[k]), 4095).bit_length() // 2}")
        out.append(own)
    return out


def _truth(page: Page) -> list[int]:
    """States of a labelled page: a mark holds for all below it; what lies above different marks is a wrapper."""
    state = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        state[k] = _LABELS.get(page.label[k] or "", state[page.parent[k]])
    return state


class Model:
    """Evidence weights by feature and log potentials by (parent state, child state), for elements and for blocks."""

    def __init__(self, weights: dict[str, tuple[float, ...]], follow: np.ndarray, prior: np.ndarray):
        self.weights, self.follow, self.prior = weights, follow, prior

    def marginals(self, page: Page) -> np.ndarray:
        """(nodes, states) by sum-product over the tree."""
        score = np.empty((len(page.tag), 3))
        for k, own in enumerate(_features(page)):
            a = b = c = 0.0
            for f in own:
                if (w := self.weights.get(f)) is not None:
                    a, b, c = a + w[0], b + w[1], c + w[2]
            score[k] = a, b, c
        score -= score.max(1, keepdims=True)
        own = np.exp(score)
        own /= own.sum(1, keepdims=True) * self.prior  # likelihood up to a factor: posterior over prior
        kind = [1 if t == "#text" else 0 for t in page.tag]
        belief, message = [list(x) for x in own], [None] * len(own)
        tables = [t.tolist() for t in self.follow]
        for k in range(len(own) - 1, 0, -1):
            table, (a, b, c), up = tables[kind[k]], belief[k], belief[page.parent[k]]
            sent = [row[0] * a + row[1] * b + row[2] * c for row in table]
            total = sent[0] + sent[1] + sent[2]
            message[k] = sent = [x / total + 1e-12 for x in sent]
            up[0], up[1], up[2] = up[0] * sent[0], up[1] * sent[1], up[2] * sent[2]
            total = up[0] + up[1] + up[2]
            up[0], up[1], up[2] = up[0] / total + 1e-30, up[1] / total + 1e-30, up[2] / total + 1e-30
        root = [b * p for b, p in zip(belief[0], (0.98, 0.01, 0.01), strict=True)]
        out = [[x / sum(root) for x in root]]
        for k in range(1, len(own)):
            table, up = tables[kind[k]], out[page.parent[k]]
            rest = [u / m for u, m in zip(up, message[k], strict=True)]
            down = [(rest[0] * table[0][j] + rest[1] * table[1][j] + rest[2] * table[2][j]) * belief[k][j] for j in range(3)]
            total = sum(down)
            out.append([x / total for x in down])
        return np.array(out)

    def blocks(self, source: str | None) -> list[str]:
        """The main text's blocks, in page order."""
        page = parse(source) if source else Page()
        if not page.text:
            return []
        p = self.marginals(page)
        return [text for k, text in sorted(page.text.items()) if p[k, 1] >= p[k, 2]]


def train(pages: list[str], rounds: int = 300) -> Model:
    """Softmax weights by full-batch gradient steps, potentials by smoothed counts of labelled parents and children."""
    trees = [parse(p) for p in pages]
    rows = [(own, state) for t in trees for own, state in zip(_features(t), _truth(t), strict=True)]
    names = {f: i for i, f in enumerate(sorted({f for own, _ in rows for f in own}))}
    y = np.array([s for _, s in rows])
    at = np.repeat(np.arange(len(rows)), [len(own) for own, _ in rows])
    col = np.array([names[f] for own, _ in rows for f in own])
    w, g2 = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-6)
    target = np.eye(3)[y]
    for _ in range(rounds):
        z = np.stack([np.bincount(at, w[col, s], len(rows)) for s in range(3)], 1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target)[at]
        g = np.stack([np.bincount(col, d[:, s], len(names)) for s in range(3)], 1) / len(rows) + 3e-5 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    follow = np.ones((2, 3, 3)) * 0.5
    for t in trees:
        s = _truth(t)
        for k in range(1, len(s)):
            follow[int(t.tag[k] == "#text"), s[t.parent[k]], s[k]] += 1
    prior = np.bincount(y, minlength=3) / len(y)
    return Model({f: tuple(w[i]) for f, i in names.items()}, follow / follow.sum(2, keepdims=True), prior)


def labelled_pages(n: int = 240, seed: int = 7) -> list[str]:
    """Pages of varied build; data-y="1" marks content, data-y="0" boilerplate."""
    rng = random.Random(seed)

    def prose(low: int, high: int) -> str:
        words = [rng.choice(_PROSE) for _ in range(rng.randint(low, high))]
        return (" ".join(words)).capitalize() + rng.choice([".", ".", ".", "?", "!", ""])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(k))

    def box(tags: str, names: str, inner: str, y: str) -> str:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(["block", "box", "wrap", "col"])}"'])
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    def plain(tag: str, inner: str, y: str) -> str:
        return f'<{tag} data-y="{y}">{inner}</{tag}>'

    def paragraphs(low: int, high: int) -> str:
        out = ""
        for _ in range(rng.randint(low, high)):
            text = prose(*rng.choice([(1, 6), (8, 60), (20, 90)]))
            if rng.random() < 0.3:
                text = f"<b>{text}" + ("</b>" if rng.random() < 0.5 else "")
            if rng.random() < 0.2:
                text += f' <a href="#">{prose(1, 4)}</a> {prose(3, 20)}'
            out += f"<p>{text}" + rng.choice(["</p>", "</p>", "</p>", "<br>"])
        if rng.random() < 0.3:
            out += "<ul>" + "".join(f"<li>{prose(3, 14)}</li>" for _ in range(3)) + "</ul>"
        if rng.random() < 0.2:
            out += f"<h2>{prose(2, 6)}</h2><blockquote>{prose(6, 30)}</blockquote><pre>{prose(3, 9)}</pre>"
        if rng.random() < 0.15:
            out += f"<table><tr><th>{prose(1, 2)}</th><td>{prose(1, 5)}</td></tr></table><figure><figcaption>{prose(3, 9)}</figcaption></figure>"
        return out

    def boilerplate_inside() -> str:
        return rng.choice([
            lambda: box("div aside section", "ad ads advert advertisement sponsored promo banner", prose(2, 25), "0"),
            lambda: box("div aside", "related recommended share social newsletter subscribe tags meta", f"<p>{prose(1, 5)}</p><ul>{links(3)}</ul>", "0"),
            lambda: plain("form", f"<label>{prose(1, 3)}</label><input><button>{prose(1, 2)}</button>", "0"),
            lambda: plain("aside", f"<p>{prose(3, 30)}</p>", "0"),
        ])()

    def comments() -> str:
        inner = f"<h3>{prose(1, 2)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "response"])}"><p>{prose(3, 40)}</p></div>' for _ in range(rng.randint(1, 4)))
        return box("section div ol", "comments comment-list responses discussion disqus replies", inner, "0")

    def article() -> str:
        title = f"<h1>{prose(2, 12)}</h1>"
        if rng.random() < 0.25:
            title = f"<header>{title}<p>{prose(3, 12)}</p></header>"
        body = title + paragraphs(1, 6)
        if rng.random() < 0.3:
            body += boilerplate_inside() + paragraphs(1, 3)
        if rng.random() < 0.2:
            body += comments()
        kind = rng.random()
        if kind < 0.4:
            return plain("article", body, "1")
        if kind < 0.5:
            return plain("main", body, "1")
        if kind < 0.55:
            return "".join(plain("p", prose(20, 90), "1") for _ in range(rng.randint(1, 5)))
        return box("div section main article", "content main article post entry story text body page-content post-body", body, "1")

    def top() -> str:
        out = ""
        if rng.random() < 0.4:
            out += plain("header", f"<a href='/'>{prose(1, 3)}</a><p>{prose(2, 7)}</p>", "0")
        elif rng.random() < 0.4:
            out += box("div", "header top masthead topbar site-header logo", f"<p>{prose(1, 6)}</p>", "0")
        if rng.random() < 0.7:
            out += plain("nav", f"<ul>{links(rng.randint(2, 7))}</ul>", "0") if rng.random() < 0.6 else box("div ul", "nav menu navigation navbar breadcrumb", links(rng.randint(2, 7)), "0")
        if rng.random() < 0.4:
            out += box("div", "ad ads advert banner sponsored promo", prose(1, 25), "0")
        if rng.random() < 0.3:
            out += box("div section", "cookie notice cookie-notice consent alert gdpr popup modal", f"<p>{prose(5, 30)}</p><button>{prose(1, 2)}</button>", "0")
        return out

    def bottom() -> str:
        out = ""
        if rng.random() < 0.4:
            out += plain("aside", f"<h3>{prose(1, 3)}</h3><p>{prose(3, 30)}</p><ul>{links(3)}</ul>", "0") if rng.random() < 0.5 else box("div", "sidebar side rail widget related", f"<p>{prose(2, 30)}</p><ul>{links(4)}</ul>", "0")
        if rng.random() < 0.35:
            out += comments()
        if rng.random() < 0.25:
            out += plain("form", f"<p>{prose(2, 9)}</p><label>{prose(1, 3)}</label><button>{prose(1, 2)}</button>", "0")
        out += plain("footer", rng.choice([f"&copy; {prose(3, 25)}", f"<p>{prose(3, 25)}</p>", f"<ul>{links(3)}</ul><p>{prose(2, 9)}</p>"]), "0") if rng.random() < 0.7 else box("div", "footer bottom copyright legal", f"<p>{prose(3, 25)}</p>", "0")
        return out

    pages = []
    for _ in range(n):
        inner = top() + article() + bottom()
        if rng.random() < 0.4:
            inner = f'<div {rng.choice(["class", "id"])}="{rng.choice(["page", "wrapper", "container", "layout", "site"])}">{inner}</div>'
        pages.append(f"<html><head><title>{prose(2, 6)}</title></head><body>{inner}</body></html>")
    pages += [f'<p data-y="1">{prose(5, 60)}</p>' for _ in range(8)] + [f'<div data-y="1">{prose(5, 60)}</div>' for _ in range(4)]
    return pages


def _extracted(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = ["\n\n".join(model.blocks(source)) for source in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or train(labelled_pages())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(lambda it: _extracted(it, model), "page_id long, url string, text string, n_chars long")
