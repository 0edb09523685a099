"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks. A block's vector holds its whole tag path (element names and class, id
and role words, hashed, outer ones fainter), all its words (hashed, as shares) and a few measures; a
bidirectional LSTM written in numpy reads the whole sequence both ways, so each block is classified with all
of the page before and after it.
Blocks of the article are joined in page order.

The network is trained here, from seed, on pages made by `training_pages`: random layouts of articles among
menus, headers, footers, sidebars, notices, adverts, forms and comments, whose labels are known by
construction. Nothing of the pages to be extracted is learned from.

Null or empty html, and a page without an article block, give the empty text. Repeated rows give the same.
"""

from __future__ import annotations

import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideloom.llm.htmlblocks import Block, Node, blocks

PATHS, WORDS, MEASURES = 96, 48, 8
NEARNESS = 0.9
INPUT = PATHS + WORDS + MEASURES
HIDDEN = 16


@lru_cache(maxsize=100_000)
def _cell(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def path_vector(node: Node | None) -> np.ndarray:
    """The hashed names and words of an element and all it stands in, each step out weighing NEARNESS times the last."""
    chain = []
    while node is not None and node.memo is None:
        chain.append(node)
        node = node.parent
    x = np.zeros(PATHS, dtype=np.float32) if node is None else node.memo
    for node in reversed(chain):
        x = x * NEARNESS
        x[[_cell(part, PATHS) for part in (node.name, *node.words)]] = 1.0
        node.memo = x
    return x


def vector(block: Block) -> np.ndarray:
    x = np.zeros(INPUT, dtype=np.float32)
    x[:PATHS] = path_vector(block.node)
    words = block.text.lower().split()
    counts = np.bincount([_cell(w.strip(".,:;!?()\"'"), WORDS) for w in words], minlength=WORDS)
    x[PATHS : PATHS + WORDS] = counts / max(1, len(words))
    n, size = len(words), max(1, len(block.text))
    x[PATHS + WORDS :] = (
        min(1.0, math.log1p(n) / 6),
        min(1.0, block.linked / size),
        min(1.0, sum(map(block.text.count, ".,;:!?")) / max(1, n)),
        block.text[-1:] in ".!?\"",
        n > 12,
        "©" in block.text,
        block.node is not None and block.node.name == "p",
        min(1.0, block.node.depth / 12 if block.node else 0.0),
    )
    return x


class Labeller:
    """One LSTM a direction, of HIDDEN cells, and a logistic output on both states."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((INPUT, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p[f"u{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.p["oc"] = np.zeros(1, dtype=np.float32)

    def _both(self, name: str) -> np.ndarray:
        return np.stack([self.p[f"{name}f"], self.p[f"{name}b"]])

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of both directions, (2, pages, steps, HIDDEN), each in its own reading order. They are held where the mask is off."""
        n, steps, _ = x.shape
        z = np.stack([x @ self.p["wf"] + self.p["cf"], (x @ self.p["wb"] + self.p["cb"])[:, ::-1]]).transpose(2, 0, 1, 3)
        masks, u = np.stack([mask, mask[:, ::-1]]).transpose(2, 0, 1)[..., None], self._both("u")
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        states, kept = np.zeros((2, n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            g = z[t] + h @ u
            s = 1 / (1 + np.exp(-g[..., : 3 * HIDDEN]))
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            k, m = np.tanh(g[..., 3 * HIDDEN :]), masks[t]
            new_c = np.where(m, f * c + i * k, c)
            tc = np.tanh(new_c)
            new_h = np.where(m, o * tc, h)
            if keep:
                kept.append((h, c, i, f, o, k, tc, m))
            h, c = new_h, new_c
            states[:, :, t] = h
        return states, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        states, memory = self._run(x, mask, keep)
        both = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["oc"], -30, 30))), both, memory

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the blocks that the mask keeps."""
        prob, both, memory = self.forward(x, mask, keep=True)
        error = ((prob - y) * mask / max(1, mask.sum())).astype(np.float32)
        g = {"o": np.einsum("nt,nth->h", error, both), "oc": error.sum(keepdims=True).reshape(1)}
        back = np.stack([error[..., None] * self.p["o"][:HIDDEN], (error[..., None] * self.p["o"][HIDDEN:])[:, ::-1]])
        n, steps, _ = x.shape
        u = self._both("u")
        dh, dc, du = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32), np.zeros_like(u)
        dz = np.zeros((2, n, steps, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, k, tc, m = memory[t]
            dh = dh + back[:, :, t]
            live, held_h, held_c = np.where(m, dh, 0), np.where(m, 0, dh), np.where(m, 0, dc)
            dcell = np.where(m, dc, 0) + live * o * (1 - tc * tc)
            step = np.concatenate([dcell * k * i * (1 - i), dcell * c * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - k * k)], axis=-1)
            dz[:, :, t] = step
            du += h.transpose(0, 2, 1) @ step
            dh = step @ u.transpose(0, 2, 1) + held_h
            dc = dcell * f + held_c
        for j, (d, own) in enumerate((("f", dz[0]), ("b", dz[1][:, ::-1]))):
            g[f"u{d}"] = du[j]
            g[f"w{d}"] = x.reshape(-1, INPUT).T @ own.reshape(-1, 4 * HIDDEN)
            g[f"c{d}"] = own.sum(axis=(0, 1))
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 32, rate: float = 0.01) -> Labeller:
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        shuffle = random.Random(11)
        m, v, it = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            shuffle.shuffle(groups)
            for group in groups:
                x, mask = _padded([pages[i][0] for i in group])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(group):
                    y[r, : len(pages[i][1])] = pages[i][1]
                it += 1
                grads = self.gradients(x, mask, y)
                scale = min(1.0, 1.0 / (1e-9 + math.sqrt(sum(float((a * a).sum()) for a in grads.values()))))
                for k, a in grads.items():
                    a = a * scale
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.01 * (a * a - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**it)) / (np.sqrt(v[k] / (1 - 0.99**it)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]], most_cells: int = 40_000) -> list[np.ndarray]:
        """Article or not, for every block of every page; pages of like length are read together."""
        found: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= most_cells:
                to += 1
            x, mask = _padded([np.stack([vector(b) for b in pages[i]]) for i in order[at:to]])
            prob, _, _ = self.forward(x, mask)
            for r, i in enumerate(order[at:to]):
                found[i] = prob[r, : len(pages[i])] >= 0.5
            at = to
        return found


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((len(rows), longest, INPUT), np.float32), np.zeros((len(rows), longest), bool)
    for r, a in enumerate(rows):
        x[r, : len(a)], mask[r, : len(a)] = a, True
    return x, mask


# Words that pages use for the parts around an article.
_PARTS = {
    "menu": ("nav menu navbar navigation topnav breadcrumb breadcrumbs", "Home About Contact Products News Login Search Archive Accueil Startseite Inicio"),
    "header": ("header masthead banner logo topbar branding", "Welcome The Daily Official Site Since"),
    "footer": ("footer bottom copyright colophon legal", "© Copyright All rights reserved Terms Privacy Imprint Impressum"),
    "sidebar": ("sidebar aside related widget recent trending popular", "Related Most read Popular Latest posts Tags Archive See also"),
    "notice": ("notice cookie consent gdpr alert popup modal", "We use cookies Accept Decline Your privacy settings consent"),
    "advert": ("ad ads advert advertisement sponsored promo sponsor", "Advertisement Sponsored Buy now Save today Offer"),
    "form": ("form newsletter subscribe signup search login", "Your email Subscribe Send Name Password Submit"),
    "comments": ("comments comment discussion replies respond commentlist", "says Reply Great post Thanks Comments Leave a comment"),
}
_WRAPS = "content main post entry story article body text single page hentry prose".split()
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st le la de que ou ai eux ción mente ar os as el ge be ung keit sch ein ich".split()


def training_pages(count: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(html, label of each block) of random pages."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(count)]


def _prose(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 4)))) for _ in range(rng.randint(low, high))]
    junk = rng.choice(("", "", "", "", "###", "!!", " |", "***"))
    out, first = [], True
    for w in words:
        w = w.capitalize() if first else w
        first = rng.random() < 0.12
        out.append(w + ("." if first else "," if rng.random() < 0.06 else "") + (junk if junk and rng.random() < 0.7 else ""))
    return " ".join(out) + rng.choice((".", ".", ".", "", "!"))


def _page(rng: random.Random) -> tuple[str, list[int]]:
    labels: list[int] = []

    def leaf(tag: str, text: str, label: int, closed: bool = True) -> str:
        labels.append(label)
        return f"<{tag}>{text}" + (f"</{tag.split(' ')[0]}>" if closed else "")

    def named(kind: str) -> str:
        word = rng.choice(_PARTS[kind][0].split())
        return rng.choice((f'class="{word}"', f'id="{word}"', f'class="box {word}-wrap"', f"class={word}"))

    def cue(kind: str) -> str:
        words = _PARTS[kind][1].split()
        return " ".join(rng.sample(words, min(len(words), rng.randint(1, 4))))

    def part(kind: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        bare = tag != "div" and rng.random() < 0.45
        tag = tag if bare or rng.random() < 0.4 else "div"
        inside = ""
        if kind == "menu" or kind == "sidebar" and rng.random() < 0.6:
            for _ in range(rng.randint(2, 9)):
                word = cue(kind) if rng.random() < 0.5 else _prose(rng, 1, 4)
                inside += f"<li><a href='/x'>{word}</a></li>"
                labels.append(0)
            inside = f"<ul>{inside}</ul>"
        elif kind == "comments":
            for _ in range(rng.randint(1, 5)):
                one = leaf("p", _prose(rng, 3, 60), 0)
                inside += f"<div {named(kind)}>{one}</div>" if rng.random() < 0.7 else one
        elif kind == "form":
            inside = "".join(leaf(rng.choice(("div", "p", "button")), cue(kind), 0) + "<input name=q>" for _ in range(rng.randint(1, 3)))
        else:
            for _ in range(rng.randint(1, 3)):
                text = cue(kind) if rng.random() < 0.4 else _prose(rng, 2, 16)
                if kind == "footer" and rng.random() < 0.8:
                    text = "&copy; " + text
                inside += leaf(rng.choice(("p", "div", "div")), text, 0) if rng.random() < 0.5 or inside else _bare(text, labels)
        return f"<{tag}{'' if bare else ' ' + named(kind)}>{inside}</{tag}>"

    def article() -> str:
        inside = leaf("h1", _prose(rng, 2, 14), 1) if rng.random() < 0.85 else ""
        for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 8, 12, 20))):
            r = rng.random()
            if r < 0.07:
                inside += leaf(rng.choice(("h2", "h3")), _prose(rng, 1, 8), 1)
            elif r < 0.12:
                inside += "<ul>" + "".join(leaf("li", _prose(rng, 2, 20), 1) for _ in range(rng.randint(1, 4))) + "</ul>"
            elif r < 0.16:
                inside += leaf("blockquote", _prose(rng, 5, 40), 1)
            elif r < 0.19:
                inside += "<table><tr>" + "".join(leaf("td", _prose(rng, 1, 6), 1) for _ in range(rng.randint(1, 4))) + "</tr></table>"
            elif r < 0.30:
                inside += leaf("p", f"<b>{_prose(rng, 3, 20)}<br>", 1, closed=False)
            else:
                low, high = rng.choice(((1, 5), (5, 30), (20, 120)))
                text = _prose(rng, low, high)
                if rng.random() < 0.1:
                    text = text.replace(" ", " <a href='/y'>", 1) + "</a>"
                inside += leaf("p", text, 1)
            if rng.random() < 0.04:
                inside += part("advert")
        word = rng.choice(_WRAPS)
        return rng.choice((f"<article>{inside}</article>", f"<main>{inside}</main>", f'<div class="{word}">{inside}</div>', f'<article class="{word}">{inside}</article>', f'<div id="{word}"><div class="{rng.choice(_WRAPS)}">{inside}</div></div>'))

    before = [k for k in ("header", "menu", "notice", "advert") if rng.random() < {"menu": 0.8}.get(k, 0.45)]
    rng.shuffle(before)
    after = [k for k in ("sidebar", "form", "comments", "advert", "notice", "footer") if rng.random() < {"footer": 0.85}.get(k, 0.35)]
    body = "".join(map(part, before)) + article() + "".join(map(part, after))
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("wrapper", "container", "site", "layout"))}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}" + rng.choice(("</body></html>", "")), labels


def _bare(text: str, labels: list[int]) -> str:
    labels.append(0)
    return text


def fit(pages: int = 800, epochs: int = 6, seed: int = 5) -> Labeller:
    """The labeller, trained on `pages` made pages; pages whose blocks the parser sees otherwise are left out."""
    rows = []
    for page, labels in training_pages(pages, seed):
        found = blocks(page)
        if found and len(found) == len(labels):
            rows.append((np.stack([vector(b) for b in found]), np.array(labels, np.float32)))
    return Labeller().train(rows, epochs)


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    parsed = [blocks(p) for p in pages]
    return [" ".join(b.text for b, take in zip(found, chosen, strict=True) if take) for found, chosen in zip(parsed, model.label(parsed), strict=True)]


def extract(pages: DataFrame, model: Labeller, step_chars: int = 2_000_000) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars)."""

    def run(batches):
        for batch in batches:
            html, out, at = batch.column(2).to_pylist(), [], 0
            while at < len(html):
                to, size = at, 0
                while to < len(html) and (to == at or size + len(html[to] or "") <= step_chars):
                    size, to = size + len(html[to] or ""), to + 1
                out += main_texts(html[at:to], model)
                at = to
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"])
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
