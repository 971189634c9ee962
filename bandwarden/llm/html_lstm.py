"""Main text of web pages by a recurrent block labeller.

Method: a page is the sequence of its leaf blocks.  Each block is a vector of its tag path (hashed elements and class,
id and role parts, near ones heavier), its hashed words, and a few shape statistics.  A bidirectional LSTM in NumPy reads
the sequence in both directions, so every block is labelled with the whole document as context.

It is trained here, on at most ``SAMPLE`` pages of the table and as many pages built from their texts in other templates.
The labels are weak: a teacher that knows which elements and class names hold an article and which hold menus, notices,
adverts, forms or comments.  Every page is then labelled whole; no block or page is cut short.
"""
from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_blocks import Block, page_blocks
from .tables import batches, table
from .words import slices

SAMPLE = 300
TRAINING_BLOCKS = 120   # a training page has at most so many blocks; labelling has no such limit
PATH, WORDS, SHAPE = 96, 48, 12
HIDDEN_UNITS = 16
EPOCHS = 5
SEED = 5
_BATCH = 32

MAIN = frozenset("article main content post entry story body text page".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset".split())
ASIDE = frozenset("nav navbar menu header masthead footer copyright sidebar widget related ad ads advert advertisement sponsored promo "
                  "banner cookie consent notice alert popup modal newsletter subscribe comment comments commentlist reply respond share "
                  "social breadcrumb breadcrumbs tags search login pagination navigation contentinfo complementary toolbar".split())


def teacher(block: Block) -> int:
    """1 if the path leads through an article's container and through nothing that is set aside."""
    inside = False
    for tag, *names in block.path:
        if tag in ASIDE_TAGS or not ASIDE.isdisjoint(names):
            return 0
        inside |= tag in MAIN_TAGS or (tag != "body" and not MAIN.isdisjoint(names))
    return int(inside)


_cells: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    key = tuple(" ".join(e) for e in path)
    if key not in _cells:
        if len(_cells) > 20_000:
            _cells.clear()
        out = np.zeros(PATH, np.float32)
        for depth, element in enumerate(reversed(path)):
            for i, name in enumerate(element):
                code = zlib.crc32(f"{'t' if i == 0 else 'n'}{name}".encode())
                out[code % PATH] += (1 if code & 0x10000 else -1) * (1.0 if depth < 2 else 0.7)
        _cells[key] = out
    return _cells[key]


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """Feature rows of the blocks of one page."""
    out = np.zeros((len(blocks), PATH + WORDS + SHAPE), np.float32)
    if not blocks:
        return out
    for s in slices(pa.array([b.text for b in blocks])):
        h = s.hashes(lower=True)
        n = np.diff(s.bounds)
        row = np.repeat(np.arange(s.rows), n)
        cell = (h & np.uint64(0xFFFF)).astype(np.int64) % WORDS
        counts = np.bincount(row * WORDS + cell, 1.0 - 2.0 * ((h >> np.uint64(20)) & np.uint64(1)), s.rows * WORDS).reshape(s.rows, WORDS)
        out[s.first:s.first + s.rows, PATH:PATH + WORDS] = counts / np.maximum(1, n)[:, None]
        out[s.first:s.first + s.rows, PATH + WORDS] = np.log1p(n) / 4
    for i, b in enumerate(blocks):
        out[i, :PATH] = _path_vector(b.path)
        size = max(1, len(b.text))
        tag = b.path[-1][0] if b.path else ""
        out[i, PATH + WORDS + 1:] = (
            np.log1p(size) / 6, min(1, b.link_chars / size), sum(map(b.text.count, ".,!?;:")) / size * 5, i / len(blocks),
            (len(blocks) - i) / len(blocks), len(b.path) / 10, tag[:1] == "h" and tag[1:].isdigit(), tag == "li", tag == "p",
            b.text[-1] in ".!?", 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Bidirectional LSTM with one logistic output per step."""

    def __init__(self, width: int = PATH + WORDS + SHAPE, units: int = HIDDEN_UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.units = units
        self.p = {}
        for side in "fb":
            self.p[f"W{side}"] = rng.normal(0, 0.3 / np.sqrt(width), (width, 4 * units))
            self.p[f"U{side}"] = rng.normal(0, 1 / np.sqrt(units), (units, 4 * units))
            self.p[f"c{side}"] = np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)])
        self.p["V"], self.p["a"] = rng.normal(0, 0.1, 2 * units), np.zeros(1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, units) of one direction; steps without a block leave the state as it is."""
        steps, pages, _ = x.shape
        n, h, c = self.units, np.zeros((pages, self.units)), np.zeros((pages, self.units))
        z_all = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
        out, saved = np.zeros((steps, pages, n)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = z_all[t] + h @ self.p[f"U{side}"]
            gate, new = _sigmoid(z[:, :3 * n]), np.tanh(z[:, 3 * n:])
            i, f, o = gate[:, :n], gate[:, n:2 * n], gate[:, 2 * n:]
            cell = f * c + i * new
            bent = np.tanh(cell)
            m = mask[t][:, None]
            saved.append((t, h, c, i, f, o, new, bent, m))
            h, c = m * (o * bent) + (1 - m) * h, m * cell + (1 - m) * c
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        ahead, a = self._run("f", x, mask)
        back, b = self._run("b", x, mask)
        both = np.concatenate([ahead, back], axis=2)
        return _sigmoid(both @ self.p["V"] + self.p["a"]), (both, a, b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss over the blocks and its gradients, by back-propagation through time."""
        prob, (both, a, b) = self.forward(x, mask)
        total = mask.sum()
        loss = -(mask * np.log(np.where(label > 0, prob, 1 - prob) + 1e-12)).sum() / total
        error = mask * (prob - label) / total
        grad = {"V": np.einsum("tp,tpu->u", error, both), "a": np.array([error.sum()])}
        n = self.units
        for side, saved, own in (("f", a, slice(0, n)), ("b", b, slice(n, 2 * n))):
            dz_all = np.zeros((*x.shape[:2], 4 * n))
            dU = np.zeros_like(self.p[f"U{side}"])
            dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            for t, h, c, i, f, o, new, bent, m in reversed(saved):
                dh = dh + error[t][:, None] * self.p["V"][own]
                through = m * dh
                dcell = through * o * (1 - bent ** 2) + m * dc
                dz = np.concatenate([dcell * new * i * (1 - i), dcell * c * f * (1 - f), through * bent * o * (1 - o), dcell * i * (1 - new ** 2)], 1)
                dz_all[t] = dz
                dU += h.T @ dz
                dh, dc = dz @ self.p[f"U{side}"].T + (1 - m) * dh, dcell * f + (1 - m) * dc
            grad[f"W{side}"] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * n)
            grad[f"U{side}"], grad[f"c{side}"] = dU, dz_all.sum((0, 1))
        return loss, grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> "Labeller":
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, rate = 0, 0.01
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[i]) // 8 for i in order], kind="stable")]  # little padding
            for at in rng.permutation(range(0, len(order), _BATCH)):
                some = order[at:at + _BATCH]
                x, mask = padded([pages[i] for i in some])
                label = padded([labels[i][:, None] for i in some])[0][:, :, 0]
                if not mask.any():
                    continue
                _, grad = self.gradients(x, mask, label)
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of every block; pages of similar length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            some = order[at:at + _BATCH * 4]
            while len(some) > 1 and len(pages[some[-1]]) * len(some) > 20_000:  # a bounded number of steps and pages at once
                some = some[:len(some) // 2]
            x, mask = padded([pages[i] for i in some])
            prob = self.forward(x, mask)[0]
            for j, i in enumerate(some):
                out[i] = prob[:len(pages[i]), j]
            at += len(some)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1])), np.zeros((steps, len(pages)))
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


def other_template(texts: list[str], small: list[str], rng: random.Random) -> str:
    """A page with ``texts`` as its article and ``small`` texts around it, in one of many templates."""
    pick = lambda: rng.choice(small)
    name = lambda tag, *names: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">'
    links = lambda n: "".join(f'<li><a href="/{i}">{pick()}</a></li>' for i in range(n))

    def menu() -> str:
        return rng.choice([f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>",
                           f"{name('div', 'menu', 'navbar', 'main-nav', 'nav')}<ul>{links(rng.randint(2, 8))}</ul></div>",
                           f"{name('ul', 'menu', 'breadcrumb', 'navigation')}{links(rng.randint(2, 5))}</ul>"])

    def box(tag_names: list[tuple[str, ...]]) -> str:
        tag, *names = rng.choice(tag_names)
        inner = rng.choice([f"<p>{pick()}</p>", pick(), f"<h3>{pick()}</h3><p>{rng.choice(texts)}</p>", f"<ul>{links(3)}</ul>",
                            f"<div>{pick()}</div><div>{rng.choice(texts)}</div>"])
        return f"{name(tag, *names) if names else f'<{tag}>'}{inner}</{tag}>"

    notice = lambda: box([("div", "ad", "advert", "sponsored", "promo", "banner"), ("div", "cookie-notice", "cookie-consent", "alert", "notice", "popup"),
                          ("section", "newsletter", "subscribe", "share", "social")])
    side = lambda: box([("aside",), ("div", "sidebar", "widget", "related"), ("aside", "related", "sidebar")])
    head = lambda: box([("header",), ("div", "header", "masthead"), ("header", "site-header")])
    foot = lambda: box([("footer",), ("div", "footer", "copyright", "site-footer")])
    form = lambda: f"<form><label>{pick()}</label><input><p>{pick()}</p><button>{pick()}</button></form>"

    def comments() -> str:
        each = lambda: rng.choice(["<div class=comment><b>{}</b><p>{}</p></div>", "<li class=\"comment\"><p>{} {}</p></li>"]).format(pick(), rng.choice(texts))
        opened, end = rng.choice([('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<ol class="commentlist">', "</ol>")])
        return opened + f"<h3>{pick()}</h3>" + "".join(each() for _ in range(rng.randint(1, 5))) + end

    def paragraph(t: str) -> str:
        return rng.choice([f"<p>{t}</p>"] * 8 + [f"<p>{t}", f"<p><b>{t}<br>", f"<h2>{t[:40]}</h2><p>{t}</p>", f"<ul><li>{t}</li><li>{pick()}</li></ul>",
                                                f"<blockquote>{t}</blockquote>", f"<div>{t}</div>", f"<pre>{t}</pre>", f"<table><tr><td>{t}</td></tr></table>",
                                                f"<p>{t} <a href='#'>{pick()}</a></p>"])

    body = [f"<h1>{pick()}</h1>"] if rng.random() < .8 else []
    for t in texts:
        body.append(paragraph(t))
        if rng.random() < .06:
            body.append(rng.choice([notice, side, form])())
    if rng.random() < .15:
        body.append(comments())
    opened, end = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                              ('<div class="content">', "</div>"), ('<div id="content"><div class="post">', "</div></div>"),
                              ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"),
                              ('<div class="article-body">', "</div>"), ('<div role="main">', "</div>"), ('<div class="post-text">', "</div>")])
    before = [f() for f in (menu, head, notice, side, form) if rng.random() < .45]
    after = [f() for f in (side, notice, form, comments, menu) if rng.random() < .35] + [foot() for _ in range(rng.random() < .8)]
    rng.shuffle(before)
    wrap = rng.choice([("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page-wrap"><div>', "</div></div>")])
    return "<html><body>" + wrap[0] + "".join([*before, opened, *body, end, *after]) + wrap[1] + rng.choice(["</body></html>", ""])


def training_pages(sample: list[str | None], seed: int = SEED) -> list[list[Block]]:
    rng = random.Random(seed)
    own = [b for b in (page_blocks(p) for p in sample) if 0 < len(b) <= TRAINING_BLOCKS]
    texts = [b.text for blocks in own for b in blocks if len(b.text) > 60] or ["Plain words that fill a sentence of a page."]
    small = [b.text[:50] for blocks in own for b in blocks] or ["Some words"]
    clean = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    texts, small = [clean(t[:600]) for t in texts], [clean(t) for t in small]
    made = [page_blocks(other_template([rng.choice(texts) for _ in range(rng.randint(1, 10))], small, rng)) for _ in range(SAMPLE)]
    return own + made


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Labeller fitted on at most ``sample`` pages (the smallest hashes) and ``SAMPLE`` pages in other templates."""
    texts = pages.select(F.col("html").cast("string").alias("html")).where("html IS NOT NULL").withColumn("key", F.xxhash64("html"))
    keys = [r.key for r in texts.select("key").orderBy("key").limit(sample).collect()]  # hashes alone are ranked
    chosen = texts.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect()
    sets = training_pages([r.html for r in chosen])  # at most ``sample`` rows
    return Labeller().fit([block_vectors(b) for b in sets], [np.array([teacher(x) for x in b], np.float64) for b in sets])


def main_texts(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page: its main blocks, one per line.

    A null or empty page, or one without a main block, has an empty text; other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # a fixed number of weights

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            blocks = [page_blocks(h.as_py()) for h in part.column("html")]
            marks = shared.value.label([block_vectors(b) for b in blocks])
            texts = ["\n".join(x.text for x, m in zip(b, p) if m >= 0.5) for b, p in zip(blocks, marks)]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(batches(run), "page_id long, url string, text string, n_chars long")


def op7_block_labeller(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_texts(pages, train(pages))
