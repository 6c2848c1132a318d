"""Main text of pages by a bidirectional LSTM (numpy) that labels every block of a page in its context.

A page is the sequence of its leaf blocks. A block is a vector: its tag path
(element names and the words of class, id and role) and its words, each hashed
to signed sums, with a few measures (length, share in links, place). The
network reads the whole sequence both ways; every block is labelled with what
it has seen of the page, however long.

Training is on a bounded sample of pages that say themselves what their article
is (an article or main element): those blocks are 1, the rest 0. So that it
does not only learn one site's markup, each sampled page is also laid out anew
with other containers for its article and other surroundings (menus, notices,
forms, sidebars, adverts, comments) whose texts are taken from the sample too.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import batches
from feedweave.llm.html_blocks import KEPT_PATHS, Block, Path, blocks, path_of

PATH_DIM, WORD_DIM, MEASURES = 192, 24, 6
DIM = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 20
#: Pages of the training sample, layouts made of each, and passes over them.
TRAIN_PAGES, LAYOUTS, EPOCHS = 200, 3, 8

#: By path: the vector of its elements, and that with its leaf's marks.
_paths: dict[Path, np.ndarray] = {}
_leaves: dict[Path, np.ndarray] = {}
_NO_PATH = np.zeros(PATH_DIM)


def _signed(tokens, dim: int) -> np.ndarray:
    h = np.array([zlib.crc32(t.encode()) for t in tokens], dtype=np.int64)
    return np.bincount(h % dim, 1.0 - 2.0 * (h >> 20 & 1), dim) if len(h) else np.zeros(dim)


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM), dtype=np.float32)
    for i, b in enumerate(page):
        if len(_paths) + len(_leaves) > KEPT_PATHS:
            _paths.clear()
            _leaves.clear()
        path = b.path if isinstance(b.path, Path) else path_of(b.path)
        whole = _leaves.get(path)
        if whole is None:
            # near elements say more than far ones
            near = {"leaf:" + t for t in list(dict.fromkeys(itertools.islice(path.backwards(), 12)))[:2]}
            above = path.fold(_paths, _NO_PATH, lambda above, own: above + _signed(own.fresh, PATH_DIM) if own.fresh else above)
            whole = _leaves[path] = (above + _signed(near, PATH_DIM)).astype(np.float32)
        out[i, :PATH_DIM] = whole
        words = b.text.split()
        out[i, PATH_DIM:PATH_DIM + WORD_DIM] = _signed(words, WORD_DIM) / math.sqrt(len(words))
        n = len(b.text)
        out[i, PATH_DIM + WORD_DIM:] = math.log1p(n) / 5, b.linked / n, b.text[-1] in ".!?…", len(words) < 4, i / len(page), 1.0
    return out


class Labeller:
    """Two LSTMs and a logistic output; states beyond a sequence's end are held."""

    def __init__(self, seed: int = 0):
        rng = np.random.Generator(np.random.PCG64(seed))
        one = lambda: {"x": rng.standard_normal((DIM, 4 * HIDDEN)) / math.sqrt(DIM), "h": rng.standard_normal((HIDDEN, 4 * HIDDEN)) / math.sqrt(HIDDEN), "b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p = {f"{d}{k}": v.astype(np.float32) for d in "fr" for k, v in one().items()}
        self.p |= {"o": (rng.standard_normal(2 * HIDDEN) / math.sqrt(HIDDEN)).astype(np.float32), "ob": np.zeros(1, np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states (T, B, H), forward in time; keep: what the gradients need."""
        steps, size = x.shape[0], x.shape[1]
        pre = (x.reshape(-1, DIM) @ self.p[d + "x"] + self.p[d + "b"]).reshape(steps, size, -1)
        h = c = np.zeros((size, HIDDEN), np.float32)
        out, held = np.zeros((steps, size, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.p[d + "h"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN:(k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                held.append((i, f, o, g, c, squashed, h, m))
            c = m * new + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out, held

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, fk = self._run("f", x, mask, keep)
        r, rk = self._run("r", x[::-1], mask[::-1], keep)
        both = np.concatenate([f, r[::-1]], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, fk, rk

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, both, fk, rk = self.logits(x, mask, keep=True)
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        out = {"o": np.tensordot(dz, both, axes=([0, 1], [0, 1])), "ob": np.array([dz.sum()])}
        d_both = dz[..., None] * self.p["o"]
        for d, held, xs, dh_all in (("f", fk, x, d_both[..., :HIDDEN]), ("r", rk, x[::-1], d_both[::-1, :, HIDDEN:])):
            gx, gh, gb = (np.zeros_like(self.p[d + k]) for k in "xhb")
            dh = dc = np.zeros_like(dh_all[0])
            for t in range(len(held) - 1, -1, -1):
                i, f, o, g, c, squashed, h, m = held[t]
                dh = dh + dh_all[t]
                do = dh * m * squashed
                dn = dc * m + dh * m * o * (1 - squashed ** 2)
                dpre = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g ** 2)], axis=1)
                gx += xs[t].T @ dpre
                gh += h.T @ dpre
                gb += dpre.sum(axis=0)
                dh = dh * (1 - m) + dpre @ self.p[d + "h"].T
                dc = dc * (1 - m) + dn * f
            out |= {d + "x": gx, d + "h": gh, d + "b": gb}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, size: int = 16, rate: float = 0.01, seed: int = 0) -> None:
        """pages: features and labels of each page's blocks. Adam on batches of pages of like length."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first, second, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[i:i + size] for i in range(0, len(order), size)]
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                y = np.zeros_like(mask)
                for j, i in enumerate(groups[k]):
                    y[:len(pages[i][1]), j] = pages[i][1]
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - rate * first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """Whether each block of each page belongs to its main text; batches hold about ``most`` blocks, a page is never cut."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]]) <= most:
                to += 1
            x, mask = padded([pages[i] for i in order[at:to]])
            z = self.logits(x, mask)[0]
            for j, i in enumerate(order[at:to]):
                out[i] = z[:len(pages[i]), j] > 0
            at = to
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), DIM), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


#: Names by which sites mark the article and what surrounds it.
ARTICLE_NAMES = ["article", "main", "post-content", "entry-content", "article-body", "story", "content", "post", "body-text", "main-content"]
SURROUNDINGS = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "topnav", "toc"], "header": ["header", "masthead", "site-header", "banner", "top"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "colophon"], "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal"], "advert": ["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "sponsored"],
    "form": ["newsletter", "subscribe", "search", "signup", "login"], "comments": ["comments", "comment-list", "disqus", "responses", "reader-comments", "comment"],
    "share": ["share", "social", "tags", "byline", "meta", "pagination"],
}
_OUTSIDE = frozenset("nav header footer aside form".split()) | {n for names in SURROUNDINGS.values() for n in names}


def own_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks inside an article or main element, but not in what surrounds it; None if the page has no such element."""
    known: dict[Path, tuple[bool, bool]] = {}
    marks = [b.path.fold(known, (False, False), lambda above, own: (above[0] or not {"article", "main"}.isdisjoint(own.names), above[1] or not _OUTSIDE.isdisjoint(own.names))) for b in page]
    inside = [article and not outside for article, outside in marks]
    return np.array(inside, dtype=np.float32) if any(inside) and not all(inside) else None


def laid_out(texts: list[Block], others: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The article's blocks in another site's markup, with the others' texts around them."""
    pick = lambda names: names[int(rng.integers(len(names)))]
    shell = ("html", "body", *[("div", pick(["wrap", "page", "container", "site", "outer"]))[i] for i in range(2) if rng.random() < 0.5])

    def around(kind: str) -> list[Block]:
        name = pick(SURROUNDINGS[kind])
        if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5:
            path = (*shell, kind) + ((name,) if rng.random() < 0.5 else ())
        elif kind == "comments" and rng.random() < 0.3:
            path = (*shell, "section", name)
        else:
            path = (*shell, pick(["div", "section", "ul"]), *name.split("-"))
        out = []
        for _ in range(int(rng.integers(1, 7 if kind in ("nav", "comments", "aside") else 4))):
            long = kind in ("comments", "notice", "advert", "aside") and rng.random() < 0.7
            words = pick(others).split()
            words = words[:int(rng.integers(5, 60))] if long else words[:int(rng.integers(1, 6))]
            link = kind in ("nav", "aside", "footer", "share") and rng.random() < 0.7
            leaf = ("ul", "li", "a") if kind == "nav" else ((pick(["p", "div", "li", "span", "h3"]),) if rng.random() < 0.8 else ()) + (("a",) if link else ())
            text = " ".join(words)
            # a link is closed before its block ends: the path holds what encloses the whole block
            out.append(Block(text, path + tuple(x for x in leaf if x != "a"), len(text) if link else 0))
        return out

    kinds = list(SURROUNDINGS)
    before = [b for k in ("header", "nav", "notice", "advert", "form", "aside", "share") if rng.random() < 0.4 for b in around(k)]
    after = [b for k in ("share", "advert", "comments", "aside", "form", "nav", "footer", "notice") if rng.random() < 0.45 for b in around(k)]
    name = pick(ARTICLE_NAMES)
    holder = (*shell, name) if name in ("article", "main") else (*shell, pick(["div", "section", "article", "main"]), *name.split("-"))
    leaves = ["p"] * 8 + ["h2", "li", "blockquote", "td", "div"]
    article: list[Block] = []
    labels: list[int] = []
    for i, b in enumerate(texts):
        leaf = "h1" if i == 0 and rng.random() < 0.8 else pick(leaves)
        article.append(Block(b.text, (*holder, *(("ul",) if leaf == "li" else ()), leaf), 0))
        labels.append(1)
        if rng.random() < 0.03:
            inner = around(pick([k for k in kinds if k != "comments"]))
            article += [Block(x.text, (*holder, *x.path[len(shell):]), x.linked) for x in inner]
            labels += [0] * len(inner)
    return before + article + after, np.array([0] * len(before) + labels + [0] * len(after), dtype=np.float32)


def train(pages: list[str], seed: int = 0, layouts: int = LAYOUTS, epochs: int = EPOCHS) -> Labeller:
    rng = np.random.Generator(np.random.PCG64(seed))
    parsed = [blocks(p) for p in pages]
    labels = [own_labels(p) for p in parsed]
    articles = [[b for b, y in zip(p, own, strict=True) if y] for p, own in zip(parsed, labels, strict=True) if own is not None]
    # as they are (twice, beside the layouts made of them)
    data = [(features(p), own) for p, own in zip(parsed, labels, strict=True) if own is not None] * 2
    others = [b.text for a in articles for b in a] or ["text"]
    articles = articles or [[Block("Some plain words of a text.", (), 0)] * 4]
    # a small sample is laid out more often
    for a in articles:
        for _ in range(max(layouts, TRAIN_PAGES * layouts // len(articles))):
            made, y = laid_out(a[:40], others, rng)
            data.append((features(made), y))
    model = Labeller(seed)
    model.fit(data, epochs, seed=seed)
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES, seed: int = 0) -> DataFrame:
    """One row per page: id, url, text (the blocks of the main text, joined by a line feed; empty if none), n_blocks (all).

    The training sample is the ``train_pages`` pages of the smallest hash of id
    and html; one task trains on it. Null html
    counts as empty: no blocks, empty text. A page is read whole, in time that
    grows with its length. Null ids and urls are kept;
    repeated rows are read one by one. Other columns are not read. An empty
    table gives an empty result.
    """
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    chosen = plain.select("id", "html", F.xxhash64("id", "html").alias("h")).orderBy("h").limit(train_pages).select("html")

    def fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [x for batch in rows for x in batches.as_str(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sample, seed).p)], pa.binary())], ["model"])

    # one task: the sample is bounded; the weights have a fixed size
    fitted = chosen.coalesce(1).mapInArrow(fit, "model binary").first()
    model = pages.sparkSession.sparkContext.broadcast(bytes(fitted["model"]) if fitted else pickle.dumps(Labeller(seed).p))
    kind = plain.schema["id"].dataType.simpleString()

    def label(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = pickle.loads(model.value)
        for batch in batches.slices(rows, text=2):
            parsed = [blocks(x) for x in batches.as_str(batch.column(2))]
            kept = labeller.label([features(p) for p in parsed])
            text = ["\n".join(b.text for b, y in zip(p, own, strict=True) if y) for p, own in zip(parsed, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, parsed), pa.int64())], ["id", "url", "text", "n_blocks"])

    return plain.mapInArrow(label, f"id {kind}, url string, text string, n_blocks long").withColumnsRenamed({"id": id_col, "url": url_col})
