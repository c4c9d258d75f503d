"""Main text of HTML pages by a bidirectional LSTM over leaf blocks (numpy only).

Each block is a vector of its hashed tag path, its hashed words and a few
sizes; the network reads the page's blocks in both directions and gives every
block the probability of being main text.  It is trained here, on random
pages whose labels are known from their making.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.cluster import ship
from tomoframe.llm import arrow_text, html_training, shared
from tomoframe.llm.html_blocks import Block, blocks

PATH_SIZE, WORD_SIZE, MORE = 256, 96, 7
INPUT, HIDDEN = PATH_SIZE + WORD_SIZE + MORE, 24
TRAIN_PAGES, EPOCHS, BATCH = 700, 5, 14
#: Blocks times pages in one pass of the network at most (a longer page passes alone).
CELLS = 16_384


@functools.lru_cache(1 << 16)
def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block, over all its words; paths count their nearest tags most."""
    out = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        row = out[i]
        n = len(b.path)
        for d, token in enumerate(b.path):
            row[_bucket(token, PATH_SIZE)] += 1.0 if d >= n - 3 else 0.7
        words = b.text.lower().split()
        if words:
            at = np.fromiter((_bucket(w, WORD_SIZE) for w in words), np.int64, len(words))
            row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount(at, minlength=WORD_SIZE) / (1 + len(words))
        stops = b.text.count(".") + b.text.count(",")
        row[-MORE:] = (np.log1p(len(b.text)) / 5, np.log1p(len(words)) / 4, b.linked, min(1.0, stops / (1 + len(words))), b.text.endswith((".", "!", "?")), min(i, 20) / 20, 1.0)
    return out


@dataclass
class BlockLabeller:
    """Weights of both directions and of the output: wx (2, INPUT, 4H), wh (2, H, 4H), b (2, 4H), out (2H + 1)."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> BlockLabeller:
        r = np.random.default_rng(seed)
        b = np.zeros((2, 4 * HIDDEN), np.float32)
        b[:, HIDDEN : 2 * HIDDEN] = 1
        scale = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        return BlockLabeller(scale(2, INPUT, 4 * HIDDEN), scale(2, HIDDEN, 4 * HIDDEN), b, scale(2 * HIDDEN + 1))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: int, keep: list | None) -> np.ndarray:
        """Hidden states (T, N, H) of one direction; x is (T, N, INPUT), mask (T, N, 1)."""
        steps, n, _ = x.shape
        pre = x.reshape(-1, INPUT) @ self.wx[d] + self.b[d]
        pre = pre.reshape(steps, n, 4 * HIDDEN)
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.wh[d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, N) of main-text probabilities."""
        h = np.concatenate([self._run(x, mask, d, None) for d in (0, 1)], 2)
        return 1 / (1 + np.exp(-np.clip(h @ self.out[:-1] + self.out[-1], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over blocks and its gradients, by back-propagation through time."""
        tapes: list[list] = [[], []]
        h = np.concatenate([self._run(x, mask, d, tapes[d]) for d in (0, 1)], 2)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out[:-1] + self.out[-1], -30, 30)))
        m = mask[:, :, 0]
        total = m.sum()
        loss = float(-(m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        e = (p - y) * m / total
        gout = np.concatenate([np.einsum("tn,tnh->h", e, h), [e.sum()]]).astype(np.float32)
        gwx, gwh, gb = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        for d in (0, 1):
            dh_out = e[:, :, None] * self.out[d * HIDDEN : (d + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = np.zeros(h.shape[1:2] + (HIDDEN,), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, g, c, tc, before, mt in reversed(tapes[d]):
                dh = dh + dh_out[t]
                own = mt * dh
                do = own * tc
                dc2 = mt * dc + own * o * (1 - tc * tc)
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g * g)], 1)
                dz_all[t] = dz
                gwh[d] += before.T @ dz
                dh = (1 - mt) * dh + dz @ self.wh[d].T
                dc = (1 - mt) * dc + dc2 * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            gwx[d] = x.reshape(-1, INPUT).T @ flat
            gb[d] = flat.sum(0)
        return loss, [gwx, gwh, gb, gout]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages), 1), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def labelled_page(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of one random page."""
    doc, keep = html_training.page(seed)
    found = blocks(doc)
    want = [" ".join(k.split()) for k in keep]
    labels, at = np.zeros(len(found), np.float32), 0
    inside_head = [b.path and "title" in b.path for b in found]
    for i, b in enumerate(found):
        if at < len(want) and not inside_head[i] and b.text == want[at]:
            labels[i], at = 1, at + 1
    return vectors(found), labels


@functools.lru_cache(1)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 1) -> BlockLabeller:
    """Adam over random pages; the same weights each time, once for each driver process."""
    data = sorted((labelled_page(seed * 1_000_003 + k) for k in range(pages)), key=lambda p: len(p[1]))
    net = BlockLabeller.fresh()
    params = [net.wx, net.wh, net.b, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batches = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    r, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for k in r.permutation(len(batches)):
            x, mask = _padded([p[0] for p in batches[k]])
            y = np.zeros(x.shape[:2], np.float32)
            for j, p in enumerate(batches[k]):
                y[: len(p[1]), j] = p[1]
            _, grads = net.gradients(x, mask, y)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            t += 1
            rate = 0.012 * (0.5 if epoch >= epochs - 2 else 1.0)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 5 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def label_pages(net: BlockLabeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Main-text probabilities of each page's blocks; pages of like length share a pass."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= CELLS and len(pages[order[to]]) <= 2 * len(pages[order[at]]) + 8:
            to += 1
        part = order[at:to]
        x, mask = _padded([vectors(pages[k]) for k in part])
        p = net.probabilities(x, mask)
        for j, k in enumerate(part):
            out[k] = p[: len(pages[k]), j]
        at = to
    return out


def extract(net: BlockLabeller, texts: list[str], threshold: float = 0.5) -> list[str]:
    found = [blocks(t) for t in texts]
    return ["\n".join([b.text for b, p in zip(page, prob, strict=True) if p >= threshold]) for page, prob in zip(found, label_pages(net, found), strict=True)]


def extract_pages(pages: DataFrame, net: BlockLabeller | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null and empty pages, and pages without main text, give the empty text.
    Repeated rows are read one by one, an empty table gives an empty result,
    other columns are ignored.
    """
    ship(pages.sparkSession)
    net = net or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow_text.slices(batch, 2):
                texts = extract(net, part.column(2).to_pylist(), threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(shared.read(spark, sf_dir, "pages"))
