"""HTML extraction: a bidirectional LSTM labels every text block of a page by its tags, its words and all other blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkfolio.llm.blocks import Block, blocks
from sparkfolio.llm.common import carry, restore
from sparkfolio.llm.page_maker import MARK, Maker

PATHS, WORDS, PLAIN = 512, 64, 8


@lru_cache(50_000)
def _place(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block: its whole hashed tag path, far elements with less weight, all its hashed words, and a few plain measures."""
    out = np.zeros((len(page), PATHS + WORDS + PLAIN), np.float32)
    for i, (row, b) in enumerate(zip(out, page, strict=True)):
        elements: list[list[str]] = []
        for token in b.path:
            if token[0] != "." or not elements:
                elements.append([])
            elements[-1].append(token)
        for up, element in enumerate(reversed(elements)):
            weight = max(0.5, 1 - up / 40)
            for token in element:
                place = _place(token, PATHS)
                row[place] = max(row[place], weight)
        if b.path:
            row[_place("leaf " + next(t for t in reversed(b.path) if t[0] != "."), PATHS)] = 1
        words = b.text.split()
        told = np.bincount([_place(word.lower(), WORDS) for word in words], minlength=WORDS)
        row[PATHS:PATHS + WORDS] = np.log2(1 + told) * (0.5 * min(1.0, (12 / max(1, len(words))) ** 0.5))
        n, length = len(words), len(b.text)
        row[-PLAIN:] = (np.log1p(n) / 5, b.linked / max(1, length), length / max(1, n) / 10, b.text[-1] in ".!?:…", n < 5, i / len(page), 1 / (1 + i), b.depth / 10)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Two LSTMs over the blocks of a page, one from each end, and a logistic layer on both."""

    def __init__(self, inputs: int, hidden: int, seed: int) -> None:
        rng, self.hidden = np.random.default_rng(seed), hidden
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, 2 * hidden), "skip": np.zeros(inputs), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"w{d}": rng.normal(0, 0.08, (inputs, 4 * hidden)), f"u{d}": rng.normal(0, 0.15, (hidden, 4 * hidden)), f"c{d}": np.zeros(4 * hidden)}
            self.p[f"c{d}"][hidden:2 * hidden] = 1  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _turn(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Positions which reverse each sequence within its length."""
        at = np.arange(steps)[None, :]
        return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, h = len(x), x.shape[1], self.hidden
        given, u = x @ self.p[f"w{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        out, kept = np.empty((n, steps, h), np.float32), []
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps):
            z = given[:, t] + state @ u
            gate, new = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            i, f, o = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:]
            before, was = cell, state
            cell = f * cell + i * new
            seen = np.tanh(cell)
            state = o * seen
            out[:, t] = state
            if keep:
                kept.append((i, f, o, new, before, seen, was))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, g: dict) -> None:
        h, u = self.hidden, self.p[f"u{d}"]
        to_state, to_cell = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
        dz_all = np.empty((len(x), x.shape[1], 4 * h), np.float32)
        du = np.zeros_like(u)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, new, before, seen, was = kept[t]
            ds = grad[:, t] + to_state
            dc = to_cell + ds * o * (1 - seen * seen)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), ds * seen * o * (1 - o), dc * i * (1 - new * new)], 1)
            to_cell, to_state = dc * f, dz @ u.T
            du += was.T @ dz
            dz_all[:, t] = dz
        flat = dz_all.reshape(-1, 4 * h)
        g[f"w{d}"], g[f"u{d}"], g[f"c{d}"] = x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)

    def _logits(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        turn = self._turn(lengths, x.shape[1])[:, :, None]
        back = np.take_along_axis(x, turn, 1)
        one, kept_f = self._run(x, "f", keep)
        two, kept_b = self._run(back, "b", keep)
        two = np.take_along_axis(two, turn, 1)
        both = np.concatenate([one, two], 2)
        return both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"], both, back, turn, kept_f, kept_b

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int, batch: int, rate: float) -> None:
        """Cross entropy by Adam; pages of like length share a batch."""
        rng, step = np.random.default_rng(1), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = np.argsort([len(p) for p in pages], kind="stable")
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        total = rounds * len(groups)
        for _ in range(rounds):
            for which in rng.permutation(len(groups)):
                own = groups[which]
                x, lengths = _padded([pages[i] for i in own])
                y, _ = _padded([labels[i][:, None] for i in own])
                z, both, back, turn, kept_f, kept_b = self._logits(x, lengths, True)
                inside = np.arange(x.shape[1])[None, :] < lengths[:, None]
                dz = (np.where(inside, _sigmoid(z) - y[:, :, 0], 0) / inside.sum()).astype(np.float32)
                g = {"out": (both * dz[:, :, None]).sum((0, 1)), "skip": (x * dz[:, :, None]).sum((0, 1)), "bias": dz.sum(keepdims=True)[0]}
                grad = dz[:, :, None] * self.p["out"]
                self._back(x, "f", kept_f, grad[:, :, :self.hidden], g)
                self._back(back, "b", kept_b, np.take_along_axis(grad[:, :, self.hidden:], turn, 1), g)
                step += 1
                scale = min(1.0, 5 / max(1e-9, float(np.sqrt(sum((x * x).sum() for x in g.values())))))
                now = rate * (1 - step / (total + 1))
                for k, p in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * (scale * g[k]) ** 2
                    p -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)

    def label(self, pages: list[np.ndarray], cells: int = 8_000) -> list[np.ndarray]:
        """The chance of each block to be part of the article; at most ``cells`` blocks or one page at a time."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order, at = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])), 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= cells:
                to += 1
            x, lengths = _padded([pages[i] for i in order[at:to]])
            chance = _sigmoid(self._logits(x, lengths)[0])
            for row, i in zip(chance, order[at:to], strict=True):
                out[i] = row[:len(pages[i])]
            at = to
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), rows[0].shape[1]), np.float32)
    for place, r in zip(out, rows, strict=True):
        place[:len(r)] = r
    return out, lengths


def made_pages(count: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages made by rule, as blocks, and which blocks belong to the article."""
    maker, pages, labels = Maker(seed), [], []
    while len(pages) < count:
        found = blocks(maker.page())
        if found:
            labels.append(np.array([MARK in b.text for b in found], np.float32))
            for b in found:
                b.text = b.text.replace(MARK, "") or "-"
            pages.append(found)
    return pages, labels


@lru_cache(2)
def trained(pages: int = 1000, rounds: int = 6, hidden: int = 16, seed: int = 5) -> Labeller:
    """The model: learnt from ``pages`` made pages, the same for every input."""
    found, labels = made_pages(pages, seed)
    model = Labeller(PATHS + WORDS + PLAIN, hidden, seed)
    model.fit([vectors(p) for p in found], labels, rounds, 25, 0.015)
    return model


def extract(pages: DataFrame, *, html: str = "html", least: float = 0.5) -> DataFrame:
    """The input's columns, and ``text``, the article's blocks joined by a newline, and ``n_chars``, its code points.

    Null and empty pages have an empty text, so have pages without a block that the labeller takes for the article.
    Character references are decoded, white space within a block is one space, very long pages are read whole. Broken
    markup is read as far as it goes. An empty table gives an empty result. Input columns called text or n_chars are
    replaced.

    The labeller is trained on the driver from made pages, and broadcast (its size is fixed). Pages are independent:
    nothing is shuffled.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())

    @pandas_udf("string")
    def article(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = []
            for at in range(0, len(batch), 256):
                found = [blocks(page) for page in batch.iloc[at:at + 256]]
                chances = model.value.label([vectors(p) for p in found])
                texts += ["\n".join(b.text for b, c in zip(p, chance, strict=True) if c >= least) for p, chance in zip(found, chances, strict=True)]
            yield pd.Series(texts, dtype=object)

    rows = carry(pages, html=html).withColumn("article", article("html"))
    text = F.coalesce("article", F.lit(""))
    return restore(rows, text=text, n_chars=F.char_length(text).cast("long"))
