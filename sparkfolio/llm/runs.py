"""Periodic runs of words, found online by catchers over completed power-of-two blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import carry, restore

FACTOR = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 2 << 20  # of the texts that go through one set of catchers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Level:
    """The catchers of one block size: one for each completed block, until words two sizes further on have come."""

    def __init__(self, size: int) -> None:
        self.size, self.block = size, 0
        self.base, self.prints = 0, np.empty(0, np.uint64)  # fingerprints of the stretches of this size from ``base`` on
        self.doubled = 0  # from here on the next level lacks fingerprints
        self.caught = np.zeros((1, size), bool)  # by the last block, by distance

    def catch(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """Take further fingerprints; new squares as start, period and number of blocks.

        A block's catcher looks for the block at a distance of one to two sizes. Where two blocks in a row come again at one
        distance, a square is caught; the blocks after them which do so too belong to it.
        """
        size = self.size
        self.prints = np.concatenate([self.prints, prints])
        done = (self.base + len(self.prints)) // size - 1
        if done <= self.block:
            return []
        rows = self.prints[self.block * size - self.base:(done + 1) * size - self.base].reshape(-1, size)
        caught = np.concatenate([self.caught, rows[1:] == rows[:-1, :1]])
        squares = caught[1:] & caught[:-1]
        first, self.block, self.caught = self.block, done, caught[-1:]
        found = []
        for row, more in np.argwhere(squares & ~np.concatenate([np.zeros((1, size), bool), squares[:-1]])).tolist():
            blocks = int(np.argmin(np.append(squares[row:, more], False)))
            found.append(((first + row - 1) * size, size + more, blocks))
        return found

    def double(self) -> np.ndarray:
        """Fingerprints of twice the size which are known now; those no longer needed go."""
        end, size = self.base + len(self.prints), self.size
        start = self.doubled
        self.doubled = max(start, end - size)
        left, right = self.prints[start - self.base:self.doubled - self.base], self.prints[start + size - self.base:]
        made = mix(left * FACTOR + right[:len(left)])
        drop = min(self.doubled, self.block * size) - self.base
        self.prints, self.base = self.prints[drop:], self.base + drop
        return made


class Catchers:
    """Runs of a growing row of words: stretches of smallest period q and a length of ``times * q`` and ``least`` or more.

    ``append`` takes any number of words, one or many, as numbers from 0 on. They complete blocks of 1, 2, 4, ... words. A run of
    period q holds at least two blocks in a row of the size s <= q < 2 s which come again at distance q, so the catchers
    of that size see it as a square; compared by fingerprint, then word by word. A square opens a run, which reaches to
    the left as far as its words agree, and to the right with each word appended, until one differs. A square inside a run
    of no longer period belongs to it: its period is then a multiple of the run's, or the same. Levels are taken from small to large, so periods
    are smallest ones. The work is of the order n log n at any input, and grows with no group or count.
    """

    def __init__(self, times: int = 4, least: int = 6, longest: int | None = None) -> None:
        self.times, self.least, self.longest = times, least, longest
        self.words, self.n = np.empty(1024, np.int64), 0
        self.levels = [Level(1)]
        self.open: list[list[int]] = []  # start, period, first place whose word differs from that a period on, or isn't known to agree
        self.closed: list[tuple[int, int, int]] = []  # start, length, period

    def append(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self.words):
            self.words = np.concatenate([self.words[:self.n], np.empty(self.n + len(words), np.int64)])
        self.words[self.n:self.n + len(words)] = words
        self.n += len(words)
        self._advance()
        prints = mix((words.astype(np.uint64) + np.uint64(1)) * FACTOR)
        for level in self.levels:
            squares = level.catch(prints)
            if squares:
                self._merge(level.size, squares)
            prints = level.double()
            if not len(prints) or (self.longest is not None and 2 * level.size > self.longest):
                break
            if level is self.levels[-1]:
                self.levels.append(Level(2 * level.size))

    def finish(self) -> list[tuple[int, int, int]]:
        """Start, length and period of all runs, by start, then period; no words may follow.

        Words that occur nowhere else complete the last blocks and end the runs. ``append`` takes numbers from 0 on.
        """
        longest = self.n // self.times if self.longest is None else self.longest
        self.append(-1 - np.arange(3 * max(1, longest)))
        return sorted(self.closed, key=lambda r: (r[0], r[2]))

    def _long(self, run: tuple[int, int, int]) -> bool:
        return run[1] >= max(self.least, self.times * run[2])

    def _advance(self) -> None:
        still = []
        for run in self.open:
            start, q, reach = run
            run[2] = reach = self._reach(reach, q)
            if reach + q == self.n:
                still.append(run)
            elif self._long((start, reach + q - start, q)):
                self.closed.append((start, reach + q - start, q))
        self.open = still

    def _reach(self, at: int, q: int) -> int:
        """The first place from ``at`` on whose word differs from the one ``q`` on, or has none."""
        step = 16
        while at + q < self.n:
            end = min(at + step, self.n - q)
            differ = self.words[at:end] != self.words[at + q:end + q]
            if differ.any():
                return at + int(differ.argmax())
            at, step = end, 2 * step
        return at

    def _back(self, at: int, q: int) -> int:
        """The first place of the stretch before ``at`` whose words agree with those ``q`` on."""
        step = 16
        while at > 0:
            start = max(0, at - step)
            differ = self.words[start:at] != self.words[start + q:at + q]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = start, 2 * step
        return at

    def _merge(self, size: int, squares: list[tuple[int, int, int]]) -> None:
        runs = sorted(self._spans(size))
        starts = np.array([r[0] for r in runs], np.int64)
        ends = np.maximum.accumulate(np.array([r[1] for r in runs], np.int64)) if runs else starts
        s, q, blocks = np.array(squares).T
        before = np.searchsorted(starts, s, "right") - 1
        known = np.where(before >= 0, np.append(ends, -1)[before], -1)  # to here the words from s on are in a run
        for i in np.flatnonzero(known < s + q + (blocks + 1) * size).tolist():
            first, period, count = squares[i]
            start = first
            while start < first + count * size:
                end = start + period + 2 * size
                reach = self._reach(start, period)
                inside = known[i] >= end if start == first else any(a <= start and end <= b for a, b in self._spans(size))
                if reach + period >= end and not inside:
                    run = (self._back(start, period), period, reach)
                    if reach + period == self.n:
                        self.open.append(list(run))
                    elif self._long((run[0], reach + period - run[0], period)):
                        self.closed.append((run[0], reach + period - run[0], period))
                # goes on only where fingerprints were equal and the words were not
                start = max(start + size, -(-(reach + 1) // size) * size)

    def _spans(self, size: int) -> list[tuple[int, int]]:
        """Starts and ends of the runs of this level's periods or shorter ones; in longer ones there may be others."""
        closed = [(start, start + length) for start, length, q in self.closed if q < 2 * size]
        return closed + [(start, reach + q) for start, q, reach in self.open if q < 2 * size]


def planted(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """Start and period of the repetition that the contract puts into every tenth document."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 else None


def repeated(ids: list[int | None], texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, with the repetitions that the ids ask for."""
    out = []
    for doc_id, text in zip(ids, texts, strict=True):
        words = text.split()
        if at := planted(len(words), doc_id):
            a, p = at
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        out.append(words)
    return out


def runs_of(texts: list[list[bytes]], times: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each text. Texts of like length go through the same catchers, parted by words that occur once."""
    code = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        if len(words) >= least:
            classes.setdefault(len(words).bit_length(), []).append(i)
    for at in classes.values():
        longest = max(len(texts[i]) for i in at)
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in at])
        row = np.empty(starts[-1], np.int64)
        for start, i in zip(starts.tolist(), at, strict=False):
            row[start:start + len(texts[i])] = np.fromiter(map(code.__getitem__, texts[i]), np.int64, len(texts[i]))
        row[starts[1:] - 1] = np.arange(len(at)) + len(code)
        catchers = Catchers(times, least, longest // times)
        catchers.append(row)
        for start, length, period in catchers.finish():
            k = int(np.searchsorted(starts, start, "right")) - 1
            found[at[k]].append((start - int(starts[k]), length, period))
    return found


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Columns of one document: runs, the foremost one, the digests, the words dropped."""
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = words
    if runs:
        keep = np.ones(len(words), bool)
        for s, length, q in runs:
            keep[s + q:s + length] = False
        kept = [words[i] for i in np.flatnonzero(keep)]
    text = b" ".join(kept)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(words), len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), text)


FOUND = ("n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed string")


def periodic_runs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", times: int = 4, least: int = 6, repeat: bool = False,
) -> DataFrame:
    """The input's columns and what periodic runs each text holds, and ``collapsed``, the text without their repetitions.

    A run is a stretch of consecutive words (``[^\\x20\\x09-\\x0D]+``) with smallest period q, of ``times * q`` and
    ``least`` words or more, that no neighbouring word extends. ``n_words``, ``n_runs``; ``start``, ``length``,
    ``period``, ``exponent_milli`` of the longest run (then the first, then that of the smaller period), null without one;
    ``runs_sha256`` over all runs' ``start,length,period`` lines. A word is dropped from ``collapsed`` if a run holds it
    after the run's first period; the others are joined by one blank. With ``repeat`` every tenth document, by the crc32 of
    its id, has a repetition put in first, as the contract of the query asks; a null id asks for none.

    Null and empty texts have no words and no runs. Rows are looked at one by one, so repeated rows have equal results;
    an empty table gives an empty result. Input columns named like the new ones are replaced.

    Plan: no shuffle. Each task runs the catchers over the texts of its split in batches of about 2 MB; a longer text is a
    batch of its own.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    rows = carry(docs, id=doc_id, text=text).select("row")  # the id and the text once, as part of the row
    of_id, of_text = docs.columns.index(doc_id), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("row").field(of_text)]
            ids = batch.column("row").field(of_id).to_pylist() if repeat else [None] * len(texts)
            sizes = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, "right")) - 1)
                words = repeated(ids[at:end], texts[at:end])
                found = list(zip(*map(_digest, words, runs_of(words, times, least)), strict=True))
                columns = [pa.array(c, pa.int64()) for c in found[:6]] + [pa.array(found[6], pa.string()), pa.array(found[7], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, end - at), *columns], names=["row", *names])
                at = end

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {FOUND}")
    return restore(made, **{name: F.col(name) for name in names})
