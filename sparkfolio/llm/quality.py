"""Quality classifier: similar labelled documents vote, by cosine in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkfolio.llm.common import LOWER, UPPER, carry, restore

TERMS = 4096  # hashed terms
SHAPES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def terms(text: str | None) -> Counter:
    """How often each term stands in the whole text.

    Terms are the shapes of words (letters, capitals, digits and marks, runs made one), short words themselves, words
    which repeat the one before, how varied the words are, and how many there are. A text without words has the last two.
    """
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    found = Counter(RUNS.sub(rb"\1", data.translate(SHAPES)).split())
    for word, n in Counter(data.translate(TO_LOWER).split()).items():
        if len(word) <= 3:
            found[b"w " + word] += n
    n = len(words)
    found[b"same"] = sum(map(eq, words, words[1:]))
    found[b"varied %d" % (8 * len(set(words)) // max(1, n))] = max(1, n // 4)
    found[b"long %d" % n.bit_length()] = 1
    return +found


def matrix(texts: list[str | None]) -> np.ndarray:
    """Log term counts, one row a text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        for term, n in terms(text).items():
            row[zlib.crc32(term) % TERMS] += n
    return np.log1p(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Neighbours:
    """Labelled vectors in the latent space, and the way into it."""

    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # of the labelled documents, of length one
    labels: np.ndarray
    k: int

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int, k: int) -> Neighbours:
        """Counts weighted by inverse document frequency, then a truncated singular value decomposition."""
        weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = unit(counts * weight)
        basis = np.random.default_rng(7).standard_normal((TERMS, min(dimensions, TERMS))).astype(np.float32)
        for _ in range(4):  # subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        axes = (basis @ turn.T).astype(np.float32)
        return cls(weight, axes, unit(x @ axes), labels.astype(np.float64), k)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        """Mean label of the k nearest by cosine, weighted by the cosine; exact products, block by block."""
        out = np.full(len(counts), 0.5)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        for at in range(0, len(counts), block):
            cosine = unit(unit(counts[at:at + block] * self.weight) @ self.axes) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            say = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0) ** 4
            total = say.sum(1)
            voted = (say * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[at:at + block] = np.where(total > 0, voted, self.labels.mean())
        return np.clip(out, 0, 1)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, per_class: int, dimensions: int, k: int) -> Neighbours:
    """Fit on at most ``per_class`` rows of each label, those with the smallest hash of their id, outside fold 0."""
    marked = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("label")).where((fold(F.col("id")) != 0) & F.col("label").isNotNull())
    marked = marked.groupBy("id").agg(F.min("label").alias("label"))
    order = (F.xxhash64("id"), F.col("id"))
    sample = marked.where("label = 1").orderBy(*order).limit(per_class).unionAll(marked.where("label = 0").orderBy(*order).limit(per_class))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "id")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at:at + 256]
                found = matrix(some["text"].tolist())
                places = [np.flatnonzero(row) for row in found]
                yield pd.DataFrame({"id": some["id"], "label": some["label"], "place": places, "value": [row[p] for row, p in zip(found, places, strict=True)]})

    kind = docs.schema[doc_id].dataType.simpleString()
    found = rows.select("id", F.col("label").cast("int").alias("label"), "text").mapInPandas(counted, f"id {kind}, label int, place array<int>, value array<float>")
    # bounded: two classes of per_class rows, each with TERMS numbers at most
    got = sorted({(r["id"], r["label"], tuple(r["place"]), tuple(r["value"])) for r in found.toLocalIterator()})
    counts = np.zeros((len(got), TERMS), np.float32)
    for row, (_, _, place, value) in zip(counts, got, strict=True):
        row[list(place)] = value
    return Neighbours.fit(counts, np.array([g[1] for g in got]), dimensions, k)


def classify(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3,
    per_class: int = 1500, dimensions: int = 48, k: int = 15,
) -> DataFrame:
    """The input's columns and ``held_out``, ``score``, ``predicted`` for every document.

    Only labelled rows whose crc32(id as text) mod 5 is not 0 teach; ``held_out`` says that it is 0. Scores depend on the
    whole text alone: 0 to 1, higher where label 1 is likelier. Null text counts as empty, empty text is scored by its
    (missing) words like any other. A null id is not held out. Of several labels of one id the smallest teaches; null
    labels and labels of unknown documents don't. Without labels every score is 0.5. Rows with equal texts have equal
    scores; an empty table gives an empty result. Input columns named like the new ones are replaced.

    The labelled sample is bounded by ``per_class``; its vectors (``2 * per_class`` x ``dimensions``) are broadcast.
    Every document is one row of an exact matrix product in the task that read it; nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, label=label, per_class=per_class, dimensions=dimensions, k=k))

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([np.empty(0), *(model.value.score(matrix(texts[at:at + 512])) for at in range(0, len(texts), 512))]))

    rows = carry(docs, id=doc_id, text=text).withColumn("score", scored("text"))
    held = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return restore(rows, held_out=held, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))
