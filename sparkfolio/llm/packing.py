"""Best-fit packing: documents become token pieces, and the pieces fill as few training sequences as they can."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import LOWER, UPPER, cut, pieces_of

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

PART = "array<struct<doc_id: {id}, piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: array<int>, offset: bigint>>"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest items first, each into the open bin with the least room that still holds it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while an open bin has room r
    made = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, made
            made += 1
        bins[item] = bin_
        if room > length:
            if not with_room[room - length]:
                rooms |= 1 << (room - length)
            with_room[room - length].append(bin_)
    return bins


class WordEncoder:
    """Token ids of whole texts, by way of a bounded memory of words.

    Holds for tokenizers which lower-case, drop white space, never join across it, and part a run of letters from the
    mark after it: then a text's ids are those of its words, one after the other.
    """

    def __init__(self, tokenizer: str, remember: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in tokenizer:  # a name among the installed public ones
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer, self.remember = Tokenizer.from_file(tokenizer), remember
        self.known: dict[bytes, bytes] = {}
        self.marks = {m: self._encode([m])[0] for m in (b".", b",")}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as unsigned little-endian 32-bit numbers."""
        # a special token's name in capitals is ordinary text and must stay so
        split = [(t if b"<|" in t else t.translate(TO_LOWER)).split() for t in texts]  # on ASCII white space alone
        known = self.known
        missing = [w for w in set().union(*split) if w not in known]
        parted = {w: w[:-1] for w in missing if w[-1:] in self.marks and w[:-1].decode().lower().isalpha()}
        own = {w: b"" for w in missing if w not in parted} | {w: b"" for w in parted.values() if w not in known}
        own = dict(zip(own, self._encode(list(own)), strict=True))
        room = self.remember - len(known)
        if room > 0:
            known.update((w, x) for w, x in islice(own.items(), room) if len(w) <= 32)
        for word, core in parted.items():
            own[word] = (own[core] if core in own else known[core]) + self.marks[word[-1:]]
        return [b"".join([own[w] if w in own else known[w] for w in words]) for words in split]


@lru_cache(2)
def encoder(tokenizer: str) -> WordEncoder:
    """One for each Python worker, which keeps what it has learnt from task to task."""
    return WordEncoder(tokenizer)


def _bins(parts: pa.ListArray, item_lengths: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Best fit of items, each a list of parts: one row per bin with its parts, their offsets renewed."""
    bin_of = best_fit(item_lengths, capacity)
    order = np.argsort(bin_of, kind="stable")
    taken = parts.take(pa.array(order))
    flat = taken.flatten()
    counts = np.diff(taken.offsets.to_numpy())
    first = np.searchsorted(bin_of[order], np.arange(bin_of.max() + 1 if len(bin_of) else 0))
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = np.concatenate([ends[first], ends[-1:]])
    lengths = flat.field("length").to_numpy()
    before = np.concatenate([[0], np.cumsum(lengths)])
    offset = before[:-1] - np.repeat(before[starts[:-1]], np.diff(starts))
    names = [f.name for f in flat.type]
    fields = [pa.array(offset, pa.int64()) if n == "offset" else flat.field(n) for n in names]
    again = pa.StructArray.from_arrays(fields, names=names)
    total = pa.array(np.diff(before[starts]), pa.int64())
    return pa.RecordBatch.from_arrays([total, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), again)], names=["total", "parts"])


def _cut_and_fit(tokenizer: str, capacity: int, eos: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = encoder(tokenizer), np.array([eos], dtype="<u4").tobytes(), 4 * capacity
        columns: list[list] = [[], [], [], [], [], []]
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                encoded = encode([text or b"" for text in some.column(1).to_pylist()])
                for doc, data in zip(some.column(0).to_pylist(), encoded, strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), width)):
                        own = data[at:at + width]
                        ids = np.frombuffer(own, dtype="<u4").astype("int32").tolist() if with_ids else None
                        for column, value in zip(columns, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own), ids), strict=True):
                            column.append(value)
        if not columns[0]:
            return
        kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        n = len(columns[0])
        flat = pa.StructArray.from_arrays([*arrays, pa.array(np.zeros(n, np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "offset"])
        one_each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), flat)
        yield from _small(_bins(one_each, np.array(columns[3]), capacity))

    return run


def _small(rows: pa.RecordBatch, size: int = 2048) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, size):
        yield rows.slice(at, size)


def _merge(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            whole = pa.Table.from_batches(rows).combine_chunks()
            parts = whole.column("parts").chunk(0) if whole.column("parts").num_chunks else None
            yield from _small(_bins(parts, whole.column("total").to_numpy(), capacity))

    return run


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 4096,
    eos: int = 1, slack: int = 32, task_bins: int = 20_000, with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; only longer documents are cut.

    A document is its token ids and ``eos``. Pieces are ``capacity`` tokens long, the last one may be shorter. Returns a row
    per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset, and the token ids with ``with_ids``.

    Null and empty texts are one piece with ``eos`` alone. Null ids and repeated rows are packed like any other row. Ties of
    length go in the order of the rows. An empty table gives an empty result. Other columns of the input are left out.

    Hierarchical residual packing: every task cuts the documents of its split and best-fits the pieces (the state is some
    fifty bytes a piece). Bins with at most ``slack`` tokens of room are done. The others are dealt to fewer tasks of about
    ``task_bins`` bins, as items of the next best-fit round, until one task holds the rest or a round no longer joins a
    twentieth of them (pieces over half a sequence never fit together; what is left is then final). A bin holds at most
    ``capacity`` pieces, so rows are bounded. Texts are never shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"total bigint, parts {PART.format(id=kind)}"
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    bins = cut(rows.mapInArrow(_cut_and_fit(tokenizer, capacity, eos, with_ids), schema))
    done, left = [bins.where(F.col("total") >= capacity - slack)], bins.where(F.col("total") < capacity - slack)
    count = left.count()
    while count > 1:
        tasks = pieces_of(count, task_bins)
        merged = cut(left.repartition(tasks).mapInArrow(_merge(capacity), schema))
        done.append(merged.where(F.col("total") >= capacity - slack))
        left = merged.where(F.col("total") < capacity - slack)
        before, count = count, left.count()
        if tasks == 1 or count > 0.95 * before:
            break
    sequences = reduce(DataFrame.unionAll, [*done, left])
    numbered = sequences.select(F.monotonically_increasing_id().alias("sequence_id"), "parts")
    out = numbered.select("sequence_id", F.explode("parts").alias("p"))
    more = [F.col("p.ids").alias("ids")] if with_ids else []
    return out.select(
        F.col("p.doc_id").alias(doc_id), F.col("p.piece").alias("piece"), F.col("p.start").alias("start"), F.col("p.length").alias("length"),
        F.col("p.ids_crc32").alias("ids_crc32"), "sequence_id", F.col("p.offset").alias("offset"), *more,
    )
