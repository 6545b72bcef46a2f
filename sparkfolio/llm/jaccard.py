"""N-gram Jaccard join by PartEnum signatures, and the components of its links."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from sparkfolio.llm.common import LOWER, UPPER, cut, pieces_of, stored
from sparkfolio.llm.components import connect

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
ODD, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
BROADCAST_IDS = 1_000_000  # about 32 MB as a hashed relation
GROUP_BLOCK = 2048  # nodes of a group that are compared with as many others in one task
PAIRED = 256  # nodes of a bucket up to which its pairs are rows; larger buckets are compared in groups
PAIR = "a bigint, b bigint, n_a bigint, n_b bigint"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle, none is none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    total, factor = np.zeros(len(h) - width + 1, np.uint64), ODD
    for j in range(width):
        total += h[j:len(h) - width + 1 + j] * np.uint64(factor)
        factor = factor * ODD & ALL
    return np.unique(mix(total))


class PartEnum:
    """Signatures such that two sets with ``den * |r & s| >= num * |r | s|`` share at least one, unless they are equal.

    Sizes fall into bands; the larger set of a similar pair lies in some band j and the smaller in j or j - 1, so a set
    signs for its own band and for the next. In band j the sets differ in at most k elements. The domain is dealt into
    ``n1`` parts, each into ``n2`` cells; at least 1 + spare parts differ in at most ``k2`` elements, and there some
    choice of n2 - k2 cells agrees. Its content is a signature. A choice without elements says nothing and would be shared
    by a fixed share of all sets; a set in which at most ``spare`` parts have one needs none of these. Another set is
    dealt anew by other hashes, up to three times, and only then signs its empty choices as well.
    """

    DEALS = 3

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ends = [1]  # of the bands
        self.shapes: dict[int, tuple[int, int, int, tuple, int]] = {}

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.ends, size))

    def differing(self, band: int) -> int:
        while len(self.ends) <= band:
            self.band(self.ends[-1] + 1)
        return 2 * self.ends[band] * (self.den - self.num) // (self.den + self.num)

    def shape(self, band: int) -> tuple[int, int, int, tuple, int]:
        """k, n1, n2, the choices of cells, spare; the same for all sets that sign in the band.

        With one cell a part, so many parts are spare as the smallest of these sets is expected to leave empty, three
        standard deviations and one more: then hardly a set is dealt twice. Where no number up to ``k + 1`` is enough, since
        each spare part adds an empty one, it is the number that lacks least, and some sets are dealt anew.
        """
        if band not in self.shapes:
            k = self.differing(band)
            if k <= 8:
                self.shapes[band] = k, k // 2 + 2, 3, ((0, 1), (0, 2), (1, 2)), 1
            else:
                least = self.num * (self.ends[band - 1] + 1) / self.den

                def lacking(spare: int) -> float:
                    empty = (k + 1 + spare) * math.exp(-least / (k + 1 + spare))
                    return empty + 3 * math.sqrt(empty) + 1 - spare

                choice = range(2, k + 2)
                spare = next((x for x in choice if lacking(x) <= 0), min(choice, key=lacking))
                self.shapes[band] = k, k + 1 + spare, 1, ((0,),), spare
        return self.shapes[band]

    def __call__(self, items: np.ndarray) -> np.ndarray:
        out = []
        if len(items):
            own = self.band(len(items))
            for band in (own, own + 1):
                if self.shape(band)[0] > 0:  # sets which differ in nothing are equal
                    out += self._signed(items, band)
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _signed(self, items: np.ndarray, band: int) -> list[np.ndarray]:
        _, n1, n2, choices, spare = self.shape(band)
        out = []
        for deal in range(self.DEALS):
            dealt = mix(items + np.uint64((deal + 1) * ODD & ALL))
            cell = ((dealt >> np.uint64(11)) % np.uint64(n1 * n2)).astype(np.int64)
            size = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
            low = np.bincount(cell, (dealt & np.uint64(0xFFFFFFFF)).astype(np.float64), n1 * n2).astype(np.uint64).reshape(n1, n2)
            high = np.bincount(cell, (dealt >> np.uint64(32)).astype(np.float64), n1 * n2).astype(np.uint64).reshape(n1, n2)
            bare = np.zeros(n1, bool)
            made = []
            for c, cells in enumerate(choices):
                cells = list(cells)
                place = np.arange(n1, dtype=np.uint64) + np.uint64(((band * self.DEALS + deal) * 8 + c + 1) * ODD & ALL)
                value = mix(mix(low[:, cells].sum(1) + mix(place)) + high[:, cells].sum(1))
                empty = size[:, cells].sum(1) == 0
                bare |= empty
                made.append((value, empty))
            enough = int(bare.sum()) <= spare
            signs_empty = deal == self.DEALS - 1 and not enough
            out += [value if signs_empty else value[~empty] for value, empty in made]
            if enough:
                break
        return out


def _id_of(items: np.ndarray) -> int:
    """A 64-bit id of the set as a signed number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(items).sum() + mix(np.array([len(items)], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.translate(TO_LOWER).split(), width) for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array([len(x) for x in found], pa.int64()), pa.array([_id_of(x) for x in found], pa.int64())],
                names=["id", "mark", "n", "node"])

    return run


def _signatures(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, seen = PartEnum(num, den), set()
        for batch in batches:
            ids, signed, count = [], [], 0
            for text in _texts(batch.column("text")):
                items = shingle_set(text.translate(TO_LOWER).split(), width)
                node = _id_of(items)
                if len(items) and node not in seen:  # a copy in the same split has the same signatures
                    seen.add(node)
                    own = sign(items)
                    ids.append(np.full(len(own), node, np.int64))
                    signed.append(own.view(np.int64))
                    count += len(own)
                if count > 100_000:
                    yield _pairs(signed, ids)
                    ids, signed, count = [], [], 0
            if count:
                yield _pairs(signed, ids)

    return run


def _pairs(signed: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(signed)), pa.array(np.concatenate(ids))], names=["signature", "node"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and node, those whose signature has several nodes.

    Buckets with the same nodes get the same name, the mixed sum of the nodes, so one of them is left after a distinct;
    the name of a very large bucket, passed on in parts, is its signature.
    """
    large = 200_000
    rest_s, rest_n = np.empty(0, np.int64), np.empty(0, np.int64)
    whole: int | None = None  # the signature of a bucket of which a part went on

    def out(s: np.ndarray, n: np.ndarray, whole: int | None) -> pa.RecordBatch | None:
        if not len(s):
            return None
        same = np.r_[False, (s[1:] == s[:-1]) & (n[1:] == n[:-1])]
        s, n = s[~same], n[~same]
        first = np.r_[True, s[1:] != s[:-1]]
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        if whole is not None and s[0] == whole:
            size[0] += 2
        starts = np.flatnonzero(first)
        name = np.add.reduceat(mix(n.view(np.uint64)), starts).view(np.int64)
        if whole is not None:
            name[s[starts] == whole] = whole
        keep = (size > 1)[group]
        return pa.RecordBatch.from_arrays([pa.array(name[group][keep]), pa.array(n[keep])], names=["bucket", "node"]) if keep.any() else None

    for batch in batches:
        s = np.concatenate([rest_s, batch.column(0).to_numpy()])
        n = np.concatenate([rest_n, batch.column(1).to_numpy()])
        if not len(s):
            continue
        last = int(np.searchsorted(s, s[-1]))  # the last bucket may go on in the next batch
        if len(s) - last > large:
            if last and (b := out(s[:last], n[:last], whole)):
                yield b
            whole = int(s[-1])
            if b := out(s[last:-1], n[last:-1], whole):
                yield b
            last = len(s) - 1
        elif last and (b := out(s[:last], n[:last], whole)):
            yield b
        rest_s, rest_n = s[last:], n[last:]
    if b := out(rest_s, rest_n, whole):
        yield b


def odd_sketch(items: np.ndarray) -> bytes:
    """A bit for each of m places, set where an odd number of elements fall; m is 4 to 8 times the number of elements.

    The sketches of two sets differ in no more bits than the sets in elements. Half as many places are the two halves' xor.
    """
    places = max(64, 4 << (len(items) - 1).bit_length())
    at = (mix(items ^ np.uint64(ODD)) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def _quarter(sketch: bytes) -> bytes:
    """The odd sketch of a quarter of the places, at least 64: enough to rule out most pairs."""
    bits = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(bits.reshape(min(4, len(bits)), -1), axis=0).tobytes()


def _differ(one: bytes, two: bytes) -> int:
    """At least so many elements are in one set alone, by their odd sketches."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _bodies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for node in batch.column("node").to_pylist():  # rows which repeat an id and its text
                new.append(node not in seen)
                seen.add(node)
            batch = batch.filter(pa.array(new, pa.bool_()))
            words = [t.translate(TO_LOWER).split() for t in _texts(batch.column("text"))]
            sketch = [odd_sketch(shingle_set(w, width)) for w in words]
            body = [zlib.compress(b" ".join(w), 1) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *(pa.array(x, pa.binary()) for x in (map(_quarter, sketch), sketch, body))], names=["node", "few", "sketch", "body"])

    return run


def _may_link(num: int, den: int, column: str):
    """Pairs whose sketches do not rule out the similarity: sound, for sketches never differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (den - num) // (den + num)
            rows = zip(batch.column(f"{column}_a").to_pylist(), batch.column(f"{column}_b").to_pylist(), most.tolist(), strict=True)
            keep = pa.array([_differ(x, y) <= m for x, y, m in rows], pa.bool_())
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(keep)

    return run


def _compare(num: int, den: int):
    """Of two blocks of a group, or one with itself, the pairs of different labels whose sketches may link."""

    def run(table: pa.Table) -> pa.Table:
        own, node, n, label = (table.column(c).to_numpy() for c in ("own", "node", "n", "label"))
        one = own == table.column("i")[0].as_py()
        two = own == table.column("j")[0].as_py()
        sketches = [np.frombuffer(x, np.uint64) for x in table.column("few").to_pylist()]
        width = np.array([len(x) for x in sketches])
        found: list[tuple[np.ndarray, ...]] = []
        for w in np.unique(width):
            # similar sets have sketches of this width or of twice that, whose halves fold into one
            narrow, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            bits = np.array([sketches[i] for i in narrow] + [sketches[i][:w] ^ sketches[i][w:] for i in wide])
            places, is_narrow = np.concatenate([narrow, wide]), np.arange(len(bits)) < len(narrow)
            step = max(1, 2_000_000 // max(1, bits.size))
            for at in range(0, len(bits), step):
                x, rows = places[at:at + step], slice(at, at + step)
                apart = np.bitwise_count(bits[rows, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int32)
                most = (n[x][:, None] + n[places][None, :]) * (den - num) // (den + num)
                p, q = np.nonzero(apart <= most)
                p += at
                x, y = places[p], places[q]
                ok = (label[x] != label[y]) & (is_narrow[p] | is_narrow[q]) & (node[x] < node[y])
                ok &= (one[x] & two[y]) | (two[x] & one[y])
                ok &= den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
                x, y = x[ok], y[ok]
                found.append((node[x], node[y], n[x], n[y]))
        return pa.table({name: pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k, name in enumerate(("a", "b", "n_a", "n_b"))})

    return run


def _verify(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(node: int, body: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[node] = shingle_set(zlib.decompress(body).split(), width)
            return sets[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                r, s = of(x, batch.column("body_a")[i].as_py()), of(y, batch.column("body_b")[i].as_py())
                both = len(np.intersect1d(r, s, assume_unique=True))
                linked.append(den * both >= num * (len(r) + len(s) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def shingle_classes(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``id``, ``mark`` (hash of the text), ``n`` (size of the shingle set) and ``node`` (its 64-bit id) of each row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("mark"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(_sets(width), f"id {docs.schema[doc_id].dataType.simpleString()}, mark bigint, n bigint, node bigint")


def similar_sets(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100, spanning: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets, links and labels of all documents whose shingle sets have a Jaccard similarity of num / den or more.

    Sets: ``id``, ``mark``, ``n``, ``node``; rows with equal sets have the same node. Links: the pairs ``a``, ``b`` of different nodes,
    each once. With ``spanning``, pairs which other links connect already may be left out. Labels: ``node``, ``label`` of
    all nodes with a link; nodes have the same label exactly if links connect them.

    Null and empty texts have an empty set, which is linked with nothing. Null ids and repeated rows are kept, and each of
    several texts under one id has its own set and links. An empty table gives empty results.

    Plan: equal sets fold into one node before anything else. One shuffle brings equal signatures together, sorted on disk
    where need be. Buckets with the same nodes count once. First the node of a bucket which meets most others is tested
    against them; that joins a large group of near copies by a test for each member. Where nodes of several components are
    left in a bucket of at most ``PAIRED`` nodes, each two of them are a pair. Nodes left in larger buckets are compared in
    groups, block against block. Pairs are tested by sketches of half a byte to a byte an element, first by a quarter of
    their places; these rule out most pairs below the similarity and none above it. Texts travel compressed, those of
    pairs left only. To be sure that no two of the g candidates in a group of large buckets are linked takes g * g / 2
    comparisons of sketches, which no hash spares; they are spread over the tasks.
    """
    sets = cut(shingle_classes(docs, doc_id, text, width))
    nodes = sets.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("of"), F.first("n").alias("n"))
    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("text"))
    signed = rows.mapInArrow(_signatures(width, num, den), "signature bigint, node bigint")
    found = signed.repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(_buckets, "bucket bigint, node bigint")
    members = cut(found.distinct())
    sizes = members.groupBy("bucket").agg((F.count(F.lit(1)) - 1).alias("others"))
    weight = members.join(sizes, "bucket").groupBy("node").agg(F.sum("others").alias("weight"))
    known = cut(weight.join(nodes, "node"))
    by_rank = Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "node")
    ranked = cut(members.join(known.select("node", "weight", "n"), "node").select("bucket", "node", "n", (F.row_number().over(by_rank) - 1).alias("rank")))
    made = _with_node(docs, doc_id, text, known).mapInArrow(_bodies(width), "node bigint, few binary, sketch binary, body binary")
    chosen = sets.join(known.select("node", "of"), "node").where(F.col("id").eqNullSafe(F.col("of.id")) & (F.col("mark") == F.col("of.mark")))
    if chosen.groupBy("node").count().where("count > 1").take(1):  # rows which repeat an id and its text
        made = made.dropDuplicates(["node"])
    bodies = stored(made, "bodies")
    labels = known.select("node", F.col("node").alias("label"))

    def tested(pairs: DataFrame) -> DataFrame:
        """The pairs that are links: by a quarter of the sketches, by whole ones, then by the texts of what is left."""
        for column in ("few", "sketch"):
            pairs = cut(_with_both(pairs, bodies, column).mapInArrow(_may_link(num, den, column), PAIR))
        met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        some = bodies.join(F.broadcast(met) if met.count() <= BROADCAST_IDS else met, "node", "left_semi")
        return cut(_with_both(pairs, some, "body").mapInArrow(_verify(width, num, den), "a bigint, b bigint"))

    def ordered(met: DataFrame) -> DataFrame:
        """Pairs of ``node`` and ``p`` whose sizes allow the similarity, each once."""
        met, first = met.where(den * F.least("n", "p_n") >= num * F.greatest("n", "p_n")), F.col("node") < F.col("p")
        return met.select(
            F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"), F.when(first, F.col("n")).otherwise(F.col("p_n")).alias("n_a"),
            F.when(first, F.col("p_n")).otherwise(F.col("n")).alias("n_b")).distinct()

    # each bucket's foremost node against the others
    front = ranked.where("rank = 0").select("bucket", F.col("node").alias("p"), F.col("n").alias("p_n"))
    links = tested(ordered(front.join(ranked.where("rank > 0"), "bucket")))
    if spanning:
        labels = cut(_relabel(labels, links))

    # each two nodes of different components in a small bucket
    placed, open_ = _open(ranked, labels)
    open_ = cut(open_)
    small = placed.join(open_.where(F.col("nodes") <= PAIRED).select("bucket"), "bucket").select("bucket", "node", "n", "label")
    other = small.select("bucket", F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("label").alias("p_label"))
    pairs = ordered(small.join(other, "bucket").where("node < p and label <> p_label"))
    more = tested(pairs if spanning else pairs.join(links, ["a", "b"], "left_anti"))
    links = links.unionAll(more)
    if spanning and more.take(1):
        labels = cut(_relabel(labels, more))

    # nodes which share large buckets that are not of one component yet, directly or through others, form a group
    large = ranked.join(open_.where(F.col("nodes") > PAIRED).select("bucket"), "bucket", "left_semi")
    if large.take(1):
        placed, open_ = _open(large, labels)
        roots = cut(connect(placed.join(open_, "bucket").select("node", "m")))
        sketches = bodies.select("node", "few").join(known.select("node", "n"), "node")
        rows = roots.join(sketches, "node").join(labels, "node").select("root", "node", "n", "label", "few")
        sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_BLOCK)).cast("int").alias("blocks"))
        rows = rows.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("root", "i", "j", "own", "node", "n", "label", "few")
        sent = sizes.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("nodes")), "root").agg(F.sum(F.col("blocks") * F.col("nodes"))).first()[0]
        rows = rows.repartition(pieces_of(sent or 0, 2 * GROUP_BLOCK), "root", "i", "j")  # tasks of like work, however few bytes
        likely = cut(rows.groupBy("root", "i", "j").applyInArrow(_compare(num, den), PAIR))
        more = tested(likely if spanning else likely.join(links, ["a", "b"], "left_anti"))
        links = links.unionAll(more)
        if spanning and more.take(1):
            labels = _relabel(labels, more)
    return sets, links, labels if spanning else _relabel(labels, links)


def _open(ranked: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets' rows with their labels, and the buckets of several labels: ``m``, the least node, and ``nodes``, their number."""
    placed = ranked.join(labels, "node")
    of = placed.groupBy("bucket").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.min("node").alias("m"), F.count(F.lit(1)).alias("nodes"))
    return placed, of.where("x < y").select("bucket", "m", "nodes")


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of either node."""
    for side in "ab":
        pairs = pairs.join(of.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def _with_node(docs: DataFrame, doc_id: str, text: str, known: DataFrame) -> DataFrame:
    """The text of one document of each candidate node, once for each row that repeats it.

    A document is known by its id and a hash of its text, since ids may be null or repeat. Texts move only if the
    candidates are too many to broadcast.
    """
    wanted = known.select(F.col("of.id").alias("of"), F.col("of.mark").alias("of_mark"), "node")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("mark"), F.col(f"`{text}`").cast("binary").alias("text"))
    if known.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).select("node", "text")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components which new links connect."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("u"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("v"))
    between = links.join(a, "a").join(b, "b").where("u <> v").select("u", "v").distinct()
    roots = connect(between)
    moved = labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
    return moved.select("node", F.coalesce("root", "label").alias("label"))


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100,
) -> DataFrame:
    """Each row's id, ``n_shingles`` and ``component_id``, the smallest id which links reach, its own included.

    Rows with an empty set are their own component. A null id counts as larger than any other and is the component's id
    only if it has no other. See ``similar_sets`` for the rest.
    """
    sets, _, labels = similar_sets(docs, doc_id=doc_id, text=text, width=width, num=num, den=den, spanning=True)
    placed = sets.join(labels, "node", "left").select("id", "n", F.coalesce("label", "node").alias("label"))
    first = placed.where("n > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    out = placed.join(first, "label", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"))
