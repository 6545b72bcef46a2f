"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfolio.llm.common import cut, pieces_of


MOST = 2 ** 63 - 1  # scores beyond fit no long
HUGE = 1.7976931348623157e308  # the largest double


def _rows(table: pa.Table, vector: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector the rows which have it and their matrix."""
    table = table.combine_chunks()
    column = table.column(vector).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((rows, flat[starts[rows][:, None] + np.arange(n)]))
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | bool]:
    """Exact products and which of them fit; by floating point where every sum is below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0 ** 53:
        return np.rint(a @ b.T).astype(np.int64), True
    if most < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T, True
    whole = np.vectorize(int, otypes=[object])
    scores = whole(a) @ whole(b).T
    fits = (abs(scores) <= MOST).astype(bool)
    return np.where(fits, scores, 0).astype(np.int64), fits


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of all rows and which of them fit 64 bits; the few huge vectors are told from the others, which stay fast."""
    plain = (2.0 ** 52 / max(1, a.shape[1])) ** 0.5
    out, fits = np.zeros((len(a), len(b)), np.int64), np.ones((len(a), len(b)), bool)
    parts = [[np.flatnonzero(huge), np.flatnonzero(~huge)] for huge in (np.abs(m).max(1, initial=0) > plain for m in (a, b))]
    for own in parts[0]:
        for among in parts[1]:
            if len(own) and len(among):
                out[np.ix_(own, among)], fits[np.ix_(own, among)] = _exact(a[own], b[among])
    return out, fits


def _blocks(left: pa.Table, right: pa.Table):
    """Scores of queries (rows of right, with their state) against candidates (left), by length of vector; and which pairs count."""
    if not left.num_rows or not right.num_rows:
        return
    ids, queries = left.column("row").to_numpy(), right.column("query").to_numpy()
    own = {m.shape[1]: (r, m) for r, m in _rows(left, "v")}
    for rows, matrix in _rows(right, "asked"):
        if matrix.shape[1] in own:
            among, vectors = own[matrix.shape[1]]
            scores, fits = _scores(matrix, vectors)
            yield rows, among, scores, fits & (ids[among][None, :] != queries[rows][:, None])


def _histogram(bins: int):
    schema = pa.schema([("query", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for rows, _, scores, counts_too in _blocks(left, right):
            own, low, high, width, need = (right.column(c).to_numpy()[rows] for c in ("query", "low", "high", "width", "need"))
            inside = (scores >= low[:, None]) & (scores <= high[:, None]) & counts_too
            q, c = np.nonzero(inside)
            # a range may be wider than a signed number; its differences are exact without sign
            place = ((scores[q, c].astype(np.uint64) - low[q].astype(np.uint64)) // width[q].astype(np.uint64)).astype(np.int64)
            counts = np.bincount(q * bins + place, minlength=len(rows) * bins).reshape(len(rows), bins)
            above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # in higher bins of this block
            # the k-th best of all is no worse than the k-th best here: lower bins can't hold it
            q, b = np.nonzero((counts > 0) & (above < need[:, None]))
            out.append(pa.table([pa.array(own[q], pa.int64()), pa.array(b, pa.int64()), pa.array(counts[q, b], pa.int64())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _select(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
    out = []
    for rows, among, scores, counts_too in _blocks(left, right):
        low, need = (right.column(c).to_numpy()[rows] for c in ("low", "need"))
        keys = left.column("key").take(pa.array(among)).combine_chunks()
        order = np.lexsort((among, keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)))
        among, scores, counts_too = among[order], scores[:, order], counts_too[:, order]
        tie = (scores == low[:, None]) & counts_too
        take = ((scores > low[:, None]) & counts_too) | (tie & (tie.cumsum(1) <= need[:, None]))
        q, c = np.nonzero(take)
        asked, found = pa.array(rows[q]), pa.array(among[c])
        out.append(pa.table([
            right.column("query").take(asked), right.column("query_id").take(asked), left.column("key").take(found), left.column("row").take(found),
            pa.array(scores[q, c], pa.int64())], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def top_k(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, bins: int = 256,
    block: int = 2048, query_block: int = 512,
) -> DataFrame:
    """For each row whose key is divisible by ``every`` its ``k`` best other rows: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x), x as double; the score is the integer inner product; ties go to the smaller
    key. Every row counts, also one that repeats a key: it is a candidate, asks if its key is divisible, and is only left
    out of its own candidates. A null key asks nothing and comes after the others in a tie. Vectors which are null or hold
    null or non-finite components take no part; nor do pairs of different lengths, nor pairs whose score fits no 64-bit
    integer (the other pairs of a huge vector do). With fewer than k others all are returned; an empty table gives an empty
    result. Other columns play no part.

    Both sides are dealt by row into blocks of bounded size; a task scores one block of queries against one of vectors.
    Each round splits every query's range of scores into ``bins``, adds the blocks' counts, and goes on in the bin which
    holds the k-th best, until it is one score wide. Then all better ones and the ties with the smallest keys are written.
    """
    # whole numbers as doubles: beyond 2 ** 53 a double is whole, and only there a long might be too short
    by = lambda x: F.lit(float(scale)) * x.cast("double")
    one = F.transform(F.col(f"`{vector}`"), lambda x: F.when(F.abs(by(x)) < 2.0 ** 53, F.floor(by(x)).cast("double")).otherwise(
        F.greatest(F.lit(-HUGE), F.least(F.lit(HUGE), by(x)))))
    whole = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{vector}`").isNotNull() & whole)
    # a number for each row, since keys may repeat; written with the rows, so that it stays
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("key"), one.alias("v")))
    norm = lambda v: F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x * x))
    asked = rows.where(F.col("key") % every == 0).select(F.col("row").alias("query"), F.col("key").alias("query_id"), F.col("v").alias("asked"))
    count, longest, queries = rows.agg(F.count(F.lit(1)), F.max(norm("v")), F.count(F.when(F.col("key") % every == 0, 1))).first()
    longest = longest or 0.0
    n_blocks, n_queries = pieces_of(count, block), pieces_of(queries, query_block)
    deal = F.xxhash64("row")
    left = rows.select("row", "key", "v", F.pmod(deal, F.lit(n_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"))
    right = asked.select("query", "query_id", "asked", F.pmod(F.xxhash64("query"), F.lit(n_queries)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cb"))
    # scores lie in [-high, high], a little more than the lengths allow by floating point; the first bins cover that
    bound = F.ceil(norm("asked") * F.lit(longest) * F.lit(1 + 1e-9)) + 1
    reach = norm("asked") * F.lit(longest)
    bound = F.when(reach < 9.0e18, bound.cast("long")).otherwise(F.lit(MOST))
    across = lambda c: F.expr(f"{c} div {bins}") + 1
    state = asked.select("query", bound.alias("high")).select("query", (-F.col("high")).alias("low"), "high", F.lit(k).cast("long").alias("need"))
    state = state.select("*", (2 * across("high")).alias("width"))
    state, finished = cut(state), None
    open_ = state.count()
    number = "decimal(20,0)"
    while open_:
        placed = right.join(state, "query").select("qb", "cb", "query", "asked", "low", "high", "width", "need")
        counted = left.groupBy("qb", "cb").cogroup(placed.groupBy("qb", "cb")).applyInArrow(_histogram(bins), "query bigint, bin bigint, n bigint")
        counted = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        so_far = counted.withColumn("with", F.sum("n").over(down)).join(state, "query")
        # the highest bin with which k are reached; with fewer candidates there is none, and all are taken
        hit = so_far.where(F.col("with") >= F.col("need")).groupBy("query").agg(F.max(F.struct("bin", "n", "with")).alias("h"))
        moved = state.join(hit, "query", "left")
        # in wide numbers; a bin ends where its range ends: what lies above was counted before
        start = F.col("low").cast(number) + F.col("h.bin").cast(number) * F.col("width").cast(number)
        end = F.least(F.col("high").cast("decimal(38,0)"), (start + F.col("width").cast(number) - 1).cast("decimal(38,0)"))
        low = F.when(F.col("h").isNull(), F.col("low")).otherwise(start.cast("long"))
        high = F.when(F.col("h").isNull(), F.col("high")).otherwise(end.cast("long"))
        width = F.when(F.col("h").isNull() | (F.col("width") == 1), F.lit(0)).otherwise(F.expr(f"(width + {bins - 1}) div {bins}"))
        need = F.when(F.col("h").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("h.with") - F.col("h.n")))
        after = cut(moved.select("query", low.alias("low"), high.alias("high"), need.cast("long").alias("need"), width.cast("long").alias("width")))
        done_now = after.where("width = 0").select("query", "low", "need")
        finished = done_now if finished is None else finished.unionAll(done_now)
        state = after.where("width > 0")
        open_ = state.count()
    if finished is None:
        return rows.select(F.col("key").alias("query_id"), F.lit(1).alias("rank"), F.col("key").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
    placed = right.join(finished, "query").select("qb", "cb", "query", "query_id", "asked", "low", "need")
    taken = left.groupBy("qb", "cb").cogroup(placed.groupBy("qb", "cb")).applyInArrow(_select, "query bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
