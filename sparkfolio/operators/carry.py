"""Values carried along an ordered group: previous question, previous answer, last heading.

A group may hold a large share of all rows, so a running frame never spans a whole
group. Rows are cut into blocks of consecutive positions, a frame runs inside each
block, and one value per block is passed on to later blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx

BLOCK = 8192


def carry_forward(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], block: int = BLOCK, inclusive: bool = False
) -> DataFrame:
    """Add, per name in ``values``, its last non-null value before the row (or up to it).

    ``order`` is an integer position, unique within ``keys``.
    """
    end = Window.currentRow if inclusive else -1
    marked = df.withColumns({"_block": F.floor(F.col(order) / block), **{f"_v_{n}": v for n, v in values.items()}})
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    local = marked.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    # one row per block: its last value, then the last value of all earlier blocks
    per_block = marked.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_b_{n}") for n in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = per_block.select(
        *keys, "_block", *[F.last(f"_b_{n}", ignorenulls=True).over(earlier).alias(f"_h_{n}") for n in values]
    ).filter(F.coalesce(*[F.col(f"_h_{n}").isNotNull() for n in values]) if len(values) == 1
             else F.greatest(*[F.col(f"_h_{n}").isNotNull() for n in values]))
    joined = local.join(handed, [*keys, "_block"], "left")
    return joined.withColumns({n: F.coalesce(f"_l_{n}", f"_h_{n}") for n in values}).drop(
        "_block", *[p + n for n in values for p in ("_v_", "_l_", "_h_")]
    )


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of ``keys`` up to each row, in the order of ``block``, then ``order``.

    ``block`` never falls as the order goes on. Frames run inside a block; one sum per block goes on to later ones.
    """
    marked = df.withColumns({"_block": block, "_value": value})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return marked.join(sums, [*keys, "_block"]).withColumn(name, F.sum("_value").over(inside) + F.col("_before")).drop("_block", "_value", "_before")


def with_history(turns: DataFrame) -> DataFrame:
    """Add prev_question and prev_answer to every turn of (conv_id, turn, role, text).

    The previous question is the last earlier user text with at least one token that is
    not the current text; when the last one equals the current text, the run before it counts.
    """
    text = tx.trimmed(F.col("text"))
    asks = (F.col("role") == "user") & (F.length(text) > 0) & (F.size(tx.tokens(text)) > 0)
    answers = (F.col("role") != "user") & (F.length(text) > 10)
    first = carry_forward(
        turns, ["conv_id"], "turn",
        {"_last": F.when(asks, text), "prev_answer": F.when(answers, text)},
    )
    changed = asks & F.col("_last").isNotNull() & (text != F.col("_last"))
    second = carry_forward(first, ["conv_id"], "turn", {"_other": F.when(changed, F.col("_last"))})
    return second.withColumn(
        "prev_question", F.when(F.col("_last") == text, F.col("_other")).otherwise(F.col("_last"))
    ).drop("_last", "_other")


def recent_turns(turns: DataFrame, keep: int = 6, cut: int = 500) -> DataFrame:
    """The last turns before each conversation's current question, without repeats of that question."""
    user = F.col("role") == "user"
    current = turns.filter(user).groupBy("conv_id").agg(
        F.max("turn").alias("_at"), F.max_by(tx.trimmed(F.col("text")), "turn").alias("_now")
    )
    text = tx.trimmed(F.col("text"))
    earlier = turns.join(current, "conv_id").filter(
        (F.col("turn") < F.col("_at")) & F.col("role").isin("user", "assistant") & ~(user & (text == F.col("_now")))
    )
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        earlier.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= keep)
        .select("conv_id", "turn", "role", tx.truncate(text, cut).alias("shown"))
    )
