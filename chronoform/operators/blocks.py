"""Long series in many tasks.

A series of more rows than a task should hold is dealt to blocks that follow one another in its order. Windows that look a few rows around each row get
copies of the neighbouring blocks' rows; running values are taken within a block and what the blocks before bring is added, by a window over one
row a block. Results are those of windows over whole series. Series that are short stay one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoform.sources.storage import cut

#: Blocks of one series at most; beyond that blocks grow.
MOST_BLOCKS = 1024
#: Block ends, or rows about blocks, that may be broadcast.
BROADCAST_ROWS = 5_000_000
BLOCK, NUMBER, OWN = "__block", "__number", "__own"


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def by_series(a: str, b: str, *keys: str) -> Column:
    """Whether rows of two aliased tables are of one series, null being a series."""
    return F.expr(" and ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys))


def deal(df: DataFrame, series: str, order: str, block_rows: int) -> DataFrame:
    """df with the block of each row: blocks hold some ``block_rows`` rows and follow one another in the order; rows of equal order share one.

    Series of up to ``block_rows`` rows are block 0. The ends of the others' blocks are approximate quantiles of their order, a number, date or
    timestamp, so two passes are made over narrow columns. What is broadcast is one value a block.
    """
    if BLOCK in df.columns:
        return df
    sizes = cut(df.groupBy(series).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows))
    if sizes.isEmpty():
        return df.withColumn(BLOCK, F.lit(0))
    sizes = sizes.withColumn("m", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / block_rows)).cast("int"))
    rows = df.select(series, order).alias("d").join(F.broadcast(sizes.select(series, "m")).alias("s"), by_series("d", "s", series)).select(F.col(f"d.{series}").alias(series), order, "m")
    shares = F.array(*[F.lit(i / MOST_BLOCKS) for i in range(1, MOST_BLOCKS)])
    ends = rows.groupBy(series, "m").agg(F.percentile_approx(order, shares, F.lit(10_000)).alias("q"))
    ends = cut(ends.select(series, F.array_distinct(F.expr(f"transform(sequence(1, m - 1), j -> element_at(q, cast(j * {MOST_BLOCKS} / m as int)))")).alias("__ends")))
    total = ends.agg(F.sum(F.size("__ends"))).first()[0] or 0
    joined = df.alias("d").join(small(ends, total).alias("e"), by_series("d", "e", series), "left").select("d.*", "__ends")
    steps = F.array(*[F.lit(MOST_BLOCKS >> i) for i in range(1, MOST_BLOCKS.bit_length())])  # the number of ends at or below the row, bit by bit
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get("__ends", a + s - 1) <= F.col(order), a + s).otherwise(a))
    return joined.withColumn(BLOCK, F.when(F.col("__ends").isNull(), 0).otherwise(at)).drop("__ends")


def carried(df: DataFrame, totals: dict[str, Column], before: dict[str, Callable[[str], Column]], series: str) -> DataFrame:
    """df with, for each name, what the blocks before a row's own bring of it; null in the first block of a series.

    totals are aggregates of a block; ``before`` combine those of the blocks before in a window over them.
    """
    blocks = cut(df.groupBy(series, BLOCK).agg(*[c.alias(f"__t_{k}") for k, c in totals.items()]))
    w = Window.partitionBy(series).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.select(series, BLOCK, *[f(f"__t_{k}").over(w).alias(f"__c_{k}") for k, f in before.items()]).where(F.col(BLOCK) > 0))
    joined = df.alias("d").join(small(blocks, blocks.count()).alias("b"), by_series("d", "b", series, BLOCK), "left")
    return joined.select("d.*", *[f"__c_{k}" for k in totals])


def scan(df: DataFrame, values: dict[str, tuple[str, Column, bool]], series: str, order: str, *ties: str, block_rows: int | None = None) -> DataFrame:
    """df with running values: name to (kind, expression, whether the row itself counts). kind is sum, max or last (the last that is not null).

    Nothing before: null. With block_rows None a series is one task.
    """
    if block_rows:
        df = deal(df, series, order, block_rows)
    keys = (series, BLOCK) if block_rows else (series,)
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    up, past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    own = {k: plain[kind](c).over(up if inclusive else past) for k, (kind, c, inclusive) in values.items()}
    if not block_rows:
        return df.withColumns(own)
    # an expression of the last kind is the one of the greatest order that is not null
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(order, *ties)))}
    df = df.withColumns({f"__v_{k}": c for k, (_, c, _) in values.items()})
    df = df.withColumns({f"__o_{k}": plain[kind](F.col(f"__v_{k}")).over(up if inclusive else past) for k, (kind, _, inclusive) in values.items()})
    df = carried(df, {k: total[kind](F.col(f"__v_{k}")) for k, (kind, _, _) in values.items()}, {k: plain[kind] for k, (kind, _, _) in values.items()}, series)
    joined = {}
    for k, (kind, _, _) in values.items():
        a, b = F.col(f"__c_{k}"), F.col(f"__o_{k}")
        joined[k] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b) if kind == "sum" else F.greatest(a, b) if kind == "max" else F.coalesce(b, a)
    return df.withColumns(joined).drop(*[f"__{p}_{k}" for k in values for p in "voc"])


def numbered(df: DataFrame, series: str, order: str, *ties: str, block_rows: int | None = None, name: str = NUMBER) -> DataFrame:
    """df with the number of each row of a series in its order, from 0."""
    if not block_rows:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(series).orderBy(order, *ties)) - 1).cast("long"))
    df = deal(df, series, order, block_rows)
    df = df.withColumn("__o", F.row_number().over(Window.partitionBy(series, BLOCK).orderBy(order, *ties)) - 1)
    df = carried(df, {"n": F.count(F.lit(1))}, {"n": F.sum}, series)
    return df.withColumn(name, (F.col("__o") + F.coalesce("__c_n", F.lit(0))).cast("long")).drop("__o", "__c_n")


def whole(df: DataFrame, values: dict[str, Column], series: str, block_rows: int | None = None, order: str | None = None) -> DataFrame:
    """df with aggregates of its whole series. In blocks, those of the series of several blocks are broadcast, one row a series."""
    if not block_rows:
        return df.withColumns({k: c.over(Window.partitionBy(series)) for k, c in values.items()})
    df = deal(df, series, order, block_rows)
    several = df.where(F.col(BLOCK) > 0).select(series).distinct()
    several = cut(df.alias("d").join(small(cut(several), 1).alias("s"), by_series("d", "s", series), "left_semi").groupBy(series).agg(*[c.alias(f"__w_{k}") for k, c in values.items()]))
    local = df.withColumns({f"__l_{k}": c.over(Window.partitionBy(series, BLOCK)) for k, c in values.items()})
    joined = local.alias("d").join(small(several, several.count()).alias("s"), by_series("d", "s", series), "left").select("d.*", *[f"__w_{k}" for k in values])
    return joined.withColumns({k: F.coalesce(f"__w_{k}", f"__l_{k}") for k in values}).drop(*[f"__{p}_{k}" for k in values for p in "wl"])


def in_blocks(df: DataFrame, reach: int, compute: Callable[[DataFrame, tuple[str, ...]], DataFrame], series: str, order: str, block_rows: int | None = None) -> DataFrame:
    """compute(rows, keys), whose windows are partitioned by the keys and look up to ``reach`` rows around each row; it keeps the rows and their columns.

    In blocks, the rows are those of even blocks of ``block_rows`` rows with ``reach`` rows copied from either side, so the ends of a series are still
    where no row follows.
    """
    if not block_rows:
        return compute(df, (series,))
    if reach > block_rows:
        raise ValueError("a block holds fewer rows than its windows reach")
    rows = df if NUMBER in df.columns else numbered(df, series, order, block_rows=block_rows)
    n, size = F.col(NUMBER), F.lit(block_rows)
    at = F.floor(n / size)
    copies = F.array_compact(F.array(at, F.when((n % size >= size - reach), at + 1), F.when((n % size < reach) & (at > 0), at - 1)))
    rows = rows.drop(BLOCK).withColumn("__even", F.explode(copies)).withColumn(OWN, F.col("__even") == at)
    return compute(rows, (series, "__even")).where(OWN).drop("__even", OWN, *[] if NUMBER in df.columns else [NUMBER])


def shifted(df: DataFrame, values: dict[str, tuple[str, int]], series: str, order: str, block_rows: int | None = None) -> DataFrame:
    """df with the values of rows before (negative) or after: name to (column, how many rows)."""

    def shift(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumns({k: F.lead(c, n).over(w) if n > 0 else F.lag(c, -n).over(w) for k, (c, n) in values.items()})

    return in_blocks(df, max(abs(n) for _, n in values.values()), shift, series, order, block_rows)
