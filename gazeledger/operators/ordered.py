"""Running values over very large ordered groups.

A plain window puts a whole group into one task, which fails the day one user or one file holds a large
share of all rows. Here a group is cut into slices (a time or line range). Per-slice totals are combined
on the map side and scanned first; they are small, since their number grows with the covered time or the
file length and not with the number of rows. The totals before each slice are then joined back, and the
row-level window runs inside one slice.

A line range bounds the rows of a slice by itself; a time range does not. ``cut_slices`` cuts those with too many rows again
by their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.session import materialise


# Rows of ordered work that one task takes: a task sorts all of its rows, and a fixed number of them grows with the input.
TASK_ROWS = 200_000


def tasks_for(stored: DataFrame) -> int | None:
    """The number of tasks that bounds the rows of each, or None if the session's number does; ``stored`` is a written table."""
    tasks = -(-stored.count() // TASK_ROWS)
    return tasks if tasks > int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def cut_slices(df: DataFrame, keys: list[str], slice_col: str, order: list[str], rows: int) -> tuple[DataFrame, bool]:
    """Adds ``_cut``, which divides slices of more than ``rows`` rows along ``order``, and whether there is any such slice.

    Without one, ``df`` comes back as it is. The rows of hot slices are dealt into ranges of the order and written, so that
    a range keeps its number and rows whatever executor reads it again; ranges hold about ``rows`` rows each, also if all
    of them have the same time. Other rows stay where they are, with ``_cut`` 0.
    """
    hot = materialise(df.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows), "hot-slices")
    total, slices = hot.agg(F.sum("_rows"), F.count(F.lit(1))).first()
    if not slices:
        return df, False
    hot = hot.select(*keys, slice_col)
    hot = F.broadcast(hot) if slices <= 100_000 else hot
    dealt = df.join(hot, [*keys, slice_col], "left_semi").select(*df.columns)
    dealt = dealt.repartitionByRange(-(-total // rows) + 1, *keys, slice_col, *order).withColumn("_cut", F.spark_partition_id())
    rest = df.join(hot, [*keys, slice_col], "left_anti").select(*df.columns, F.lit(0).alias("_cut"))
    return rest.unionByName(materialise(dealt, "cut-slices")), True


def running(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    include_current: bool = True,
    slice_rows: int | None = None,
    totals_of: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add running sums and last non-null values per ``keys`` in ``order``.

    The totals of slices come from ``totals_of`` if given: rows that give the same totals at less work, of at least the same slices.

    ``slice_col`` must not decrease along ``order`` within ``keys``. Keys and slice must not be NULL. Slices that do not
    bound their rows by themselves are cut beyond ``slice_rows``. Slices are dealt over ``tasks`` tasks if given.
    """
    sums, lasts = sums or {}, lasts or {}
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])  # a number is aggregated without sorting
    df, cut = cut_slices(df, keys, slice_col, order, slice_rows) if slice_rows else (df, False)
    parts = [slice_col, "_cut"] if cut else [slice_col]
    values = {f"_s_{n}": F.coalesce(e.cast("bigint"), F.lit(0).cast("bigint")) for n, e in sums.items()} | {
        f"_l_{n}": e for n, e in lasts.items()}
    staged = df.withColumns(values)
    totals = (staged if totals_of is None else totals_of.withColumns(values)).groupBy(*keys, *parts).agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), position)).alias(f"_t_{n}") for n in lasts],
    )
    earlier = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *parts,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
    )
    upto = 0 if include_current else -1
    inside = Window.partitionBy(*keys, *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    out = (staged.repartition(tasks, *keys, *parts) if tasks else staged).join(carried, [*keys, *parts])
    out = out.withColumns(
        {n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0)) for n in sums}
        | {n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")) for n in lasts}
    )
    return out.drop(*["_cut"] * cut, *[f"_{k}_{n}" for k in "sc" for n in sums], *[f"_{k}_{n}" for k in "lc" for n in lasts])


def nth_rows(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    rules: dict[str, tuple[Column, int]],
) -> DataFrame:
    """For every rule ``kind: (condition, n)`` the ``n``-th row of every group that meets the condition.

    One pass counts all rules per slice and says in which slice a sought row lies; only rows of those
    slices are ranked. The literal bound on the rank lets Spark cut each map task's share of a slice
    before the shuffle, so that a slice of any size stays small. Adds ``kind``.
    """
    staged = df.withColumns({f"_is_{k}": F.coalesce(c, F.lit(False)) for k, (c, _) in rules.items()})
    counts = staged.groupBy(*keys, slice_col).agg(*[F.count_if(f"_is_{k}").alias(f"_n_{k}") for k in rules])
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.withColumns({
        f"_b_{k}": F.coalesce(F.sum(f"_n_{k}").over(earlier), F.lit(0)) for k in rules})
    sought = F.array_compact(F.array(*[
        F.when(
            (F.col(f"_b_{k}") < n) & (F.col(f"_b_{k}") + F.col(f"_n_{k}") >= n),
            F.struct(F.lit(k).alias("kind"), (n - F.col(f"_b_{k}")).alias("_sought")),
        )
        for k, (_, n) in rules.items()
    ]))
    hits = totals.select(*keys, slice_col, F.inline(sought))
    meets = F.lit(False)
    for k in rules:
        meets = meets | ((F.col("kind") == k) & F.col(f"_is_{k}"))
    rank = F.row_number().over(Window.partitionBy("kind", *keys, slice_col).orderBy(*order))
    bound = max(n for _, n in rules.values())
    return (
        staged.join(hits, [*keys, slice_col])
        .where(meets)
        .withColumn("_rank", rank)
        .where((F.col("_rank") <= bound) & (F.col("_rank") == F.col("_sought")))
        .drop("_rank", "_sought", *[f"_is_{k}" for k in rules])
    )


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of every row, from 1, in ``order``, which must tell all rows apart.

    Rows are dealt into ranges of the order and written; a range's rows are numbered among themselves, after the rows of
    the ranges before. Equal values of the leading columns fill as many ranges as they need.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # one row per partition
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.join(F.broadcast(starts), "_range")
    return placed.withColumn(name, (F.col("_start") + inside).cast("bigint")).drop("_range", "_start")
