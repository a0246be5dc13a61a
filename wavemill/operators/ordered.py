"""Orders within groups of any size: ordinals, running sums, exact quantiles.

A window function holds its group in one task.  Here rows are dealt by range of
(group, order), so a large group is in many parts of about equal size; each part
adds up its own rows, and only the parts' totals are ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.session import kept

#: Totals of parts up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 100_000
#: Splitters of a round of selection, and values that end it.
GRID, FEW = 128, 10_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """The rows with each of ``sums`` added up over their group, to themselves,
    in ``order``; ``totals`` names columns for the sums of whole groups.

    Rows of equal order have no order among them, unless ``order`` says one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    values = rows.withColumns({f"_{k}": v for k, v in sums.items()})
    # kept, as the ranges are drawn from a sample: a part must not change between its uses
    dealt = kept(values.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    each = dealt.groupBy(*by, "_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    extra = [F.sum(f"_{k}").over(whole).alias(name) for k, name in (totals or {}).items()]
    each = each.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums], *extra)
    each = kept(each)
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"_own_{k}": F.sum(f"_{k}").over(own) for k in sums})
    on = [local[c].eqNullSafe(each[f"_of_{c}"]) for c in by] + [local["_part"] == each["_at"]]
    found = local.join(_few(each), reduce(lambda x, y: x & y, on))
    return found.select(*rows.columns, *[(F.col(f"_before_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums], *(totals or {}).values())


def ordinals(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """The rows with their place in their group, from 1."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")})


def quantiles(rows: DataFrame, value: str, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``by``, ``share`` and ``quantile``: exact, linear between two ranks, as
    ``percentile``; nulls do not count and NaN is the greatest value.

    Selection by narrowing: each round counts, by partial aggregation, the
    values below and in every group's interval and splits the interval at
    approximate quantiles; the part with the wanted ranks is the next one.
    Once an interval has ``FEW`` distinct values or is one value, these are
    ordered.  So no group's values meet in one task.
    """
    values = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    values = kept(values.groupBy(*by, "_v").agg(F.count("*").alias("_n")))
    of = [f"_of_{c}" for c in by]
    number = ~F.isnan("_v")
    state = values.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("_n").alias("_all"), F.sum(F.when(number, F.col("_n")).otherwise(0)).alias("_finite"), F.min(F.when(number, F.col("_v"))).alias("_low"), F.max(F.when(number, F.col("_v"))).alias("_high"))
    state = state.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_rank", F.col("share") * (F.col("_all") - 1))
    state = state.withColumns({"_k": F.floor("_rank"), "_j": F.ceil("_rank")})
    grid = [k / GRID for k in range(GRID + 1)]

    def beside(found: DataFrame) -> DataFrame:
        """Values in or below the interval of each share of their group."""
        on = [values[c].eqNullSafe(found[f"_of_{c}"]) for c in by]
        few = _few(found)
        both = values.join(few, reduce(lambda x, y: x & y, on)) if on else values.crossJoin(few)  # a row for each share
        return both.filter(number & (F.col("_v") <= F.col("_high")))

    while True:
        state = kept(state)
        inside = F.col("_v") >= F.col("_low")
        weight = F.col("_n")
        seen = beside(state).groupBy(*of, "share").agg(
            F.sum(F.when(~inside, weight).otherwise(0)).alias("_below"),
            F.count_if(inside).alias("_distinct"),
            F.percentile_approx(F.when(inside, F.col("_v")), grid, 100 * GRID).alias("_splits"),
        )
        seen = kept(seen)
        if seen.filter(F.col("_distinct") > FEW).isEmpty():
            break
        named = seen.select(*[F.col(c).alias(f"_s{c}") for c in of], F.col("share").alias("_sshare"), "_below", "_distinct", "_splits")
        on = [state[c].eqNullSafe(named[f"_s{c}"]) for c in of] + [state["share"] == named["_sshare"]]
        both = state.join(named, reduce(lambda x, y: x & y, on), "left")
        # how many values are up to each splitter, counted over all values
        cuts = both.filter(F.col("_distinct") > FEW).select(*of, "share", "_low", "_high", "_k", "_j", "_below", F.explode(F.array_distinct("_splits")).alias("_cut"))
        upto = beside(kept(cuts)).filter(F.col("_v") <= F.col("_cut")).groupBy(*of, "share", "_cut").agg(F.sum("_n").alias("_upto"), F.first("_k").alias("_k"), F.first("_j").alias("_j"), F.first("_low").alias("_was"), F.first("_high").alias("_top"))
        narrowed = upto.groupBy(*of, "share").agg(
            F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_k"), F.col("_cut"))), F.first("_was")).alias("_low"),
            F.coalesce(F.min(F.when(F.col("_upto") > F.col("_j"), F.col("_cut"))), F.first("_top")).alias("_high"),
        )
        narrowed = narrowed.select(*[F.col(c).alias(f"_s{c}") for c in of], F.col("share").alias("_sshare"), F.col("_low").alias("_nlow"), F.col("_high").alias("_nhigh"))
        on = [state[c].eqNullSafe(narrowed[f"_s{c}"]) for c in of] + [state["share"] == narrowed["_sshare"]]
        state = state.join(narrowed, reduce(lambda x, y: x & y, on), "left").select(*of, "_all", "_finite", "share", "_rank", "_k", "_j", F.coalesce("_nlow", "_low").alias("_low"), F.coalesce("_nhigh", "_high").alias("_high"))
    few = beside(state).filter(inside).groupBy(*of, "share").agg(F.array_sort(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n")))).alias("_few"))
    right = few.select(*[F.col(c).alias(f"_s{c}") for c in of], F.col("share").alias("_sshare"), "_few")
    counts = seen.select(*[F.col(c).alias(f"_t{c}") for c in of], F.col("share").alias("_tshare"), "_below")
    rows_ = state.join(right, reduce(lambda x, y: x & y, [state[c].eqNullSafe(right[f"_s{c}"]) for c in of] + [state["share"] == right["_sshare"]]), "left")
    rows_ = rows_.join(counts, reduce(lambda x, y: x & y, [rows_[c].eqNullSafe(counts[f"_t{c}"]) for c in of] + [rows_["share"] == counts["_tshare"]]), "left")

    def at(rank: str) -> Column:
        """The value of a rank: the first of the few that reaches it."""
        start = F.struct((F.coalesce(F.col("_below"), F.lit(0)).cast("long")).alias("upto"), F.lit(None).cast("double").alias("v"))
        step = lambda a, x: F.when(a["v"].isNotNull(), a).otherwise(F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["upto"] + x["n"] > F.col(rank), x["v"]).alias("v")))
        return F.when(F.col(rank) >= F.col("_finite"), F.lit(float("nan"))).otherwise(F.aggregate("_few", start, step)["v"])

    low, high = at("_k"), at("_j")
    part = F.col("_rank") - F.col("_k")
    exact = F.when(F.col("_k") == F.col("_j"), low).otherwise((1 - part) * low + part * high)
    return rows_.select(*[F.col(f"_of_{c}").alias(c) for c in by], "share", exact.alias("quantile"))
