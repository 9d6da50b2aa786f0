"""Ranks, limits and selection that hold up on skewed groups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsift.functions.session import cut

#: Rows that are looked at to divide the rest, and rows that are few enough to be ordered at once.
PIVOTS = 31
FEW = 1000


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group, with their number in ``rn``; for a few rows of each, or for groups that are small.

    The group limit of Spark trims each map partition to ``n`` rows per group ahead of the shuffle.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def ranked_in_groups(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with its 1-based number in its group in ``rn``, for groups of any size.

    Rows are sorted by ranges of (keys, order), so that a large group lies in several partitions. A partition's number of rows of
    a group is added to those of the partitions after it: one row per group and partition moves for that.
    """
    by = [*keys, *order]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(shifts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rn"))


#: Binary logarithm of the rows of a block in :func:`with_previous`; a partition has 2 ** 33 row numbers.
_BLOCK = 10


def with_previous(df: DataFrame, order: list[str], values: list[str], out: str = "previous") -> DataFrame:
    """Every row with ``values`` of the row before it in a total order, as a struct; NULL for the first row.

    Rows are sorted by ranges and dealt in blocks of neighbours, so the work is even whatever the values of the order are. What
    a block needs of the one before it is a single row; so is what a partition needs.
    """
    row = F.struct(*values)
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_block", F.shiftright("_at", _BLOCK))
    part = F.shiftright("_block", 33 - _BLOCK)
    lasts = placed.groupBy("_block").agg(F.max_by(row, "_at").alias("_last")).withColumn("_part", part)
    ends = lasts.groupBy("_part").agg(F.max_by("_last", "_block").alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_end"))  # a row per partition
    near = F.lag("_last").over(W.partitionBy("_part").orderBy("_block"))
    starts = lasts.withColumn("_near", near).join(ends, "_part").select("_block", F.coalesce("_near", "_end").alias("_start"))
    inside = F.lag(row).over(W.partitionBy("_block").orderBy("_at"))
    found = placed.withColumn("_inside", inside).join(starts, "_block", "left")  # each block has a start; an inner join may be dealt as the starts are, by whole partitions
    return found.select(*df.columns, F.coalesce("_inside", "_start").alias(out))


def with_global_rank(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """Rows with their 1-based position in a total order, and the number of rows.

    The rows are sorted by range and stored; only one count per partition goes through the driver.
    """
    ordered = df.orderBy(*order).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    )
    stored = cut(ordered)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total - row["first"] + 1))
        total += row["n"]
    spark = df.sparkSession
    shifts = spark.createDataFrame(offsets, "_part int, _shift bigint")
    ranked = stored.join(F.broadcast(shifts), "_part").withColumn("rank", F.col("_at") + F.col("_shift"))
    return ranked.drop("_part", "_at", "_shift"), total


def first_rows(df: DataFrame, n: int, *order: str, pivots: int = PIVOTS, few: int = FEW) -> DataFrame:
    """The first ``n`` rows of ``df`` in ascending order of columns that identify a row, nulls first; nothing is sorted or moved.

    The n-th value is found by selection: a few values divide the rows that may hold it, one count per division shows which part does, and so
    on until that part is small. Each pass is an aggregate with at most ``pivots`` + 1 groups. Equal rows at the limit all stay.
    ``df`` is read once per pass, so it should be a stored table.
    """
    if n <= 0:
        return df.limit(0)
    key = F.struct(*order)
    rows = df.select(*order)
    types = [df.schema[c].dataType for c in order]

    def value(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(t).alias(c) for c, t in zip(order, types)])

    inside, left = F.lit(True), n
    while True:
        some = rows.filter(inside)
        # which rows are taken does not matter for the result, only for the number of passes
        sample = some.orderBy(F.xxhash64(*order), *order).limit(pivots)
        cuts = sample.distinct().orderBy(*order).collect()
        if not cuts:
            return df
        place = F.lit(len(cuts))
        for i in reversed(range(len(cuts))):
            place = F.when(key <= value(cuts[i]), i).otherwise(place)
        counts = {r["place"]: r["n"] for r in some.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        if sum(counts.values()) < left:
            return df
        at = 0
        while left > counts.get(at, 0):
            left -= counts.get(at, 0)
            at += 1
        if at < len(cuts) and counts[at] == left:
            return df.filter(key <= value(cuts[at]))
        low = F.lit(True) if at == 0 else key > value(cuts[at - 1])
        high = F.lit(True) if at == len(cuts) else key <= value(cuts[at])
        inside = inside & low & high
        if counts[at] <= few:
            last = rows.filter(inside).orderBy(*order).limit(left).collect()[-1]
            return df.filter(key <= value(last))
        if at < len(cuts) and not rows.filter(inside & (key < value(cuts[at]))).head(1):
            return df.filter(key <= value(cuts[at]))

