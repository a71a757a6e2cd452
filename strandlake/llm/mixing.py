"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order (by a hash of doc_id) and are cut into
blocks of equally many words. Slot i of the schedule takes the point frac((i + 1) * phi) and the
source whose stretch of the cumulative targets holds it; the k-th slot of a source takes its
k-th block, starting over after the last one, until the source's target is met; the last block
is cut there. The schedule has a slot for each block asked for; a source that the points leave short of its blocks
(a tiny one may be missed by all) gets the missing slots after the others. A document's taken words are those
of its overlap with the blocks taken.

Targets: each source may give `repeats` times its words; what a source would get beyond that
is shared out again by weight among the others. Sources are a table throughout; there may be any number.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a
source of its own, after all others; a target is met to the word, rounded down; equal rows share their place in an order
that row numbers break and get results that differ by one block's cut at most; null doc_ids are rows like others; a very long
text is one row in as many blocks as it covers; extra columns are ignored by mixed() and carried by mixture(); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, dropped, kept, looked_up

PHI = 0.6180339887498949
BLOCK_WORDS = 1024
#: Parts of a source's order, and lengths of stretches of the schedule and of the sources, that are ranked on their own; then their totals are summed up.
ORDER_PARTS, SLOT_PART, SOURCE_PART = 4096, 1 << 16, 1 << 16
#: All words to take are cut into so many cells at least to find the source of a point by equality.
CELLS = 4096


def weighed(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: float = 2) -> DataFrame:
    """sizes: (source, size, ...) with target, and source_no in code-point order, null last; the weights repeat.

    Water-filling: the level is what a unit of weight gets; it rises until no further source is filled up.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # the number within a partition, and the partition's
    ranged = kept(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row a partition
    numbered = ranged.join(F.broadcast(offsets), "_part").withColumn("source_no", F.col("_first") + F.col("_at")).drop("_part", "_first", "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = kept(numbered.withColumn("weight", weight), "mix-weights")
    dropped(spark, ranged)
    cap, level, filled, seen = F.col("size") * float(repeats), 0.0, F.lit(False), -1
    while True:
        total, done, words, weighing = rows.agg(F.sum("size"), F.count(F.when(filled, 1)), F.sum(F.when(filled, cap)), F.sum(F.when(~filled, F.col("weight")))).first()
        if done == seen or not weighing:
            break
        level, seen = (share * (total or 0) - (words or 0.0)) / weighing, done
        filled = cap < F.col("weight") * level
    return rows.withColumn("target", F.when(filled, cap).otherwise(F.col("weight") * level))


def _below(df: DataFrame, keys: list[str], part: str, what: F.Column, name: str) -> DataFrame:
    """For each key and part, the sum of `what` over the key's earlier parts: a window over part totals."""
    sums = df.groupBy(*keys, part).agg(what.alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias(name))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(source_no, block_no, take_0, take_1): words taken from the block's start, in the first and second pass.

    sources: (source_no, size, target).
    """
    spark, long = sources.sparkSession, lambda x: x.cast("long")
    asked = sources.select("source_no", F.col("size").alias("words"), long(F.floor("target")).alias("goal")).filter("goal > 0")
    asked = asked.withColumn("n_blocks", long(F.ceil(F.col("words") / block)))
    need = long(F.floor(F.col("goal") / F.col("words"))) * F.col("n_blocks") + long(F.ceil(F.col("goal") % F.col("words") / block))
    asked = asked.withColumns({"need": need, "part": long(F.floor(F.col("source_no") / SOURCE_PART)), "all": F.lit(0)})
    total, needed, count = asked.agg(F.coalesce(F.sum("goal"), F.lit(0)), F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "source_no bigint, block_no bigint, take_0 bigint, take_1 bigint")
    earlier = Window.partitionBy("part").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    table = asked.join(_below(asked, ["all"], "part", F.sum("goal"), "low"), ["all", "part"])
    table = table.withColumn("low", F.col("low") + F.coalesce(F.sum("goal").over(earlier), F.lit(0))).withColumn("high", F.col("low") + F.col("goal"))
    width = -(-total // max(CELLS, 4 * count))
    cells = table.select("source_no", "low", "high", F.explode(F.sequence(long(F.floor(F.col("low") / width)), long(F.floor((F.col("high") - 1) / width)))).alias("cell"))
    point = F.col("id") + 1
    # in two steps, so that the fraction keeps its bits when the slot number is large
    coarse, fine = F.floor(point / 65536), point % 65536
    frac = (coarse * ((PHI * 65536) % 1.0)) % 1.0 + fine * F.lit(PHI)
    place = F.least(long(F.floor((frac % 1.0) * total)), F.lit(total - 1))
    drawn = spark.range(needed + needed // 100 + 64).select("id", place.alias("place"), long(F.floor(F.col("id") / SLOT_PART)).alias("part"))
    drawn = drawn.withColumn("cell", long(F.floor(F.col("place") / width))).join(cells, "cell").filter("place >= low AND place < high").select("id", "part", "source_no")
    below = _below(drawn, ["source_no"], "part", F.count(F.lit(1)), "before")
    within = Window.partitionBy("source_no", "part").orderBy("id")
    ranked = drawn.join(below, ["source_no", "part"]).select("source_no", (F.col("before") + F.row_number().over(within) - 1).alias("rank"))
    have = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("have"))
    short = asked.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
    ranked = ranked.unionByName(short.select("source_no", F.expr("explode(sequence(have, need - 1))").alias("rank")))
    ranked = ranked.join(asked.drop("part", "all"), "source_no").filter("rank < need")
    epoch, at = long(F.floor(F.col("rank") / F.col("n_blocks"))), F.col("rank") % F.col("n_blocks")
    length = F.least(F.lit(block).cast("long"), F.col("words") - at * block)
    take = F.least(length, F.col("goal") - epoch * F.col("words") - at * block)
    ranked = ranked.select("source_no", at.alias("block_no"), epoch.alias("epoch"), take.alias("take"))
    return ranked.groupBy("source_no", "block_no").agg(
        *[F.coalesce(F.max(F.when(F.col("epoch") == e, F.col("take"))), F.lit(0)).cast("long").alias(f"take_{e}") for e in (0, 1)]
    )


def mixed(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs, with its row number `rid`."""
    return _mixed(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("rid")), weights, share, block)


def _mixed(docs: DataFrame, weights, share: float, block: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", "rid", size.alias("size"))
    sized = kept(sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))), "mix-sizes")
    sums = sized.groupBy("skey", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
    sources = kept(weighed(sums, weights, share), "mix-targets")
    table = sources.select("skey", "source_no", F.col("size").alias("source_size"), "target", "n_rows")
    key = F.xxhash64("doc_id")
    part = F.shiftrightunsigned(key, 64 - ORDER_PARTS.bit_length() + 1).cast("int")
    placed = looked_up(sized.drop("source"), table, "skey", "n_rows", sized.count()).withColumns({"key": F.shiftrightunsigned(key, 1), "part": part})
    below = _below(placed, ["source_no"], "part", F.sum("size"), "base")
    before = Window.partitionBy("source_no", "part").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(below, ["source_no", "part"])
    placed = placed.withColumn("first", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = kept(placed.select("rid", "doc_id", "source_no", "size", "source_size", "target", "first"), "mix-order")
    spans = placed.filter("size > 0").withColumn(
        "block_no", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block)))
    )
    takes = schedule(sources, block)
    start = F.greatest(F.col("first"), F.col("block_no") * block)
    stop = F.least(F.col("first") + F.col("size"), (F.col("block_no") + 1) * block)
    overlap = [F.greatest(F.lit(0).cast("long"), F.least(stop, F.col("block_no") * block + F.col(f"take_{e}")) - start) for e in (0, 1)]
    got = spans.join(takes, ["source_no", "block_no"]).groupBy("rid").agg(F.sum(overlap[0] + overlap[1]).alias("got"))
    out = placed.join(got, "rid", "left")
    return out.select("rid", "doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """The mix as documents: each row as often as its taken words come nearest to (0, 1 or 2 times)."""
    rows = kept(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*columns(docs)).alias("row")), "mix-input")  # so that no name clashes
    times = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    out = _mixed(rows.select("row.doc_id", "row.source", "row.text", "rid"), weights, share, BLOCK_WORDS)
    counts = out.filter("size > 0").select("rid", times.alias("times")).filter("times > 0")
    return rows.join(counts, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
