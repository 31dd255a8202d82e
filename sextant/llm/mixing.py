"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source gets a target number of words from its weight; a target stops at ``most_repeats``
times the source's size and the excess is shared again by weight. Documents are shuffled by a
hash of their id, and each copy of a document gets a virtual finish time: the words that its
source has sent up to and including it, divided by the source's target. The mix is the prefix of
all copies in order of finish time that fits in the total budget.

Nothing orders a whole source or the whole corpus in one task. A source's running words are built
from hash buckets: per-bucket sums (combined before their shuffle) give each bucket its offset,
and rows are only ranked inside a bucket. The global order is cut into virtual-time ranges in the
same way: sums per range find the range that holds the budget's end, and only ranges up to it are
sorted. Buckets and ranges hold ``ROWS_PER_BUCKET`` rows, or the square root of all if that is more.

Defined results: null text has size 0; null source is a source of its own, the last in code point
order. Documents of size 0 and documents of a source with target 0 are never taken. Ties in the
shuffle are broken by id, size and a hash of the text; rows equal in all are interchangeable. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import ROWS_PER_BUCKET, bucket_count, quoted, word_count
from sextant.session import checkpointed, spread

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET_SHARE = 1.5
MOST_REPEATS = 2
#: Source tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000


def shuffle_hash(key: Column, text: Column, seed: int) -> Column:
    """60 bits of md5(seed:key) as a non-negative long; rows without a key go by their text, so that many of them do not stay together."""
    own = F.coalesce(key.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> with target: the water level at which capped shares use up the budget.

    Weights repeat over sources in code point order, null last. The table has a row per source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", weight)
    capped = ranked.withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With the sources below a row capped, the rest share what is left by weight; the first row whose cap is not under that level sets it.
    level = (F.lit(budget_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    levelled = capped.withColumn("level", level)
    reached = F.first(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(everything)
    return levelled.withColumn("water", reached).select("source", "source_rank", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def _join_sources(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    side = sources.withColumnRenamed("source", "own_source")
    side = F.broadcast(side) if count <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, most_repeats: int = MOST_REPEATS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: (id, source, size, source_size, target, copies, taken, text_hash)."""
    sized = checkpointed(spread(docs.select(id_col, source_col, text_col)).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), shuffle_hash(F.col(id_col), F.col(text_col), seed).alias("hash"), F.xxhash64(text_col).alias("text_hash")))
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    sources = checkpointed(targets(totals.drop("source_rows"), weights, budget_share, most_repeats))
    n_sources = sources.count()
    # Virtual-time ranges follow all rows, buckets of the shuffle the rows of their source; both keep the order of what they cut.
    rows = sized.count()
    buckets = max(1, int(rows / max(ROWS_PER_BUCKET, rows**0.5)))
    own_buckets = bucket_count(F.col("source_rows"), ROWS_PER_BUCKET)
    bucketed = _join_sources(sized, totals.drop("source_size"), n_sources).withColumn("bucket", F.shiftright(F.shiftright("hash", 30) * own_buckets, 30)).drop("source_rows")

    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    offset = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("own_source"), F.col("bucket").alias("own_bucket"), offset.alias("offset"))
    placed = bucketed.join(offsets, F.col("source").eqNullSafe(F.col("own_source")) & (F.col("bucket") == F.col("own_bucket"))).drop("own_source", "own_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = placed.withColumn("sent", F.col("offset") + F.sum("size").over(inside))
    timed = checkpointed(_join_sources(sent.select("id", "source", "size", "hash", "text_hash", "sent"), sources, n_sources))

    repeat = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1)))
    copies = timed.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("copy", repeat)
    finish = (F.col("sent") + F.col("copy") * F.col("source_size")) / F.col("target")
    last_range = 2 * buckets
    copies = copies.withColumn("finish", finish).withColumn("range", F.least(F.floor(F.col("finish") * buckets), F.lit(last_range)).cast("long"))
    budget = sources.agg(F.coalesce(F.least(F.lit(budget_share) * F.sum("source_size"), F.lit(float(most_repeats)) * F.sum("source_size")), F.lit(0.0)).alias("budget"))

    # Sums per virtual-time range: a table of at most 2 * buckets + 1 rows.
    ranges = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.withColumn("before", before).join(F.broadcast(budget)).filter(F.col("before") <= F.col("budget"))
    order = ("finish", "source_rank", "hash", "id", "size", "text_hash", "copy")
    cut_range = starts.agg(F.max("range").alias("cut_range"), F.max_by("before", "range").alias("cut_before"), F.max("budget").alias("budget"))
    at_cut = copies.join(F.broadcast(cut_range), F.col("range") == F.col("cut_range"))
    running = F.col("cut_before") + F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    key = F.struct(*order)
    last = at_cut.withColumn("key", key).withColumn("running", running).filter(F.col("running") <= F.col("budget")).agg(F.max("key").alias("last_key"))
    cut = cut_range.join(F.broadcast(last))
    # Every copy of an earlier range is in; in the cut's range, those up to the last that fits.
    fits = [
        F.when((F.col("size") > 0) & (F.col("target") > 0), F.when(at < F.col("cut_range"), 1).when((at == F.col("cut_range")) & F.col("last_key").isNotNull() & (own <= F.col("last_key")), 1).otherwise(0)).otherwise(0)
        for c in range(most_repeats)
        for t in [(F.col("sent") + F.lit(c) * F.col("source_size")) / F.col("target")]
        for at in [F.least(F.floor(t * buckets), F.lit(last_range)).cast("long")]
        for own in [F.struct(t.alias("finish"), "source_rank", "hash", "id", "size", "text_hash", F.lit(c).alias("copy"))]
    ]
    taken = timed.join(F.broadcast(cut), how="left").withColumn("copies", sum(fits[1:], fits[0]).cast("int"))
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Rows equal in id, source and text count as one document with the copies of all of them.
    """
    text_col, source_col = options.get("text_col", "text"), options.get("source_col", "source")
    keys = ["own_id", "own_source", "own_hash"]
    plan = mix(docs, id_col=id_col, **options).select(F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"), F.col("text_hash").alias("own_hash"), "copies").filter(F.col("copies") > 0)
    plan = plan.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # Rows travel as structs, so that no column of theirs meets a column of the plan.
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("hash"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    found = rows.join(plan, F.col("id").eqNullSafe(F.col("own_id")) & F.col("source").eqNullSafe(F.col("own_source")) & (F.col("hash") == F.col("own_hash")))
    single, repeated = found.filter("rows = 1"), found.filter("rows > 1").dropDuplicates(keys)
    return single.unionByName(repeated).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
