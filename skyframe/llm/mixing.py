"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Sizes are words.  The sources, in code-point order and null last, weigh 1, 2, 3,
repeating; targets share the sum of all sizes by weight, stop at ``most`` times
their source's size, and what is beyond is shared anew by weight.

A source is taken whole as often as its target allows; the rest of the target is
sampled: a document's key is -ln(u) / weight, with u drawn from a hash of its
identifier and text and the weight its quality (words over words and symbols), and the documents
of least keys are taken, whole, until their sizes come nearest to the rest.

Only DataFrame operations.  No source is ever gathered or sorted as one: keys
fall into ranges, the sizes of a source's ranges are prefix-summed, and only the
range in which its rest ends is sorted.  What comes out of that is one threshold
a source.  Rows that repeat an identifier and text share one key and are taken
together.  A null text has size 0 and no words to take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

MOST, RANGES = 3, 1 << 14
#: Sources whose plan fits in a broadcast, and parts that a source's rows are joined in beyond.
FEW, PARTS = 5000, 16
_WORD, _SPACE, _SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"


def n_words(text: Column) -> Column:
    """Each word becomes one letter and white space goes, so no list of words is built."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, _WORD, "x"), _SPACE, "")).cast("long"), F.lit(0).cast("long"))


def quality(text: Column, words: Column) -> Column:
    """1 for a text without symbols, less for one with many."""
    symbols = F.coalesce(F.length(text) - F.length(F.regexp_replace(text, _SYMBOL, "")), F.lit(0))
    return (words + 1).cast("double") / (words + 1 + symbols)


def _key(size: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.log(u) / quality(F.col("text"), size)


def keyed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size and the sampling key of every row."""
    sized = docs.select("doc_id", "text", "source", n_words(F.col("text")).alias("size"))
    return sized.select("doc_id", "source", "size", _key(F.col("size"), seed).alias("sample_key"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes: source, source_size (a row a source). Adds the target, by the level at which no source is above its cap."""
    every = Window.partitionBy(F.lit(0))
    weighed = sizes.withColumn("weight", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    # sources reach their caps in this order; the level is what the others get a unit of weight
    order = every.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / weights
    fits = F.when(level * F.col("weight") < most * F.col("source_size"), F.struct(F.row_number().over(order).alias("k"), level.alias("level")))
    stepped = weighed.withColumn("first_free", fits).withColumn("level", F.min("first_free").over(every)["level"])
    cap = (most * F.col("source_size")).cast("double")
    return stepped.select("source", "source_size", F.coalesce(F.least(cap, F.col("weight") * F.col("level")), cap).alias("target"))


def thresholds(rows: DataFrame, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """rows: as keyed() gives them. A row a source: source_size, target, epochs, and the greatest key that is taken once more."""
    ranged = rows.select("source", "size", "sample_key", F.floor((1 - F.exp(-F.col("sample_key"))) * ranges).alias("range"))
    parts = ranged.groupBy("source", "range").agg(F.sum("size").alias("size"))
    plan = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    last = parts.withColumn("upto", F.sum("size").over(running)).join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    # the range in which the rest ends, and what the ranges before it hold
    last = last.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest"))).select("s", "range", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))
    inside = ranged.join(last.withColumnRenamed("range", "r"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = inside.groupBy("s", "rest", "sample_key").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("s").orderBy("sample_key").rowsBetween(Window.unboundedPreceding, 0)
    # a document is taken if at least half of it is inside the rest
    inside = inside.withColumn("upto", F.sum("size").over(running)).withColumn("fits", F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    cut = inside.groupBy("s").agg(F.max(F.when(F.col("fits"), F.col("sample_key"))).alias("inside"), F.min("sample_key").alias("least"))
    cut = cut.join(last.select(F.col("s").alias("t"), "range"), F.col("s").eqNullSafe(F.col("t")))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), F.coalesce("inside", F.lit(-1.0)).alias("last_key"), F.coalesce("range", F.lit(0)).alias("last_range"))


def _planned(rows: DataFrame, plan: DataFrame, ranges: int) -> DataFrame:
    """Adds the plan of their source to rows, and times: how often a document is taken."""
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "last_key", "last_range")
    few = plan.limit(FEW + 1).collect()
    on = F.col("source").eqNullSafe(F.col("_source"))
    if len(few) <= FEW:  # so few sources may be broadcast; no source's rows have to meet
        plan = F.broadcast(rows.sparkSession.createDataFrame(few, plan.schema))
    else:  # a source may have any share of the rows, so they are joined in parts
        plan = plan.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("sample_key"), F.lit(PARTS)).cast("int"))
        on = on & (F.col("_part") == F.col("_to"))
    at = F.floor((1 - F.exp(-F.col("sample_key"))) * ranges)
    once = (at < F.col("last_range")) | ((at == F.col("last_range")) & (F.col("sample_key") <= F.col("last_key")))
    return rows.join(plan, on).withColumn("times", F.col("epochs") + once.cast("long"))


def mix(docs: DataFrame, most: int = MOST, seed: int = 1, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source)."""
    rows = runtime.cut(keyed(docs, seed))  # narrow; what follows reads it three times
    return _planned(rows, thresholds(rows, most, ranges), ranges).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def sample(docs: DataFrame, most: int = MOST, seed: int = 1, ranges: int = RANGES) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs. Texts don't move."""
    rows = runtime.cut(keyed(docs, seed))
    own = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("_row")
    sized = docs.select(own, "doc_id", "text", "source", n_words(F.col("text")).alias("_size"))
    ready = sized.select("_row", "source", _key(F.col("_size"), seed).alias("sample_key"))
    taken = _planned(ready, thresholds(rows, most, ranges), ranges).where("times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("_row.*")
