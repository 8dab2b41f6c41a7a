"""Mix sources to target weights by capped water-filling.

Sources get shares of all words by weight.  A source whose share would exceed
``epochs`` times its size is clamped there, and what it leaves goes to the
others by weight, until none is above its clamp.  Clamps and the common level of
the rest come out of one pass over the sources in order of size per weight.

Rows are then taken whole as often as they fit into the target, and a seeded
order decides which rows are taken once more: those that come first, up to the
words that are missing, the last of them in part.  The order is the MD5 of seed
and id, cut into 4096 buckets whose sums are added up before any row is looked
at, so that no source is gathered in one task.

Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
BUCKET_DIGITS = 3
MEASURES = ["size", "source_size", "target", "whole", "part"]


def n_words(text: Column) -> Column:
    """Runs of anything but white space; 0 for NULL."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: list[int], epochs: int) -> DataFrame:
    """One row per source: its size and target.  Sources are few, and already summed."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    in_order = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = in_order.rowsBetween(0, Window.unboundedFollowing)
    return (
        sources.withColumn("_weight", weight)
        .withColumn("_cap", epochs * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumns(
            {
                "_place": F.row_number().over(in_order),
                "_level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                / F.sum("_weight").over(onwards),
            }
        )
        .withColumn("_free", F.min(F.when(F.col("_level") < F.col("_ratio"), F.col("_place"))).over(everything))
        .withColumn("_level", F.max(F.when(F.col("_place") == F.col("_free"), F.col("_level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_free").isNull() | (F.col("_place") < F.col("_free")), F.col("_cap").cast("double")).otherwise(
                F.col("_level") * F.col("_weight")
            ),
        )
        .select("_source", "source_size", "target")
    )


def mixed(
    docs: DataFrame,
    weights: list[int] = [5, 2, 1],  # noqa: B006
    epochs: int = 3,
    seed: str = "mix",
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``whole`` and ``part``.

    A row is taken ``whole`` times in full and then for its first ``part`` words.
    NULL texts have size 0; a NULL source is one source, the last; a NULL key
    sorts first among equals.  Repeated rows are rows of their own and share an
    MD5; which of them is taken once more can't be told apart.  Sources without
    words have target 0, and an empty table gives an empty one.  Columns of docs
    with the names of the new ones are replaced.
    """
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    rows = docs.select(
        F.struct(*carried).alias("_row"),
        n_words(F.col(text)).alias("size"),
        F.col(source).alias("_source"),
        F.col(key).alias("_key"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_order"),
    ).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_bucket_size"))
    targets = _targets(buckets.groupBy("_source").agg(F.sum("_bucket_size").alias("source_size")), weights, epochs)
    targets = targets.withColumn("whole", F.least(F.floor(F.try_divide("target", "source_size")), F.lit(epochs)))
    targets = targets.withColumn("whole", F.coalesce("whole", F.lit(0)))
    targets = targets.withColumn("_rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    of_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_bucket_start", F.coalesce(F.sum("_bucket_size").over(of_source), F.lit(0)))
    named = targets.withColumnRenamed("_source", "_name")
    buckets = buckets.join(named, F.col("_source").eqNullSafe(F.col("_name")), "left").select(
        F.col("_source").alias("_of"), F.col("_bucket").alias("_in"), "_bucket_start", "source_size", "target", "whole", "_rest"
    )
    met = rows.join(buckets, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in")), "left")
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_order", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("_bucket_start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    met = met.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - so_far)).cast("long"))
    return met.select("_row.*", *MEASURES)


def copies(taken: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mix itself: every row as often as it is taken, the part as its first words."""
    cut = F.array_join(F.slice(F.array_remove(F.split(text, SPACE), ""), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    cut = F.when(F.col("part") >= F.col("size"), F.col(text)).otherwise(cut)
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    repeated = taken.filter(times > 0).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    repeated = repeated.withColumn(text, F.when(F.col("_time") > F.col("whole"), cut).otherwise(F.col(text)))
    return repeated.select(*[F.col(f"`{c}`") for c in columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: the words that the mix takes of it."""
    rows = mixed(docs.select("doc_id", "text", "source"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
