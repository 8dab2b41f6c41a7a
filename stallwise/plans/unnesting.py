"""Arrays inside rows: unnesting in all its forms.

The arrays are built from columns of the same row (charges of a line, words of a
text), so making them gathers no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import year_start
from stallwise.functions.numeric import TICKS, amount, exact_sum, total
from stallwise.operators.aggregates import count_where
from stallwise.operators.unnest import unnest, unnest_outer, unnest_outer_where, unnest_product
from stallwise.sources.tables import Tables, discount_amount, gross, tax_amount


def charges() -> Column:
    """Accounting entries of a line: goods, discount and tax, zero amounts included."""

    def entry(kind: str, amount: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col("l_partkey").alias("product"), amount.alias("amount")
        )

    return F.array(entry("goods", gross()), entry("discount", -discount_amount()), entry("tax", tax_amount()))


def adjustments() -> Column:
    """Discount and tax entries: empty for plain lines, NULL for lines with flag N."""
    some = F.filter(charges(), lambda e: (e["kind"] != "goods") & (e["amount"] != 0))
    return F.when(F.col("l_returnflag") != "N", some)


def charges_by_product_type(t: Tables) -> DataFrame:
    """Entries of all lines that are not zero, joined on the product named in the entry."""
    lines = t.lineitem.select(charges().alias("charges")).filter(F.size("charges") > 0)
    entries = unnest(lines, "charges", "charge").filter(F.col("charge.amount") != 0)
    # Summed per product before the join, so three entries a line collapse in the map tasks.
    per_product = entries.groupBy(F.col("charge.product").alias("product"), F.col("charge.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("entries"), exact_sum(F.col("charge.amount")).alias("ticks")
    )
    products = t.part.select("p_partkey", "p_type")
    return (
        per_product.join(products, F.col("product") == F.col("p_partkey"))
        .groupBy("p_type", "kind")
        .agg(F.sum("entries").alias("entries"), amount(F.sum("ticks")).alias("amount"))
    )


def adjustments_by_flag(t: Tables) -> DataFrame:
    """Entries per return flag; lines without entries stay under a NULL kind."""
    lines = t.lineitem.select("l_returnflag", "l_orderkey", adjustments().alias("entries"))
    return (
        unnest_outer(lines, "entries", "entry")
        .groupBy("l_returnflag", F.col("entry.kind").alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("rows_kept"),
            F.count("entry").alias("entries"),
            total(F.col("entry.amount")).alias("amount"),
        )
    )


def large_adjustments_by_year(t: Tables, least: int) -> DataFrame:
    """Left join of each line with its own entries above an amount."""
    lines = t.lineitem.select(year_start("l_shipdate").alias("ship_year"), adjustments().alias("entries"))
    large = unnest_outer_where(lines, "entries", lambda e: F.abs(e["amount"]) >= least * TICKS, "entry")
    return large.groupBy("ship_year").agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.count("entry").alias("entries"),
        total(F.col("entry.amount")).alias("amount"),
    )


def word_popularity(t: Tables) -> DataFrame:
    """How often each word is shown: documents hold lines, lines hold words.

    The words of a document are sorted, and each that differs from the one before it
    is marked, so one grouping by word counts places and documents.
    """
    words = F.filter(F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))), lambda w: w != "")
    texts = t.documents.select(F.sort_array(words).alias("words"))
    marked = F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit(None).cast("string")), F.col("words")).alias("before"))
    entries = unnest(texts.select(marked.alias("marked")), "marked", "entry").select("entry.*").filter(F.col("word").isNotNull())
    return entries.groupBy("word").agg(
        F.count(F.lit(1)).alias("appearances"), count_where(~F.col("word").eqNullSafe(F.col("before"))).alias("documents")
    )


def term_and_attribute_pairs(t: Tables) -> DataFrame:
    """Products per pair of a name word and an attribute: two arrays of one row, crossed."""
    parts = t.part.select(
        F.split("p_name", " ").alias("terms"),
        F.array(
            F.concat(F.lit("brand:"), "p_brand"),
            F.concat(F.lit("type:"), "p_type"),
            F.concat(F.lit("size:"), F.when(F.col("p_size") < 25, "small").otherwise("large")),
        ).alias("attributes"),
    )
    pairs = unnest_product(parts, "terms", "term", "attributes", "attribute")
    return pairs.groupBy("term", "attribute").agg(F.count(F.lit(1)).alias("products"))
