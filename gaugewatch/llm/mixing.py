"""Mixing sources to target weights by thresholds on a hash, without sorting.

A document's hash is fixed by its identifier. A source that needs x words beyond whole passes
takes every document whose hash lies below a threshold. The threshold is found digit by digit:
word sums by source and hash digit give the digit that holds the x-th word, and only the
documents of that bucket are looked at for the next digit. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.llm.common import stage

#: Hash bits, and bits of a digit: a source has at most 2**DIGIT histogram rows.
BITS, DIGIT = 60, 10


def words_in(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed, return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the identifier as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size and target for (source, size) rows.

    Sources in the order of their code points, null last, get the weights in turn. A level l
    gives each source min(l * weight, most * source_size); the level that gives out
    share * total is the largest of those that follow when the sources with the smallest
    most * source_size / weight are taken as full, one more each time. The windows run over
    one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight).withColumn("full", F.lit(most) * F.col("source_size"))
    everyone = Window.partitionBy()
    ordered = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.lit(share) * F.sum("source_size").over(everyone) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    return levels.select(
        "source",
        "source_size",
        F.least(F.max("level").over(everyone) * F.col("weight"), "full").alias("target"),
    )


def thresholds(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """source, threshold, rest and at: where the needed words end.

    ``rows`` has source, size and place; ``needs`` has source and need, below the source's size.
    Words at places below the threshold come to need - rest; ``at`` words stand at the threshold.
    """
    bounds = needs.select("source", F.lit(0).cast("long").alias("prefix"), F.col("need").alias("rest"))
    inside = rows
    for level in range(BITS // DIGIT):
        shift = BITS - DIGIT * (level + 1)
        known = bounds.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "rest")
        here = inside.join(
            known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + DIGIT) == F.col("p"))
        ).withColumn("digit", F.shiftright("place", shift))
        sums = here.groupBy("source", "digit").agg(F.sum("size").alias("at"), F.first("rest").alias("rest"))
        upto = Window.partitionBy("source").orderBy("digit")
        summed = sums.withColumn("upto", F.sum("at").over(upto))
        edge = (F.col("rest") >= F.col("upto") - F.col("at")) & (F.col("rest") < F.col("upto"))
        bounds = stage(
            summed.where(edge).select(
                "source", F.col("digit").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("at")).alias("rest"), "at"
            )
        )
        if level == 0:
            # What is left is about one in 2**DIGIT of the documents.
            inside = stage(
                rows.join(
                    bounds.select(F.col("source").alias("s"), F.col("prefix").alias("p")),
                    F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift) == F.col("p")),
                ).select(*rows.columns)
            )
    return bounds.withColumnRenamed("prefix", "threshold")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Columns ``keep``, doc_id, size, source_size, target and taken for every row of ``docs``.

    ``taken`` counts words, repeats included: each document gives the whole passes its source
    needs, those below the source's threshold one pass more, and the document at the threshold
    the words still missing, so that a source comes within a word of its target. Rows that
    share an identifier share a hash; at the threshold they split what is missing in
    proportion to their sizes. A null or text without words has size 0 and gives nothing; a
    null source is a source of its own, a null identifier an identifier of its own. Reruns
    and other partitionings give the same result. An empty table gives no rows.
    """
    whole = docs.select(
        *keep,
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words_in(F.col(text).cast("string")).alias("size"),
        place(F.col(doc_id)).alias("place"),
    )
    rows = stage(whole.drop(*keep))
    targets = source_targets(rows, weights, share, most)
    # A source without words gives no whole pass; a plain division by its size would raise.
    passes = F.floor(F.try_divide("target", "source_size"))
    targets = targets.withColumn("passes", F.coalesce(passes, F.lit(0)).cast("long"))
    need = F.floor("target").cast("long") - F.col("passes") * F.col("source_size")
    targets = stage(targets.withColumn("need", need))
    edges = thresholds(rows.select("source", "size", "place"), targets.where(F.col("need") > 0).select("source", "need"))
    edges = edges.withColumnRenamed("source", "edge_source")
    plan = targets.join(edges, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    # One row per source; staged, its size is known, so kept columns need not move.
    plan = stage(plan.withColumnRenamed("source", "plan_source"))
    joined = (whole if keep else rows).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    at_edge = F.when(F.col("at") == F.col("size"), F.col("rest")).otherwise(
        F.floor(F.col("rest") * (F.col("size") / F.col("at"))).cast("long")
    )
    extra = (
        F.when(F.col("place") < F.col("threshold"), F.col("size"))
        .when(F.col("place") == F.col("threshold"), at_edge)
        .otherwise(F.lit(0))
    )
    taken = F.col("passes") * F.col("size") + F.coalesce(extra, F.lit(0))
    return joined.select(*keep, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
