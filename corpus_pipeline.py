"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewatch.llm import decontaminate, jaccard, language, mixing, secret_scan
from gaugewatch.llm.common import bucket_of, row_key, ship, stage, table
from gaugewatch.session import scratch_dir, use_utc


def keyed(docs: DataFrame) -> DataFrame:
    """whole (all columns), doc_id, text and row, a key by which stages decide: identifiers may be null or repeat."""
    return docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text", row_key(docs.columns).alias("row"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or is claimed by no language."""
    model = language.fit(docs, F.coalesce(bucket_of("doc_id", 4) != 2, F.lit(True)))
    # Whole rows in one column, so that no column of theirs clashes with a new one.
    rows = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    judged = language.identify(rows, model, keep=("whole",))
    return judged.where(~F.col("rejected")).select("whole.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8) the row of least identifier stays, nulls last.

    Rows that agree in all columns are one; others that share an identifier go by their texts.
    Rows are told apart by a 256-bit key, and numbered for the comparison.
    """
    unique = keyed(docs).dropDuplicates(["row"]).drop("row")
    rows = stage(unique.withColumn("number", F.monotonically_increasing_id()))
    found = jaccard.similarity_components(rows.select("number", "text"), n=5, percent=80, doc_id="number")
    copies = found.where(F.col("number") != F.col("component_id")).select("number", "component_id")
    heads = copies.select(F.col("component_id").alias("number"), "component_id").distinct()
    members = stage(copies.union(heads))
    ranked = rows.select("number", "doc_id").join(members, "number")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "number")
    least = ranked.groupBy("component_id").agg(F.min(first)["number"].alias("least"))
    gone = stage(members.join(least, "component_id").where(F.col("number") != F.col("least")).select("number"))
    return rows.join(gone, "number", "left_anti").select("whole.*")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows.select("row", "text"), table(spark, sf_dir, "benchmark"), doc_id="row")
    dirty = found.where("contaminated").select("row").distinct()
    return rows.join(dirty, "row", "left_anti").select("whole.*")


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a secret was found go."""
    rows = keyed(docs)
    found, _ = secret_scan.scan_history(rows.select("row", "text"), path="row")
    kinds = [F.size(rule.kind) > 0 for rule in secret_scan.RULES]
    leaking = found.where(kinds[0] | kinds[1] | kinds[2]).select(F.col("path").alias("row")).distinct()
    return rows.join(leaking, "row", "left_anti").select("whole.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, whole, with size, source_size, target and taken.

    Columns of these names in ``docs`` give way to the mix's own.
    """
    made = ["size", "source_size", "target", "taken"]
    rows = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text", "source")
    taken = mixing.mix(rows, keep=("whole",)).where(F.col("taken") > 0)
    return taken.select(*[F.col("whole")[c].alias(c) for c in docs.columns if c not in made], *made)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_text),
    ("secrets", drop_secrets),
    ("mixing", mix_sources),
]

#: Language models and shingle components with a learned filter before them: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: whole rows, with what the mix takes of each. An empty table gives no rows."""
    use_utc(spark)
    ship(spark)
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
