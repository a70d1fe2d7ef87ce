"""Secret scans over every version of every path, by a ledger of scanned blobs.

A version is addressed by the SHA-256 of its text. A blob is scanned once for each version of
each rule, however many paths and commits hold it; the ledger keeps the outcome, and findings
reach the paths by a join on the address. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.llm.common import stage

SPAN = "array<struct<start:int,end:int>>"
LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: A run shorter than the least length holds no longer one, so for the last two the least
#: length is in the pattern; a short assignment does use up text that another could start in.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """(start, end) of each match in code points, end exclusive.

    Each piece is what lies before a match, and the match, so the lengths of the pieces add
    up to the places. ``\\G`` lets a piece start only where the last one ended.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{rule.pattern})"), F.lit(0))

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        start = end - F.length(F.regexp_extract(piece, rule.pattern, 0))
        good = F.length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least
        found = F.when(good, F.array_append(state["found"], F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.coalesce(found, state["found"]).alias("found"))

    empty = F.array().cast(SPAN)
    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("found")), add)["found"]
    return F.when(text.rlike(rule.pattern), walked).otherwise(empty)


def address(history: DataFrame, path: str, text: str) -> DataFrame:
    """path, text and blob of every version; a null text is the empty blob."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return history.select(F.col(path).alias("path"), content.alias("text")).withColumn("blob", F.sha2("text", 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the (blob, rule version) pairs that ``ledger`` lacks, as a staged table.

    One version stands for each blob; texts move once, to meet the choice of that version.
    """
    chosen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    known = F.array().cast("array<string>")
    if ledger is not None:
        current = reduce(
            Column.__or__, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules], F.lit(False)
        )
        done = ledger.where(current).groupBy("blob").agg(F.collect_set("kind").alias("known"))
        chosen = chosen.join(done, "blob", "left").withColumn("known", F.coalesce("known", known))
        chosen = chosen.where(F.size("known") < len(rules))
    else:
        chosen = chosen.withColumn("known", known)
    chosen = chosen.select(F.col("path").alias("at"), F.col("blob").alias("address"), "known")
    same = F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("address"))
    unseen = versions.join(chosen, same)
    scans = [
        F.when(
            ~F.array_contains("known", rule.kind),
            F.struct(
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.version).alias("version"),
                spans_of(F.col("text"), rule).alias("spans"),
            ),
        )
        for rule in rules
    ]
    rows = unseen.select("blob", F.explode(F.array_compact(F.array(*scans))).alias("scan")).select("blob", "scan.*")
    # Rows that repeat path and text give a pair twice.
    return stage(rows.dropDuplicates(["blob", "kind"]))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and the spans of every rule for every version, clean ones included."""
    current = reduce(Column.__or__, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    found = ledger.where(current & (F.size("spans") > 0)).groupBy("blob")
    per_rule = [
        F.first(F.when(F.col("kind") == r.kind, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules
    ]
    joined = versions.select("path", "blob").join(found.agg(*per_rule), "blob", "left")
    return joined.select(
        "path", "blob", *[F.coalesce(r.kind, F.array().cast(SPAN)).alias(r.kind) for r in rules]
    )


def scan_history(
    history: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    path: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(findings of every version, ledger with the new pairs).

    A null or empty text has no findings. Repeated rows each get theirs. An empty history
    adds nothing to the ledger. Other columns of ``history`` have no effect.
    """
    versions = address(history, path, text)
    new = scan_unseen(versions, ledger, rules)
    full = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return findings(versions, full, rules), full


def span_text(rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` by start, then in the order of the rules, comma-joined."""

    def marked(turn: int, rule: Rule) -> Column:
        return F.transform(
            rule.kind,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(turn).alias("turn"),
                F.concat_ws(":", F.lit(rule.kind), s["start"], s["end"]).alias("shown"),
            ),
        )

    every = F.concat(*[marked(turn, rule) for turn, rule in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["shown"]), ",")
