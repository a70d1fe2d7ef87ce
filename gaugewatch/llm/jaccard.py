"""Jaccard links of documents by a blocked sparse product of the document-by-n-gram incidence.

Only the columns that can decide are multiplied. Under any order of the n-grams, two sets of
similarity t or more share k of the first |x| - ceil(t|x|) + k of either, so the product runs
over these and accumulates their overlap; n-grams that many documents share come last in the
order. Pairs are dropped by bounds that follow from the sizes: fewer than k n-grams shared (or
ceil(t|x|), if that is less), one set below t times the other, or a symmetric difference above
(1 - t) / (1 + t) of both sizes, which a 512-bit parity sketch bounds from below. What is left
is counted exactly.

Equal sets are one row from the start. Each n-gram's rows first meet the row of least
identifier only; whatever links joins that row's component, and only rows that are still in
different components meet each other. So a large group of near copies costs its size, not its
square, unless its members really fall apart. This gives components only: links inside a
component are skipped. ``similarity_links`` lists them all, which in a group of different near
copies are as many as its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.llm.common import only, row_key, stage

#: ASCII letters in lower case; blank, tab, line feed, vertical tab, form feed and return split words.
WORD_BYTES = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The share of documents whose n-grams are counted to find common ones, how often one must
#: occur there, and how many are kept. This orders n-grams; no result depends on it.
COUNTED, COMMON, MOST_COMMON = 16, 2, 2_000_000
#: k above: what two linked sets share of the first n-grams of both at least.
SHARED = 4
SKETCH_WORDS = 8
CACHE_WORDS = 500_000


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The set of hashed ``n``-word shingles, ascending; fewer words are one shingle, none give an empty set."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(codes))
    total = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        total = (total ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(29)))


def prefix_length(size: int, percent: int) -> int:
    """The n-grams of a set that the product runs over."""
    least = -(-percent * size // 100)
    return size - least + min(SHARED, least)


def common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles that many of a sixteenth of the texts hold, at most ``MOST_COMMON``; ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), n, hashes) for t in batch["text"]]
            if sets:
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "times"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select("text")
    counted = some.mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    counted = stage(counted.where(F.col("times") >= COMMON))
    # The least number of times at which the bound on how many are kept holds.
    least, kept = COMMON, 0
    for times, rows in sorted(counted.groupBy("times").count().collect(), reverse=True):
        kept += rows
        if kept > MOST_COMMON:
            least = times + 1
            break
    return np.sort(counted.where(F.col("times") >= least).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))


def incidence(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """doc, size, same (digest of the set), sketch and prefix of every row."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, n))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, common = WordHashes(), shared.value
        for batch in batches:
            sizes, same, sketches, prefixes = [], [], [], []
            for content in batch["text"]:
                found = shingles(content.as_py(), n, hashes)
                at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
                often = common[at] == found if len(common) else np.zeros(len(found), bool)
                ordered = np.concatenate([found[~often], found[often]])
                bits = np.bincount((found >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
                sizes.append(len(found))
                same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                prefixes.append(ordered[: prefix_length(len(found), percent)].view(np.int64))
            columns = [
                batch["doc"],
                pa.array(sizes, pa.int64()),
                pa.array(same, pa.binary()),
                pa.array(sketches, pa.list_(pa.int64())),
                pa.array(prefixes, pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, ["doc", "size", "same", "sketch", "prefix"])

    kind = texts.schema["doc"].dataType.simpleString()
    shown = f"doc {kind}, size long, same binary, sketch array<long>, prefix array<long>"
    return stage(texts.select("doc", "text").mapInArrow(rows, shown))


def may_link(a: str, b: str, percent: int) -> Column:
    """The bounds from sizes and sketches for rows ``a`` and ``b`` with columns size and s0, s1, ..."""
    one, other = F.col(f"{a}.size"), F.col(f"{b}.size")
    sizes = (one * 100 >= other * percent) & (other * 100 >= one * percent)
    apart = reduce(
        Column.__add__, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_WORDS)]
    )
    # |x ^ y| = |x| + |y| - 2 |x & y|, and the overlap is at least t / (1 + t) of both sizes.
    return sizes & (apart * (100 + percent) <= (one + other) * (100 - percent))


def linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough."""
    ids = stage(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct())
    asked = only(texts.select("doc", "text"), ids, "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            kept, last, second = [], None, None
            for one, other in zip(batch["text_a"], batch["text_b"]):
                if last is None or not one.equals(last):
                    last, second = one, shingles(one.as_py(), n, hashes)
                first = shingles(other.as_py(), n, hashes)
                both = len(np.intersect1d(first, second, assume_unique=True))
                kept.append(bool(both) and 100 * both >= percent * (len(first) + len(second) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    kind = texts.schema["doc"].dataType.simpleString()
    with_b = pairs.join(asked.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(asked.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}").distinct())


def components(edges: DataFrame) -> DataFrame:
    """doc and component (least identifier) of every document in ``edges`` (a, b), by alternating stars."""
    current = stage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 2**31)).first()
        if state == before:
            break
        before = state
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = stage(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = stage(small.union(least.select("a", F.col("least").alias("b"))).distinct())
    return current.select(F.col("a").alias("doc"), F.col("b").alias("component"))


def _labelled(found: DataFrame) -> DataFrame:
    """Components with the least member itself."""
    return stage(found.union(found.select(F.col("component").alias("doc"), "component")).distinct())


def candidates(rows: DataFrame, percent: int, also: Column | None = None) -> DataFrame:
    """The pairs (a, b) that the bounds leave, a below b, of staged rows doc, shingle, size, s0, s1, ...

    ``also`` is one more condition on the sides ``x`` and ``y``.
    """
    x, y = rows.alias("x"), rows.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc") < F.col("y.doc")) & may_link("x", "y", percent)
    met = x.join(y, meet if also is None else meet & also).groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    met = met.agg(F.count("*").alias("shared"), F.min("x.size").alias("size_a"), F.min("y.size").alias("size_b"))
    least = F.ceil(F.least("size_a", "size_b") * percent / 100)
    return stage(met.where(F.col("shared") >= F.least(F.lit(SHARED), least)).select("a", "b"))


def similarity_links(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(every link between different shingle sets; what each row of ``docs`` links to).

    Links are set_a, set_b, doc_a, doc_b, rows_a and rows_b, once for each pair: the sets'
    keys, their least identifiers and how many rows hold them. Rows are doc_id, n_shingles, set
    and n_links, the number of other rows that the row's text links with, rows of an equal set
    included. A row without identifier, or without words, is in no set and has no links.
    Linking is that of ``similarity_components``; reruns give the same keys.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("doc", F.when(F.col("doc_id").isNotNull(), F.xxhash64(row_key(["doc_id", "text"]))))
    # The identifiers of the keys; rows that agree in identifier and text have one key.
    ids = stage(texts.select("doc", "doc_id").where(F.col("doc").isNotNull()).distinct())
    rows = incidence(texts, n, percent)
    named = rows.where(F.col("doc").isNotNull() & (F.col("size") > 0))
    sets = named.join(ids, "doc").groupBy("same").agg(
        F.min("doc").alias("set"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")
    )
    sets = stage(sets)
    keys = sets.select("same", F.col("set").alias("doc"))
    own = named.join(keys, ["same", "doc"], "left_semi").dropDuplicates(["doc"])
    sketches = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)]
    entries = own.select("doc", "size", *sketches, F.explode("prefix").alias("shingle"))
    several = entries.groupBy("shingle").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    entries = stage(entries.join(several, "shingle", "left_semi"))
    distinct = texts.select("doc", "text").where(F.col("doc").isNotNull()).join(keys.select("doc"), "doc", "left_semi")
    pairs = linked(candidates(entries, percent), distinct.dropDuplicates(["doc"]), n, percent)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("set").alias(name), F.col("least_id").alias(f"doc_{name}"), F.col("rows").alias(f"rows_{name}"))

    links = pairs.join(side("a"), "a").join(side("b"), "b")
    links = stage(
        links.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "doc_a", "doc_b", "rows_a", "rows_b")
    )
    ends = links.select(F.col("set_a").alias("set"), F.col("rows_b").alias("linked"))
    ends = ends.union(links.select(F.col("set_b").alias("set"), F.col("rows_a").alias("linked")))
    counted = sets.join(ends.groupBy("set").agg(F.sum("linked").alias("linked")), "set", "left")
    counted = counted.select("same", "set", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    # The digest of a row without identifier meets no set.
    same = F.when(F.col("doc").isNotNull() & (F.col("size") > 0), F.col("same"))
    out = rows.withColumn("same", same).join(counted, "same", "left").join(ids, "doc", "left")
    return links, out.select(
        F.col("doc_id").alias(doc_id),
        F.col("size").alias("n_shingles"),
        "set",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def similarity_components(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Documents link when 100 * |x & y| >= percent * |x | y| for their shingle sets; a component
    is what links reach, named by its least identifier. A null text, or one without words, has
    an empty set and is alone. Rows that repeat an identifier are one document that links
    wherever one of its texts does; a row without identifier is alone, with a null component.
    An empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = incidence(texts, n, percent)
    named = rows.where(F.col("doc").isNotNull() & (F.col("size") > 0))
    equal = stage(named.groupBy("same").agg(F.min("doc").alias("doc")))
    sets = named.join(equal, ["same", "doc"], "left_semi")
    sketched = sets.select("doc", "size", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)]).distinct()

    entries = sets.select("doc", "size", F.explode("prefix").alias("shingle"))
    heads = entries.groupBy("shingle").agg(F.min("doc").alias("head"), F.count("*").alias("rows"))
    heads = heads.where(F.col("rows") > 1)
    members = stage(entries.join(heads, "shingle").select("shingle", "doc", "head"))

    def enough(a: str, b: str) -> Column:
        """Of the n-grams counted in ``shared``."""
        least = F.ceil(F.least(F.col(f"{a}.size"), F.col(f"{b}.size")) * percent / 100)
        return F.col("shared") >= F.least(F.lit(SHARED), least)

    # Every member against the least one of its n-grams.
    stars = members.where(F.col("doc") != F.col("head")).groupBy(F.col("head").alias("a"), F.col("doc").alias("b"))
    stars = stars.agg(F.count("*").alias("shared"))
    one, other = sketched.alias("x"), sketched.alias("y")
    stars = stars.join(one, F.col("b") == F.col("x.doc")).join(other, F.col("a") == F.col("y.doc"))
    stars = stage(stars.where(may_link("x", "y", percent) & enough("x", "y")).select("a", "b"))
    links = linked(stars, texts, n, percent)
    found = _labelled(components(links))

    # Members that are still apart: all n-grams that two of them share are open.
    open_rows = members.select("shingle", "doc").join(found, "doc", "left")
    open_rows = open_rows.withColumn("component", F.coalesce("component", "doc"))
    several = open_rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = several.where(F.col("low") != F.col("high"))
    apart = stage(open_rows.join(several, "shingle", "left_semi").join(sketched, "doc"))
    rest = candidates(apart, percent, F.col("x.component") != F.col("y.component"))
    links = links.union(linked(rest, texts, n, percent))
    found = _labelled(components(links))

    named_sets = equal.join(found, "doc", "left").select("same", F.coalesce("component", "doc").alias("set_component"))
    # Identifiers with several texts belong to the least of their components.
    placed = named.select("doc", "same").join(named_sets, "same")
    repeats = placed.groupBy("doc").agg(F.min("set_component").alias("component_id"))
    out = rows.select("doc", "size").join(repeats, "doc", "left")
    return out.select(
        F.col("doc").alias(doc_id), F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")
    )
