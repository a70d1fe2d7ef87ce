"""Ranked lexical search with hashed max-sketches.

Every document keeps its postings (which queried terms it holds, with what impact on a score)
and a sketch: impacts folded into ``COORDINATES`` hashed coordinates, of each the largest.
Adding up a query's coordinates gives an upper bound of a document's score, for all documents
of a block at once. Documents are scored exactly in descending order of the bound, until the
bound falls below the score that the last place needs. That score is known before the search:
a first pass scores the likeliest documents of every block, and the least of the best over the
whole table holds for all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gaugewatch.llm.common import stage
from gaugewatch.llm.decontaminate import words_of

#: Coordinates of a sketch (a power of two), documents of a block, documents scored at a time.
COORDINATES, BLOCK_ROWS, STEP = 1024, 4096, 64
#: Documents of each block that the first pass scores for a query.
SEEDS = 8
#: Queries and their words that go over the documents together; more take further rounds.
QUERIES_AT_ONCE, WORDS_AT_ONCE = 2000, 1_000_000

POSTINGS = "row long, n long, terms array<int>, times array<int>"
SKETCHED = "terms array<int>, impacts array<long>, coordinates array<short>, maxima array<long>"


def _numbers(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from all values and the length of every list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list array, and the offsets of its lists."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, row, n (terms with repeats), and the numbers and counts of the terms of ``vocabulary`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            lengths, sizes, terms, times = [], [], [], []
            for content in batch["text"]:
                words = words_of(content.as_py())
                known = np.array([n for n in map(number, words) if n is not None], np.int32)
                held, often = np.unique(known, return_counts=True)
                lengths.append(len(words))
                sizes.append(len(held))
                terms.append(held)
                times.append(often)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (terms, times)]
            columns = [pa.array(lengths, pa.int64()), *[_numbers(x, sizes, pa.int32()) for x in flat]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row"], *columns], ["doc_id", "row", "n", "terms", "times"]
            )

    return rows.mapInArrow(count, f"doc_id {kind}, {POSTINGS}")


def length_factors(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """50 and half a hundred times the length against the mean length, rounded down."""
    if len(n) and 50 * n_docs * int(n.max()) >= 2**63:
        return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 50 + 50 * n * n_docs // max(1, n_terms)


def coordinates_of(terms: np.ndarray) -> np.ndarray:
    """The sketch coordinate of a term number."""
    mixed = terms.astype(np.uint32) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - COORDINATES.bit_length() + 1)).astype(np.int16)


def sketch(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, row and, for documents with queried terms, their impacts and the sketch of these."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    kind = counted.schema["doc_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, offsets = _flat(batch["terms"])
            times = _flat(batch["times"])[0].astype(np.int64)
            sizes = np.diff(offsets)
            factor = np.repeat(length_factors(batch["n"].to_numpy(), n_docs, n_terms), sizes)
            impacts = shared.value[terms] * (10**9 * times // (1000 * times + 20 * factor))
            # The largest impact of each coordinate of each document.
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = doc * COORDINATES + coordinates_of(terms)
            order = np.lexsort((impacts, place))
            last = np.flatnonzero(np.append(place[order][1:] != place[order][:-1], True)) if len(place) else order
            kept, best = place[order][last], impacts[order][last]
            folded = np.bincount(kept // COORDINATES, minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["row"],
                    batch["terms"],
                    _numbers(impacts, sizes, pa.int64()),
                    _numbers((kept % COORDINATES).astype(np.int16), folded, pa.int16()),
                    _numbers(best, folded, pa.int64()),
                ],
                ["doc_id", "row", "terms", "impacts", "coordinates", "maxima"],
            )

    return counted.where(F.size("terms") > 0).mapInArrow(fold, f"doc_id {kind}, row long, {SKETCHED}")


class Block:
    """Postings and sketches of some documents."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, n_terms: int):
        column = lambda name: pa.concat_arrays(batch[name].chunks) if isinstance(batch, pa.Table) else batch[name]
        self.terms, self.offsets = _flat(column("terms"))
        self.impacts = _flat(column("impacts"))[0]
        self.size = len(self.offsets) - 1
        coordinates, offsets = _flat(column("coordinates"))
        self.sketches = np.zeros((COORDINATES, self.size), np.int64)
        self.sketches[coordinates, np.repeat(np.arange(self.size), np.diff(offsets))] = _flat(column("maxima"))[0]
        self.asked = np.zeros(n_terms, bool)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """No document scores more than its bound."""
        return self.sketches[coordinates_of(query)].sum(0)

    def scores(self, query: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        self.asked[query] = True
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[docs] - (ends - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(np.where(self.asked[self.terms[at]], self.impacts[at], 0))])
        self.asked[query] = False
        return sums[ends] - sums[ends - sizes]

    def seeds(self, query: np.ndarray, n: int) -> np.ndarray:
        """Exact scores of the ``n`` documents of the highest bounds."""
        bounds = self.bounds(query)
        docs = np.argpartition(-bounds, n - 1)[:n] if self.size > n else np.arange(self.size)
        return self.scores(query, docs)

    def best(self, query: np.ndarray, k: int, least: int, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best documents of score ``least`` or more, their scores, and how many were scored.

        ``ties`` orders documents of equal score.
        """
        bounds = self.bounds(query)
        able = np.flatnonzero(bounds >= max(1, least))
        turn = able[np.argsort(-bounds[able], kind="stable")]
        docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        scored = 0
        while scored < len(turn):
            if len(docs) == k and bounds[turn[scored]] < found[-1]:
                break
            chosen = turn[scored : scored + STEP]
            scored += len(chosen)
            scores = self.scores(query, chosen)
            good = scores >= max(1, least)
            docs, found = np.concatenate([docs, chosen[good]]), np.concatenate([found, scores[good]])
            kept = np.lexsort((ties[docs], -found))[:k]
            docs, found = docs[kept], found[kept]
        return docs, found, scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of up to ``BLOCK_ROWS`` rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            piece = batch.slice(at, BLOCK_ROWS)
            if n + piece.num_rows > BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _ties(names: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Turns of documents of equal score: by identifier, nulls last, then by row."""
    table = pa.table({"name": names, "row": rows})
    order = pa.compute.sort_indices(table, [("name", "ascending"), ("row", "ascending")], null_placement="at_end")
    turns = np.empty(len(rows), np.int64)
    turns[order.to_numpy()] = np.arange(len(rows))
    return turns


def search(sketched: DataFrame, queries: dict[int, np.ndarray], n_terms: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, doc_id, row, score of at most ``k`` documents a block, the best ``k`` of all among them; blocks' work).

    The second one has, for every block, the documents it holds and how many were scored
    exactly, summed over the queries.
    """
    spark = sketched.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    kind = sketched.schema["doc_id"].dataType.simpleString()

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table, n_terms)
            found = {q: block.seeds(terms, min(SEEDS, k)) for q, terms in shared.value.items()}
            names = np.repeat(np.fromiter(found, np.int32, len(found)), [len(x) for x in found.values()])
            scores = np.concatenate([*found.values(), np.zeros(0, np.int64)])
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(scores, pa.int64())], ["query", "score"])

    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    first = sketched.mapInArrow(seeds, "query int, score long").withColumn("turn", turn).where(F.col("turn") <= k)
    # One number per query: what the last place needs at least.
    needed = first.where(F.col("turn") == k).select("query", "score").toArrow().to_pydict()
    least = dict(zip(needed["query"], needed["score"]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table, n_terms)
            rows = table["row"].to_numpy()
            ties = _ties(table["doc_id"], rows)
            names, docs, scores, work = [], [], [], 0
            for q, terms in shared.value.items():
                own, found, scored = block.best(terms, k, least.get(q, 1), ties)
                names.append(np.full(len(own), q, np.int32))
                docs.append(own)
                scores.append(found)
                work += scored
            at = pa.array(np.concatenate(docs).astype(np.int64))
            columns = [
                pa.array(np.concatenate(names)),
                pa.concat_arrays(table["doc_id"].chunks).take(at),
                pa.array(rows).take(at),
                pa.array(np.concatenate(scores).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "row", "score"])
            # Work of the block: no query, the documents it holds, those it scored.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None], pa.int32()),
                    pa.nulls(1, columns[1].type),
                    pa.array([block.size * len(names)], pa.int64()),
                    pa.array([work], pa.int64()),
                ],
                ["query", "doc_id", "row", "score"],
            )

    found = stage(sketched.mapInArrow(rank, f"query int, doc_id {kind}, row long, score long"))
    work = found.where(F.col("query").isNull()).select(F.col("row").alias("held"), F.col("score").alias("scored"))
    return found.where(F.col("query").isNotNull()), work


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents for every row of ``queries``.

    Scores are those of the module's contract: term weights from how many documents hold a
    term, impacts that level off with a term's count and fall with the document's length, all
    in whole numbers. A term counts once in a query. Ties go to the smaller identifier, nulls
    last, then to the earlier row. Null and empty texts hold no terms: as documents they are
    not counted, as queries they find nothing. Repeated rows are documents, or queries, each
    for itself, so a repeated item has each of its ranks several times. Columns of the same
    names in both tables, and other columns, have no effect. Empty tables give no rows.

    Queries go in rounds bounded by ``QUERIES_AT_ONCE`` and ``WORDS_AT_ONCE`` (one query may be longer); each round
    reads the texts once and shuffles none of them.
    """
    spark = docs.sparkSession
    asked = queries.select(
        F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("item")
    )
    asked = stage(asked.withColumn("letters", F.coalesce(F.octet_length("text"), F.lit(0))))
    n_asked, letters = asked.agg(F.count("*"), F.coalesce(F.sum("letters"), F.lit(0))).first()
    # A word takes two bytes at least, with its separator.
    rounds = max(1, -(-n_asked // QUERIES_AT_ONCE), -(-letters // (2 * WORDS_AT_ONCE)))
    found = None
    for turn in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == turn).select("item", "text").toArrow()
        vocabulary: dict[bytes, int] = {}
        terms_of = {}
        for item, content in zip(own["item"].to_pylist(), own["text"].to_pylist()):
            words = dict.fromkeys(words_of(content))
            if words:
                terms_of[item] = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)
        counted = stage(postings(docs, vocabulary, doc_id, text))
        n_docs, n_terms = counted.where(F.col("n") > 0).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One number for every term of this round's queries.
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[held["term"].to_numpy()] = held["count"].to_numpy()
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        sketched = stage(sketch(counted, weights, n_docs, n_terms))
        numbers = dict(enumerate(terms_of))
        hits, _ = search(sketched, {i: terms_of[item] for i, item in numbers.items()}, len(vocabulary), k)
        names = spark.createDataFrame(
            pa.table({"query": pa.array(list(numbers), pa.int32()), "item": pa.array(list(numbers.values()), pa.int64())})
        )
        hits = hits.join(names, "query").select("item", "doc_id", "row", "score")
        found = hits if found is None else found.unionByName(hits)
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    named = ranked.join(asked.select("item", "item_id"), "item")
    return named.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")
