"""Benchmark decontamination with a positional inverted index, distributed by document.

Every shard of documents holds postings: for each word of the benchmark, the places where it
stands. A window of a benchmark item is looked up from its rarest word in the shard: each
posting less the word's offset is a place where the window can start, and these places are
intersected with the offset-adjusted postings of its other words, rarer ones first. What is
left after all words are exact occurrences; nothing is shuffled to find them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.llm.common import row_key, stage

#: Words of a window, and words of a shard of documents.
WINDOW, SHARD_WORDS = 10, 2_000_000
#: Windows that go over the documents together; more go in further blocks.
WINDOWS_AT_ONCE = 200_000

#: ASCII letters in lower case, digits and every byte of a non-ASCII letter stay; the rest is blank.
WORD_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, window (its words as one blank-joined string) and length, one row each.

    An item of fewer than ``size`` words is one window; one without words has none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, content in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(content)
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    rows.append((item, b" ".join(words[at : at + size]).decode(), len(words[at : at + size])))
            columns = list(zip(*rows)) or [(), (), ()]
            types = (pa.string(), pa.string(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "window", "length"])

    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    return items.mapInArrow(cut, "item_id string, window string, length int").distinct()


class Shard:
    """Postings of the words of ``vocabulary`` over some documents, one after the other.

    Between documents stands a gap that no word fills, as long as the longest window.
    """

    def __init__(self, texts: list[list[bytes]], vocabulary: dict[bytes, int], gap: int = WINDOW):
        lengths = np.array([len(words) for words in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths + gap)])[: len(texts)] if texts else np.zeros(0, np.int64)
        size = int((lengths + gap).sum())
        self.word_at = np.full(size, -1, np.int32)
        for at, words in zip(self.first, texts):
            self.word_at[at : at + len(words)] = np.fromiter((vocabulary.get(w, -1) for w in words), np.int32, len(words))
        self.places = np.argsort(self.word_at, kind="stable")
        bounds = np.searchsorted(self.word_at[self.places], np.arange(len(vocabulary) + 1))
        self.begin, self.end = bounds[:-1], bounds[1:]

    def postings(self, word: int) -> np.ndarray:
        """Places of a word, ascending."""
        return self.places[self.begin[word] : self.end[word]]

    def starts(self, window: np.ndarray) -> np.ndarray:
        """Places where all words of ``window`` (word numbers) stand at their offsets."""
        order = np.argsort(self.end[window] - self.begin[window], kind="stable")
        found = self.postings(window[order[0]]) - order[0]
        found = found[found >= 0]
        for offset in order[1:]:
            if not len(found):
                break
            # A place is in the offset-adjusted list of a word if that word stands there.
            found = found[self.word_at[found + offset] == window[offset]]
        return found

    def documents(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number and position inside it."""
        doc = np.searchsorted(self.first, places, side="right") - 1
        return doc, places - self.first[doc]


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[tuple[pa.Array, Shard, list[int]]]:
    """Documents of up to ``SHARD_WORDS`` words, or one longer document, their index and their lengths."""
    for batch in batches:
        texts, size, since = [], 0, 0
        for row, content in enumerate(batch["text"]):
            texts.append(words_of(content.as_py()))
            size += len(texts[-1])
            if size > SHARD_WORDS or row + 1 == batch.num_rows:
                yield batch["doc"].slice(since, len(texts)), Shard(texts, vocabulary), [len(t) for t in texts]
                texts, size, since = [], 0, row + 1


def find_windows(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, window, start and length of every occurrence of a window; doc and n_words of every row), exactly.

    Windows go in blocks of ``WINDOWS_AT_ONCE``, so what is sent to the executors has a bound
    whatever the benchmark's size. Occurrences in rows that repeat an identifier, or have none,
    are listed for each row.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    distinct = stage(windows.select("window").distinct())
    blocks = max(1, -(-distinct.count() // WINDOWS_AT_ONCE))
    found = lengths = None
    for block in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        asked = sorted(own.toArrow()["window"].to_pylist())
        shared = docs.sparkSession.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            vocabulary: dict[bytes, int] = {}
            numbered = [
                np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.encode().split(b" ")]) for text in asked
            ]
            for ids, shard, sizes in _shards(batches, vocabulary):
                rows, names, starts, spans = list(range(len(sizes))), [None] * len(sizes), [0] * len(sizes), list(sizes)
                for window, text in zip(numbered, asked):
                    places = shard.starts(window)
                    if len(places):
                        doc, at = shard.documents(places)
                        rows += doc.tolist()
                        names += [text] * len(at)
                        starts += at.tolist()
                        spans += [len(window)] * len(at)
                columns = [ids.take(pa.array(rows, pa.int64())), pa.array(names, pa.string())]
                columns += [pa.array(starts, pa.int64()), pa.array(spans, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "window", "start", "length"])

        # Rows without window hold the length of every document.
        rows = stage(texts.mapInArrow(search, f"doc {kind}, window string, start long, length long"))
        hits = rows.where(F.col("window").isNotNull())
        found = hits if found is None else found.unionByName(hits)
        if lengths is None:
            lengths = rows.where(F.col("window").isNull()).select("doc", F.col("length").alias("n_words"))
    return found, lengths


def covered(starts: str) -> Column:
    """Words under the windows of an array of (start, length), each counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, window: Column) -> Column:
        end = F.greatest(state["to"], window["start"] + window["length"])
        new = end - F.greatest(state["to"], window["start"])
        return F.struct(end.alias("to"), (state["n"] + F.greatest(new, F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(starts), zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``.

    A word is hit if it lies under any occurrence of a benchmark window. Null and empty texts
    have no words and are clean, as is everything if the benchmark has no words. Every row is
    judged by its own text, also where identifiers are null or repeat. Benchmark items of one
    identifier count once. Occurrences gather per identifier and text only, where the text's
    length bounds them.
    """
    windows = stage(benchmark_windows(benchmark))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select(F.struct("doc_id", row_key(["doc_id", "text"]).alias("row")).alias("doc"), "text")
    occurrences, counted = find_windows(rows, windows, "doc", "text")
    hits = occurrences.withColumn("doc", F.col("doc.row"))
    counted = counted.select("doc.doc_id", F.col("doc.row").alias("doc"), "n_words")
    spans = hits.groupBy("doc").agg(F.collect_set(F.struct("start", "length")).alias("starts"))
    spans = spans.select("doc", covered("starts").alias("n_hit"))
    items = hits.select("doc", "window").distinct().join(windows.select("window", "item_id"), "window")
    items = items.groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = spans.join(items, "doc", "left").withColumnRenamed("doc", "hit_doc")
    all_rows = counted.join(found, F.col("doc") == F.col("hit_doc"), "left")
    none = F.array().cast("array<string>")
    return all_rows.select(
        F.col("doc_id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def near_matches(docs: DataFrame, phrase: str, slack: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start and stop (exclusive) of stretches that hold the words of ``phrase`` in order, close together.

    The stretch may be ``slack`` words longer than the phrase. It starts at the phrase's first
    word; of the stops from one start the first counts. A phrase without words matches nothing.
    """
    words = words_of(phrase)
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
        for ids, shard, _ in _shards(batches, vocabulary):
            starts = shard.postings(vocabulary[words[0]]) if words else np.zeros(0, np.int64)
            last = starts
            for word in words[1:]:
                postings = np.append(shard.postings(vocabulary[word]), np.iinfo(np.int64).max)
                last = postings[np.searchsorted(postings, last, side="right")]
                near = last < starts + len(words) + slack
                starts, last = starts[near], last[near]
            doc, at = shard.documents(starts)
            inside = shard.documents(last)[0] == doc
            columns = [ids.take(pa.array(doc[inside])), pa.array(at[inside]), pa.array((last - starts + at + 1)[inside])]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "stop"])

    return texts.mapInArrow(search, f"doc {kind}, start long, stop long")
