"""Importance resampling towards a target text collection, on hashed word n-grams.

The texts of a batch are joined with sentinels, so that one regular expression pass finds the
words of all of them. Places of words against the offsets of the documents tell which n-grams
cross from one document into the next; these are masked before the buckets are counted. The
CRC-32 of an n-gram comes from those of its words by arithmetic, without joining any strings.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.llm.common import stage

#: Hash buckets, longest n-gram, words that a document needs to be drawn, the part of such documents drawn.
BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text joined into one pass; a longer text takes several.
PASS_BYTES = 4 * 2**20
#: Words, with what stands before the next one, that a Python worker remembers, and the longest of them.
CACHE_ENTRIES, CACHE_BYTES = 500_000, 64

# A word (lower-case ASCII letters, digits, all bytes of other letters), and what stands before the next one.
GAP_BYTE = re.compile(rb"[^0-9a-z\x80-\xff]")
WORD_AND_GAP = re.compile(rb"([0-9a-z\x80-\xff]+)[^0-9a-z\x80-\xff]*")
SPELLED = re.compile(rb"[0-9a-z\x80-\xff]+[^0-9a-z\x80-\xff]*")
#: No word holds it.
SENTINEL = b"\x00"
POLYNOMIAL = 0xEDB88320


def _zero_byte(values: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more zero byte."""
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ POLYNOMIAL, values >> 1)
    return values


class CrcShift:
    """CRC-32 of a string from that of its beginning: ``crc(a + b) == shift(crc(a), len(b)) ^ crc(b)``."""

    #: Shifts below this have a table of their own.
    TABLED = 64

    def __init__(self):
        # What each byte of a register becomes after so many zero bytes, for each of its four places.
        byte = np.arange(256, dtype=np.uint32)
        now = np.stack([byte << np.uint32(8 * place) for place in range(4)])
        tables = [now]
        for _ in range(1, self.TABLED):
            now = _zero_byte(now)
            tables.append(now)
        self.table = np.stack(tables).reshape(-1).astype(np.uint32)
        # Doublings of the last tabled length, for long strings.
        self.doubled = [_zero_byte(now)]
        for _ in range(32):
            self.doubled.append(self._by(self.doubled[-1].reshape(-1), self.doubled[-1]))

    @staticmethod
    def _by(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        return (
            table[values & 255] ^ table[256 + (values >> 8 & 255)] ^ table[512 + (values >> 16 & 255)] ^ table[768 + (values >> 24)]
        )

    def __call__(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        base = (lengths % self.TABLED).astype(np.int64) << 10
        out = self.table[base + (values & 255)]
        for place in range(1, 4):
            out ^= self.table[base + (place << 8) + (values >> np.uint32(8 * place) & 255)]
        turns = lengths // self.TABLED
        for step, table in enumerate(self.doubled):
            if not turns.any():
                break
            odd = np.flatnonzero(turns & 1)
            out[odd] = self._by(table.reshape(-1), out[odd])
            turns = turns >> 1
        return out


class Spellings(dict):
    """Numbers of words with what follows them; lengths and checksums of the words by number."""

    def __init__(self):
        super().__init__()
        self.lengths, self.alone, self.after_blank = array("q"), array("I"), array("I")

    def __missing__(self, spelling: bytes) -> int:
        word = WORD_AND_GAP.match(spelling).group(1)
        number = len(self.lengths)
        self.lengths.append(len(word))
        self.alone.append(zlib.crc32(word))
        self.after_blank.append(zlib.crc32(b" " + word))
        if len(spelling) <= CACHE_BYTES:
            self[spelling] = number
        return number


class Batches:
    """Buckets of the n-grams of texts, pass by pass."""

    def __init__(self):
        self.shift = CrcShift()
        self.known = Spellings()

    def passes(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text number and bucket of every n-gram, text number of every word) of each pass.

        A text longer than a pass is cut between words, and the last words of a cut are seen
        again before the next one, so every n-gram is counted once, where its last word stands.
        """
        ready, size = [], 0
        for number, text in enumerate(texts):
            data = (text or "").encode().lower()
            if len(data) > PASS_BYTES:
                yield from self._flush(ready)
                yield from self._long(number, data)
                ready, size = [], 0
                continue
            if size + len(data) > PASS_BYTES:
                yield from self._flush(ready)
                ready, size = [], 0
            ready.append((number, data))
            size += len(data)
        yield from self._flush(ready)

    def _flush(self, ready: list[tuple[int, bytes]]) -> Iterator:
        if ready:
            numbers, data = zip(*ready)
            yield self._one(np.array(numbers), data, 0)

    def _long(self, number: int, data: bytes) -> Iterator:
        before: list[bytes] = []
        at = 0
        while at < len(data):
            end = min(at + PASS_BYTES, len(data))
            if end < len(data):
                # Up to the end of the word that the cut would part.
                gap = GAP_BYTE.search(data, end)
                end = gap.start() if gap else len(data)
            piece = b" ".join([*before, data[at:end]])
            yield self._one(np.array([number]), [piece], len(before))
            before = WORD_AND_GAP.findall(piece)[1 - GRAMS :]
            at = end

    def _one(self, numbers: np.ndarray, data: tuple[bytes, ...] | list[bytes], again: int) -> tuple:
        """The n-grams of texts of one pass; the first ``again`` words were counted before."""
        joined = SENTINEL.join(data)
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        offsets = np.cumsum(lengths + 1) - lengths - 1
        found = SPELLED.findall(joined)
        # Each match reaches up to the next one, so their lengths give their places.
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        places = len(joined) - int(sizes.sum()) + np.cumsum(sizes) - sizes
        if len(self.known.lengths) > CACHE_ENTRIES:
            self.known = Spellings()
        spelled = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        doc = np.searchsorted(offsets, places, side="right") - 1
        length = np.frombuffer(self.known.lengths, np.int64)[spelled] + 1
        code = np.frombuffer(self.known.alone, np.uint32)[spelled]
        added = np.frombuffer(self.known.after_blank, np.uint32)[spelled]
        fresh = np.arange(len(found)) >= again
        docs, codes = [doc[fresh]], [code[fresh]]
        for n in range(2, GRAMS + 1):
            # code[i]: the n-gram that ends at word i + n - 1.
            code = self.shift(code[:-1], length[n - 1 :]) ^ added[n - 1 :]
            inside = (doc[n - 1 :] == doc[: len(doc) - n + 1]) & fresh[n - 1 :]
            docs.append(doc[n - 1 :][inside])
            codes.append(code[inside])
        return numbers[np.concatenate(docs)], (np.concatenate(codes) % BUCKETS).astype(np.int64), numbers[doc[fresh]]


def _texts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.col(text).cast("string").alias("text"))


def bucket_counts(rows: DataFrame, text: str = "text") -> np.ndarray:
    """How many n-grams of all texts fall in each bucket.

    Every task adds up its own texts first; the driver gets one number per bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Batches(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in reader.passes(batch["text"].to_pylist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    found = _texts(rows, text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an n-gram of each bucket adds to a document's weight: 1000 times the log ratio of the smoothed shares, rounded down."""
    all_source, all_target = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    ratio = lambda s, t: (float(t + 1) * all_source) / (float(s + 1) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Batches()
        for batch in batches:
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for docs_of, buckets, word_docs in reader.passes(batch["text"].to_pylist()):
                words += np.bincount(word_docs, minlength=n)
                features += np.bincount(docs_of, minlength=n)
                # Whole numbers far below 2**53 stay exact in doubles.
                weight += np.bincount(docs_of, shared.value[buckets], minlength=n).astype(np.int64)
            columns = [pa.array(x, pa.int64()) for x in (words, features, weight)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weighed, f"doc_id {kind}, n_words long, n_features long, weight long")


def chance(doc_id: str, seed: int = SEED) -> Column:
    """A Gumbel-distributed addend in thousandths, fixed by the identifier; a null one counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def best_first(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank`` from 1 in ``order``, without one task that sees all: ranges first, then turns inside each.

    The order must not leave many rows equal, as equal rows share a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("held"))
    # One row per range.
    starts = stage(sizes.select("part", F.expr("sum(held) OVER (ORDER BY part) - held").alias("before")))
    turn = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = dealt.withColumn("turn", turn).join(F.broadcast(starts), "part")
    return ranked.withColumn(rank, F.col("before") + F.col("turn")).drop("part", "turn", "before")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; undrawn rows have no rank.

    Drawn are the ``PERCENT`` of the documents with ``LEAST_WORDS`` words or more whose score
    (weight plus ``chance``) is highest, ties to the smaller identifier, then to the earlier
    row; a null identifier comes last. Null and empty texts have no features and weigh 0. Rows
    that repeat are drawn each for itself; other columns have no effect; an empty table gives
    no rows, an empty target makes rare n-grams weigh more. Texts are read twice and never shuffled.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    found = weigh(docs, gain, doc_id, text).withColumn("score", F.col("weight") + chance("doc_id"))
    # A number for every row, fixed from here on, parts rows that are equal in all else.
    found = stage(found.withColumn("row", F.monotonically_increasing_id()))
    able = found.where(F.col("n_words") >= LEAST_WORDS)
    n_drawn = able.count() * PERCENT // 100
    ranked = best_first(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    others = found.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    shown = [F.col("doc_id").alias(doc_id), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*shown).unionByName(others.select(*shown))
