"""Removal of byte strings that occurred before, by refined suffix buckets.

Suffixes are put into buckets by their first q bytes, and buckets are refined by the bucket
identifiers of later offsets: the identifier at 2q bytes is made of those at offsets 0 and q,
and each refinement is reused by the next (2, 4, ... 64, then 100 bytes). Equal identifiers
mean equal bytes, up to collisions of 64-bit hashes.

Only sampled suffixes are shuffled. Of the 69 32-byte strings inside a 100-byte string the one
of least identifier is its anchor; equal strings have equal anchors at equal distance, so a
string can repeat only where an anchor bucket has several members. A stretch of strings with
one anchor is one row. Stretches that are equal as a whole differ in nothing but their place,
so one of them stands for all. Stretches that meet others in an anchor bucket without being
equal to them are cut into pieces of ``PIECE`` strings by distance from the anchor, with the
bytes that all strings of a piece have in common as the next, longer bucket; of equal pieces
one stands for all again, and only what still meets others is opened, string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugewatch.llm.common import only, stage

#: Bytes of a repeated string, bytes of an anchor.
LENGTH, ANCHOR = 100, 32
#: Strings of a piece; their common bytes are LENGTH - PIECE + 1.
PIECE = 8
#: String starts of one document that are handled together; places inside one fit 20 bits.
CHUNK = 1 << 19

_WITHIN = (1 << 20) - 1
_code = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64)
_TIMES, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """A new identifier from the one at an offset and the one further on."""
    x = first * _TIMES + later
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the ``ANCHOR``-byte and of the ``LENGTH``-byte string at every place."""
    known = {1: _code[np.frombuffer(data, np.uint8)]}
    size = 1
    while size < 64:
        known[2 * size] = _join(known[size][:-size], known[size][size:])
        size *= 2
    n = max(0, len(data) - LENGTH + 1)
    whole = _join(_join(known[64][:n], known[32][64 : 64 + n]), known[4][96 : 96 + n])
    return known[ANCHOR], whole


def stretches(data: bytes) -> tuple[np.ndarray, ...]:
    """anchor bucket, stretch identifier, first start, further starts, distance of the anchor; for every stretch."""
    grams, whole = buckets(data)
    n = len(whole)
    # The place breaks ties towards the left and says where the anchor is.
    least = (grams & ~np.uint64(_WITHIN)) | np.arange(len(grams), dtype=np.uint64)
    window = LENGTH - ANCHOR + 1
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[window - size : window - size + n])
    anchor = (least & np.uint64(_WITHIN)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    more = last - first
    lead = anchor[first] - first
    stretch = _join(_join(whole[first], whole[last]), (more * 128 + lead).astype(np.uint64))
    return grams[anchor[first]].view(np.int64), stretch.view(np.int64), first, more, lead


def _chunks(text: str | None) -> Iterator[tuple[int, bytes]]:
    data = (text or "").encode()
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        yield at, data[at : at + CHUNK + LENGTH - 1]


def _map(texts: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """``rows_of`` a text gives columns of equal length; they come with the document's identifier first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[c.as_py() for c in row] for row in zip(*batch.columns[1:])]
            made, owner = [], []
            size = 0
            for i, row in enumerate(parts):
                for columns in rows_of(*row):
                    made.append(columns)
                    owner.append(np.full(len(columns[0]), i))
                    size += len(columns[0])
                if made and (size > 200_000 or i + 1 == len(parts)):
                    doc = batch.column(0).take(pa.array(np.concatenate(owner)))
                    columns = [_column(c) for c in zip(*made)]
                    yield pa.RecordBatch.from_arrays([doc, *columns], ["doc", *names])
                    made, owner, size = [], [], 0

    names = [field.split()[0] for field in schema.split(", ")]
    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc {kind}, {schema}")


def _column(parts: tuple) -> pa.Array:
    """Numbers, or (lengths, values) of lists, of several texts as one column."""
    if isinstance(parts[0], np.ndarray):
        return pa.array(np.concatenate(parts))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([lengths for lengths, _ in parts]))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([v for _, v in parts])))


def anchors(texts: DataFrame) -> DataFrame:
    """doc, bucket, stretch, start, more and lead of every stretch of every text."""

    def rows_of(text: str | None) -> Iterator[tuple[np.ndarray, ...]]:
        for at, data in _chunks(text):
            bucket, stretch, first, more, lead = stretches(data)
            yield bucket, stretch, first + at, more, lead

    return _map(texts.select("doc", "text"), rows_of, "bucket long, stretch long, start long, more long, lead long")


def shared_buckets(texts: DataFrame) -> DataFrame:
    """Anchor buckets of more than one member."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(data)[0] for text in batch["text"] for _, data in _chunks(text.as_py())]
            if found:
                bucket, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(bucket), pa.array(n.astype(np.int64))], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("bucket")


def repeated(texts: DataFrame) -> DataFrame:
    """doc, start and end of stretches of bytes covered by strings that also start earlier.

    ``texts`` has doc and text. The stretches of one document may overlap.
    """
    shared = stage(shared_buckets(texts))
    members = stage(anchors(texts).join(shared, "bucket", "left_semi"))
    place = F.struct("doc", "start")
    first = members.groupBy("bucket", "stretch").agg(F.min(F.struct("doc", "start", "more", "lead")).alias("first"))
    first = stage(first)
    kinds = first.groupBy("bucket").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    # One of several equal stretches is cut where its bucket has others.
    opened = first.join(kinds, "bucket", "left_semi").select("bucket", "first.*").groupBy("doc")
    opened = stage(opened.agg(F.collect_list(F.struct("bucket", "start", "more", "lead")).alias("opened")))
    held = only(texts.select("doc", "text"), opened, "doc").join(opened, "doc")
    schema = "core long, piece long, start long, more long, strings array<long>"
    pieces = stage(_map(held.select("doc", "text", "opened"), _pieces, schema))

    # Equal pieces are one again; the others in a bucket are opened.
    one = stage(pieces.groupBy("core", "piece").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    mixed = stage(one.groupBy("core").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1).select("core"))
    again = pieces.select("core", "piece", "doc", "start", "more").join(one.where(F.col("n") > 1).drop("n"), ["core", "piece"])
    again = again.where(place != F.col("first")).select("doc", "start", "more")
    strings = pieces.join(mixed, "core").select("core", "doc", "start", F.posexplode("strings").alias("at", "string"))
    strings = stage(strings.select("core", "string", "doc", (F.col("start") + F.col("at")).alias("start")))
    firsts = strings.groupBy("core", "string").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where(F.col("n") > 1).drop("n")
    single = strings.join(firsts, ["core", "string"]).where(place != F.col("first"))
    single = again.unionByName(single.select("doc", "start", F.lit(0).cast("long").alias("more")))
    copies = members.join(first.drop("more"), ["bucket", "stretch"])
    copies = copies.where(place != F.struct("first.doc", "first.start")).select("doc", "start", "more")
    return copies.unionByName(single).select("doc", "start", (F.col("start") + F.col("more") + LENGTH).alias("end"))


def _pieces(text: str | None, spans: list[dict]) -> Iterator[tuple]:
    """core, piece, first start, number of further starts and the strings of every piece of the given stretches."""
    data = (text or "").encode()
    start, more, far, bucket = (np.array([s[name] for s in spans], np.int64) for name in ("start", "more", "lead", "bucket"))
    # A string's distance from the anchor falls from ``far`` to ``near`` as its start moves on.
    near = far - more
    count = far // PIECE - near // PIECE + 1
    owner = np.repeat(np.arange(len(spans)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + (near // PIECE)[owner]
    high = np.minimum(far[owner], number * PIECE + PIECE - 1)
    low = np.maximum(near[owner], number * PIECE)
    anchor = (start + far)[owner]
    begin, further, inner = anchor - high, high - low, anchor - number * PIECE
    chunk = begin // CHUNK
    for c in np.unique(chunk):
        own = chunk == c
        known, whole = buckets(data[c * CHUNK : (c + 1) * CHUNK + 2 * PIECE + LENGTH])
        at, n, common = begin[own] - c * CHUNK, further[own], inner[own] - c * CHUNK
        # All strings of a piece hold the bytes from the start of its last string to the end of its first.
        ends = _join(known[common], known[common + LENGTH - PIECE + 1 - ANCHOR])
        middle = _join(known[common + 24], known[common + 48])
        core = _join(_join(ends, middle), bucket[owner[own]].view(np.uint64) ^ number[own].astype(np.uint64))
        shape = (high[own] * 128 + low[own]).astype(np.uint64)
        piece = _join(_join(whole[at], whole[at + n]), shape)
        places = np.repeat(at, n + 1) + np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        strings = (n + 1, whole[places].view(np.int64))
        yield core.view(np.int64), piece.view(np.int64), begin[own], n, strings


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs under half-open intervals; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[opens], np.concatenate([reach[:-1][opens[1:]], reach[-1:]])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, with the bytes kept if asked.

    A byte goes if a 100-byte string covers it that also starts earlier: in a smaller doc_id,
    or in the same document further left. Strings are judged on the input. Null is empty, and
    texts of fewer than 100 bytes stay whole. Rows that repeat an identifier are copies of one
    document: places of equal strings in them are the same place, and what goes from one goes
    from all, at the same places. A row without identifier stays whole and removes nothing.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    found = repeated(texts.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH)))
    per_doc = found.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.join(stage(per_doc), "doc", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, spans in zip(batch["text"], batch["spans"]):
                data, spans = (content.as_py() or "").encode(), spans.as_py() or []
                kept, at, gone, runs = [], 0, 0, 0
                if spans:
                    places = np.array([(s["start"], s["end"]) for s in spans])
                    for start, end in zip(*merged(places[:, 0], np.minimum(places[:, 1], len(data)))):
                        if start < end:
                            kept.append(data[at:start])
                            at, gone, runs = int(end), gone + int(end - start), runs + 1
                left = b"".join([*kept, data[at:]])
                rows.append((len(data), gone, runs, hashlib.sha256(left).hexdigest(), left if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch["doc"], *columns], ["doc", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kind = texts.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = joined.select("doc", "text", "spans").mapInArrow(cut, schema).withColumnRenamed("doc", doc_id)
    return out if with_text else out.drop("kept")
