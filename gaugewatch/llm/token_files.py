"""Token ids of documents as compressed binary files, and back.

Documents are dealt to files by ranges of their identifiers, so files in order hold them in
order. A file is a row of blocks. A block stands alone: its header names its sizes and the
CRC-32 of all that follows, then come its documents and the digits of the context-mixing range
coder (``token_coder``), whose model starts empty in every block.

Files are written by Spark's text writer, whose line separator ends a block, so its commit
protocol covers lost executors and any file system that Spark knows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from gaugewatch.llm import token_coder
from gaugewatch.llm.common import stage
from gaugewatch.llm.token_counts import PRE_TOKEN, byte_letters

#: Bytes of text that a file gets on average.
FILE_BYTES = 24 * 2**20
#: Words, and pieces of words, whose ids a Python worker remembers for sure, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: Bytes of texts that a Python worker gets, and of ids that it gives, at once.
BATCH_BYTES = 2 * 2**20
#: Signs that are a piece alone after a letter.
SIGNS = frozenset(".,;:!?)")

# The file format. Name, version, file, documents, ids, digits, lanes, vocabulary, checksum.
HEADER, MAGIC, VERSION, BLOCK_END = struct.Struct("<4sIIIIIIII"), b"gwti", 1, "\n"
NO_NAME, GOES_ON = 1, 2

DOCUMENTS = "file int, place long, doc_id long, start_in_file long, n_tokens long, ids binary"


class Known(dict):
    """Ids made by ``make``, remembered in two generations: the older one goes when the newer one is full."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class TextIds:
    """Ids of whole texts as the library gives them, in arrays of 32-bit numbers.

    A text is cut before blanks, which are borders for the vocabulary's own split unless they
    lie inside longer white space; ids of words and of their pieces are made by the library
    once and remembered. Texts that hold such white space or an added token go to it whole.
    """

    def __init__(self, definition: str, end: int):
        self.library = Tokenizer.from_str(definition)
        self.end = array("I", [end]).tobytes()
        self.merge = self.library.model.tokenize
        self.letters = "".join(letter for _, letter in sorted(byte_letters().items()))
        self.blank = self.letters[ord(" ")]
        self.split = regex.compile(PRE_TOKEN).findall
        self.after_blank, self.pieces = Known(self.word), Known(self.piece)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Patterns that begin with a fixed character are found fastest.
        self.blanks = re.compile(r" (?<=\s )(?:\s|\Z)").search
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the vocabulary's split."""
        # Most are ASCII letters, which stand for themselves.
        shown = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self.merged(shown)

    def merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word after a blank."""
        if word.isalpha():
            return self.merged(self.blank + word) if word.isascii() else self.piece(" " + word)
        # Most others end in one sign.
        if word[:-1].isalpha() and word[-1] in SIGNS:
            return self.after_blank[word[:-1]] + self.pieces[word[-1]]
        first, *rest = self.split(" " + word)
        begin = self.after_blank[first[1:]] if first[1:].isalpha() else self.pieces[first]
        return begin + b"".join(map(self.pieces.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        """All ids of the text, then the end id."""
        if self.blanks(text) or self.added(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        first, *rest = text.split(" ")
        begin = b"".join(map(self.pieces.__getitem__, self.split(first)))
        return b"".join([begin, *map(self.after_blank.__getitem__, rest), self.end])


_last: list = []


def ids_maker(definition: str, end: int) -> TextIds:
    """One for all tasks of a Python worker, so that words are remembered from task to task."""
    if not _last or _last[:2] != [definition, end]:
        _last[:] = [definition, end, TextIds(definition, end)]
    return _last[2]


def write_block(file: int, docs: list[tuple[int | None, int, bool]], ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of (doc_id, number of ids in this block, goes on in the next block) and all their ids."""
    counts, digits = token_coder.encode(ids, vocabulary) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    names = np.array([0 if name is None else name for name, _, _ in docs], "<i8")
    marks = np.array([NO_NAME * (name is None) + GOES_ON * more for name, _, more in docs], "<u1")
    sizes = np.array([n for _, n, _ in docs], "<u4")
    body = b"".join(x.tobytes() for x in (names, marks, sizes, counts.astype("<u2"), digits.astype("<u4")))
    head = HEADER.pack(MAGIC, VERSION, file, len(docs), len(ids), len(digits), len(counts), vocabulary, 0)
    return HEADER.pack(*HEADER.unpack(head)[:-1], zlib.crc32(body, zlib.crc32(head))) + body


def block_sizes(data: memoryview, at: int) -> tuple[tuple, int]:
    """The header at ``at`` and the place after its block."""
    head = HEADER.unpack_from(data, at)
    if head[:2] != (MAGIC, VERSION):
        raise ValueError("not a block of token ids")
    return head, at + HEADER.size + 13 * head[3] + 2 * head[6] + 4 * head[5]


def read_block(data: memoryview, at: int) -> tuple[int, list[tuple[int | None, int, bool]], np.ndarray, int]:
    """File, documents and ids of the block at ``at``, and the place after it. A wrong checksum raises ValueError."""
    head, end = block_sizes(data, at)
    _, _, file, n_docs, n_ids, n_digits, n_lanes, vocabulary, checksum = head
    body = data[at + HEADER.size : end]
    if zlib.crc32(body, zlib.crc32(HEADER.pack(*head[:-1], 0))) != checksum:
        raise ValueError(f"a block of token ids at byte {at} is damaged")
    cut = np.cumsum([0, 8 * n_docs, n_docs, 4 * n_docs, 2 * n_lanes, 4 * n_digits])
    parts = [body[a:b] for a, b in zip(cut, cut[1:])]
    names, marks, sizes, counts, digits = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "<u1", "<u4", "<u2", "<u4")))
    docs = [(None if m & NO_NAME else n, s, bool(m & GOES_ON)) for n, m, s in zip(names.tolist(), marks.tolist(), sizes.tolist())]
    ids = token_coder.decode(counts, digits, n_ids, vocabulary) if n_ids else np.zeros(0, np.int64)
    return file, docs, ids, end


class BlockWriter:
    """Gathers ids of documents, and gives a block whenever one is full."""

    def __init__(self, file: int, vocabulary: int):
        self.file, self.vocabulary = file, vocabulary
        self.docs: list[tuple[int | None, int, bool]] = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        while self.n + len(ids) > token_coder.BLOCK_IDS:
            room = token_coder.BLOCK_IDS - self.n
            if room:
                self._take(doc_id, ids[:room], True)
                ids = ids[room:]
            yield from self.close()
        self._take(doc_id, ids, False)

    def _take(self, doc_id: int | None, ids: np.ndarray, more: bool) -> None:
        self.docs.append((doc_id, len(ids), more))
        self.parts.append(ids)
        self.n += len(ids)

    def close(self) -> Iterator[bytes]:
        if self.docs:
            yield write_block(self.file, self.docs, np.concatenate(self.parts), self.vocabulary)
        self.docs, self.parts, self.n = [], [], 0


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get batches of about ``BATCH_BYTES``, however many rows that is."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """The ids of every text, then ``end_id``, as files under ``path`` in ascending order of ``doc_id``.

    Documents without identifier come first; rows that share one keep the table's order. A null
    or empty text is the end id alone. Ids are those of the tokenizers library without added
    special tokens; special strings inside texts are its tokens. Other columns have no effect.
    One shuffle of the texts, by ranges of identifier and row, so a frequent identifier fills many
    files. A task holds one text and one block. An empty table gives files without blocks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    vocabulary = max(Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True), end_id + 1)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    # The row's place in the table parts equal identifiers; it is fixed by the table's files.
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    # Small tables still use every core.
    files = max(-(-size // FILE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // 2**20)), 1)
    ordered = rows.repartitionByRange(int(files), F.asc_nulls_first("doc_id"), "row")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "row").select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_maker(shared.value, end_id)
        writer = BlockWriter(TaskContext.get().partitionId(), vocabulary)
        for batch in batches:
            for name, content in zip(batch["doc_id"].to_pylist(), batch["text"]):
                for block in writer.add(name, np.frombuffer(ids_of(content.as_py()), np.uint32)):
                    yield pa.record_batch([pa.array([block], pa.binary())], ["value"])
        for block in writer.close():
            yield pa.record_batch([pa.array([block], pa.binary())], ["value"])

    made = ordered.mapInArrow(blocks, "value binary").select(F.col("value").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        made.write.option("lineSep", BLOCK_END).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, before: the number of ids in all files before it. Only headers are looked at."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    head, end = block_sizes(data, at)
                    yield pa.record_batch([pa.array([head[2]], pa.int32()), pa.array([head[4]], pa.int64())], ["file", "n"])
                    at = end + len(BLOCK_END)

    per_file = _files(spark, path).mapInArrow(totals, "file int, n long").groupBy("file").agg(F.sum("n").alias("n"))
    # One row per file of many megabytes: the running sum is over few rows.
    return per_file.select("file", F.expr("sum(n) OVER (ORDER BY file) - n").alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: file, place in it, doc_id, ids before it in the file, n_tokens, ids (32 bits each, little-endian).

    Every block's checksum is tested; a damaged one ends the query with a ValueError.
    """
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [part.split()[0] for part in DOCUMENTS.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _last.clear()  # readers need no words
        for batch in batches:
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()), 0
                place = start = 0
                begun: list[bytes] = []
                while at < len(data):
                    file, docs, ids, end = read_block(data, at)
                    at = end + len(BLOCK_END)
                    ids = ids.astype("<u4", copy=False)
                    ready, since, size = [], 0, 0
                    for name, n, more in docs:
                        # Bytes: pyarrow never lets go of a memoryview that it has made a value of.
                        own = ids[since : since + n].tobytes()
                        since += n
                        if more or begun:
                            begun.append(own)
                        if more:
                            continue
                        if ready and size + len(own) > BATCH_BYTES:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ready), types)], names)
                            ready, size = [], 0
                        size += len(own)
                        whole = b"".join(begun) if begun else own
                        begun = []
                        ready.append((file, place, name, start, len(whole) // 4, whole))
                        place, start = place + 1, start + len(whole) // 4
                    if ready:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ready), types)], names)

    return _files(spark, path).mapInArrow(rows, DOCUMENTS)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    starts = stage(file_starts(spark, path))
    found = read_tokens(spark, path).select("file", "doc_id", "start_in_file", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
