"""Token counts under a byte-level BPE vocabulary.

Most pre-tokens of a text are vocabulary entries. Which entries the merges turn back into
themselves is proved once, on the driver, for the whole vocabulary; a pre-token among them
is one token without further work. Only the rest goes through the merges, and each distinct
one only once while the cache lasts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: Pre-tokens kept with their counts in one Python worker, and the longest one kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
#: Above this many characters the pre-tokens of a text are taken one by one, not as a list.
LIST_CHARS = 2_000_000

# Fixed value: the split that byte-level vocabularies of this family are made for.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """A tokenizer file, and the strings proved to be one token alone."""

    def __init__(self, definition: str):
        content = json.loads(definition)
        split = content["pre_tokenizer"] or {}
        added = content["added_tokens"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        if content["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not plain:
            raise ValueError("only plain byte-level tokenizer files can be counted")
        self.definition = definition
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.whole = self._prove(content["model"]["vocab"])

    def _prove(self, entries: dict[str, int]) -> list[str]:
        merge = Tokenizer.from_str(self.definition).model.tokenize
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        proved = []
        for entry in entries:
            if len(merge(entry)) == 1:
                try:
                    proved.append(bytes(byte_of[c] for c in entry).decode())
                except (KeyError, UnicodeDecodeError):
                    continue  # part of a character: no pre-token is equal to it
        return proved


class PieceCounts(dict):
    """Tokens of a pre-token; the proved ones are there from the start."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.whole = vocabulary.whole
        self.merge = Tokenizer.from_str(vocabulary.definition).model.tokenize
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> int:
        count = len(self.merge("".join(map(self.letters.__getitem__, piece.encode()))))
        if len(piece) <= CACHE_CHARS:
            if len(self) > CACHE_ENTRIES:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = count
        return count


class TextCounter:
    def __init__(self, vocabulary: Vocabulary):
        self.pieces = PieceCounts(vocabulary)
        self.pattern = regex.compile(PRE_TOKEN)
        self.added = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None

    def __call__(self, text: str) -> int:
        if self.added is None:
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if len(text) <= LIST_CHARS:
            found = self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        return sum(map(self.pieces.__getitem__, found))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The tokenizer file is read on the driver and sent out with its proof; both are bounded by
    the vocabulary. No shuffle. A null or empty text has no bytes and no tokens. Every row
    is kept, repeated ones and null identifiers too; columns not in ``keep`` have no effect.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(file.read()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(shared.value)
        for batch in batches:
            *kept, texts = batch.columns
            counts = pa.array([counter(value.as_py() or "") for value in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, counts], [*batch.schema.names[:-1], "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(*keep, n_bytes, F.col(text).cast("string").alias("n_tokens"))
    schema = docs.select(*keep, n_bytes, F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
