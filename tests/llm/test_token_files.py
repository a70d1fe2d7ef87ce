"""Token files: ids against the library, exact round trips, damaged files."""

import gc
import struct
import tracemalloc
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewatch.llm import token_coder, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [
    "a  b   c",
    "a\n b",
    "a\n  b",
    "a \n b",
    "a\n \nb",
    "tail  ",
    "tail \n ",
    " lead",
    "  lead",
    "\t\t x",
    "it's they'll 's",
    " 's x",
    "x  y",
    "x　 y   z",
    "a\x1c b\x85 c",
    "<|endoftext|>",
    "a  <|endoftext|> b",
    "½ ² Ⅷ 一二 1234 a1b2",
    "_ __ a_b",
    "日本語 テキスト\n\nÄÖÜ é",
    "é \U0001f600 \U0001f468‍\U0001f469",
    " ",
    "\n",
    "",
]


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    with open(PATH, encoding="utf-8") as file:
        ids_of = token_files.TextIds(file.read(), 0)
    rng = np.random.default_rng(4)
    signs = list("ab z'9.,_\n\t \x1cé日½") + ["  ", "<|endoftext|>", "'ll", "the"]
    texts = AWKWARD + ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    for text in texts:
        assert list(array("I", ids_of(text))) == library.encode(text, add_special_tokens=False).ids + [0], repr(text)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000, 40_000])
@pytest.mark.parametrize("vocabulary", [2, 300, 50_257])
def test_coder_gives_back_what_it_got(n, vocabulary):
    rng = np.random.default_rng(n)
    for ids in (
        rng.integers(0, vocabulary, n),
        np.full(n, vocabulary - 1),
        np.minimum(rng.zipf(1.2, n), vocabulary) - 1,
        np.resize(rng.integers(0, vocabulary, 17), n),
    ):
        counts, digits = token_coder.encode(ids, vocabulary)
        assert (token_coder.decode(counts, digits, n, vocabulary) == ids).all()


def test_coder_learns_from_all_three_orders():
    size = lambda ids, v: token_coder.encode(ids, v)[1].nbytes / len(ids)
    rng = np.random.default_rng(0)
    n = 200_000
    assert size(rng.integers(0, 50_000, n), 50_257) < 2.3  # nothing to learn: 15.6 bits
    assert size(np.minimum(rng.zipf(1.5, n), 50_000), 50_257) < 0.9  # order 0
    follows = rng.integers(0, 50_000, 2000)
    walk = np.zeros(n, np.int64)
    for i in range(1, n):
        walk[i] = follows[(walk[i - 1] * 7 + 1) % 2000] if i % 50 else i % 2000
    assert size(walk, 50_257) < 0.7  # order 1


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, file string")


def test_round_trip_of_awkward_tables(spark, tmp_path, monkeypatch):
    rows = [(i * 3 % 50, text, None, "x") for i, text in enumerate(AWKWARD)]
    rows += [(None, "no name", 1, "x"), (None, None, 1, "x"), (7, "same", 1, "x"), (7, "same", 1, "x"), (-5, "below", 1, None)]
    rows += [(8, "long text, longer than a block. " * 400, 1, "y")]
    monkeypatch.setattr(token_coder, "BLOCK_IDS", 700)
    token_files.write_tokens(make(spark, rows).repartition(3), PATH, str(tmp_path / "out"))
    got = token_files.token_digests(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert len(got) == len(rows)
    names = [row["doc_id"] for row in got]
    assert names[:2] == [None, None] and names[2:] == sorted(name for name, *_ in rows if name is not None)
    want = sorted(
        (-10 if name is None else name, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for name, text, *_ in rows
        for ids in [library_ids(text) + [0]]
    )
    assert sorted((-10 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for row in got:
        assert row["start"] == at
        at += row["n_tokens"]
    ids = {row["doc_id"]: row["ids"] for row in token_files.read_tokens(spark, str(tmp_path / "out")).collect()}
    assert list(array("I", bytes(ids[8]))) == library_ids(rows[-1][1]) + [0]


def test_empty_table(spark, tmp_path):
    token_files.write_tokens(make(spark, []), PATH, str(tmp_path / "none"))
    assert token_files.token_digests(spark, str(tmp_path / "none")).count() == 0


def test_one_identifier_fills_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    rows = [(1, f"text number {i}", None, None) for i in range(2000)]
    token_files.write_tokens(make(spark, rows), PATH, str(tmp_path / "hot"))
    held = token_files.read_tokens(spark, str(tmp_path / "hot")).groupBy("file").count().collect()
    assert len(held) > 5 and max(row["count"] for row in held) < 1000


def test_damaged_blocks_are_noticed():
    block = token_files.write_block(3, [(1, 4, False), (None, 2, True)], np.array([5, 6, 7, 0, 9, 9]), 50_257)
    file, docs, ids, end = token_files.read_block(memoryview(block), 0)
    assert (file, docs, ids.tolist(), end) == (3, [(1, 4, False), (None, 2, True)], [5, 6, 7, 0, 9, 9], len(block))
    for at in (9, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            token_files.read_block(memoryview(bytes(bad)), 0)


def test_special_strings_and_whole_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    token_files.write_tokens(docs, PATH, str(tmp_path / "docs"))
    got = {r["doc_id"]: r for r in token_files.token_digests(spark, str(tmp_path / "docs")).collect()}
    library = Tokenizer.from_file(PATH)
    start = 0
    for row in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect():
        ids = library.encode(row["text"], add_special_tokens=False).ids + [0]
        own = got[row["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_a_word_is_remembered_once_with_or_without_its_sign():
    with open(PATH, encoding="utf-8") as file:
        ids_of = token_files.TextIds(file.read(), 0)
    text = "a first line, then.\nAnother line, then first"
    assert list(array("I", ids_of(text))) == [*library_ids(text), 0]
    assert not any(word[:1] == " " and word[1:].isalpha() for word in ids_of.pieces)


def test_readers_let_go_of_the_ids_they_gave(monkeypatch):
    """A worker that reads many files must not grow with what it has read."""
    readers = []
    frame = types.SimpleNamespace(mapInArrow=lambda reader, schema: readers.append(reader))
    monkeypatch.setattr(token_files, "_files", lambda spark, path: frame)
    token_files.read_tokens(None, "anywhere")
    docs, n = [(i, 1000, False) for i in range(100)], 100_000
    block = token_files.write_block(0, docs, np.arange(n, dtype=np.uint32) % 7, 7) + b"\n"
    files = pa.record_batch([pa.array([block], pa.binary())], ["content"])
    monkeypatch.setattr(token_files, "BATCH_BYTES", 50_000)

    def read():
        given = list(readers[0](iter([files])))
        assert sum(b.num_rows for b in given) == 100 and max(b.nbytes for b in given) < 60_000
        return given[0].column(5)[0].as_py()[:8]

    assert read() == np.array([0, 1], "<u4").tobytes()
    tracemalloc.start()
    try:
        read()
        gc.collect()
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(5):
            read()
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] - before < 4 * n
    finally:
        tracemalloc.stop()


def test_workers_get_small_batches(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('abc ', 1024) AS text")
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes], pa.int64())], ["n"]) for b in batches)
    with token_files.small_batches(spark):
        given = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(given) > 4000 * 4096 and max(given) < 2 * token_files.BATCH_BYTES
