"""Importance resampling against a plain version, and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from gaugewatch.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % 10_000 for run in runs]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of every row."""
    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for name, text in docs:
        words, buckets = features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in buckets
        )
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((name, words, len(buckets), weight, score))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in rows), key=repr)


def collected(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("pass_bytes", [4 * 2**20, 97])
def test_same_as_a_plain_version(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(importance, "PASS_BYTES", pass_bytes)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text")
    rows = [tuple(r) for r in docs.collect()]
    # Shipped workers have the module's own pass size, so the passes are compared here too.
    reader = importance.Batches()
    found = [[] for _ in rows]
    for numbers, buckets, _ in reader.passes([text for _, text in rows]):
        for number, bucket in zip(numbers.tolist(), buckets.tolist()):
            found[number].append(bucket)
    assert [sorted(x) for x in found] == [sorted(features(text)[1]) for _, text in rows]
    want = plain(rows, [r["text"] for r in target.collect()])
    assert collected(importance.resample(docs, target)) == want


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Alpha", "beta", "ÉTÉ", "日本", "x9"]) for _ in range(r.randrange(18, 24)))) for i in range(200)]
    rows += [(None, rows[0][1]), (None, None), (500, ""), (501, " \n\x00 .,"), (502, "w" * 5000 + " " + "v" * 200 + " u")]
    rows += [(503, "one two")]
    docs = spark.createDataFrame([(a, b, 1, "s", 2.0) for a, b in rows], "doc_id long, text string, rank int, part string, weight double")
    target = spark.createDataFrame([("beta beta x9",), (None,), ("",)], "text string")
    assert collected(importance.resample(docs.repartition(5), target)) == plain(rows, ["beta beta x9", None, ""])


def test_repeated_rows_are_drawn_each_for_itself(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text)] * 60 + [(2, text + " more")] * 40, "doc_id long, text string")
    got = importance.resample(docs, docs.select("text").limit(0)).collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs, docs.select("text")).count() == 0


def test_long_shifts_of_checksums():
    import numpy as np

    shift = importance.CrcShift()
    for n in (0, 1, 63, 64, 65, 1000, 100_000):
        a, b = b"begin", bytes(range(256)) * (n // 256) + b"z" * (n % 256)
        got = shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(got) == zlib.crc32(a + b)
