"""Ranked search against a plain version; bounds, work saved, odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gaugewatch.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k):
    held = [(name, Counter(terms(text))) for name, text in docs]
    n_docs = sum(1 for _, c in held if c)
    n_terms = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for turn, (name, c) in enumerate(held):
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text))
                if c[t]
            )
            if score > 0:
                scored.append((-score, name is None, name or 0, turn, name))
        out += [(item, rank + 1, x[4], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def collected(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_same_as_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    want = plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 50)
    assert collected(ranked_search.ranked_search(docs, items)) == want


def test_odd_rows_and_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERIES_AT_ONCE", 3)
    r = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "日本", "x9", "gamma", "delta"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(150)]
    rows += [(None, "beta gamma"), (None, None), (300, ""), (301, "..."), (302, "beta " * 30_000)]
    rows += [(400 + i, "alpha delta alpha") for i in range(30)]
    items = [(1, "alpha"), (2, "Beta beta GAMMA"), (3, None), (4, ""), (5, "unheard of"), (6, "日本 ÉTÉ delta x9"), (None, "x9")]
    docs = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, item_id string, n int").coalesce(1)
    asked = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    assert collected(ranked_search.ranked_search(docs, asked, k=7)) == plain(rows, items, 7)


def test_repeated_items_and_copies(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 20 + [(2, "other words")] * 5, "doc_id long, text string")
    items = spark.createDataFrame([(1, "same words"), (1, "same words")], "item_id long, text string")
    got = ranked_search.ranked_search(docs, items, k=10).collect()
    assert sorted(r["rank"] for r in got) == sorted(2 * list(range(1, 11))) and {r["doc_id"] for r in got} == {1}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked_search.ranked_search(docs, items).count() == 0
    assert ranked_search.ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_bounds_hold_and_save_work(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    vocabulary: dict[bytes, int] = {}
    asked = {}
    for i, text in enumerate(items):
        asked[i] = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(ranked_search.words_of(text))])
    counted = ranked_search.postings(docs, vocabulary, "doc_id", "text")
    sketched = ranked_search.sketch(counted, np.full(len(vocabulary), 1000), 1000, 400_000).cache()
    block = ranked_search.Block(pa.Table.from_batches(sketched.toArrow().to_batches()), len(vocabulary))
    everyone = np.arange(block.size)
    for query in asked.values():
        assert (block.bounds(query) >= block.scores(query, everyone)).all()
    _, work = ranked_search.search(sketched, asked, len(vocabulary), 10)
    held, scored = work.groupBy().sum().first()
    assert scored < 0.5 * held


def test_length_factor_does_not_overflow():
    n = np.array([0, 3, 10**9], np.int64)
    many, all_terms = 5 * 10**10, 2 * 10**13
    assert ranked_search.length_factors(n, many, all_terms).tolist() == [50 + 50 * int(x) * many // all_terms for x in n]
