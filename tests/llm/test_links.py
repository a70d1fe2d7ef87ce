"""All links of documents and their numbers, against all pairs."""

import random
from collections import Counter

import pytest

from gaugewatch.llm import jaccard
from gaugewatch.llm.common import ship


def shingles_of(text, n):
    words = (text or "").split()
    return frozenset(tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))) if words else frozenset()


def like(x, y, percent):
    return bool(x & y) and 100 * len(x & y) >= percent * len(x | y)


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (3, 90)])
def test_every_link_is_found(spark, n, percent):
    ship(spark)
    rng = random.Random(8)
    words, rows = [f"w{i}" for i in range(300)], []
    for group in range(5):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(14):
            drifted = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                drifted[rng.choice((0, 1, 79, rng.randrange(80)))] = rng.choice(words)
            rows.append((len(rows), " ".join(drifted)))
    rows += [(3, rows[20][1]), (3, rows[3][1]), (7, "few"), (8, "few"), (900, None), (901, ""), (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links, found = jaccard.similarity_links(docs, n=n, percent=percent)
    links = links.collect()

    named = [(i, shingles_of(t, n)) for i, t in rows if i is not None]
    sets = list({s for _, s in named if s})
    held, least = Counter(s for _, s in named), {s: min(i for i, o in named if o == s) for s in sets}
    want = [(x, y) for k, x in enumerate(sets) for y in sets[:k] if like(x, y, percent)]
    assert len(want) > 100
    end = lambda s: (least[s], held[s])
    assert Counter(tuple(sorted([(r.doc_a, r.rows_a), (r.doc_b, r.rows_b)])) for r in links) == Counter(
        tuple(sorted([end(x), end(y)])) for x, y in want
    )
    numbers = [
        (str(i), len(s), sum(like(s, o, percent) for _, o in named) - 1 if i is not None and s else 0)
        for i, s in ((i, shingles_of(t, n)) for i, t in rows)
    ]
    assert Counter((str(r.doc_id), r.n_shingles, r.n_links) for r in found.collect()) == Counter(numbers)


def test_no_rows_give_no_links(spark):
    ship(spark)
    links, found = jaccard.similarity_links(spark.createDataFrame([], "doc_id long, text string"))
    assert links.count() == found.count() == 0
