"""Groups of near copies that drift apart and meet again through links, against all pairs."""

import random

import pytest

from gaugewatch.llm import jaccard
from gaugewatch.llm.common import ship


def components_of_all_pairs(texts, n, percent):
    sets = {}
    for i, text in texts:
        words = text.split()
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (3, 90)])
def test_drifting_chains(spark, n, percent):
    ship(spark)
    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(300)], []
    for _ in range(6):
        chain = [[rng.choice(words) for _ in range(60)]]
        for _ in range(20):
            drifted = list(rng.choice(chain))
            for _ in range(rng.choice((0, 1, 1, 2))):
                drifted[rng.randrange(60)] = rng.choice(words)
            chain.append(drifted)
        texts += [" ".join(t) for t in chain]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similarity_components(docs, n=n, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in found} == components_of_all_pairs(rows, n, percent)
