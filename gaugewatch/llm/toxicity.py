"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.llm.common import stage

#: The sample: this many texts of each label at most, each whole.
ROWS_PER_LABEL = 4000
#: Entries of the learned lexicon, the toxic sample texts one must occur in, its least log-odds.
LEXICON, LEAST_TEXTS, LEAST_WEIGHT = 200, 5, 2.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF, FOLDS = 60, 3, 0.2, 32, 8, 4
#: Words between a second person and a lexicon word that count as close.
NEAR = 5

# Second-person words of the languages served.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos "
    "usted ustedes ti tus vosotros".split()
)
# Signs and digits written for letters.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = (
    "log_words", "strong_density", "strong_any", "strong_distinct", "lexicon_weight", "masked_density",
    "near_second_person", "second_person", "capital_letters", "capital_words", "punctuation", "exclamations",
    "stars", "digits_in_words", "repeats",
)

EDGES = ".,;:!?\"'()[]{}*#%&$-_"
#: Beginnings of words that stand for a family of words, marked by a tilde.
STEMS = (4, 5, 6)
#: Words as written, kept with what they are, in one Python worker.
CACHE_WORDS = 300_000

_capitals = bytes(range(65, 91))
_signs = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_letters = bytes(b for b in range(128) if chr(b).isalpha()) + bytes(range(0xC0, 0x100))
HIT, SECOND, MASKED, SHOUTED, MIXED = 1, 2, 4, 8, 16


class Words(dict):
    """What a word as written is: a sum of the marks above, 0 for most."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def entry(self, low: str) -> str | None:
        """The heaviest lexicon entry that the word or one of its beginnings is."""
        forms = [low, *[low[:n] + "~" for n in STEMS if len(low) > n]]
        return max((f for f in forms if f in self.lexicon), key=self.lexicon.get, default=None)

    def __missing__(self, written: str) -> int:
        word = written.strip(EDGES)
        low = word.lower()
        mark = (HIT if self.entry(low) else 0) | (SECOND if low in SECOND_PERSON else 0)
        if low and not mark and not low.isalpha():
            digits, letters = any(map(str.isdigit, low)), any(map(str.isalpha, low))
            mark |= (MIXED if digits and letters else 0) | (MASKED if self.entry(low.translate(STANDS_FOR)) else 0)
        if len(word) > 1 and word.isupper():
            mark |= SHOUTED
        if len(self) > CACHE_WORDS:
            self.clear()
        self[written] = mark
        return mark


def features_of(text: str, words: Words) -> list[float]:
    """The values of ``FEATURES``, over the whole text; an empty text has zeros."""
    written = text.split()
    marks = np.fromiter(map(words.__getitem__, written), np.uint8, len(written))
    hits, seconds = np.flatnonzero(marks & HIT), np.flatnonzero(marks & SECOND)
    entries = [words.entry(written[i].strip(EDGES).lower()) for i in hits]
    near = 0
    if len(hits) and len(seconds):
        right = np.searchsorted(hits, seconds)
        after = hits[np.minimum(right, len(hits) - 1)] - seconds
        before = seconds - hits[np.maximum(right - 1, 0)]
        near = int((((after >= 0) & (after <= NEAR)) | ((before >= 0) & (before <= NEAR))).sum())
    data = text.encode()
    count = lambda those: len(data) - len(data.translate(None, those))
    codes = np.frombuffer(data, np.uint8)
    repeats = int(((codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2])).sum()) if len(codes) > 2 else 0
    n, size = max(1, len(written)), max(1, len(data))
    rate = lambda mark: int((marks & mark > 0).sum()) / n
    return [
        float(np.log1p(len(written))), len(hits) / n, float(min(len(hits), 5)), float(min(len(set(entries)), 5)),
        sum(map(words.lexicon.get, entries)) / n, rate(MASKED), near / n, rate(SECOND),
        count(_capitals) / max(1, count(_letters)), rate(SHOUTED), count(_signs) / size,
        text.count("!") / size, text.count("*") / size, rate(MIXED), repeats / size,
    ]


# ---- the learner -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A full binary tree: ``feature`` and ``edge`` by node, ``value`` by leaf."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.edge[node])
        return self.value[node - (2**DEPTH - 1)]


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, bend: np.ndarray) -> Tree:
    """Splits by the largest gain over binned features, level by level."""
    inner = 2**DEPTH - 1
    feature, edge, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**DEPTH)
    node = np.zeros(len(x), int)
    for at in range(inner):
        rows = np.flatnonzero(node == at)
        best = (1e-9, 0, np.inf)
        whole = slope[rows].sum() ** 2 / (bend[rows].sum() + 1)
        for f, cuts in enumerate(edges):
            if not len(cuts) or len(rows) < 2 * LEAST_LEAF:
                continue
            sums = [np.cumsum(np.bincount(bins[rows, f], w, len(cuts) + 1))[:-1] for w in (slope[rows], bend[rows], None)]
            left, right = sums[0], slope[rows].sum() - sums[0]
            gain = left**2 / (sums[1] + 1) + right**2 / (bend[rows].sum() - sums[1] + 1) - whole
            gain[(sums[2] < LEAST_LEAF) | (len(rows) - sums[2] < LEAST_LEAF)] = 0
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (float(gain[cut]), f, float(cuts[cut]))
        feature[at], edge[at] = best[1:]
        node[rows] = 2 * at + 1 + (x[rows, feature[at]] > edge[at])
    for leaf in range(2**DEPTH):
        rows = node - inner == leaf
        value[leaf] = -RATE * slope[rows].sum() / (bend[rows].sum() + 1)
    return Tree(feature, edge, value)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Trees for the logistic loss, and the log-odds they start from."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    bins = np.stack([np.searchsorted(cuts, column, side="left") for cuts, column in zip(edges, x.T)], 1)
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, bins, edges, p - y, p * (1 - p)))
        score = score + trees[-1](x)
    return start, trees


def margin(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    return model[0] + sum(tree(x) for tree in model[1])


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to the labels: pool adjacent violators."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, first score, last score
    for s, label in zip(scores[order], y[order]):
        blocks.append([float(label), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, count, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
            blocks[-1][3] = last
    knots = np.array([s for b in blocks for s in (b[2], b[3])])
    values = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return knots, values


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    boosted: tuple[float, list[Tree]]
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = margin(self.boosted, x)
        steps = np.interp(raw, self.knots, self.values)
        # A trace of the margin orders texts that share a step; it never crosses one half.
        blended = 0.98 * steps + 0.02 / (1 + np.exp(-raw))
        return np.where((steps >= 0.5) == (blended >= 0.5), blended, steps)


def form_counts(sample: DataFrame) -> DataFrame:
    """word, bad and texts: the toxic and all sample texts that hold a word or a beginning of one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, texts = Counter(), Counter()
            for content, label in zip(batch["text"], batch["label"].to_pylist()):
                plain = {w.strip(EDGES) for w in content.as_py().lower().split()}
                forms = plain | {w[:n] + "~" for n in STEMS for w in plain if len(w) > n}
                texts.update(f for f in forms if len(f) > 1)
                if label:
                    bad.update(forms)
            rows = [(f, bad[f], n) for f, n in texts.items()]
            columns = list(zip(*rows)) or [(), (), ()]
            types = (pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["word", "bad", "texts"])

    counted = sample.select("text", "label").mapInArrow(count, "word string, bad long, texts long")
    return counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("texts").alias("texts"))


def _least(rows: DataFrame, place: Column, tie: str) -> DataFrame:
    """The ``ROWS_PER_LABEL`` rows of least ``place`` of each label; each task passes on no more than that."""
    turn = F.row_number().over(Window.partitionBy("label").orderBy(place, tie))
    return rows.withColumn("turn", turn).where(F.col("turn") <= ROWS_PER_LABEL).drop("turn")


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", label: str = "toxic", doc_id: str = "doc_id"
) -> ToxicityModel | None:
    """A model from labelled rows where ``may_learn`` holds; None unless both labels occur.

    Labels of one identifier that disagree count as the higher one. Of the identifiers that
    have a text, the ``ROWS_PER_LABEL`` of least hash are drawn for each label, and of their
    different texts again as many: neither the number of labels nor that of rows that share an
    identifier changes the bound. Lexicon counts are made by Spark over the drawn rows, and the
    driver gets their features.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & may_learn)
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    drawn = stage(_least(marks, F.xxhash64("id"), "id"))
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), content.alias("text")).join(drawn, "id")
    texts = texts.withColumn("order", F.xxhash64("id", "text")).dropDuplicates(["id", "order"])
    sample = stage(_least(texts, F.col("order"), "id"))
    counted = form_counts(sample)
    totals = sample.agg(F.sum("label"), F.count("*")).first()
    if not totals[0] or totals[0] == totals[1]:
        return None
    bad_rate = (F.col("bad") + 0.1) / totals[0]
    fine_rate = (F.col("texts") - F.col("bad") + 0.5) / (totals[1] - totals[0])
    weighed = counted.where(F.col("bad") >= LEAST_TEXTS).withColumn("weight", F.log(bad_rate / fine_rate))
    strongest = weighed.where(F.col("weight") > LEAST_WEIGHT).orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "word").limit(LEXICON)
    lexicon = {row["word"]: row["weight"] for row in strongest.collect()}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            rows = [features_of(t.as_py(), words) for t in batch["text"]]
            yield pa.record_batch(
                [batch["label"], batch["order"], pa.array(rows, pa.list_(pa.float64()))], ["label", "order", "x"]
            )

    rows = sample.select("text", "label", "order")
    got = rows.mapInArrow(featured, "label int, order long, x array<double>").toArrow().sort_by("order")
    y = got["label"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist())
    fold = np.arange(len(y)) % FOLDS
    outside = np.zeros(len(y))
    for i in range(FOLDS):
        outside[fold == i] = margin(boost(x[fold != i], y[fold != i]), x[fold == i])
    return ToxicityModel(lexicon, boost(x, y), *isotonic(outside, y))


def score(
    docs: DataFrame, model: ToxicityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` with score (0 to 1) and predicted (1 from one half on).

    A null or empty text is scored by its features, all zero; without a model every score is
    0. No shuffle; the model's size is fixed by the constants above.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = Words(own.lexicon if own else {})
        for batch in batches:
            *kept, texts = batch.columns
            if own is None or not batch.num_rows:
                found = np.zeros(batch.num_rows)
            else:
                found = own.scores(np.array([features_of(t.as_py() or "", words) for t in texts]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("score"))
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema
    scored = rows.mapInArrow(predict, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
