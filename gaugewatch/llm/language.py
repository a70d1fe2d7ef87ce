"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its byte n-grams, looked up by hash. Embeddings and
the softmax are trained together by stochastic gradient descent in numpy, on a bounded sample.
A temperature makes the scores honest. A text is rejected if its score is below nearly all
held-out scores, or if the subwords of its language's training texts hardly cover it: a
softmax over few languages is often sure of texts that are in none of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.llm.common import stage

#: Hash buckets of subwords, embedding width, n-gram lengths in bytes.
BUCKETS, WIDTH, GRAMS = 4096, 16, (1, 2, 3, 4)
#: The sample: this many different texts per language at most, each whole; a fifth calibrates.
ROWS_PER_LANGUAGE, CALIBRATION = 1500, 5
#: Sample texts of all languages together, and languages learned at most: those with the most
#: sample texts, then the first by name. Fewer texts per language are drawn if there are many.
SAMPLE_ROWS, LANGUAGES = 8000, 200
#: The quantile of what held-out texts reach below which a text is rejected.
QUANTILE = 0.005
EPOCHS, BATCH, RATE, SEED = 30, 64, 0.5, 11
#: Bytes of one text hashed at a time.
CHUNK = 1 << 20

UNKNOWN = "und"

#: ASCII letters in lower case; every other ASCII byte is a blank, all others stay.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_letter = np.random.default_rng(SEED).integers(1, 2**32, 256, dtype=np.uint32)


def subword_counts(text: str) -> np.ndarray:
    """How often each hash bucket occurs among the byte n-grams of the folded text."""
    data = b" ".join(text.encode().translate(FOLD).split())
    counts = np.zeros(BUCKETS, np.int64)
    lap = max(GRAMS) - 1
    for at in range(0, len(data), CHUNK):
        # The lap lets n-grams reach into the next chunk; each starts in one chunk only.
        codes = _letter[np.frombuffer(data[at : at + CHUNK + lap], np.uint8)]
        own = min(CHUNK, len(data) - at)
        rolled = codes
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                rolled = rolled[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
            if n in GRAMS and len(rolled):
                mixed = (rolled[:own] ^ (rolled[:own] >> np.uint32(15))) * np.uint32(0x85EBCA77)
                counts += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
            if not len(rolled):
                break
    return counts


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Embeddings times softmax weights: what one subword adds to each language.
    claims: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: By language: log of how often each subword occurs in its training texts, against all subwords alike.
    typical: np.ndarray
    #: By language: the least mean of these under which a text is covered.
    floors: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.claims / max(1, counts.sum()) + self.bias) / self.temperature
        powers = np.exp(logits - logits.max())
        return powers / powers.sum()

    def judge(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        found = self.scores(counts)
        best = int(found.argmax())
        cover = float(counts @ self.typical[best] / max(1, counts.sum()))
        return self.languages[best], float(found[best]), bool(found[best] < self.threshold or cover < self.floors[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def train(counts: np.ndarray, names: list[str]) -> LanguageModel:
    """Fit on rows of subword counts; a fifth of them sets temperature, threshold and floors.

    Real-numbered ``counts`` are turned into shares in place: the sample is held once.
    The threshold is the ``QUANTILE`` of the scores of held-out texts that are read right, and
    half of the least if they are too few for it. The floor of a language is the same quantile
    of how well its held-out texts are covered, less log 2; without such texts it has none.
    """
    languages = tuple(sorted(set(names)))
    target = np.array([languages.index(n) for n in names])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(target))
    held = order[: len(order) // CALIBRATION]
    rows = order[len(order) // CALIBRATION :]
    seen = np.stack([counts[rows[target[rows] == i]].sum(0, dtype=np.float64) for i in range(len(languages))]) + 0.5
    average = np.asarray(counts, np.float32)
    average /= np.maximum(1, average.sum(1, keepdims=True))
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        # Averages of thousands of subwords are small, so embeddings take long steps.
        rate = RATE * (1 - epoch / EPOCHS)
        for chosen in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            x, y = average[chosen], target[chosen]
            hidden = x @ embeddings
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(y)), y] -= 1
            error /= max(1, len(y))
            step = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(0)
            embeddings -= 100 * rate * x.T @ step
    claims = embeddings @ weights
    used = held if len(held) else rows
    logits, truth = average[used] @ claims + bias, target[used]
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0), key=loss)
    scores = _softmax(logits / temperature)
    right = scores.argmax(1) == truth
    best = scores.max(1)[right]
    few = len(best) * QUANTILE < 1
    threshold = 0.0 if not len(best) else best.min() / 2 if few else np.quantile(best, QUANTILE, method="lower")
    typical = np.log(BUCKETS * seen / seen.sum(1, keepdims=True)).astype(np.float32)
    floors = np.full(len(languages), -np.inf)
    for i in range(len(languages)):
        own = average[used[right & (truth == i)]] @ typical[i]
        if len(own):
            floors[i] = np.quantile(own, QUANTILE, method="lower") - np.log(2)
    return LanguageModel(languages, claims.astype(np.float32), bias, float(temperature), float(threshold), typical, floors)


def fit(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """A model from the rows where ``may_learn`` holds and text and language are there; None without such rows.

    Drawn are the ``ROWS_PER_LANGUAGE`` texts of least hash of each language, or all if there
    are fewer; copies count once. ``SAMPLE_ROWS`` and ``LANGUAGES`` bound them together, however
    many values ``lang`` has. The driver gets their subword counts only, packed.
    """
    usual = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), may_learn.alias("may"))
    usual = usual.where(F.col("may") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    usual = usual.withColumn("place", F.xxhash64("text"))
    # Few rows of each language leave a task before they meet in the language's own.
    places = usual.select("lang", "place").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = stage(places.withColumn("turn", turn).where(F.col("turn") <= ROWS_PER_LANGUAGE))
    largest = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    learned = [row["lang"] for row in largest.collect()]
    if not learned:
        return None
    each = max(1, min(ROWS_PER_LANGUAGE, SAMPLE_ROWS // len(learned)))
    drawn = chosen.where((F.col("turn") <= each) & F.col("lang").isin(learned))
    bounds = {row["lang"]: row["last"] for row in drawn.groupBy("lang").agg(F.max("place").alias("last")).collect()}
    # A map of one entry per language: the last place drawn. Other languages have none.
    last = F.create_map(*[F.lit(x) for entry in bounds.items() for x in entry])
    sample = usual.where(F.col("place") <= F.try_element_at(last, F.col("lang"))).dropDuplicates(["lang", "place"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [zlib.compress(subword_counts(t.as_py()).astype("<u4").tobytes(), 1) for t in batch["text"]]
            yield pa.record_batch([batch["lang"], pa.array(rows, pa.binary())], ["lang", "counts"])

    packed = sample.select("text", "lang").mapInArrow(counted, "lang string, counts binary").toArrow()
    if not len(packed):
        return None
    packed = packed.sort_by([("lang", "ascending"), ("counts", "ascending")])
    counts = np.empty((len(packed), BUCKETS), np.float32)
    for i, row in enumerate(packed["counts"]):
        counts[i] = np.frombuffer(zlib.decompress(row.as_buffer()), "<u4")
    return train(counts, packed["lang"].to_pylist())


def identify(
    docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and rejected.

    A text that is null or has no letter, and every text without a model, is ``und`` with
    score 0 and rejected. Other texts get the likeliest language and its calibrated score;
    ``rejected`` if the score is below the model's threshold or the language's subwords cover
    too little of the text. No shuffle; the model's size is
    fixed by ``BUCKETS`` and the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            *kept, texts = batch.columns
            names, scores, rejected = [], [], []
            for value in texts:
                content = value.as_py()
                if own is None or content is None:
                    names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                name, score, out = own.judge(subword_counts(content))
                names.append(name), scores.append(score), rejected.append(out)
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    content = F.col(text).cast("string")
    rows = docs.select(*keep, F.when(content.rlike(r"\p{L}"), content).alias("lang_pred"))
    schema = docs.select(
        *keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
    ).schema
    return rows.mapInArrow(predict, schema)
