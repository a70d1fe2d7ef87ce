"""The Spark-free pieces: tokens, bounds, suffix buckets, archives, learners."""

import io

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gaugewatch.llm import decontaminate, jaccard, language, suffix_dedup, token_counts, topk, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = token_counts.TextCounter(token_counts.Vocabulary(open(PATH, encoding="utf-8").read()))
LIBRARY = Tokenizer.from_file(PATH)


@given(st.text(st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_tokens_agree_with_the_library(text):
    assert COUNTER(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|><|endoftext|>b ", "x" * 5000, " " * 900, "I'LL don't\n\n\t z"])
def test_tokens_of_odd_texts(text):
    assert COUNTER(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_whole_entries_are_proved():
    whole = set(COUNTER.pieces.whole)
    assert " the" in whole and len(whole) > 40_000
    for piece in sorted(whole)[::500]:
        assert len(LIBRARY.encode(piece, add_special_tokens=False, is_pretokenized=False).ids) >= 1


@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_block_search_is_exact(n, width, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-3, 4, (n, width)).astype(float)
    ids = rng.permutation(n)
    found = {q: list(zip(a, s)) for q, a, s, _ in topk.search_block(ids, rows, ids[:5], rows[:5], rows[:3], 4)}
    for q, x in zip(ids[:5], rows[:5]):
        want = sorted((-int(x @ y), int(i)) for i, y in zip(ids, rows) if i != q)[:4]
        assert [(int(i), int(s)) for i, s in found[q]] == [(i, -s) for s, i in want]


def test_search_stops_early_on_spread_vectors():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 1000, (4000, 3)).round()
    scored = [n for *_, n in topk.search_block(np.arange(4000), rows, np.arange(9), rows[:9], rows[:40], 10)]
    assert max(scored) < 4000


def test_scores_beyond_a_long_are_held():
    big = np.array([[2.0**62, 2.0**62]])
    assert topk._exact(big, big)[0, 0] == 2**63 - 1


@given(st.text("ab", min_size=0, max_size=400), st.integers(0, 250))
@settings(max_examples=60, deadline=None)
def test_stretches_hold_every_start_once(text, pad):
    data = (text + "c" * pad).encode()
    if len(data) < suffix_dedup.LENGTH:
        return
    _, _, first, more, _ = suffix_dedup.stretches(data)
    starts = np.concatenate([np.arange(f, f + m + 1) for f, m in zip(first, more)])
    assert starts.tolist() == list(range(len(data) - suffix_dedup.LENGTH + 1))


def test_equal_strings_have_equal_buckets():
    rng = np.random.default_rng(3)
    piece = bytes(rng.integers(97, 123, 300, dtype=np.uint8))
    left, right = b"x" * 500 + piece + b"y" * 99, piece + b"z" * 400
    known = [suffix_dedup.buckets(d)[1] for d in (left, right)]
    assert (known[0][500:701] == known[1][:201]).all()


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), min_size=1, max_size=20))
def test_runs_are_merged(spans):
    starts, ends = np.array([s for s, _ in spans]), np.array([s + n for s, n in spans])
    covered = {p for s, n in spans for p in range(s, s + n)}
    runs = list(zip(*suffix_dedup.merged(starts, ends)))
    assert {p for s, e in runs for p in range(s, e)} == covered
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_cut_by_declared_lengths(version):
    fields = warc.ARC_FIELDS[version]
    about = f"{version} 0 x\n{fields}\n"
    content = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nfiledesc://trap\n\n\n"
    middle = "" if version == 1 else " 200 - - 0 f"
    data = f"filedesc://x 0.0.0.0 20000101000000 text/plain {len(about)}\n{about}\n".encode()
    data += f"http://a 1.1.1.1 20010203040506 text/html{middle} {len(content)}\n".encode() + content + b"\n"
    (record,) = warc.read_arc(io.BytesIO(data))
    assert record.content == content and record.fields["URL"] == "http://a"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-9])))


@given(st.text("ab c", max_size=60), st.integers(1, 5))
def test_shingle_sets(text, n):
    words = text.split(" ")
    words = [w for w in words if w]
    want = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    assert len(jaccard.shingles(text, n, jaccard.WordHashes())) == len(want)


def test_long_text_is_hashed_whole(monkeypatch):
    text = "Straße und Weg " * 400
    whole = language.subword_counts(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    assert (language.subword_counts(text) == whole).all()


def test_language_model_learns_and_rejects():
    texts = ["the thing that was " * 5, "der die das und ist " * 5] * 30
    model = language.train(np.stack([language.subword_counts(t).astype(np.float32) for t in texts]), ["en", "de"] * 30)
    assert model.languages[model.scores(language.subword_counts("das ist der")).argmax()] == "de"
    assert 0 < model.threshold < 1


def test_unseen_scripts_and_random_letters_are_rejected():
    rng = np.random.default_rng(7)
    parts = {
        "de": "der die das und sch ein ich en er te gen lich ung stei ber pf tz zu".split(),
        "en": "the and of to ing tion er th re nd at on es wh ough ly ed it".split(),
        "es": "los de ción que es ar as el ado mente ía os una por rr ez ida con".split(),
    }
    words = lambda p: " ".join("".join(rng.choice(p, rng.integers(1, 4))) for _ in range(rng.integers(20, 80)))
    counts_of = lambda texts: np.stack([language.subword_counts(t).astype(np.float32) for t in texts])
    names = [n for n in parts for _ in range(400)]
    model = language.train(counts_of([words(parts[n]) for n in names]), names)
    fresh = [n for n in parts for _ in range(100)]
    judged = [model.judge(c) for c in counts_of([words(parts[n]) for n in fresh])]
    assert sum(name == n and not out for (name, _, out), n in zip(judged, fresh)) >= 0.97 * len(fresh)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    odd = ["".join(rng.choice([*letters, " "], 300)) for _ in range(50)]
    odd += ["Привет, это текст о погоде и природе. " * 4, "Η γλώσσα είναι πολύ όμορφη", "今天天气很好我们去公园散步吧", "qzx"]
    assert all(model.judge(c)[2] for c in counts_of(odd))


def test_isotonic_rises_and_keeps_means():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert np.interp([1, 2, 3, 4], knots, values).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_trees_fit_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    model = toxicity.boost(x, y)
    assert ((toxicity.margin(model, x) > 0) == (y > 0)).mean() > 0.97


def test_families_and_disguised_words_are_found():
    words = toxicity.Words({"moron": 5.0, "lowei~": 4.0})
    x = dict(zip(toxicity.FEATURES, toxicity.features_of("You M0ron! MORON loweischaft", words)))
    assert x["strong_any"] == 2 and x["masked_density"] == 0.25 and x["near_second_person"] == 0.25
    assert toxicity.features_of("", words) == [0.0] * len(toxicity.FEATURES)


def test_words_of_a_benchmark():
    assert decontaminate.words_of("Ab-Cd 9é\x00Z") == ["ab".encode(), b"cd", "9é".encode(), b"z"]
    assert decontaminate.words_of(None) == []
