import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame, prose
from terrane.llm import hmm


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


@pytest.mark.parametrize("known", [20, 60, 10_000])
def test_counts_and_base_scores(spark, known):
    rows = documents(n=80)
    docs = frame(spark, rows)
    got = hmm.score(docs, docs.filter(~hmm.held_out()), frequent=20, iterations=1, known=known).collect()
    assert len(got) == len(rows)
    train = Counter(t for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2 for t in tokens(r[1]))
    n, v = sum(train.values()), len(train)
    want = sorted(((r[0], len(tokens(r[1])), sum(train[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens(r[1])), 6)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)


def small():
    words = {b"a": 2, b"b": 3, b"c": 4}
    return hmm.Model(words, np.array([0.2, 0.1, 0.3, 0.25, 0.15]), 3)


def numbers(model, text):
    """The small model's token numbers: its one class is 1."""
    return np.array([*(model.words.get(w, 1) for w in text.split()), hmm.END], np.int32)


def test_forward_against_all_paths():
    model = small()
    texts = [b"a b c x a", b"", b"c c c", b"b"]
    ids = [numbers(model, t) for t in texts]
    order = sorted(range(4), key=lambda i: -len(ids[i]))
    flat, length = np.concatenate([ids[i] for i in order]), np.array([len(ids[i]) for i in order])
    columns = hmm.Columns(np.cumsum(length) - length, length)
    got, *_ = hmm._forward(model.emit.T[flat[columns.source]], model.step, np.broadcast_to(model.start, (4, 3)), columns, False)
    for value, i in zip(got, order):
        p = sum(model.start[s[0]] * math.prod(model.step[a, b] for a, b in itertools.pairwise(s)) * math.prod(model.emit[k, t] for k, t in zip(s, ids[i])) for s in itertools.product(range(3), repeat=len(ids[i])))
        assert value == pytest.approx(math.log(p))


def test_expected_counts_against_all_paths():
    model = small()
    ids, inside = [numbers(model, b"a b c"), numbers(model, b"c x")], np.array([False, True])
    sums, want = hmm._no_counts(model), hmm._no_counts(model)
    length = np.array([4, 3])
    hmm.expected_counts(model, np.concatenate(ids), np.array([0, 4]), length, inside, sums)
    for x, deep in zip(ids, inside):
        paths = {}
        for s in itertools.product(range(3), repeat=len(x)):
            paths[s] = (model.inner if deep else model.start)[s[0]] * math.prod(model.step[a, b] for a, b in itertools.pairwise(s)) * math.prod(model.emit[k, t] for k, t in zip(s, x))
        total = sum(paths.values())
        for s, p in paths.items():
            want["inner" if deep else "start"][s[0]] += p / total
            for k, t in zip(s, x):
                want["emit"][k, t] += p / total
            for a, b in itertools.pairwise(s):
                want["step"][a, b] += p / total
    for k in ("emit", "step", "start", "inner"):
        assert sums[k] == pytest.approx(want[k], rel=1e-4, abs=1e-6)


def test_training_raises_the_likelihood_and_beats_the_base(spark):
    rng = random.Random(6)
    kinds = [[prose(rng, 1) + s for _ in range(40)] for s in ("xx", "yy", "zz")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(20, 300))), "en", "s", 1) for i in range(150)]
    docs = frame(spark, rows)
    model = hmm.Model({w.encode(): i for i, w in enumerate((w for k in kinds for w in k), hmm.WORDS)}, np.full(hmm.WORDS + 120, 1 / (hmm.WORDS + 120)))
    likelihood = hmm.baum_welch(model, docs, 4)
    assert all(b > a for a, b in itertools.pairwise(likelihood))
    got = [r for r in hmm.score(docs, docs.filter(~hmm.held_out())).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_tables_and_clashing_columns(spark):
    docs = frame(spark).withColumns({"k": F.lit("x"), "th": F.lit(1), "rare": F.lit(2), "n": F.lit(3)})
    empty = spark.createDataFrame([], DOC)
    assert hmm.score(docs, docs).count() == docs.count()
    assert hmm.score(empty, docs).count() == 0
    assert {r.n_known for r in hmm.score(docs, empty).collect()} == {0}


def test_a_cut_text_counts_like_its_stretches_with_each_transition_once():
    model = small()
    ids = numbers(model, b"a b c a b c c a")
    sums = hmm._no_counts(model)
    hmm.expected_counts(model, ids, np.array([0, 3, 6]), np.array([4, 4, 3]), np.array([False, True, True]), sums, np.array([True, True, False]))
    assert sums["emit"].sum() == pytest.approx(9, rel=1e-5) and sums["step"].sum() == pytest.approx(8, rel=1e-5)
    assert sums["emit"].sum(0) == pytest.approx(np.bincount(ids, minlength=5), rel=1e-5)


def test_frequent_words_fill_the_bin_that_overflows(spark):
    counts = spark.createDataFrame([(f"w{i:03d}", 5) for i in range(300)] + [("top", 90)], "word string, n long")
    got = [r.word for r in hmm.frequent_words(counts, 101)]
    assert got == ["top", *(f"w{i:03d}" for i in range(100))]


def test_scores_against_a_plain_forward_recursion(spark):
    """The whole score, rare and unseen words included, from counts and the trained model alone."""
    rows = [r for r in documents(n=60) if r[0] is not None]
    docs = frame(spark, rows)
    held = {}
    plain = hmm.baum_welch
    hmm.baum_welch = lambda model, *a: held.update(model=model) or plain(model, *a)
    try:
        got = {(r.doc_id, r.n_tokens): r.score for r in hmm.score(docs, docs.filter(~hmm.held_out()), frequent=20, iterations=2, known=60).collect()}
    finally:
        hmm.baum_welch = plain
    model = held["model"]
    train = Counter(t for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for t in tokens(r[1]))
    total = Counter()
    for w, n in train.items():
        if w is not None and w not in model.words:
            total[hmm.class_of(w)] += n + 1
    for r in rows[:25]:
        ll, now = 0.0, model.start
        for i, w in enumerate(tokens(r[1])):
            k = hmm.END if w is None else model.words.get(w, hmm.class_of(w))
            share = 1.0 if w is None or w in model.words else (train[w] + 1) / (total[k] + 1)
            now = (now if i == 0 else now @ model.step) * model.emit[:, k] * share
            ll += math.log10(now.sum())
            now = now / now.sum()
        assert got[r[0], len(tokens(r[1]))] == pytest.approx(ll, rel=1e-6)
