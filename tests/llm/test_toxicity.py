import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame, prose
from terrane.llm import toxicity

BAD = ["zorgly", "zorgath", "vexum"]
LABELS = "doc_id long, quality int, toxic int"


def labelled(seed=4, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randint(5, 120)).split(), i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD).capitalize() + rng.choice([".", "", "!"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = labelled()
    docs = frame(spark, rows)
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], LABELS))
    got = toxicity.tag(docs, model).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and sum((r.score >= 0.3) == truth[r.doc_id] for r in held) / len(held) > 0.98
    marked = [r.text[x.start : x.end].lower() for r in got for x in r.spans]
    assert marked and sum(any(w in m for w in BAD) for m in marked) / len(marked) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = labelled()
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a, b = (toxicity.learn(frame(spark, rows), spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert (a["hash"] == b["hash"]).all() and np.allclose(a["weight"], b["weight"])


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 11])
    emission, pairs, start = rng.normal(0, 2, 11), rng.normal(0, 1, (2, 2)), 0.7
    got = toxicity.chain(emission, first, pairs, start)
    for a, b in itertools.pairwise(first):
        total, toxic = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            if path:
                w = np.exp(sum(emission[a:b] * path) + start * path[0] + sum(pairs[x, y] for x, y in itertools.pairwise(path)))
                total += w
                toxic += w * np.array(path)
        if b > a:
            assert got[a:b] == pytest.approx(toxic / total)


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows, labels = labelled(n=120)
    docs = frame(spark, rows + documents()[-9:]).withColumns({"score": F.lit("x"), "toxic0": F.lit(1)})
    lab = spark.createDataFrame(labels, LABELS)
    kept = toxicity.keep_clean(docs, lab)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 101 in ids and 102 in ids and len(ids) < docs.count()
    none = toxicity.learn(docs, lab.filter("toxic = 0"))
    assert toxicity.tag(docs.drop("score"), none).filter("score <> 0").count() == 0
    assert toxicity.tag(spark.createDataFrame([], DOC), toxicity.learn(docs, lab)).count() == 0
