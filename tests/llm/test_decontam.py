import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame, prose
from terrane.llm import decontam


def items(rng):
    rows = documents()
    out = [(i, prose(rng, rng.randint(1, 40))) for i in range(6)]
    out += [(10, " ".join(rows[4][1].split()[-60:-30])), (11, rows[20][1]), (12, None), (13, "..."), (None, " ".join(rows[9][1].split()[2:18])), (10, rows[30][1].upper() + "!")]
    return out


def brute(text, bench):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in bench:
        w = words(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(own) - m + 1):
                if own[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("block", [4 << 20, 900])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rows, bench = documents(n=40), items(random.Random(5))
    got = decontam.find(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = sorted(((r[0], *brute(r[1], bench)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for sizes in ([40, 1, 7], [300]):
        text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in sizes])
        index = decontam.FMIndex(text, 3)
        phrases = rng.integers(1, 4, (60, 5))
        length = rng.integers(1, 6, 60)
        low, high = index.search(phrases, length)
        for p, m, a, b in zip(phrases, length, low, high):
            want = [i for i in range(len(text) - m) if (text[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_clean_keeps_columns_and_empty_tables(spark):
    bench = spark.createDataFrame(items(random.Random(5)), "item_id long, text string")
    docs = frame(spark).withColumns({"found0": F.lit(1), "items": F.lit("x")})
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert decontam.find(spark.createDataFrame([], DOC), bench).count() == 0
    assert decontam.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()
