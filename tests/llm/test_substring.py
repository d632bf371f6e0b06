import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame, prose
from terrane.llm import substring


def brute(rows, window=substring.WINDOW):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    ids = [substring.NULL_ID if r[0] is None else r[0] for r in rows]
    first = {}
    for k, w in zip(ids, words):
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, k), k)
    out = []
    for r, k, w in zip(rows, ids, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shared_rows(seed):
    """Passages of about a window's length, repeated at many places and partly."""
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (49, 50, 51, 75, 130)]
    rows = documents(seed)
    for i in range(200, 260):
        p = rng.choice(passages).split()
        cut = p[rng.choice([0, 0, 1, 5]) : rng.choice([len(p), len(p), len(p) - 1, 60])]
        rows.append((i, prose(rng, rng.randint(0, 30)) + "\n" + "\v".join(cut) + "  " + prose(rng, rng.randint(0, 70)), "en", "s", 1))
    rows += [(300, " ".join(["same"] * 140), "en", "s", 1), (299, " ".join(["same"] * 90), "en", "s", 1)]
    return rows


def run(docs, batches):
    return sorted((tuple(r) for r in substring.dedup(docs, batches).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()), key=str)


@pytest.mark.parametrize("heavy", [substring.HEAVY, 3])
def test_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring, "HEAVY", heavy)
    for seed, batches in ((1, 1), (2, 4)):
        rows = shared_rows(seed)
        want = brute(rows)
        assert run(frame(spark, rows), batches) == want
        assert sum(r[2] > 0 for r in want) > 30
    assert not [t.name for t in spark.catalog.listTables() if "terrane_run" in t.name]


def test_empty_and_clashing_columns(spark):
    assert run(spark.createDataFrame([], DOC), 3) == []
    rows = documents()
    assert run(frame(spark, rows).withColumns({"k": F.lit("x"), "th": F.lit(1), "ranges": F.lit(2)}), 2) == brute(rows)


def test_border_passages_repeated_inside_one_document(spark):
    """A smaller doc_id's passage of about a window, held again in the same document or row of its doc_id."""
    rng = random.Random(5)
    rows = []
    for i in range(12):
        passage = prose(rng, 50 + 3 * i)
        around = prose(rng, 60) + " " + passage + " " + prose(rng, 60)
        rows.append((i, prose(rng, 70) + " " + passage + " " + prose(rng, 70), "en", "s", 1))
        rows.append((100 + i, around + " " + prose(rng, 20) + " " + around, "en", "s", 1))
        k = None if i % 2 else 200 + i
        other = prose(rng, 60) + " " + passage + " " + prose(rng, 60)
        if i % 3 == 0:
            rows[-1] = (k, around, "en", "s", 1)
            rows += [(k, prose(rng, 9) + " " + around, "en", "s", 1), (k, other + " " + other, "en", "s", 1)]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) >= 12
    for batches in (1, 3):
        assert run(frame(spark, rows), batches) == want


def test_an_index_that_is_closed_and_opened_again(spark):
    rows = sorted((r for r in shared_rows(3) if r[0] is not None), key=lambda r: r[0])
    parts = [rows[:40], rows[40:75], rows[75:]]
    want = {str((r[0], r[1])) + str(r[3]): r for r in brute(rows)}
    index, seen, got = substring.SegmentIndex(spark), [], []
    for part in parts:
        history = frame(spark, seen) if seen else None
        out = substring.dedup(frame(spark, part), 2, index, history)
        got += [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()]
        seen += part
        closed = index.close()
        assert not [t.name for t in spark.catalog.listTables() if "terrane_run" in t.name]
        index = substring.SegmentIndex.open(spark, closed)
    index.drop()
    assert sorted(got, key=str) == brute(rows) and len(want) > 50
