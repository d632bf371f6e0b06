import random

import numpy as np
import pytest
import xxhash

from tests.llm.cases import DOC, documents, frame
from terrane.llm import simhash
from pyspark.sql import functions as F


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, budget=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_documents_against_brute_force(spark):
    rows = documents(n=140)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [plain(r[1]) for r in rows]
    least = {}
    for g, r in zip(groups(fps), rows):
        least[g] = min(least.get(g, 1 << 63), (1 << 63) if r[0] is None else r[0])
    want = sorted((str(r[0]), f, str(None if least[g] == 1 << 63 else least[g])) for r, f, g in zip(rows, fps, groups(fps)))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("near, most", [(0, 1 << 17), (300, 1 << 17), (300, 20)])
def test_links_against_all_pairs(spark, near, most, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_ROOT", most)
    monkeypatch.setattr(simhash, "PAIRS_AT_A_TIME", 64)
    rng = random.Random(near)
    fps = {rng.getrandbits(64) for _ in range(400)}
    seeds = list(fps)[:3] + [0, 2**64 - 1]
    for _ in range(near):
        f = rng.choice(seeds)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    frame_ = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    at = {f: i for i, f in enumerate(fps)}
    edges = [(at[r.a & (2**64 - 1)], at[r.b & (2**64 - 1)]) for r in simhash.links(frame_).collect()]
    root = list(range(len(fps)))
    for a, b in edges * 12:
        root[a] = root[b] = min(root[a], root[b])
    for a, b in edges:
        assert root[a] == root[b]
    same = lambda r: sorted(map(sorted, {g: [i for i, x in enumerate(r) if x == g] for g in r}.values()))
    assert same(root) == same(groups(fps))


def test_empty_and_clashing_columns(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    extra = frame(spark).withColumns({"fp": F.lit("x"), "root": F.lit(1), "component_id": F.lit(2)})
    assert simhash.near_duplicates(extra).count() == len(documents())


def test_keep_one_keeps_each_group_once(spark):
    rows = documents()
    rows += [(7, "another text of the same id, far from the other one", "en", "s", 1), (None, rows[0][1], "en", "s", 1)]
    docs = frame(spark, rows).withColumn("row0", F.lit(5))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).distinct().collect()
    names = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.th, str(r.text)) for r in marked)
    root = groups([plain(t if t != "None" else None) for _, _, t in names])
    want = sorted(n for i, n in enumerate(names) if root[i] == i)
    got = kept.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    assert sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.th, str(r.text)) for r in got) == want
    assert sum(k == 7 for k, _, _ in want) == 2
