import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame
from terrane.llm import media, shared, textkit


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed, nodes, n", [(1, 60, 40), (2, 200, 90), (3, 30, 200)])
def test_components_against_union_find(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(i, i + 1) for i in range(1000, 1040)]
    want = {x: r for x, r in roots(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in shared.components(df).collect()} == want
    # nodes that are structs: the root is the smallest one by its first field
    twin = lambda c: F.struct((-F.col(c)).alias("order"), F.col(c).alias("name"))
    got = shared.components(df.select(twin("a").alias("a"), twin("b").alias("b"))).collect()
    least = {x: max(y for y in want if want[y] == r) for x, r in want.items()}
    assert {r.node.name: r.root.name for r in got} == least


def test_components_of_nothing(spark):
    assert shared.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stashed_tables_are_read_back_and_discarded(spark):
    kept = shared.stash(frame(spark), "cases")
    assert sorted(map(str, kept.collect())) == sorted(map(str, frame(spark).collect()))
    shared.discard(kept)
    with pytest.raises(Exception):
        spark.read.schema(DOC).parquet(kept._stashed_at).count()


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_words_against_a_pattern(size):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \t\n\v\f\rÉ\x1c.") for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", " "]
    column = pa.array(texts).slice(3)
    got, hashes = [], {}
    for i, j, data, bounds in textkit.chunks(column, size):
        words = textkit.Words(data, bounds)
        for r in range(j - i):
            own = [data[a:b].tobytes().decode() for a, b in zip(words.start[words.first[r] : words.first[r + 1]], words.end[words.first[r] : words.first[r + 1]])]
            got.append(own)
        for a, b, h in zip(words.start, words.end, words.hash):
            assert hashes.setdefault(data[a:b].tobytes(), int(h)) == int(h)
        assert words.counts().sum() == len(words) == len(words.owner())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[3:]]
    assert len(set(hashes.values())) == len(hashes)


def test_spans_hash_alike_wherever_they_are():
    values = np.array([5, 9, 2, 5, 9, 2, 7], np.uint64)
    pre = textkit.prefix(values, textkit.Powers(0x9E3779B97F4A7C15))
    at = np.array([0, 3]), np.array([3, 6])
    a, b = textkit.span(pre, *at, textkit.Powers(0x9E3779B97F4A7C15))
    assert a == b != textkit.span(pre, np.array([1]), np.array([4]), textkit.Powers(0x9E3779B97F4A7C15))[0]


def test_media_of_a_table_with_clashing_columns_and_a_very_long_text(spark):
    rows = documents() + [(7000, "long " * 200_000, "en", "s", 1)]
    docs = frame(spark, rows).withColumns({"feature": F.lit("x"), "type": F.lit(1), "declared": F.lit(2), "payload_bytes": F.lit("y")})
    got = {r.doc_id: r for r in media.store(docs).collect()}
    assert media.store(docs).count() == len(rows) and got[7000].n_bytes == 1_000_000
    payload = b"long " * 200_000
    payload += b" " * (-len(payload) % 192)
    kind = got[7000].type
    import hashlib

    stored = media.encode(payload, kind)
    assert (got[7000].media_bytes, got[7000].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
