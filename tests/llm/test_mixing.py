import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOC, documents, frame, prose
from terrane.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}


def test_sizes_targets_and_taken(spark):
    rows = documents()
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goals, taken, most = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
        assert r.taken == r.epochs * r.size <= 3 * r.size
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= most[s] / 2 + 1e-6
    assert sum(abs(taken[s] - goals[s]) for s in sizes) <= 0.05 * sum(goals.values())


def test_half_of_the_words_come_before_the_middle(spark):
    """Positions are shares of all words that the mix takes."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 40)), "en", f"src{i % 5}", 1) for i in range(3000)]
    mixed = mixing.mix(frame(spark, rows)).select("size", "positions", "source").collect()
    whole = sum(r.size * len(r.positions) for r in mixed)
    for at in (0.1, 0.25, 0.5, 0.75, 0.9):
        assert sum(r.size * sum(p < at for p in r.positions) for r in mixed) / whole == pytest.approx(at, abs=0.01)
    # a source whose schedule falls comes early, one whose schedule rises late
    middle = lambda s: [p for r in mixed if r.source == s for p in r.positions]
    assert sum(middle("src0")) / len(middle("src0")) < 0.45 < 0.55 < sum(middle("src2")) / len(middle("src2"))


def test_fillers_bring_each_source_near_its_target(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([2, 3, 5, 9, 400])), "en", f"src{i % 3}", 1) for i in range(600)]
    for fillers, miss in ((256, 5), (40, 200)):
        monkeypatch.setattr(mixing, "FILLERS", fillers)
        got = defaultdict(lambda: [0, 0.0])
        for r in mixing.mix(frame(spark, rows)).collect():
            got[r.source][0] += r.taken
            got[r.source][1] = r.target
        assert all(abs(taken - target) <= miss for taken, target in got.values())


def test_against_sql(spark, tmp_path):
    rows = [r for r in documents() if r[0] != 105] + [(400, "Ünï\x1ccode words", "en", "src0", 1)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = mixing.op1_mix_sources(spark, str(tmp_path)).toPandas()
    want = con.sql(mixing.OP1_SQL).df()[got.columns]
    sort = lambda df: df.astype(object).where(df.notna(), -1).sort_values(["size", "doc_id"], key=lambda c: c.astype(float)).values.tolist()
    assert sort(got) == sort(want)


def test_columns_that_are_carried(spark):
    docs = frame(spark).withColumn("cell", F.lit("x"))
    out = mixing.mix(docs, carry=("text", "lang", "cell"))
    assert {"text", "lang", "cell", "position"} <= set(out.columns)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((r[0], r[1]) for r in documents()), key=str)


def test_reruns_and_partitions_agree(spark):
    a, b = (mixing.mix(frame(spark).repartition(n)).select("doc_id", "source", "size", "taken", "position").collect() for n in (1, 7))
    key = lambda r: (str(r.doc_id), str(r.source), r.size)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_cells_do_not_change_the_result(spark, monkeypatch):
    a = mixing.mix(frame(spark)).select("doc_id", "size", "taken").collect()
    monkeypatch.setattr(mixing, "CELLS", 4)
    b = mixing.mix(frame(spark)).select("doc_id", "size", "taken").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_inverse_demand_inverts_the_integral(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("share")).withColumn("t", F.expr(mixing.inverse_demand("share", knots))).withColumn("back", F.expr(mixing.demand("t", knots))).collect()
        for r in rows:
            met = sum(min(max(r.t - t0, 0), t1 - t0) * w + s * min(max(r.t - t0, 0), t1 - t0) ** 2 / 2 for t0, t1, w, s, _ in mixing._pieces(knots))
            assert met == pytest.approx(r.share, abs=1e-9) and r.back == pytest.approx(r.share, abs=1e-9)


def test_empty_and_clashing_columns(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    extra = frame(spark).withColumns({"cell": F.lit("x"), "target": F.lit(1), "size": F.lit("y"), "rank": F.lit(0)})
    assert mixing.mix(extra).count() == len(documents())


def test_training_order_is_sorted(spark):
    mixed = mixing.mix(frame(spark))
    got = [r.position for r in mixing.training_order(mixed).collect()]
    assert got == sorted(got) and len(got) == mixed.agg(F.sum("epochs")).first()[0]
