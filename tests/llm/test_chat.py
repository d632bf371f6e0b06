import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.cases import prose
from terrane.llm import chat

CONV = "conv_id long, turn long, role string, text string"


def by_hand():
    a, b, c = "The first remark, in full.", "Another line here", "Third one"
    return [
        (1, 0, "user", f"{a}\n{b}"),
        (1, 1, "assistant", f"On Monday, A wrote:\n> {a.upper()}\n> {b}\nMy answer"),
        (1, 2, "user", f"> > {a}\n> my answer!\n{c}"),
        (1, 3, "user", "nothing quoted\nB said:\nno quote below"),
        (1, 4, None, f">>>>{a}\n> unknown words\nend"),
        (1, 5, "user", f"> {c}\n> {a}"),
        (1, 6, "user", f"> The first\n> remark, in full. Another\n> line here\n> > {c}\nSo much"),
        (1, 7, "user", "> The first remark in full and then some more words that nobody wrote\nhalf of it is made up"),
        (2, 0, "user", f"> {a}\nelsewhere"),
    ]


def test_links_by_hand(spark):
    got = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(by_hand(), CONV)).collect()}
    say = lambda k: (got[k].n_quoted, got[k].n_linked, got[k].reply_to, got[k].root_turn, got[k].depth, got[k].clean_text)
    assert say((1, 0)) == (0, 0, None, 0, 0, "The first remark, in full.\nAnother line here")
    assert say((1, 1)) == (1, 1, 0, 0, 1, "My answer")
    assert say((1, 2)) == (2, 2, 1, 0, 2, "Third one")
    assert say((1, 3)) == (0, 0, None, 3, 0, "nothing quoted\nB said:\nno quote below")
    assert say((1, 4)) == (2, 1, None, 4, 0, "end")
    assert say((1, 5)) == (1, 0, None, 5, 0, "")  # one passage of two messages' lines, in another order
    assert say((1, 6)) == (2, 2, 0, 0, 1, "So much")
    assert say((1, 7)) == (1, 0, None, 7, 0, "half of it is made up")
    assert say((2, 0)) == (1, 0, None, 0, 0, "elsewhere")


def many(seed=3):
    """Conversations that quote each other's lines at several levels, with nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(9):
            lines = [prose(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 3))]
            quote = []
            for old in rng.sample(said, min(len(said), rng.randint(0, 2))):
                quote += ["> " * rng.choice([1, 1, 2, 3]) + x for x in old]
            if quote and rng.random() < 0.5:
                quote.insert(0, "On day %d, someone wrote:" % turn)
            said.append(lines)
            rows.append((conv, turn, "user", "\n".join(quote + lines)))
    rows += [(None, 0, "user", "alone"), (None, 1, "user", "> alone\nyes"), (3, None, "user", "> ?\n" + rows[27][3]), (4, 2, None, None), (4, 3, "user", ""), rows[20], rows[20], (5, 5, "user", "other version")]
    return rows


def test_against_sql(spark):
    rows = many()
    base = spark.createDataFrame(rows, CONV)
    columns = ["conv_id", "turn", "role", "n_quoted", "n_linked", "reply_to", "root_turn", "depth", "clean_text"]
    got = sorted((tuple(r) for r in chat.link(base).select(*columns).collect()), key=str)
    db = duckdb.connect()
    db.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    db.execute("CREATE TABLE conversations AS SELECT * FROM given")
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({chat.OP9_SQL})").fetchall(), key=str)
    assert got == want
    assert sum(r[5] is not None for r in got) > 30 and max(r[7] for r in got) > 2


def test_order_clashing_columns_and_empty_tables(spark):
    base = spark.createDataFrame(many(), CONV)
    extra = base.withColumns({"chat0": F.lit("x"), "depth": F.lit(7), "c": F.lit(1), "hash": F.lit(2)})
    out = chat.link(extra).collect()
    assert len(out) == len(many())
    assert any(r.depth != 7 for r in out) and {(r.chat0, r.c) for r in out} == {("x", 1)}
    key = [(r.conv_id if r.conv_id is not None else 1 << 62, r.root_turn if r.root_turn is not None else 1 << 62, r.turn if r.turn is not None else 1 << 62) for r in out]
    assert key == sorted(key)
    assert chat.link(spark.createDataFrame([], CONV)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, i, "user", f"> say number {i - 1} here\nsay number {i} here") for i in range(40)]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, CONV)).collect()}
    assert [got[i].depth for i in range(40)] == list(range(40)) and {r.root_turn for r in got.values()} == {0}


def test_only_conversations_that_quote_are_hashed(spark):
    a = "a remark of quite a few words"
    rows = [(1, 0, 0, 0, 0, a), (1, 1, 0, 0, 1, a), (2, 0, 0, 0, 0, a), (2, 1, 0, 0, 0, "short")]
    given = spark.createDataFrame(rows, "c long, t long, h long, pos int, level int, norm string")
    got = chat.sources(given, chat.passages(given)).collect()
    assert {(r.c, r.source) for r in got} == {(1, 0)} and len(got) == 3
