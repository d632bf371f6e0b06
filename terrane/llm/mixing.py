"""Operator 1: mixing sources to target weights along a curriculum.  DataFrame functions only.

Each source gets a target number of words by weight, stopping at ``max_epochs`` times
its size (the excess is shared anew by weight).  A source's weight varies over
training as a piecewise-linear schedule; its integral is the source's cumulative
token demand.  A document copy that begins after ``c`` words of its source's supply is
due when the source's demand reaches ``c``: the demand is inverted at ``c``.  All sources' demand up to
that time, as a share of the whole, is the copy's training position, so half of the words come before
position 0.5.  Documents are range-sorted by position.

A source's target is some whole epochs and a part of one.  Of the part, documents are taken in order of a hash while they
fit; the last FILLERS documents of that order, about, are then taken from large to small where they fit what is left.

Nulls: a null text has size 0; a null source is a source of its own, after all others
by code point; a null doc_id counts as the empty string in the hash.  Documents of size 0 are never
taken.  Repeated rows are documents of their own.  An empty table gives an empty table.
Further columns of the input are ignored, or passed on by ``carry``; those named like a column of the result are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.shared import WORD, stash, table

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: (progress, relative weight) of a source by rank, repeating: heavy sources fade, light ones rise.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (0.3, 1.2), (1.0, 0.8)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
MAX_EPOCHS = 3
#: Rows of a source that are put in order by one task, about.
CELL_ROWS = 50_000
#: Hash cells a source is cut into, at least.
CELLS = 256
#: Documents of a source that make up for what the others leave of its target, on average (all of a source with fewer).
FILLERS = 256
SEED = 17
RESULT = ("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "positions", "position")
#: Bits of a draw.
DRAW_BITS = 60


def _pieces(knots: tuple) -> list[tuple[float, float, float, float, float]]:
    """Of each piece of a schedule whose integral is scaled to 1: start, end, weight at start,
    slope, and the demand met before it."""
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    if knots[0][0] != 0 or knots[-1][0] != 1 or whole <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule runs from progress 0 to 1 with weights that are not negative")
    out, met = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1, w0 / whole, (w1 - w0) / (t1 - t0) / whole, met))
        met += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def inverse_demand(share: str, knots: tuple) -> str:
    """SQL for the progress at which the schedule's cumulative demand reaches ``share`` (0 to 1)."""
    out = ""
    for t0, t1, w, slope, met in reversed(_pieces(knots)):
        # w x + slope x^2 / 2 = share - met, by the root that stays finite as slope goes to 0
        rest = f"greatest({share} - {met:.17e}, 0e0)"
        root = f"sqrt(greatest({w * w:.17e} + {2 * slope:.17e} * {rest}, 0e0))"
        x = f"least({t0:.17e} + coalesce(2e0 * {rest} / nullif({root} + {w:.17e}, 0e0), 0e0), {t1:.17e})"
        reach = (t1 - t0) * w + slope * (t1 - t0) ** 2 / 2
        out = f"case when {share} < {met + reach:.17e} then {x} else {out} end" if out else x
    return out


def demand(t: str, knots: tuple) -> str:
    """SQL for the share of a schedule's demand that is met at progress ``t``."""
    parts = []
    for t0, t1, w, slope, _ in _pieces(knots):
        x = f"least(greatest({t} - {t0:.17e}, 0e0), {t1 - t0:.17e})"
        parts.append(f"({x} * {w:.17e} + {x} * {x} * {slope / 2:.17e})")
    return " + ".join(parts)


def due(share: str, schedules: tuple) -> str:
    """SQL for the progress at which a source of ``which`` schedule has met a share of its target."""
    cases = " ".join(f"when {k} then {inverse_demand(share, s)}" for k, s in enumerate(schedules))
    return f"case which {cases} end"


def met_by_all(t: str, schedules: tuple) -> str:
    """SQL for the share of all sources' demand that is met at progress ``t``; part0, ... are the schedules' shares."""
    return " + ".join(f"part{k} * ({demand(t, s)})" for k, s in enumerate(schedules))


def targets(sources: DataFrame, weights: tuple, max_epochs: int) -> DataFrame:
    """``sources(source_key, source_size)`` with rank and target: shares by weight that stop at
    max_epochs times the size, the excess reshared by weight.

    One row a source: the windows over all rows order source names, not documents.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level of the first source, by cap over weight, that doesn't reach its cap
    levels = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("met", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("met") * F.col("weight"), F.col("cap")))
    return levels.select("source_key", "rank", F.greatest(target, F.lit(0.0)).alias("target"))


def _with_goals(sized: DataFrame, weights: tuple, schedules: tuple, max_epochs: int) -> DataFrame:
    """A row a source: source_key, source_size, target, which (schedule), part0, ... (shares of all demand by schedule),
    whole (epochs), part (words of a further one), limit (of the part, for all but fillers) and filler (least draw of those)."""
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("docs"))
    goals = sums.join(targets(sums, weights, max_epochs), "source_key").withColumn("which", F.col("rank") % len(schedules))
    everything = Window.partitionBy()  # one row a source
    for k in range(len(schedules)):
        goals = goals.withColumn(f"part{k}", F.sum(F.when(F.col("which") == k, F.col("target")).otherwise(0.0)).over(everything) / F.sum("target").over(everything))
    goals = goals.withColumn("whole", F.coalesce(F.least(F.floor(F.expr("target / nullif(source_size, 0)")), F.lit(max_epochs)), F.lit(0)).cast("int"))
    goals = goals.withColumn("part", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    share = F.lit(1.0) - F.least(F.lit(1.0), F.lit(float(FILLERS)) / F.greatest("docs", F.lit(1)).cast("double"))
    return goals.withColumn("limit", F.col("part") * share).withColumn("filler", F.floor(share * F.lit(float(1 << DRAW_BITS))).cast("long")).drop("rank", "docs")


def _filled(placed: DataFrame) -> DataFrame:
    """source_key, cell and at of the fillers that are taken, FILLERS a source on average."""
    taken = placed.filter((F.col("draw") < F.col("filler")) & F.col("fits")).groupBy("source_key").agg(F.sum("size").alias("words"))
    fillers = placed.filter((F.col("size") > 0) & (F.col("draw") >= F.col("filler")) & (F.col("part") > 0))
    lists = fillers.groupBy("source_key").agg(F.first("part").alias("part"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "draw", "cell", "at"))).alias("docs"))
    lists = lists.join(taken, "source_key", "left").withColumn("left", F.col("part") - F.coalesce("words", F.lit(0)).cast("double"))
    # from large to small, what fits; then the smallest one that did not, if it leaves less than before
    state = F.struct(F.col("left"), F.array().cast("array<struct<less:bigint,draw:bigint,cell:int,at:int>>").alias("in"), F.lit(None).cast("struct<less:bigint,draw:bigint,cell:int,at:int>").alias("out"))

    def step(acc, x):
        fits = -x["less"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] + x["less"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["in"], F.array(x))).otherwise(acc["in"]).alias("in"), F.when(fits, acc["out"]).otherwise(x).alias("out"))

    done = F.aggregate("docs", state, step, lambda acc: F.when(-acc["out"]["less"] <= 2 * acc["left"], F.concat(acc["in"], F.array(acc["out"]))).otherwise(acc["in"]))
    return lists.select("source_key", F.explode(done).alias("x")).select("source_key", "x.cell", "x.at", F.lit(True).alias("filled"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """One row a document, range-sorted by first training position: doc_id, source, size,
    source_size, target, taken (words, repeats counted), epochs, positions (one a copy that is
    taken, 0 to 1) and position (the first; null if none is taken), and the columns of ``carry``.

    The order of a source's supply is by a hash of doc_id and text.  A source of any size is cut into hash cells,
    whose sums are put in order first; only a cell is sorted by one task.
    """
    source_key = F.when(F.col("source").isNull(), F.struct(F.lit(1).alias("none"), F.lit("").alias("name"))).otherwise(F.struct(F.lit(0).alias("none"), F.col("source").cast("string").alias("name")))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    draw = F.conv(F.left(digest, F.lit(DRAW_BITS // 4)), 16, 10).cast("long")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    sized = stash(docs.select("doc_id", "source", source_key.alias("source_key"), size.alias("size"), draw.alias("draw"), *carried), "sized")
    rows = sized.count()
    cells = CELLS
    while cells * CELL_ROWS < rows:
        cells *= 2
    # the upper bits name the cell
    sized = sized.withColumn("cell", F.shiftright("draw", DRAW_BITS - (cells.bit_length() - 1)).cast("int"))

    sums = sized.groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("offset", F.sum("words").over(Window.partitionBy("source_key").orderBy("cell")) - F.col("words")).drop("words")
    sums = sums.join(_with_goals(sized, weights, schedules, max_epochs), "source_key")

    in_cell = Window.partitionBy("source_key", "cell").orderBy("draw", "size")
    placed = sized.join(sums, ["source_key", "cell"]).withColumn("at", F.row_number().over(in_cell))
    placed = placed.withColumn("begin", F.col("offset") + F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    fits = (F.col("size") > 0) & (F.col("begin").cast("double") + F.col("size") / F.lit(2.0) <= F.col("limit"))
    placed = placed.withColumn("fits", fits)
    filled = _filled(placed.drop("carried"))
    placed = placed.join(filled, ["source_key", "cell", "at"], "left")
    further = F.when(F.col("draw") < F.col("filler"), F.col("fits")).otherwise(F.coalesce("filled", F.lit(False)))
    # words of the source's supply before each copy that is taken
    starts = F.expr("transform(sequence(0, greatest(whole, 1) - 1), e -> cast(e * source_size + begin as double))")
    # fillers spread over what the others leave of the part
    last = F.expr(f"cast(whole * source_size as double) + case when draw < filler then cast(begin as double) else limit + (part - limit) * cast(draw - filler as double) / cast({1 << DRAW_BITS} - filler as double) end")
    taken = F.when(F.col("size") == 0, F.array().cast("array<double>")).otherwise(F.concat(F.when(F.col("whole") > 0, starts).otherwise(F.array().cast("array<double>")), F.when(further, F.array(last)).otherwise(F.array().cast("array<double>"))))
    times = F.expr(f"transform(copies, c -> {due('least(c / target, 1e0)', schedules)})")
    out = placed.withColumn("copies", taken).withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.size("copies") * F.col("size")).cast("long").alias("taken"), F.size("copies").alias("epochs"),
        F.expr(f"transform(times, t -> least({met_by_all('t', schedules)}, 1e0))").alias("positions"), "draw",
        *[F.col(f"carried.{c}").alias(c) for c in carry],
    )
    out = out.withColumn("position", F.try_element_at("positions", F.lit(1)))
    # what is not taken comes after, spread by its draw so that no range holds all of it
    due_at = F.coalesce(F.col("position"), F.lit(2.0) + F.col("draw").cast("double") / F.lit(float(1 << DRAW_BITS)))
    return out.withColumn("due_at", due_at).repartitionByRange("due_at").sortWithinPartitions("due_at", "doc_id").drop("due_at", "draw")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row a copy that is taken, range-sorted by its training position: doc_id, epoch, position."""
    return mixed.select("doc_id", F.posexplode("positions").alias("epoch", "position")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    first, last = F.col("position"), F.try_element_at("positions", F.lit(-1))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "epochs", F.round(first, 6).alias("position"), F.round(last, 6).alias("last_position"))


def _oracle() -> str:
    """The query in SQL: targets by the levels of ``targets``, fillers by a recursion from large to small."""
    weights = "[" + ", ".join(f"{w}e0" for w in WEIGHTS) + "]"
    parts = ", ".join(f"sum(CASE WHEN rank % {len(SCHEDULES)} = {k} THEN target ELSE 0e0 END) OVER () / sum(target) OVER () AS part{k}" for k in range(len(SCHEDULES)))
    place = lambda c: f"round(least({met_by_all(due(f'least({c} / target, 1e0)', SCHEDULES), SCHEDULES)}, 1e0), 6)"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
     CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {DRAW_BITS // 4}) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, {weights}[rank % {len(WEIGHTS)} + 1] AS weight, source_size * {float(MAX_EPOCHS)}e0 AS cap FROM s),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT first(level ORDER BY cap / weight, rank) AS met FROM l WHERE level * weight <= cap),
t AS (SELECT l.*, greatest(least(cap, coalesce((SELECT met FROM m) * weight, cap)), 0e0) AS target FROM l),
g AS (SELECT *, rank % {len(SCHEDULES)} AS which, {parts}, coalesce(least(floor(target / nullif(source_size, 0)), {MAX_EPOCHS}), 0) AS whole, 1e0 - least(1e0, {float(FILLERS)}e0 / greatest(docs, 1)) AS share FROM t),
h AS (SELECT *, target - whole * source_size AS part, (target - whole * source_size) * share AS lim, CAST(floor(share * {float(1 << DRAW_BITS)!r}) AS BIGINT) AS filler FROM g),
p AS (SELECT d.rid, d.doc_id, d.size, d.draw, h.*, sum(d.size) OVER (PARTITION BY h.rank ORDER BY d.draw, d.size, d.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS begin
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, size > 0 AND draw < filler AND CAST(begin AS DOUBLE) + size / 2e0 <= lim AS fits FROM p),
f AS (SELECT rank, rid, size, row_number() OVER (PARTITION BY rank ORDER BY size DESC, draw, rid) AS i FROM q WHERE size > 0 AND draw >= filler AND part > 0),
r AS (SELECT rank, any_value(part) - coalesce(sum(size) FILTER (fits), 0) AS rest FROM q GROUP BY rank),
k AS (SELECT rank, CAST(0 AS BIGINT) AS i, rest, FALSE AS took FROM r
      UNION ALL SELECT k.rank, f.i, CASE WHEN f.size <= k.rest THEN k.rest - f.size ELSE k.rest END, f.size <= k.rest FROM k JOIN f ON f.rank = k.rank AND f.i = k.i + 1),
e AS (SELECT rank, arg_max(rest, i) AS rest, max(i) FILTER (NOT took AND i > 0) AS out FROM k GROUP BY rank),
c AS (SELECT f.rid FROM f JOIN k ON f.rank = k.rank AND f.i = k.i JOIN e ON e.rank = f.rank WHERE k.took OR (f.i = e.out AND f.size <= 2 * e.rest)),
o AS (SELECT q.*, CASE WHEN size = 0 THEN 0 ELSE whole END AS full_, size > 0 AND (fits OR rid IN (SELECT rid FROM c)) AS further FROM q),
z AS (SELECT *, whole * source_size + CASE WHEN draw < filler THEN CAST(begin AS DOUBLE) ELSE lim + (part - lim) * CAST(draw - filler AS DOUBLE) / CAST({1 << DRAW_BITS} - filler AS DOUBLE) END AS extra FROM o),
y AS (SELECT *, CASE WHEN full_ > 0 THEN CAST(begin AS DOUBLE) WHEN further THEN extra END AS c1, CASE WHEN further THEN extra WHEN full_ > 0 THEN CAST((whole - 1) * source_size + begin AS DOUBLE) END AS c2 FROM z)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST((full_ + further::INT) * size AS BIGINT) AS taken, CAST(full_ + further::INT AS INTEGER) AS epochs,
       CASE WHEN c1 IS NOT NULL THEN {place('c1')} END AS position, CASE WHEN c2 IS NOT NULL THEN {place('c2')} END AS last_position FROM y
"""


OP1_SQL = _oracle()
