"""Operator 9: quotation linking of conversations.  DataFrame functions only.

A line's quote level is its number of leading '>' marks (blanks between them allowed); level 0
is the message's own.  A quoted passage is a run of lines of one level above 0; its words are those of its normalised
lines (lower case, runs of anything but letters and digits to one space), so it doesn't matter how it is
wrapped.  Runs of SHINGLE words of passages, and of all own words of a message, are hashed; a passage of fewer words, and an
own line of fewer, are hashed whole.  A hash belongs to the first message of its conversation that has it in own
words, and counts for later messages only.  A passage with LINKED of its hashes found links to the message that most of them
belong to, the first of equals.  A message replies to the message that most of its level-1 hashes link to, the
latest of equals.  Quoted lines, and a line of attribution right above them, are removed.

Replies are followed up to the message that replies to none: that is the root.  The result is
sorted by conversation, root, turn, so each root is followed by the replies below it; rows are
range-sorted, so a conversation of any size is spread over tasks.

Nulls: a null conv_id is a conversation of its own, after all others; a null turn comes after all
others in its conversation; a null text has no lines and stays null; a null role stays.  Rows
with the same conv_id and turn are alternatives of one message: each gets a row, and any of them can
be an original.  Empty texts stay.  An empty table gives an empty table.  Further columns are
kept, but for those named like a new column, which give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.shared import NULL_ID, discard, stash, table

#: Words that are hashed together, and share of a passage's hashes that must be found.
SHINGLE = 5
LINKED = 0.8
MARKS = r"^((?:[ \t]*>)+)"
#: Columns of the result.
NEW = ("n_quoted", "n_linked", "reply_to", "root_turn", "depth", "clean_text")
#: Lines that introduce a quotation.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió|.{1,80}\bwrote|.{1,80}\bsaid)\s*:\s*$"


def level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(line):
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[^\p{L}\p{Nd}]+", " "))


def parse(text: str = "text"):
    """The lines of a text as an array of struct(level, norm)."""
    return F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(level(x).alias("level"), normalised(x).alias("norm")))


def shingles(words):
    """Distinct hashes of the runs of SHINGLE words, or of all if they are fewer."""
    runs = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    return F.array_distinct(F.transform(runs, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def passages(lines: DataFrame) -> DataFrame:
    """c, t, h, level, piece and words of the quoted passages, and at level 0 of each message's own words.
    lines: c, t, h, pos, level, norm, each once."""
    run = F.col("pos") - F.row_number().over(Window.partitionBy("c", "t", "h", "level").orderBy("pos"))  # within a message
    pieces = lines.withColumn("piece", F.when(F.col("level") > 0, run).otherwise(0)).groupBy("c", "t", "h", "level", "piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ")
    words = pieces.agg(F.filter(F.split(text, " "), lambda w: w != "").alias("words"))
    return words.filter(F.size("words") > 0)


def sources(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """c, hash and source (the first message that has it in own words), for conversations that quote anything: what is said in
    others can't be quoted.  lines, pieces: those of ``passages``."""
    quoting = pieces.filter("level > 0").select("c").distinct()
    short = lines.filter("level = 0 and norm <> ''").filter(F.size(F.split("norm", " ")) < SHINGLE).join(quoting, "c", "left_semi").select("c", "t", F.xxhash64("norm").alias("hash"))
    said = pieces.filter("level = 0").join(quoting, "c", "left_semi").select("c", "t", F.explode(shingles(F.col("words"))).alias("hash"))
    return said.unionByName(short).groupBy("c", "hash").agg(F.min("t").alias("source"))


def without_quotes(text):
    """The own lines of a text, without the attributions right above quoted ones."""
    lines = F.split(text, "\n")

    def own(x, i):
        return (level(x) == 0) & ~((F.coalesce(level(F.get(lines, i + 1)), F.lit(0)) > 0) & x.rlike(ATTRIBUTION))

    return F.array_join(F.filter(lines, own), "\n")


def link(messages: DataFrame, rounds: int = 64) -> DataFrame:
    """``messages`` with n_quoted (quoted passages that have letters or digits), n_linked (those with an original),
    reply_to (turn, null if none), root_turn, depth and clean_text, in reply order."""
    free = [f"chat{n}" for n in range(len(messages.columns) + 3) if f"chat{n}" not in messages.columns][:3]
    c, t, h = free
    keyed = messages.withColumns({c: F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)), t: F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID)), h: F.xxhash64("text")})
    lines = keyed.select(F.col(c).alias("c"), F.col(t).alias("t"), F.col(h).alias("h"), F.posexplode(parse()).alias("pos", "line"))
    # a repeated row's lines count once
    lines = stash(lines.select("c", "t", "h", "pos", "line.level", "line.norm").distinct(), "chatlines")
    pieces = stash(passages(lines), "passages")
    own = sources(lines, pieces)
    quoted = pieces.filter("level > 0").select("c", "t", "h", "level", "piece", F.explode(shingles(F.col("words"))).alias("hash"))
    met = quoted.join(own, ["c", "hash"], "left").withColumn("source", F.when(F.col("source") < F.col("t"), F.col("source")))
    votes = met.groupBy("c", "t", "h", "level", "piece", "source").agg(F.count("*").alias("n"))
    found = F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("n"))), F.lit(0))
    most = F.max(F.when(F.col("source").isNotNull(), F.struct("n", (-F.col("source")).alias("first"))))
    linked = votes.groupBy("c", "t", "h", "level", "piece").agg(F.sum("n").alias("n"), F.when(found >= F.ceil(F.sum("n") * LINKED - 1e-9), -most["first"]).alias("source"))
    by_source = linked.groupBy("c", "t", "h", "source").agg(F.count("*").alias("passages"), F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("direct"))
    best = F.max(F.when(F.col("source").isNotNull() & (F.col("direct") > 0), F.struct("direct", "source")))
    seen = by_source.groupBy("c", "t", "h").agg(F.sum("passages").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("passages")).otherwise(0)).alias("n_linked"), best["source"].alias("reply_to"))
    seen = stash(seen, "quotes")
    discard(lines)
    discard(pieces)
    # of alternatives of a message, the smallest reply_to stands for what others reply to
    up = seen.filter("reply_to is not null").groupBy("c", "t").agg(F.min("reply_to").alias("up"))
    roots = stash(up.select("c", "t", F.col("up").alias("root"), F.lit(1).alias("steps")), "roots")
    for _ in range(rounds):  # each round doubles the steps that are followed
        further = roots.select("c", F.col("t").alias("root"), F.col("root").alias("over"), F.col("steps").alias("more"))
        nxt = stash(roots.join(further, ["c", "root"], "left").select("c", "t", F.coalesce("over", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("over").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots, moved = nxt.drop("moved"), nxt.filter("moved").limit(1).count()
        roots._stashed_at = nxt._stashed_at
        if not moved:
            break
    found = seen.join(roots.select("c", F.col("t").alias("reply_to"), "root", "steps"), ["c", "reply_to"], "left")
    found = found.select("c", "t", "h", "n_quoted", "n_linked", "reply_to", F.coalesce("root", "reply_to").alias("root"), F.when(F.col("reply_to").isNotNull(), F.coalesce("steps", F.lit(0)) + 1).alias("depth"))
    keep = [x for x in messages.columns if x not in NEW]
    out = keyed.select(*keep, c, t, h).join(found.toDF(c, t, h, *(f"new_{x}" for x in ("n_quoted", "n_linked", "reply_to", "root", "depth"))), [c, t, h], "left")
    turn = lambda x: F.when(x != NULL_ID, x)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    root = F.coalesce("new_root", t)
    return out.repartitionByRange(c, root, t, h).sortWithinPartitions(c, root, t, h).select(
        *keep, zero("new_n_quoted").alias("n_quoted"), zero("new_n_linked").alias("n_linked"), turn(F.col("new_reply_to")).alias("reply_to"),
        turn(root).alias("root_turn"), zero("new_depth").alias("depth"), without_quotes(F.col("text")).alias("clean_text"),
    )


def op9_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "n_quoted", "n_linked", "reply_to", "root_turn", "depth", "clean_text")


OP9_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, *, coalesce(CAST(conv_id AS BIGINT), 9223372036854775807) AS c, coalesce(CAST(turn AS BIGINT), 9223372036854775807) AS t, string_split(text, chr(10)) AS ls FROM conversations),
l AS (SELECT rid, c, t, i, ls[i] AS line, ls[i + 1] AS below FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
p AS (SELECT rid, c, t, i, line, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
             len(regexp_replace(regexp_extract(coalesce(below, ''), '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS below_level,
             trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS norm FROM l),
pieces AS (SELECT rid, c, t, level, CASE WHEN level > 0 THEN run ELSE 0 END AS piece, list_filter(string_split(string_agg(norm, ' ' ORDER BY i), ' '), lambda w: w <> '') AS ws
           FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS run FROM p) GROUP BY ALL),
sh AS (SELECT rid, c, t, level, piece, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda x: array_to_string(list_slice(ws, x, x + 4), ' ')))) AS run FROM pieces WHERE len(ws) > 0),
own AS (SELECT c, run, min(t) AS source FROM (SELECT c, t, run FROM sh WHERE level = 0 UNION ALL SELECT c, t, norm FROM p WHERE level = 0 AND norm <> '' AND len(string_split(norm, ' ')) < 5) GROUP BY c, run),
met AS (SELECT sh.rid, sh.c, sh.t, sh.level, sh.piece, CASE WHEN own.source < sh.t THEN own.source END AS source FROM sh LEFT JOIN own ON own.c = sh.c AND own.run = sh.run WHERE sh.level > 0),
votes AS (SELECT rid, c, t, level, piece, source, count(*) AS n FROM met GROUP BY ALL),
linked AS (SELECT rid, c, t, level, piece, sum(n) AS n, CASE WHEN coalesce(sum(n) FILTER (source IS NOT NULL), 0) * 10 >= sum(n) * 8 THEN first(source ORDER BY n DESC, source) FILTER (source IS NOT NULL) END AS source FROM votes GROUP BY rid, c, t, level, piece),
sources AS (SELECT rid, c, t, source, count(*) AS passages, coalesce(sum(n) FILTER (level = 1), 0) AS direct FROM linked GROUP BY ALL),
seen AS (SELECT rid, c, t, sum(passages) AS n_quoted, coalesce(sum(passages) FILTER (source IS NOT NULL), 0) AS n_linked,
                first(source ORDER BY direct DESC, source DESC) FILTER (source IS NOT NULL AND direct > 0) AS reply_to FROM sources GROUP BY rid, c, t),
up AS (SELECT c, t, min(reply_to) AS up FROM seen WHERE reply_to IS NOT NULL GROUP BY c, t),
chain AS (SELECT c, t, up AS root, 1 AS steps FROM up UNION ALL SELECT chain.c, chain.t, up.up, steps + 1 FROM chain JOIN up ON up.c = chain.c AND up.t = chain.root),
roots AS (SELECT c, t, arg_max(root, steps) AS root, max(steps) AS steps FROM chain GROUP BY c, t),
clean AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS s FROM p
          WHERE level = 0 AND NOT (below_level > 0 AND regexp_matches(line, '(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió|.{1,80}\bwrote|.{1,80}\bsaid)\s*:\s*$')) GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       CASE WHEN reply_to <> 9223372036854775807 THEN reply_to END AS reply_to,
       CASE WHEN coalesce(roots.root, reply_to, m.t) <> 9223372036854775807 THEN coalesce(roots.root, reply_to, m.t) END AS root_turn,
       CAST(CASE WHEN reply_to IS NULL THEN 0 ELSE coalesce(roots.steps, 0) + 1 END AS BIGINT) AS depth,
       CASE WHEN m.text IS NOT NULL THEN coalesce(clean.s, '') END AS clean_text
FROM m LEFT JOIN seen USING (rid) LEFT JOIN roots ON roots.c = m.c AND roots.t = seen.reply_to LEFT JOIN clean USING (rid)
"""
