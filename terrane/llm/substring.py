"""Operator 2: substring dedup over a log-structured index of window hashes.

A window is WINDOW consecutive words.  Its anchor is the run of ANCHOR words in it with
the smallest hash, the first of equals; equal windows have equal anchors at equal places.
Consecutive windows with the same anchor form a segment, which is known by a hash of the
words its windows cover.  Two documents that share a segment share all its windows.

The index holds each distinct segment once, with the first document that has it, in
immutable runs: tables bucketed and sorted by segment hash.  A batch of documents (in
order of doc_id) is merge-joined with each run; what is new becomes another run, and
runs are compacted into one when they get too many.  Then segments that share an anchor
but differ are verified window by window on the texts they came from, which finds the
windows that lie on a shared passage's border, at all places of a segment in rows of its first doc_id.

Windows are compared by 96 bits of two independent hashes.

An index can be closed and opened again, in another session too, to take further batches.  Runs hold segments, not texts: the
windows on borders of what a new batch shares with older documents are verified on those documents' texts, so ``dedup``
wants them as ``history`` and reads of them what holds a shared anchor.

Nulls: a null text has no words.  A null doc_id counts as larger than all others; rows
with the same doc_id aren't smaller than each other.  Repeated rows each get a row.  An
empty table gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import NULL_ID, discard, id_key, new_path, remove, stash, table
from terrane.llm.textkit import Powers, Words, chunks, mix, prefix, signed, span

WINDOW = 50
ANCHOR = 8
#: Runs beyond which the index is compacted.
FAN_IN = 2
BATCHES = 3
#: Segments that may be broadcast: those with more than 1 / HEAVY of a batch's rows.
HEAVY = 2000
_U = np.uint64
FIRST, SECOND = Powers(0xD6E8FEB86659FD93), Powers(0xA3B195354A39B70D)
_SALT = _U(0x5851F42D4C957F2D)


def _hash_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return prefix(words.hash, FIRST), prefix(mix(words.hash ^ _SALT), SECOND)


def _stretch(pre: tuple[np.ndarray, np.ndarray], a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits over the words [a, e)."""
    n = (e - a).astype(_U)
    return signed(mix(span(pre[0], a, e, FIRST) + n)), signed(mix(span(pre[1], a, e, SECOND) + n)).astype(np.int32)


def _sliding_first_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Of each stretch of ``width`` keys, the place of its first minimum (by the upper 32 bits)."""
    packed = (keys >> _U(32) << _U(32)) | np.arange(len(keys), dtype=_U)
    reach = 1
    while 2 * reach <= width:
        packed = np.minimum(packed[:-reach], packed[reach:])
        reach *= 2
    if reach < width:
        packed = np.minimum(packed[: len(packed) - (width - reach)], packed[width - reach :])
    return (packed & _U(0xFFFFFFFF)).astype(np.int64)


def segments(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Of each segment: text row, a and b (first and last start of its windows, words of the text),
    anchor hash fp, and the hashes seg and chk of the words covered."""
    n = len(words)
    if n < window:
        return {k: np.zeros(0, t) for k, t in (("row", np.int64), ("a", np.int32), ("b", np.int32), ("fp", np.int64), ("seg", np.int64), ("chk", np.int32))}
    pre = _hash_words(words)
    at = np.arange(n - anchor + 1)
    keys = mix(span(pre[0], at, at + anchor, FIRST))
    place = _sliding_first_minimum(keys, window - anchor + 1)
    owner = words.owner()
    start = np.arange(n - window + 1)
    start = start[owner[start] == owner[start + window - 1]]
    place = place[start]
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))) if len(start) else np.zeros(0, np.int64)
    a, b = start[cut], start[np.concatenate((cut[1:], [len(start)])) - 1] if len(cut) else start[cut]
    row = owner[a]
    seg, chk = _stretch(pre, a, b + window)
    return {"row": row, "a": (a - words.first[row]).astype(np.int32), "b": (b - words.first[row]).astype(np.int32), "fp": signed(keys[place[cut]]), "seg": seg, "chk": chk}


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "th"))
        for i, j, data, bounds in chunks(batch.column("text")):
            found = segments(Words(data, bounds))
            row = found.pop("row") + i
            yield pa.RecordBatch.from_pydict({"k": k[row], "th": th[row], **found}, schema=_SEGMENT)


_SEGMENT = pa.schema([("k", pa.int64()), ("th", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("fp", pa.int64()), ("seg", pa.int64()), ("chk", pa.int32())])
SEGMENT = "k long, th int, a int, b int, fp long, seg long, chk int"
RUN = "seg BIGINT, chk INT, k BIGINT, th INT, a INT, b INT, fp BIGINT"
_WINDOW = pa.schema([("k", pa.int64()), ("th", pa.int32()), ("a", pa.int32()), ("s", pa.int32()), ("w", pa.int64()), ("c", pa.int32())])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that start in the given ranges, by hash, each with the range's a."""
    for batch in batches:
        k, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "th"))
        ranges = batch.column("ranges")
        flat, offsets = ranges.flatten(), np.concatenate(([0], np.cumsum(ranges.value_lengths().to_numpy(zero_copy_only=False))))
        low, high = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "b"))
        for i, j, data, bounds in chunks(batch.column("text")):
            words = Words(data, bounds)
            part = slice(int(offsets[i]), int(offsets[j]))
            row = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
            n = high[part] - low[part] + 1
            row, base = np.repeat(row, n), np.repeat(low[part], n)
            s = base + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = words.first[row - i] + s
            w, c = _stretch(_hash_words(words), a, a + WINDOW)
            yield pa.RecordBatch.from_pydict({"k": k[row], "th": th[row], "a": base.astype(np.int32), "s": s.astype(np.int32), "w": w, "c": c}, schema=_WINDOW)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(id_key().alias("k"), F.hash(text).alias("th"), text.alias("text"))


class SegmentIndex:
    """Immutable sorted runs of the segments seen so far: seg, chk and its first place (k, th, a, b, fp)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.runs, self.found = spark, [], []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def open(cls, spark: SparkSession, closed: dict) -> SegmentIndex:
        """The index that ``close`` described."""
        out = cls(spark, closed["buckets"])
        for path in closed["runs"]:
            name = f"terrane_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (seg, chk) SORTED BY (seg, chk) INTO {out.buckets} BUCKETS LOCATION '{path}'")
            out.runs.append((name, path))
        return out

    def close(self) -> dict:
        """Forgets the runs' tables and says where their files are."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        out = {"buckets": self.buckets, "runs": [path for _, path in self.runs]}
        self.runs, self.found = [], []
        return out

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"terrane_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        (rows.repartition(self.buckets, "seg", "chk").sortWithinPartitions("seg", "chk")
         .write.bucketBy(self.buckets, "seg", "chk").sortBy("seg", "chk").option("path", path).saveAsTable(name))
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (k, th, text), whose keys aren't smaller than those before, and returns its
        segments that a smaller key has: k, th, a, b."""
        rows = stash(batch.mapInArrow(_segment_rows, SEGMENT), "segments")
        first = rows.groupBy("seg", "chk").agg(F.min(F.struct("k", "th", "a", "b", "fp")).alias("at"), F.count("*").alias("n"))
        first = stash(first, "firsts")
        # segments with more than their share of all rows, of which there are HEAVY at most
        share = (first.agg(F.sum("n")).first()[0] or 0) // HEAVY
        heavy = F.broadcast(first.filter(F.col("n") > max(share, 1)).select("seg", "chk"))
        fresh = first
        for name, _ in self.runs:
            fresh = fresh.join(self.spark.table(name).select("seg", "chk"), ["seg", "chk"], "left_anti")
        self.runs.append(self._write(fresh.select("seg", "chk", "at.*")))
        repeats, where = None, rows.select("seg", "chk", "k", "th", "a", "b")
        for name, _ in self.runs:
            known = self.spark.table(name).select("seg", "chk", F.col("k").alias("first"), F.col("th").alias("first_th"), F.col("a").alias("first_a"))
            # a heavy segment's rows stay where they are; the others are merge-joined
            found = where.join(F.broadcast(known.join(heavy, ["seg", "chk"])), ["seg", "chk"]).unionByName(where.join(heavy, ["seg", "chk"], "left_anti").join(known, ["seg", "chk"]))
            # further places in rows of the first key aren't repeats, but have the windows that are found at the first place, which they name
            of = [F.when(F.col("k") == F.col("first"), F.col(c)).alias(c) for c in ("first_th", "first_a")]
            found = found.filter("k > first or th <> first_th or a <> first_a").select("k", "th", "a", "b", *of)
            repeats = found if repeats is None else repeats.unionByName(found)
        repeats = stash(repeats, "repeats")
        self.found.append(repeats)
        discard(rows)
        discard(first)
        if len(self.runs) > FAN_IN:
            self.compact()
        return repeats.filter("first_a is null").select("k", "th", "a", "b")

    def compact(self) -> None:
        """Merges the runs into one."""
        old, self.runs = self.runs, [self._write(self.segments())]
        for run in old:
            self._drop(run)

    def segments(self) -> DataFrame:
        out = self.spark.table(self.runs[0][0])
        for name, _ in self.runs[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def verify(self, docs: DataFrame) -> DataFrame:
        """Windows of first keys' segments that a smaller key has in another segment with the same anchor:
        k, th, a, b.  docs: the (k, th, text) that were added."""
        known = self.segments().select("k", "th", "a", "b", "fp")
        shared = known.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
        ranges = known.join(shared, "fp").groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
        windows = docs.join(ranges, ["k", "th"]).select("k", "th", "ranges", "text")
        windows = stash(windows.mapInArrow(_window_rows, "k long, th int, a int, s int, w long, c int"), "windows")
        least = windows.groupBy("w", "c").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("last > first").select("w", "c", "first")
        found = stash(windows.join(least, ["w", "c"]).filter("k > first").select("k", "th", "a", "s").distinct(), "verified")
        discard(windows)
        starts = found.select("k", "th", "s")
        for places in self.found:
            at = places.filter("first_a is not null").select("k", "first_th", "first_a", F.col("th").alias("th2"), F.col("a").alias("a2"))
            met = at.join(found.select("k", F.col("th").alias("first_th"), F.col("a").alias("first_a"), "s"), ["k", "first_th", "first_a"])
            starts = starts.unionByName(met.select("k", F.col("th2").alias("th"), (F.col("a2") + F.col("s") - F.col("first_a")).alias("s")))
        return starts.select("k", "th", F.col("s").alias("a"), F.col("s").alias("b"))

    def drop(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs, self.found = [], []


def covered(ranges: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1] + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


#: Bytes of kept words after which rows are passed on.
KEPT_BYTES = 8 << 20


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, ranges = batch.column("doc_id"), batch.column("text"), batch.column("ranges")
        first, size, rows = 0, 0, []
        for r in range(batch.num_rows):
            words = texts[r].as_buffer().to_pybytes().split() if texts[r].is_valid else []
            n, gone = len(words), 0
            if ranges[r].is_valid:
                v = ranges[r].values
                hit = covered(np.stack([v.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "b")], 1), n)
                gone = int(hit.sum())
                words = [words[i] for i in np.flatnonzero(~hit).tolist()]
            rows.append((n, gone, b" ".join(words)))
            size += len(rows[-1][2])
            if size >= KEPT_BYTES or r == batch.num_rows - 1:
                n_words, n_removed, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])
                first, size, rows = r + 1, 0, []


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs(k, ...) as n batches in order of k, of about the same number of rows."""
    cuts = sorted(set(docs.approxQuantile("k", [i / n for i in range(1, n)], 0.02))) if n > 1 else []
    low, out = None, []
    for cut in [*(int(c) for c in cuts), None]:
        part = docs if low is None else docs.filter(F.col("k") > low)
        out.append(part if cut is None else part.filter(F.col("k") <= cut))
        low = cut
    return out


def dedup(docs: DataFrame, batches: int = BATCHES, index: SegmentIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by a space), one row a document.

    index: one that holds older documents, whose ids are not larger than those of ``docs``; history: these documents.  The index
    then holds the new ones, too; without one, an index is made for this call.
    """
    held = index if index is not None else SegmentIndex(docs.sparkSession)
    keyed = _keyed(docs)
    gone = None
    for batch in batches_of(keyed, batches):
        repeats = held.add(batch)
        gone = repeats if gone is None else gone.unionByName(repeats)
    gone = gone.unionByName(held.verify(keyed if history is None else _keyed(history).unionByName(keyed)))
    if index is None:
        held.drop()
    gone = gone.groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("k"), F.hash(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))
    rows = rows.join(gone, ["k", "th"], "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
h AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS k, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS m FROM w),
f AS (SELECT m, min(k) AS first FROM h GROUP BY m),
p AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (m) WHERE k > first),
g AS (SELECT rid, list(p) AS ps FROM p GROUP BY rid),
x AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT x.rid, string_agg(ws[x.p], ' ' ORDER BY x.p) AS t FROM x LEFT JOIN p ON x.rid = p.rid AND x.p = p.p WHERE p.p IS NULL GROUP BY x.rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g.ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN kept USING (rid)
"""
