"""Storage and graph helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id: nulls come after every other id.
NULL_ID = (1 << 63) - 1

#: Whitespace of the word rule: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent, in a local session, a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost
    executor costs only the tasks it was running.  options: of the Parquet writer.

    The shuffle files of the finished job are garbage then; Spark deletes them when the
    driver has collected its own, which is asked for here.  The first collection leaves what
    the write was the last to hold, so files would stay until the next job has written its own.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    df.sparkSession._jvm.System.gc()
    out._stashed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stash`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stashed_at", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def id_key(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, root)``, root the smallest node
    reachable.  Nodes are of any type that has an order; if what a group needs to know is the first field of
    a struct, its root has it, and no join on the root, a hot key, has to follow.

    Alternates large-star and small-star contraction (Kiveris et al. 2014) with
    minimum aggregates, so that no node's neighbours are ever gathered in one row; each
    round is written to the shared folder.  Nodes without edges do not appear; an empty
    table gives an empty table; loops and repeated edges change nothing.
    """
    pair = edges.select("a", "b").filter("a <> b")
    now = stash(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        nxt = stash(small, "edges")
        discard(now)
        now, before = nxt, mark
        mark = _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._stashed_at = now._stashed_at
    return out


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
