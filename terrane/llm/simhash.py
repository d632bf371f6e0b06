"""Operator 10: SimHash near-duplicates by a self-join of the fingerprints' binary trie.

Fingerprints of equal value are one leaf.  Five blocks of the 64 bits shard the trie:
two fingerprints with four differing bits or fewer agree in one block at least, so each
fingerprint is put under five roots, one a block value.  Below a root the trie is
walked in node pairs from the top bit down; a pair carries its number of differing bits
and is dropped once that exceeds the budget.  A root with more than MAX_ROOT leaves is cut into five
again by its other bits, where the same holds.  A root returns no pairs but each of its
leaves with the smallest leaf it is connected with, so a group of any size costs one row
a leaf; the rest of the connecting is done on these rows.

Nulls: a null text is an empty one.  Texts without words have fingerprint zero and link
like any other.  A null doc_id counts as the largest and is returned as null; a component
of null ids only has a null component_id.  Repeated rows each get a row (``keep_one`` keeps one of them).  An empty table
gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import NULL_ID, components, id_key, stash, table
from terrane.llm.textkit import LOWER, chunks, signed

WORDS_A_SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: First bit and number of bits of each block; one more than the budget.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Node pairs that are walked at a time; the rest waits on a stack.
PAIRS_AT_A_TIME = 1 << 18
#: Fingerprints that may be broadcast: those with more than 1 / HEAVY of all rows.
HEAVY = 2000
_U = np.uint64


def fingerprint(words: list[bytes], k: int = WORDS_A_SHINGLE) -> int:
    """Bit set if set in over half of the shingles' hashes."""
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = max(1, len(words) - k + 1)
    for at in range(0, n, 65536):
        hashes = np.fromiter((digest(join(words[i : i + k]), SEED) for i in range(at, min(n, at + 65536))), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        column = batch.column("text")
        for i, _, data, bounds in chunks(column):
            text = LOWER[data].tobytes()
            for r in range(len(bounds) - 1):
                out[i + r] = fingerprint(text[bounds[r] : bounds[r + 1]].split())
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(signed(out))], [*rest, "fp"])


def fingerprints(docs: DataFrame, *marks: str) -> DataFrame:
    """doc_id, the marks (longs) and fp, the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *marks, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in ("doc_id", *marks, "fp")))


# --- the trie ---------------------------------------------------------------


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


def _turned(fp: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The block's bits (counted from the top) moved to the top, the rest behind them."""
    left = first.astype(_U)
    return np.where(first == 0, fp, (fp << left) | (fp >> ((_U(64) - left) & _U(63))))


def walk(leaves: np.ndarray, skip: np.ndarray, roots: np.ndarray, budget: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of leaves within ``budget`` differing bits below a common root.

    leaves: sorted within each root; roots: bounds of the roots' leaves; skip: bits of a root's
    leaves that agree.  A node is a range of leaves with the same upper bits.
    """
    lo, hi = roots[:-1], roots[1:]
    big = hi - lo > 1
    #: (first node, its end, second node, its end, depth, differing bits); a node paired with itself stands for the pairs inside
    stack = [(lo[big], hi[big], lo[big], hi[big], skip[lo[big]].astype(np.int64), np.zeros(big.sum(), np.int64))]
    while stack:
        a, ae, b, be, depth, diff = stack.pop()
        if len(a) > PAIRS_AT_A_TIME:
            stack.extend(tuple(x[i : i + PAIRS_AT_A_TIME] for x in (a, ae, b, be, depth, diff)) for i in range(0, len(a), PAIRS_AT_A_TIME))
            continue
        small = ((ae - a) * (be - b) <= 8) | (depth >= 64)
        if small.any():
            yield from _leaf_pairs(leaves, a[small], ae[small], b[small], be[small], budget)
            keep = ~small
            a, ae, b, be, depth, diff = (x[keep] for x in (a, ae, b, be, depth, diff))
        if not len(a):
            continue
        am, bm = _middle(leaves, a, ae, depth), _middle(leaves, b, be, depth)
        same = (a == b) & (ae == be)
        depth = depth + 1
        children = [(a, am, b, bm, diff, None), (am, ae, bm, be, diff, None), (a, am, bm, be, diff + 1, None), (am, ae, b, bm, diff + 1, ~same)]
        parts = []
        for x, xe, y, ye, d, only in children:
            ok = (xe > x) & (ye > y) & (d <= budget)
            ok &= ~((x == y) & (xe == ye) & (xe - x < 2))
            if only is not None:
                ok &= only
            parts.append(tuple(v[ok] for v in (x, xe, y, ye, depth, d)))
        merged = tuple(np.concatenate([p[i] for p in parts]) for i in range(6))
        if len(merged[0]):
            stack.append(merged)


def _middle(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Of each node, its first leaf with a one at ``depth``: by bisection, all nodes at once."""
    lo, hi = lo.copy(), hi.copy()
    shift = (63 - depth).astype(_U)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (leaves[np.minimum(mid, len(leaves) - 1)] >> shift) & _U(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _leaf_pairs(leaves, a, ae, b, be, budget):
    """All pairs of two small nodes, some nodes at a time."""
    area = (ae - a) * (be - b)
    ends = np.cumsum(area)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (PAIRS_AT_A_TIME << 2), "right")))
        n = area[at:to]
        node = np.repeat(np.arange(at, to), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (be - b)[node]
        x, y = a[node] + inside // width, b[node] + inside % width
        ok = (x < y) | (a[node] != b[node])
        x, y = x[ok], y[ok]
        near = _bits(leaves[x] ^ leaves[y]) <= budget
        yield x[near], y[near]
        at = to


class _Union:
    """Smallest index connected, under links that arrive in blocks."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        up = self.up
        while True:
            x, y = up[x], up[y]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while True:
                nxt = up[up]
                if np.array_equal(nxt, up):
                    break
                up[:] = nxt


def _linked(keys: np.ndarray, fps: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and the smallest leaf each is connected with below its root; keys and leaves whole roots.

    first and width: place of the bits in which a root's leaves agree.
    """
    leaves = _turned(fps, first, width)
    order = np.lexsort((leaves, keys))
    keys, leaves, fps, width = keys[order], leaves[order], fps[order], width[order]
    roots = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    union = _Union(len(leaves))
    for x, y in walk(leaves, width, roots):
        union.add(x, y)
    to = union.up
    far = to != np.arange(len(to))
    return fps[far], fps[to[far]]


#: Leaves that are gathered before their roots are walked.
LEAVES_AT_A_TIME = 1 << 17
#: Leaves of a root beyond which it is cut by further bits.
MAX_ROOT = 1 << 17
COLUMNS = ("root", "fp", "first", "width")


def _walk_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by root; whole roots are walked together."""
    parts, held = [], 0

    def flush(upto: int | None):
        nonlocal parts, held
        rows = [np.concatenate(c) for c in zip(*parts)]
        cut = len(rows[0]) if upto is None else int(np.searchsorted(rows[0], upto))
        parts, held = [tuple(c[cut:] for c in rows)], len(rows[0]) - cut
        if cut:
            keys, fps, first, width = (c[:cut] for c in rows)
            a, b = _linked(keys, fps.view(np.uint64), first, width)
            return pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(a))), pa.array(signed(np.ascontiguousarray(b)))], ["a", "b"])
        return None

    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in COLUMNS))
        held += batch.num_rows
        if held >= LEAVES_AT_A_TIME and (out := flush(int(parts[-1][0][-1]))) is not None:
            yield out
    if parts and (out := flush(None)) is not None:
        yield out


def _bits_at(first: Column, width: Column) -> Column:
    """So many bits of fp from the first on, counted from the top and around."""
    turned = F.call_function("shiftleft", F.col("fp"), first).bitwiseOR(F.when(first > 0, F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64) - first)).otherwise(F.lit(0).cast("long")))
    return F.call_function("shiftrightunsigned", turned, F.lit(64) - width)


def _under_roots(leaves: DataFrame, specs: Column, parent: Column) -> DataFrame:
    """Each leaf once for each of its roots: fp, root, first, width.  specs: array of struct(i, first, width)."""
    rows = leaves.select("fp", parent.alias("parent"), F.explode(specs).alias("b"))
    return rows.select("fp", ((F.col("parent") * 5 + F.col("b.i")) * F.lit(8192) + _bits_at(F.col("b.first"), F.col("b.width"))).alias("root"), F.col("b.first").alias("first"), F.col("b.width").alias("width"))


def _further(first: Column, width: Column) -> Column:
    """The five blocks of the bits behind a root's, by place around the fingerprint."""
    part = F.floor((F.lit(64) - width) / 5).cast("int")
    one = lambda i: F.struct(F.lit(i).alias("i"), ((first + width + part * i) % 64).cast("int").alias("first"), (part if i < 4 else F.lit(64) - width - part * 4).cast("int").alias("width"))
    return F.array(*[one(i) for i in range(5)])


def links(leaves: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that connect just what links of MAX_BITS or fewer
    differing bits connect.  leaves: distinct fp."""
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(first).alias("first"), F.lit(width).alias("width")) for i, (first, width) in enumerate(BLOCKS)])
    rows = _under_roots(leaves, blocks, F.lit(0).cast("long"))
    large = F.broadcast(rows.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_ROOT).select("root"))  # of 40,960 at most
    if large.limit(1).count():
        held = rows.join(large, "root")
        cut = _under_roots(held.select("fp", "root", _further(F.col("first"), F.col("width")).alias("specs")), F.col("specs"), F.col("root") + 1)
        rows = rows.join(large, "root", "left_anti").unionByName(cut)
    return rows.repartition("root").sortWithinPartitions("root").select(*COLUMNS).mapInArrow(_walk_partition, "a long, b long").distinct()


def _grouped(prints: DataFrame) -> DataFrame:
    """fp, kept, the smallest (k, th) whose fingerprint is reachable, and n (rows), of ``prints(k, th, fp)``.

    A node of the graph is a fingerprint with its smallest row, so that a group's root has what the group is
    named by.
    """
    leaves = stash(prints.groupBy("fp").agg(F.min(F.struct("k", "th")).alias("least"), F.count("*").alias("n")), "leaves")
    node = leaves.select("fp", F.struct("least", "fp").alias("node"))
    edges = links(leaves.select("fp"))
    edges = edges.join(node.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(node.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))).select("node.fp", F.col("root.least").alias("kept"))
    return leaves.join(groups, "fp", "left").select("fp", F.coalesce("kept", "least").alias("kept"), "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id: the smallest doc_id whose fingerprint is reachable."""
    prints = stash(fingerprints(docs), "prints")
    named = _grouped(prints.select(id_key().alias("k"), F.lit(0).cast("long").alias("th"), "fp"))
    named = stash(named.select("fp", F.when(F.col("kept.k") != NULL_ID, F.col("kept.k")).alias("component_id"), "n"), "named")
    # rows of a fingerprint with more than its share, of which there are HEAVY at most, stay where they are
    share = max(1, (named.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy, light = F.broadcast(named.filter(F.col("n") > share)), named.filter(F.col("n") <= share)
    rest = prints.join(heavy.select("fp"), "fp", "left_anti").join(light, "fp")
    return prints.join(heavy, "fp").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each group by doc_id (and text hash, where texts share an id), all columns.

    A row is told from others by its doc_id and text: rows that share a doc_id but hold different texts are
    different documents, rows with the same of both are one.
    """
    prints = fingerprints(docs.select("text", id_key().alias("doc_id"), F.xxhash64("text").alias("th")), "th")
    prints = stash(prints.withColumnRenamed("doc_id", "k"), "prints")
    kept = _grouped(prints).select("kept.k", "kept.th").distinct()
    k, th = [f"row{n}" for n in range(len(docs.columns) + 2) if f"row{n}" not in docs.columns][:2]
    rows = docs.withColumns({k: id_key(), th: F.xxhash64("text")}).dropDuplicates([k, th])
    return rows.join(kept.toDF(k, th), [k, th], "left_semi").select(*docs.columns)
