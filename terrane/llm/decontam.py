"""Operator 3: benchmark decontamination by an FM-index per training shard.

A shard is what a task holds of the documents at a time.  Words that are in no benchmark
item can't be part of an occurrence; they cut a text into stretches, and stretches shorter
than the shortest test phrase are left out.  The suffix array of the rest, its
Burrows-Wheeler transform as a wavelet matrix, and suffix positions sampled at every
eighth word and every stretch's start make the index.  All test phrases are searched
backwards at once; occurrences are located by walking to a sampled position, and their
word spans are merged.

The benchmark is searched in blocks of bounded size, PASS_BLOCKS of them in one pass over the documents, so that no task
holds more of it.  Later passes return rows for documents with hits only, which are joined to the first one's.  Words are
compared by 64-bit hashes.

Nulls: a null text has no words.  An item without id counts as one whose id is the empty
string; an item id counts once, however many rows have it.  A document without words is
not contaminated.  Repeated rows each get a row; an empty table gives an empty table, an
empty benchmark hits nothing.  Further columns are kept by ``clean`` and ignored by ``find``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import id_key, table
from terrane.llm.textkit import LOWER, NOT_ALNUM, Words, chunks

WINDOW = 13
#: Bytes of benchmark text of a block, about, and blocks that are searched in one pass.
BLOCK_BYTES = 4 << 20
PASS_BLOCKS = 4
#: Distance of sampled suffix positions in a stretch.
SAMPLE = 8
#: Words of stretches that are indexed together, about.
SHARD_WORDS = 1 << 20


class Phrases:
    """The distinct windows of the items, over an alphabet of the items' words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.ids = sorted({i for i, _ in items})
        texts = [t.encode() for _, t in items]
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)] if texts else np.zeros(0, np.uint8)
        words = Words(data, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64), NOT_ALNUM)
        self.alphabet = np.unique(words.hash)
        symbols = np.searchsorted(self.alphabet, words.hash) + 1
        at = {x: k for k, x in enumerate(self.ids)}
        found: dict[tuple, set[int]] = {}
        for k, (item, _) in enumerate(items):
            own = symbols[words.first[k] : words.first[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(at[item])
        self.length = np.array([len(p) for p in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.words[k, : len(p)] = p
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.length.min()) if found else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; zeros are ends of stretches, each smaller than all that come later."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(ends.sum())
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """Of a text of symbols 1.. whose stretches each end in a zero."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.n = len(text)
        order = suffix_array(text)
        # a stretch's start and every SAMPLE-th word after it keep their position
        start = np.concatenate(([True], text[:-1] == 0))
        place = np.arange(self.n)
        sampled = (place - np.maximum.accumulate(np.where(start, place, 0))) % SAMPLE == 0
        kept = sampled[order]
        self.sampled, self.samples = np.concatenate(([0], np.cumsum(kept))), order[kept]
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=symbols + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            bwt = bwt[np.argsort(bit, kind="stable")]
        self.base = self._descend(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = self.ones[k][i]
            i = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol in the transform before row i."""
        return self._descend(symbol, i) - self.base[symbol]

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase, by backward search."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        live = np.flatnonzero(length > 0)
        for back in range(words.shape[1]):
            live = live[(length[live] > back) & (low[live] < high[live])]
            if not len(live):
                break
            c = words[live, length[live] - 1 - back]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows' suffixes."""
        out, at = np.empty(len(rows), np.int64), np.arange(len(rows))
        for steps in range(SAMPLE):
            here = self.sampled[rows + 1] > self.sampled[rows]
            out[at[here]] = self.samples[self.sampled[rows[here]]] + steps
            rows, at = rows[~here], at[~here]
            if not len(rows):
                break
            symbol, i = np.zeros(len(rows), np.int64), rows
            for k in range(self.levels):
                one = self.ones[k][i]
                bit = self.ones[k][i + 1] - one
                symbol = symbol << 1 | bit
                i = np.where(bit == 1, self.zeros[k] + one, i - one)
            rows = self.before[symbol] + i - self.base[symbol]
        return out


class Shard:
    """Stretches of some documents' words, and what is found in them."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.parts, self.size = phrases, [], 0

    def add(self, row: int, words: Words) -> None:
        """Keep the stretches of a chunk; row: number of its first document."""
        alphabet = self.phrases.alphabet
        if not len(words) or not len(alphabet):
            return
        at = np.minimum(np.searchsorted(alphabet, words.hash), len(alphabet) - 1)
        known = alphabet[at] == words.hash
        owner = words.owner()
        # a stretch breaks at unknown words and between documents
        new = known.copy()
        new[1:] = known[1:] & ~(known[:-1] & (owner[1:] == owner[:-1]))
        place = np.flatnonzero(known)
        if not len(place):
            return
        stretch = np.cumsum(new[place]) - 1
        long = (np.bincount(stretch) >= self.phrases.shortest)[stretch]
        place, stretch = place[long], stretch[long]
        if not len(place):
            return
        last = np.flatnonzero(np.concatenate((stretch[1:] != stretch[:-1], [True])))
        insert = lambda x, end: np.insert(x, last + 1, end)
        self.parts.append((insert(at[place] + 1, 0), insert(owner[place] + row, -1), insert(place - words.first[owner[place]], -1)))
        self.size += len(place)

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item) of the occurrences, distinct, and (document, word) of the words hit, sorted."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        text, owner, word = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        index = FMIndex(text, len(self.phrases.alphabet))
        low, high = index.search(self.phrases.words, self.phrases.length)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        begin = index.locate(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + self.phrases.length[which], -1)
        hit = np.cumsum(cover[:-1]) > 0
        pairs = np.unique(np.stack((owner[begin], which), 1), axis=0) if len(begin) else np.zeros((0, 2), np.int64)
        items = [(d, k) for d, p in pairs.tolist() for k in self.phrases.items[p]]
        docs, ids = np.array(items, np.int64).reshape(-1, 2).T
        return docs, ids, owner[hit], word[hit]


STATE = "struct<n_words:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"


def _found(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, dict[int, list[str]], dict[int, list[tuple[int, int]]]]:
    """Of the texts of a batch: number of words; items and merged word spans of those hit."""
    n_words, items, spans = np.zeros(len(column), np.int64), {}, {}
    shard = Shard(phrases)

    def settle():
        docs, ids, owner, word = shard.find()
        for d, k in zip(docs.tolist(), ids.tolist()):
            items.setdefault(d, set()).add(phrases.ids[k])
        cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1] + 1)))) if len(owner) else []
        for a, b in zip(cut, [*cut[1:], len(owner)]):
            spans.setdefault(int(owner[a]), []).append((int(word[a]), int(word[b - 1]) + 1))

    for i, j, data, bounds in chunks(column):
        words = Words(LOWER[data], bounds, NOT_ALNUM)
        n_words[i:j] = words.counts()
        shard.add(i, words)
        if shard.size >= SHARD_WORDS:
            settle()
    settle()
    return n_words, {d: sorted(x) for d, x in items.items()}, spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _all_found(blocks: list[Phrases], column: pa.Array) -> tuple[np.ndarray, dict[int, list[str]], dict[int, list[tuple[int, int]]]]:
    """``_found`` of several blocks, put together."""
    n_words, items, spans = _found(blocks[0], column)
    for phrases in blocks[1:]:
        _, more, places = _found(phrases, column)
        for r, ids in more.items():
            items[r] = sorted({*items.get(r, []), *ids})
            spans[r] = merged([*spans.get(r, []), *places[r]])
    return n_words, items, spans


def _states(n_words, items, spans, rows, kind) -> pa.Array:
    return pa.array([{"n_words": n_words[r], "items": items.get(r, []), "spans": [{"start": a, "end": b} for a, b in spans.get(r, [])]} for r in rows], type=kind)


def _search(blocks, text: str, state: str):
    """Fills the state column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Phrases(b.value) for b in blocks]
        for batch in batches:
            place = batch.schema.get_field_index(state)
            n_words, items, spans = _all_found(held, batch.column(text))
            new = _states(n_words.tolist(), items, spans, range(batch.num_rows), batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([new if c == place else batch.column(c) for c in range(batch.num_columns)], schema=batch.schema)

    return run


HITS = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _search_hits(blocks):
    """Rows of the documents with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Phrases(b.value) for b in blocks]
        for batch in batches:
            _, items, spans = _all_found(held, batch.column("text"))
            rows = sorted(items)
            if rows:
                hit = batch.take(pa.array(rows))
                places = [[{"start": a, "end": b} for a, b in spans[r]] for r in rows]
                yield pa.RecordBatch.from_arrays([hit.column("k"), hit.column("th"), pa.array([items[r] for r in rows], HITS.field(2).type), pa.array(places, HITS.field(3).type)], schema=HITS)

    return run


def _merged(spans: Column) -> Column:
    """Word ranges, those that meet made one."""
    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] <= F.get(acc, F.size(acc) - 1)["end"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", state: str = "contamination") -> DataFrame:
    """``docs`` with a column ``state``: n_words, items (ids with occurrences, sorted) and spans
    (merged word ranges that occurrences cover)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))

    def block(k):  # bounded by BLOCK_BYTES
        return spark.sparkContext.broadcast([tuple(r) for r in bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()])

    out = docs.withColumn(state, F.lit(None).cast(STATE))
    out = out.mapInArrow(_search([block(k) for k in range(min(n, PASS_BLOCKS))], text, state), out.schema)
    if n <= PASS_BLOCKS:
        return out
    keyed = docs.select(id_key().alias("k"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    hits = None
    for low in range(PASS_BLOCKS, n, PASS_BLOCKS):
        found = keyed.mapInArrow(_search_hits([block(k) for k in range(low, min(n, low + PASS_BLOCKS))]), "k long, th long, items array<string>, spans array<struct<start:int,end:int>>")
        hits = found if hits is None else hits.unionByName(found)
    # of rows of the same id and text, the hits are the same
    hits = hits.groupBy("k", "th").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))
    k, th, items, spans = [f"hit{i}" for i in range(len(docs.columns) + 5) if f"hit{i}" not in out.columns][:4]
    met = out.withColumns({k: id_key(), th: F.xxhash64(text)}).join(hits.toDF(k, th, items, spans), [k, th], "left")
    more = F.struct(F.col(f"{state}.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.concat(f"{state}.items", items))).alias("items"), _merged(F.concat(f"{state}.spans", spans)).alias("spans"))
    return met.withColumn(state, F.when(F.col(items).isNull(), F.col(state)).otherwise(more)).select(*out.columns)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans and contaminated, one row a document."""
    hit = F.aggregate("s.spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    out = scan(docs.select("doc_id", "text"), benchmark, state="s")
    out = out.select("doc_id", "s.n_words", hit.alias("n_hit"), "s.items", "s.spans")
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all their columns."""
    state = next(f"found{n}" for n in range(len(docs.columns) + 1) if f"found{n}" not in docs.columns)
    hit = F.aggregate(f"{state}.spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = scan(docs, benchmark, state=state)
    return found.filter(~contaminated(hit, F.col(f"{state}.n_words"))).select(*docs.columns)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item, ws, least(len(ws), 13) AS m, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS w FROM bs),
ms AS (SELECT DISTINCT m FROM bw),
ds AS (SELECT rid, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, ms WHERE len(ws) >= m),
dw AS (SELECT rid, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS w FROM ds),
h AS (SELECT dw.rid, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.w = bw.w AND dw.m = bw.m),
pos AS (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM h),
nh AS (SELECT rid, count(*) AS n FROM pos GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(nh.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AND 20 * coalesce(nh.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN it USING (rid)
"""
