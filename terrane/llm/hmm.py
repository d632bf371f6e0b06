"""Operator 8: scoring text by a hidden Markov language model.

Tokens are lower-cased words and one end a text.  The FREQUENT most frequent tokens each
have emissions of their own; all others fall into CLASSES classes by their last letters, whose
emissions are learned like those of a word.  In its class a token has the share (c + 1) of the class's
counts, unseen ones that of a single token.  So the model a
task holds is bounded, while counts of all words stay in a table and are joined.

Baum-Welch runs over all training documents: each partition sums its expected counts, the
sums are added up across partitions, and the next model is made from them.  For training,
texts are written as token numbers once and taken in stretches of STRETCH tokens; a stretch inside a text has an
initial distribution of its own and goes up to the first token of the next, so every transition counts.
Scoring runs the scaled forward recursion over each whole text and is exact.

Nulls: a null text is an empty one, which has an end only.  A null doc_id counts as the
text '' for the held-out rule.  Without training documents every token is unseen and the
states are alike.  Repeated rows each get a row (and count as often in training); an empty
table gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import discard, id_key, stash, table
from terrane.llm.textkit import string_buffers

STATES = 6
FREQUENT = 1 << 15
CLASSES = 1 << 11
#: Bytes at a word's end that name its class.
ENDING = 3
ITERATIONS = 4
STRETCH = 128
#: Most frequent words whose counts a task holds when it scores; the counts of others are joined.
KNOWN = 1 << 17
#: Weight of the unigram distribution in a state's emissions, in tokens.
PRIOR = 200.0
#: Tokens that are run through the recursions together.
TOKENS_AT_A_TIME = 1 << 18
HELD_OUT = 2
#: Distinct words a task counts before it passes the counts on.
WORDS_HELD = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Numbers of tokens: the end, then the classes, then words.
END, CLASS, WORDS = 0, 1, 1 + CLASSES
#: Rare words whose class a task keeps.
KEPT_WORDS = 100_000


def class_of(word: bytes) -> int:
    return CLASS + zlib.crc32(word[-ENDING:]) % CLASSES


class Numbers(dict):
    """Numbers of listed words; of others the number of their class, some of which are kept."""

    def __init__(self, listed: dict[bytes, int]) -> None:
        super().__init__(listed)
        self.room = KEPT_WORDS

    def __missing__(self, word: bytes) -> int:
        out = class_of(word)
        if self.room:
            self.room -= 1
            self[word] = out
        return out

    def of(self, text: bytes) -> np.ndarray:
        """Token numbers of a text, its end included."""
        words = text.split()
        out = np.full(len(words) + 1, END, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 7 == HELD_OUT


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = string_buffers(batch.column("text"))
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b]).translate(_LOWER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return rows

    for batch in batches:
        for text in _texts(batch):
            counts.update(text.split())
            if len(counts) > WORDS_HELD:
                yield flush()
    if counts:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over docs(text), ends not among them."""
    return docs.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list:
    """The most frequent words, ``most`` at most, from frequent to rare, equal counts by word: all of the upper bins of
    a histogram and the top of the bin that overflows, so that no task sends more than belongs to the result."""
    size = F.floor(F.log2("n") * 64).cast("int")
    left, least = most, 1 << 20
    over = None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["size"]):
        if r.words > left:
            over = r["size"]
            break
        left, least = left - r.words, r["size"]
    found = counts.filter(size >= least).collect()
    if over is not None and left:
        found += counts.filter(size == over).orderBy(F.desc("n"), "word").limit(left).collect()
    return sorted(found, key=lambda r: (-r.n, r.word))


class Model:
    """Log-free parameters: start (of texts), inner (of stretches inside texts), step, emit."""

    def __init__(self, words: dict[bytes, int], unigram: np.ndarray, states: int = STATES) -> None:
        self.words = words
        # states begin apart by the last letters of words, which differ between kinds of text
        ending = np.arange(len(unigram))
        for w, i in words.items():
            ending[i] = int.from_bytes(w[-2:], "big")
        codes = (ending[None, :] + 1) * (np.arange(states)[:, None] * 2 + 1) * 0x9E3779B1 % (1 << 32)
        codes = (codes ^ (codes >> 15)) * 0x2C1B3C6D % (1 << 32)
        tilt = np.exp(2.0 * (codes / float(1 << 32) - 0.5))
        self.unigram = unigram
        self.emit = (unigram * tilt) / (unigram * tilt).sum(1, keepdims=True)
        self.step = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(self.step, 0.95 if states > 1 else 1.0)
        self.start = self.inner = np.full(states, 1 / states)

    def learned(self, sums: dict) -> None:
        self.emit = (sums["emit"] + PRIOR * self.unigram) / (sums["emit"].sum(1, keepdims=True) + PRIOR)
        n = len(self.start)
        self.step = (sums["step"] + 1 / n) / (sums["step"].sum(1, keepdims=True) + 1)
        self.start, self.inner = ((sums[k] + 1 / n) / (sums[k].sum() + 1) for k in ("start", "inner"))


class Columns:
    """Many sequences, from long to short, laid out by place: first all first tokens, then all second ones."""

    def __init__(self, begin: np.ndarray, length: np.ndarray) -> None:
        steps = np.arange(int(length[0]))
        self.active = np.searchsorted(-length, -steps - 1, "right")  # sequences with more than t tokens
        self.edge = np.concatenate(([0], np.cumsum(self.active)))
        place = np.repeat(steps, self.active)
        self.source = begin[np.arange(self.edge[-1]) - self.edge[place]] + place

    def __iter__(self):
        return zip(self.edge[:-1].tolist(), self.edge[1:].tolist())


def _forward(emit: np.ndarray, step: np.ndarray, first: np.ndarray, columns: Columns, keep: bool):
    """Scaled forward recursion over many sequences at once.

    emit: emission of each token by state, laid out by ``columns``; first: initial distribution of each
    sequence.  Returns log-likelihoods and, if kept, the scaled messages and their scales.
    """
    total = np.zeros(len(first))
    messages = np.empty_like(emit) if keep else None
    scales = np.empty(len(emit), emit.dtype) if keep else None
    now = None
    for a, b in columns:
        now = (first if now is None else now[: b - a] @ step) * emit[a:b]
        scale = now.sum(1)
        now /= scale[:, None]
        total[: b - a] += np.log(scale)
        if keep:
            messages[a:b], scales[a:b] = now, scale
    return total, messages, scales


def expected_counts(model: Model, ids: np.ndarray, begin: np.ndarray, length: np.ndarray, inside: np.ndarray, into: dict, ahead: np.ndarray | None = None) -> None:
    """Adds the expected counts of some sequences.  inside: those that don't start their text; ahead: those whose last
    token is the next one's first, which counts there."""
    order = np.argsort(-length, kind="stable")
    begin, length, inside = begin[order], length[order], inside[order]
    columns = Columns(begin, length)
    ids = ids[columns.source]
    emit = model.emit.T.astype(np.float32)[ids]
    step, turned = model.step.astype(np.float32), np.ascontiguousarray(model.step.T, np.float32)
    first = np.where(inside[:, None], model.inner, model.start).astype(np.float32)
    total, messages, scales = _forward(emit, step, first, columns, True)
    into["loglike"] += total.sum()
    emit /= scales[:, None]
    back = np.ones((len(length), len(step)), np.float32)
    gamma, pairs = np.empty_like(messages), np.zeros(step.shape)
    edges = list(columns)
    for t in range(len(edges) - 1, -1, -1):
        a, b = edges[t]
        n = b - a
        gamma[a:b] = messages[a:b] * back[:n]
        if t:
            out = back[:n] * emit[a:b]
            before = edges[t - 1][0]
            pairs += messages[before : before + n].T @ out
            back[:n] = out @ turned
    into["step"] += pairs * model.step
    if ahead is not None:
        last = np.flatnonzero(ahead[order])
        gamma[columns.edge[length[last] - 1] + last] = 0
    columns_of = np.ascontiguousarray(gamma.T)
    for k in range(len(step)):
        into["emit"][k] += np.bincount(ids, columns_of[k], into["emit"].shape[1])
    head = gamma[: len(length)]
    into["start"] += head[~inside].sum(0)
    into["inner"] += head[inside].sum(0)


def _no_counts(model: Model) -> dict:
    k, n = model.emit.shape
    return {"emit": np.zeros((k, n)), "step": np.zeros((k, k)), "start": np.zeros(k), "inner": np.zeros(k), "loglike": 0.0}


def _expect(sent):
    """Rows (part, i, values by state) of a partition's expected counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        sums, held, size = _no_counts(model), [], 0

        def settle():
            ids = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            pieces = -(-lengths // STRETCH)
            text = np.repeat(np.arange(len(held)), pieces)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = (np.cumsum(lengths) - lengths)[text] + piece * STRETCH
            length = np.minimum(lengths[text] - piece * STRETCH, STRETCH)
            ahead = piece < pieces[text] - 1
            expected_counts(model, ids, begin, length + ahead, piece > 0, sums, ahead)

        for batch in batches:
            column = batch.column("ids")
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                held.append(flat[a:b])
                size += b - a
                if size >= TOKENS_AT_A_TIME:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        rows = [("emit", i, sums["emit"][:, i]) for i in np.flatnonzero(sums["emit"].any(0)).tolist()]
        rows += [("step", i, x) for i, x in enumerate(sums["step"])] + [("start", 0, sums["start"]), ("inner", 0, sums["inner"]), ("loglike", 0, np.full(len(model.step), sums["loglike"]))]
        for a in range(0, len(rows), 10_000):
            part = rows[a : a + 10_000]
            values = np.stack([r[2] for r in part])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(values.shape[1]))], ["part", "i", *(f"s{k}" for k in range(values.shape[1]))])

    return run


def _number(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(sent.value)
        for batch in batches:
            ids = [numbers.of(text) for text in _texts(batch)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))], ["ids"])

    return run


def baum_welch(model: Model, docs: DataFrame, iterations: int = ITERATIONS) -> list[float]:
    """Trains the model on all of docs(text); returns the log-likelihood before each round."""
    states = len(model.step)
    if not iterations:
        return []
    numbered = stash(docs.select("text").mapInArrow(_number(docs.sparkSession.sparkContext.broadcast(model.words)), "ids array<int>"), "numbered")
    columns = [f"s{k}" for k in range(states)]
    out = []
    for _ in range(iterations):
        sent = docs.sparkSession.sparkContext.broadcast(model)  # FREQUENT words and their emissions at most
        parts = numbered.mapInArrow(_expect(sent), "part string, i int, " + ", ".join(f"{c} double" for c in columns))
        got = parts.groupBy("part", "i").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # a row a frequent word
        sums = _no_counts(model)
        for r in got:
            values = np.array(r[2:])
            if r.part == "emit":
                sums["emit"][:, r.i] = values
            elif r.part == "step":
                sums["step"][r.i] = values
            elif r.part == "loglike":
                sums["loglike"] = values[0]
            else:
                sums[r.part] = values
        model.learned(sums)
        out.append(sums["loglike"])
        sent.unpersist()
    discard(numbered)
    return out


def _score(sent):
    """Of each text: tokens; known ones and log10 sums but for words that the task has no count of;
    those words, and how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, listed, base, gain, class_share, group, end_known = sent.value
        numbers, emit, frequent = Numbers(listed), model.emit.T, len(model.unigram)
        for batch in batches:
            rows = batch.num_rows
            n, known = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            base_sum, likelihood, shares = np.zeros(rows), np.zeros(rows), np.zeros(rows)
            rare: list[list[dict]] = []
            ids = []
            for r, text in enumerate(_texts(batch)):
                x = numbers.of(text)
                far = np.flatnonzero((x >= CLASS) & (x < WORDS))
                words = text.split() if len(far) else []
                rare.append([{"w": w, "n": c} for w, c in Counter([words[i] for i in far.tolist()]).items()])
                n[r], known[r], base_sum[r], shares[r] = len(x), len(x) - 1 - len(far) + end_known, base[x].sum(), gain[x].sum() - class_share[x[far]].sum()
                # listed words without emissions of their own have those of their class
                x = np.where(x >= frequent, group[x], x)
                ids.append(x)
            lengths = np.array([len(x) for x in ids])
            order, low = np.argsort(-lengths, kind="stable"), 0
            while low < rows:
                to = max(low + 1, low + int(np.searchsorted(np.cumsum(lengths[order[low:]]), TOKENS_AT_A_TIME, "right")))
                part = order[low:to]
                columns = Columns(np.cumsum(lengths[part]) - lengths[part], lengths[part])
                flat = np.concatenate([ids[r] for r in part])[columns.source]
                total, *_ = _forward(emit[flat], model.step, np.broadcast_to(model.start, (len(part), len(model.step))), columns, False)
                likelihood[part] = total / math.log(10)
                low = to
            likelihood += shares
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), batch.column("th"), pa.array(n), pa.array(known), pa.array(base_sum), pa.array(likelihood), pa.array(rare, pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())])))], schema=_SCORED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("th", pa.int32()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("hmm", pa.float64()), ("rare", pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())])))])
SCORED = "doc_id long, k long, th int, n_tokens long, known long, base double, hmm double, rare array<struct<w:string,n:long>>"


def score(docs: DataFrame, train: DataFrame, frequent: int = FREQUENT, iterations: int = ITERATIONS, known: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each of ``docs``, by a
    model of the texts of ``train``."""
    counts = stash(word_counts(train), "counts")
    texts = train.count()
    words, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = (words or 0) + texts, kinds + (texts > 0)
    listed = frequent_words(counts, max(known, frequent))
    top = listed[:frequent]
    ids = {r.word.encode(): i for i, r in enumerate(listed, WORDS)}
    count = np.array([texts, *[0] * CLASSES, *(r.n for r in listed)], np.float64)
    denominator = tokens + kinds + 1
    # what a class's words that have no emissions of their own share, with an unseen one
    shared = np.ones(WORDS)
    of_class = F.crc32(F.call_function("substring", F.encode("word", "UTF-8"), F.lit(-ENDING), F.lit(ENDING))) % CLASSES
    for r in counts.groupBy(of_class.cast("int").alias("c")).agg(F.sum(F.col("n") + 1).alias("n")).collect():  # a row a class
        shared[CLASS + r.c] += r.n
    group = np.arange(len(count))
    for r, i in zip(listed, range(WORDS, len(count))):
        group[i] = class_of(r.word.encode())
    np.subtract.at(shared, group[WORDS : WORDS + len(top)], count[WORDS : WORDS + len(top)] + 1)
    unigram = (count[: WORDS + len(top)] + 1) / denominator
    unigram[CLASS:WORDS] = shared[CLASS:] / denominator
    if not texts:
        unigram[END], unigram[CLASS:WORDS] = 0.5, 0.5 / CLASSES
    model = Model({w: i for w, i in ids.items() if i < len(unigram)}, unigram / unigram.sum())
    baum_welch(model, train, iterations if texts else 0)

    base = np.log10((count + 1) / denominator)
    class_share = np.log10(shared)
    # of listed words without emissions of their own, the share of their class
    gain = np.log10(count + 1)
    gain[WORDS:] -= class_share[group[WORDS:]]
    gain[: len(unigram)] = base[CLASS:WORDS] = 0
    sent = docs.sparkSession.sparkContext.broadcast((model, ids, base, gain, class_share, group, int(texts > 0)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("k"), F.hash(text).alias("th"), text.alias("text"))
    scored = stash(rows.mapInArrow(_score(sent), SCORED), "scored")
    # rare words meet their counts; a repeated row's words arrive as often as the row, which its marks count
    rare = scored.filter(F.size("rare") > 0)
    tail = rare.select("k", "th", F.explode("rare").alias("x")).select("k", "th", F.col("x.w").alias("word"), F.col("x.n").alias("times"))
    tail = tail.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    tail = tail.groupBy("k", "th").agg(F.sum("times").alias("times"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("met"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"))
    marks = rare.groupBy("k", "th").agg(F.count("*").alias("marks"))
    tail = tail.join(marks, ["k", "th"]).select("k", "th", *[(F.col(c) / F.col("marks")).alias(c) for c in ("times", "met", "gain")])
    out = scored.drop("rare").join(tail, ["k", "th"], "left").fillna(0, ["times", "met", "gain"])
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.round("met")).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain") - F.col("times") * F.lit(math.log10(denominator))).alias("base_score"),
        (F.col("hmm") + F.col("gain")).alias("score"),
    )


def op8_hmm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
