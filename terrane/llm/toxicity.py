"""Operator 7: toxic spans by a linear-chain conditional random field.

Two states, clean and toxic.  A token's features are the token and its first three to six
bytes, lower-cased; each has a weight for the toxic state, and state pairs have weights of
their own.  Token labels come from document labels: features that together explain the
toxic documents and occur in no clean ones, found by greedy cover, mark the toxic tokens
of toxic documents, so the labels of tokens are made, not given.  Weights are fitted by the gradient of the chain's
log-likelihood (forward-backward over windows of a document's tokens) with an L1 penalty.

Scoring runs forward-backward over every whole text.  A document's score is its largest
marginal of the toxic state; offending spans are runs of tokens with a marginal of a half
or more, as character offsets.

The model is fitted on a bounded sample: TRAIN_ROWS labelled documents of each class,
by a hash of doc_id, never of the held-out quarter, and TRAIN_BYTES of texts in all; of their windows those with
a toxic token, and CLEAN_WINDOWS times as many (LEAST_CLEAN more) of clean documents.  All documents are scored.

Nulls: a null text has no tokens; texts without tokens score 0.  A null doc_id has no label
and counts as the text '' for the held-out rule.  Rows of labels with nulls are ignored; of
repeated ones each counts.  Without labels of both classes every score is 0.  Repeated rows
each get a row; an empty table gives an empty table.  Further columns are kept, but for those named like a new
column, which give way to it.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import table
from terrane.llm.textkit import BYTE_CODES, BYTE_POWERS, LOWER, NOT_ALNUM, Words, chunks, mix, prefix, span

#: Bytes of texts that are tagged together, about.
TEXT_BYTES = 4 << 20
#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_ROWS = 1500
#: Bytes of their texts, at most.
TRAIN_BYTES = 64 << 20
#: Clean windows for each one with a toxic token, and besides.
CLEAN_WINDOWS, LEAST_CLEAN = 1, 2000
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
#: Toxic documents not yet explained that a feature must explain to mark tokens.
LEAST_COVER = 3
#: Tokens of a training window, rounds and step of the fit, L1 penalty.
SPAN_TOKENS, ROUNDS, STEP, PENALTY = 24, 40, 0.5, 2e-5
HELD_OUT = 2


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == HELD_OUT


def token_features(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    """Tokens of a chunk and the hashes of their features, one column a feature; zero where a token
    is not longer than the prefix."""
    data = LOWER[data]
    words = Words(data, bounds, NOT_ALNUM, hashes=False)
    pre = prefix(BYTE_CODES[data], BYTE_POWERS)
    whole = mix(span(pre, words.start, words.end, BYTE_POWERS))
    columns = [whole]
    for n in PREFIXES:
        part = mix(span(pre, words.start, np.minimum(words.start + n, words.end), BYTE_POWERS) + np.uint64(n))
        columns.append(np.where(words.end - words.start > n, part, np.uint64(0)))
    return words, np.stack(columns, 1)


def chain(emission: np.ndarray, first: np.ndarray, pairs: np.ndarray, start: float) -> np.ndarray:
    """Marginals of the toxic state of each token of texts [first[i], first[i + 1]).

    emission: log-weight of toxic against clean; pairs: log-weights of state pairs.  Messages are
    kept as log-ratios of the two states, so that no text is too long for them.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    (t00, t01), (t10, t11) = pairs

    def forward(r):
        return np.logaddexp(t01, t11 + r) - np.logaddexp(t00, t10 + r)

    def backward(r):
        return np.logaddexp(t10, t11 + r) - np.logaddexp(t00, t01 + r)

    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # texts with more than t tokens
    ahead, behind = np.empty(len(emission)), np.empty(len(emission))
    last = None
    for t in range(most):
        at = begin[: active[t]] + t
        last = emission[at] + (start if t == 0 else forward(last[: active[t]]))
        ahead[at] = last
    message = np.zeros(len(length))
    for t in range(most - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        behind[at] = message[:n]
        message[:n] = backward(emission[at] + message[:n])
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))


def _cover(docs: list[tuple[int, np.ndarray]]) -> set[int]:
    """Features that mark toxic tokens.  docs: (label, distinct features, the longest first)."""
    clean = [found for label, found in docs if not label]
    clean = np.unique(np.concatenate([*clean, np.zeros(1, np.uint64)]))
    held = lambda sorted_, x: sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x
    toxic = [found[~held(clean, found)] for label, found in docs if label]
    names, n = np.unique(np.concatenate([*toxic, np.zeros(1, np.uint64)]), return_counts=True)
    names = np.concatenate(([np.uint64(0)], names[n >= LEAST_COVER]))
    toxic = [found[held(names, found)].tolist() for found in toxic]
    place: dict[int, int] = {}  # how early a feature stands in a document's list, at best
    holders: dict[int, list[int]] = {}
    for d, found in enumerate(toxic):
        for i, f in enumerate(found):
            place[f] = min(place.get(f, i), i)
            holders.setdefault(f, []).append(d)
    count = {f: len(ds) for f, ds in holders.items()}
    chosen, left = set(), set(range(len(toxic)))
    while count:
        best = max(count, key=lambda f: (count[f], -place[f], -f))
        if count[best] < LEAST_COVER:
            break
        chosen.add(best)
        for d in left.intersection(holders[best]):
            left.remove(d)
            for f in toxic[d]:
                if f in count:
                    count[f] -= 1
    return chosen


def fit(texts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """Feature hashes and weights, bias, pair weights and start weight from (label, text) rows."""
    texts = sorted(set(texts))
    parts, first = [], [np.zeros(1, np.int64)]
    for _, _, data, bounds in chunks(pa.array([t for _, t in texts], pa.binary()).cast(pa.string()), 1 << 19):
        words, found = token_features(data, bounds)
        parts.append(found)
        first.append(words.first[1:] + first[-1][-1])
    features, first = np.concatenate(parts), np.concatenate(first)
    del parts
    # the whole token, then the longer prefixes, come first in a document's list
    by_length = [0, *range(len(PREFIXES), 0, -1)]
    docs = []
    for d, (label, _) in enumerate(texts):
        own = features[first[d] : first[d + 1]][:, by_length]
        _, at = np.unique(own.T.ravel(), return_index=True)
        docs.append((label, own.T.ravel()[np.sort(at)]))
    chosen = np.array(sorted(_cover(docs)), np.uint64)
    del docs
    label = np.repeat(np.array([x for x, _ in texts], bool), np.diff(first))
    tag = np.isin(features, chosen).any(1) & label
    # windows of a document's tokens, the last one shorter: those with a toxic token, and clean documents' evenly
    pieces = -(-np.diff(first) // SPAN_TOKENS)
    owner = np.repeat(np.arange(len(texts)), pieces)
    begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPAN_TOKENS
    length = np.minimum(first[owner + 1] - begin, SPAN_TOKENS)
    sums = np.concatenate(([0], np.cumsum(tag)))
    near = np.flatnonzero(sums[begin + length] > sums[begin])
    if not len(chosen) or not len(near):
        return np.zeros(0, np.uint64), np.zeros(0), -20.0, np.zeros((2, 2)), 0.0
    other = np.flatnonzero(~np.array([x for x, _ in texts], bool)[owner])
    most = CLEAN_WINDOWS * len(near) + LEAST_CLEAN
    other = other[np.linspace(0, len(other) - 1, min(len(other), most)).astype(np.int64)] if len(other) else other
    taken = np.concatenate((near, other))
    held = np.arange(SPAN_TOKENS) < length[taken, None]
    at = np.where(held, begin[taken, None] + np.arange(SPAN_TOKENS), 0)
    features = np.where(held[:, :, None], features[at], np.uint64(0))
    names = np.unique(features)
    ids, gold = np.searchsorted(names, features).astype(np.int32), (tag[at] & held).astype(np.int64)
    del features
    weight, bias, pairs, start = np.zeros(len(names)), -2.0, np.zeros((2, 2)), 0.0
    weight[names == 0] = 0
    total = np.full(len(names), 1e-8)
    other_total = np.full(6, 1e-8)
    n = len(at)
    both = held[:, 1:]
    want_pairs = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[both], minlength=4).reshape(2, 2)
    for _ in range(ROUNDS):
        emission = bias + weight[ids].sum(2)
        alpha = np.empty((n, SPAN_TOKENS, 2))
        alpha[:, 0] = np.stack((np.zeros(n), start + emission[:, 0]), 1)
        for t in range(1, SPAN_TOKENS):
            moved = np.logaddexp(alpha[:, t - 1, :1] + pairs[0], alpha[:, t - 1, 1:] + pairs[1])
            moved[:, 1] += emission[:, t]
            alpha[:, t] = np.where(held[:, t, None], moved, alpha[:, t - 1])
        beta, got_pairs = np.zeros((n, 2)), np.zeros((2, 2))
        norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        posterior = np.empty((n, SPAN_TOKENS))
        for t in range(SPAN_TOKENS - 1, -1, -1):
            posterior[:, t] = np.exp(alpha[:, t, 1] + beta[:, 1] - norm)
            if t:
                out = beta + np.stack((np.zeros(n), emission[:, t]), 1)
                joint = alpha[:, t - 1, :, None] + pairs + out[:, None, :]
                got_pairs += np.exp(joint - norm[:, None, None])[held[:, t]].sum(0)
                beta = np.where(held[:, t, None], np.logaddexp(pairs[:, 0] + out[:, :1], pairs[:, 1] + out[:, 1:]), beta)
        error = np.where(held, gold - posterior, 0) / n
        gradient = np.bincount(ids.ravel(), np.repeat(error.ravel(), ids.shape[2]), len(names))
        total += gradient**2
        rate = STEP / np.sqrt(total)
        weight += rate * gradient
        weight = np.sign(weight) * np.maximum(np.abs(weight) - rate * PENALTY, 0)
        weight[names == 0] = 0
        rest = np.concatenate(([error.sum(), error[:, 0].sum()], ((want_pairs - got_pairs) / n).ravel()))
        other_total += rest**2
        move = STEP / 2 / np.sqrt(other_total) * rest
        bias, start, pairs = bias + move[0], start + move[1], pairs + move[2:].reshape(2, 2)
    kept = np.abs(weight) > 1e-3
    return names[kept], weight[kept], bias, pairs, start


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, room = [], TRAIN_BYTES
    for batch in batches:
        for y, t in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            text = t.encode()
            room -= len(text)
            if room >= 0:
                rows.append((int(y), text))
    if len({y for y, _ in rows}) == 2:
        names, weight, bias, pairs, start = fit(rows)
        yield pa.RecordBatch.from_pydict({"name": np.concatenate((names.view(np.int64), np.arange(6))), "weight": np.concatenate((weight, [bias, start], pairs.ravel())), "is_feature": np.arange(len(names) + 6) < len(names)})


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model's weights, from labelled documents that are not held out."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = None
    for y in (0, 1):  # ids only, and a bounded number of them
        part = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("order"))
    got = rows.repartition(1).sortWithinPartitions("order").mapInArrow(_train, "name long, weight double, is_feature boolean").collect()
    features = sorted((r.name, r.weight) for r in got if r.is_feature)
    rest = [r.weight for r in sorted((r for r in got if not r.is_feature), key=lambda r: r.name)]
    hashes = np.array([f for f, _ in features], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return {"hash": hashes[order], "weight": np.array([w for _, w in features])[order] if features else np.zeros(0), "rest": rest}


def _tagged(model: dict, column: pa.Array) -> tuple[np.ndarray, dict[int, list[dict]]]:
    """Score of each text, and the spans of those that have any."""
    hashes, weight, rest = model["hash"], model["weight"], model["rest"]
    scores, spans = np.zeros(len(column)), {}
    if not rest or not len(hashes):
        return scores, spans
    emissions, places, firsts, n = [], [], [np.zeros(1, np.int64)], 0
    for i, j, data, bounds in chunks(column, 1 << 19):
        words, features = token_features(data, bounds)
        value = np.zeros(len(words))
        for c in range(features.shape[1]):
            at = np.minimum(np.searchsorted(hashes, features[:, c]), len(hashes) - 1)
            value += np.where(hashes[at] == features[:, c], weight[at], 0.0)
        emissions.append(value)
        firsts.append(words.first[1:] + n)
        letter = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        row = words.owner()
        places.append(np.stack((letter[words.start] - letter[bounds[row]], letter[words.end] - letter[bounds[row]]), 1).astype(np.int32) if len(words) else np.zeros((0, 2), np.int32))
        n += len(words)
    first = np.concatenate(firsts)
    marginal = chain(np.concatenate(emissions) + rest[0], first, np.array(rest[2:]).reshape(2, 2), rest[1])
    full = np.flatnonzero(np.diff(first))
    if len(full):
        scores[full] = np.maximum.reduceat(marginal, first[full])
    toxic = np.flatnonzero(marginal >= 0.5)
    place = np.concatenate(places)
    row = np.searchsorted(first, toxic, "right") - 1
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (toxic[1:] != toxic[:-1] + 1)))) if len(toxic) else []
    for a, b in zip(cut, [*cut[1:], len(toxic)]):
        spans.setdefault(int(row[a]), []).append({"start": int(place[toxic[a], 0]), "end": int(place[toxic[b - 1], 1])})
    return scores, spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def tag(docs: DataFrame, model: dict, score: str = "score", spans: str = "spans") -> DataFrame:
    """``docs`` with columns for the score and the offending character offsets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumns({score: F.lit(0.0), spans: F.lit(None).cast("array<struct<start:int,end:int>>")})

    def run(batches):
        for batch in batches:
            scores, found = np.zeros(batch.num_rows), {}
            for i, j, _, _ in chunks(batch.column("text"), TEXT_BYTES):
                scores[i:j], some = _tagged(sent.value, batch.column("text").slice(i, j - i))
                found |= {i + r: x for r, x in some.items()}
            new = {score: pa.array(scores), spans: pa.array([found.get(r, []) for r in range(batch.num_rows)], SPANS)}
            schema = batch.schema
            yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else batch.column(i) for i, f in enumerate(schema)], schema=schema)

    return out.mapInArrow(run, out.schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than the threshold, all their columns."""
    free = [f"toxic{n}" for n in range(len(docs.columns) + 2) if f"toxic{n}" not in docs.columns]
    return tag(docs, learn(docs, labels), free[0], free[1]).filter(F.col(free[0]) < threshold).select(*docs.columns)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tag(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
