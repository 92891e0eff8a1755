"""Toxicity by maximum-scoring segments of token log-odds.

Training: how many toxic and how many other texts hold each token (a word, or the stem of a longer
one) gives its log-odds with an informative Dirichlet prior, and their z-score; significant tokens
get a weight. A text is the sequence of its words' weights less a drift. One linear scan (Ruzzo and
Tompa) finds all maximal segments. Under texts that aren't toxic a segment follows an extreme-value
law: of n words about K n exp(-lambda s) segments score above s, where lambda solves
E exp(lambda weight) = 1. What lambda s has beyond log(K n) is a segment's excess; excesses above 0
come as one in the mean, each exponential, and the evidence of a text is the surprise (minus the log
of the chance) of the sum of all of them. The share of toxic training texts by evidence, made
monotone, is the score. Evidence for this comes from weights that were learned without the text's
own part of the training texts (cross-fitting by a hash of the text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandex.llm import wordhash
from strandex.llm.runtime import Tables, trimmed

#: Bytes of the stems that count as tokens beside the whole word.
STEMS = (4, 5, 6)
#: Strength of the Dirichlet prior in tokens, its floor per token, least z-score.
PRIOR, FLOOR, LEAST_Z = 10_000.0, 0.5, 3.5
#: Significant tokens that the driver reads at a time.
READ_TOKENS = 1 << 20
#: Subtracted from the weight of every word, so that the expected weight is negative.
DRIFT = 0.3
GRID = np.round(np.arange(1, 31) * 0.1, 1)
#: Bins of the evidence for the calibration, and what they rise by in all, so that more evidence scores more.
LOW, HIGH, BINS, RISE = -10.0, 40.0, 100, 1e-3
#: Parts of the training texts for cross-fitting.
FOLDS = 5
#: Rows of token counts that a task gathers before it merges them, and that it sends on at most.
GATHER, SEND = 1 << 18, 1 << 19
#: Labels broadcast to the texts at most (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 4_000_000
_SALT = np.random.default_rng(99).integers(0, 2**63, len(STEMS) + 1, dtype=np.uint64)


def _surprise() -> tuple[np.ndarray, np.ndarray]:
    """s, and -log of the chance that N excesses sum to s or more: N is Poisson of mean 1, each is exponential of mean 1."""
    s = np.concatenate([[1e-9], np.arange(0.25, 100, 0.25)])
    k = np.arange(1, 200)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(k))])
    terms = np.logaddexp.accumulate(np.outer(np.log(s), k - 1) - log_factorial[k - 1], axis=1)  # sum of s^j / j! for j < k
    return s, 1 + s - np.logaddexp.reduce(terms - log_factorial[k], axis=1)


_SUM, _SURPRISE = _surprise()


def _tokens(part: np.ndarray, offsets: np.ndarray):
    """Words, and for each kind of token the hash of each word's (0 where a word has no such stem)."""
    starts, ends, first = wordhash.spans(part, offsets, wordhash.NOT_ALNUM)
    kinds = [np.zeros(len(starts), np.uint64) for _ in range(len(STEMS) + 1)]
    for i, j in wordhash.blocks(starts, ends):
        base = starts[i]
        total, at, to = wordhash.sums(part[base : ends[j - 1]]), starts[i:j] - base, ends[i:j] - base
        kinds[0][i:j] = wordhash.between(total, at, to) ^ _SALT[0]
        for kind, k, salt in zip(kinds[1:], STEMS, _SALT[1:]):
            stem = wordhash.between(total, at, np.minimum(at + k, to)) ^ salt
            stem[to - at <= k] = 0
            kind[i:j] = stem
    return starts, ends, first, kinds


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (token, columns) of several tables as one."""
    token, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    counts = np.empty((len(token), len(_COUNTS)), np.int32)  # a column at a time: the tables are large beside a worker
    for k in range(len(_COUNTS)):
        counts[:, k] = np.bincount(at, np.concatenate([c[:, k] for _, c in parts]), len(token))
    return token, counts


_COUNTS = [f"{side}{f}" for f in range(FOLDS) for side in ("toxic", "other")]


def _presence(train: DataFrame) -> DataFrame:
    """(token, toxic0, other0, ...): numbers of texts by part. A task holds a bounded number of tokens."""

    def batch_of(table):
        token, counts = table
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *[pa.array(c, pa.int64()) for c in counts.T.astype(np.int64)]], names=["token", *_COUNTS])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            column = 2 * batch.column(2).to_numpy() + ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = wordhash.buffers(batch.column(0))
            for i, j in wordhash.steps(offsets):
                _, _, first, kinds = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = [np.unique(np.concatenate([k[first[r] : first[r + 1]] for k in kinds])) for r in range(j - i)]
                token, at = np.unique(np.concatenate(own), return_inverse=True)
                place = at * len(_COUNTS) + np.repeat(column[i:j], [len(x) for x in own])
                counts = np.bincount(place, minlength=len(token) * len(_COUNTS)).reshape(-1, len(_COUNTS)).astype(np.int32)
                word = token != 0
                held.append((token[word], counts[word]))
                size += len(token)
                if size > GATHER:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > SEND:
                        yield batch_of(held[0])
                        held, size = [], 0
                    else:
                        size //= 2  # room for as much again before the next merge
        if held:
            yield batch_of(_merged(held))

    rows = train.mapInArrow(trimmed(run), "token long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _without_copies(train: DataFrame, work: Tables) -> DataFrame:
    """(text, toxic, fold), once for exact copies with the same label; every other text stays."""
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    return work.write("train", train.select("text", "toxic").distinct().withColumn("fold", fold))


def _log_odds(counts: DataFrame) -> DataFrame:
    """(token, w, w0, w1, ...): weights from all parts, and from all but one; null where a token isn't significant."""
    total = counts.agg(*[F.sum(c).alias(c) for c in _COUNTS]).first()
    weights = []
    for left_out in (None, *range(FOLDS)):
        kept = [f for f in range(FOLDS) if f != left_out]
        y1, y0 = (sum((F.col(f"{side}{f}") for f in kept[1:]), F.col(f"{side}{kept[0]}")) for side in ("toxic", "other"))
        n1, n0 = (float(sum(total[f"{side}{f}"] or 0 for f in kept)) for side in ("toxic", "other"))
        prior = F.greatest(F.lit(FLOOR), PRIOR * (y1 + y0) / (n1 + n0 + 1))
        side = lambda y, n: F.log((y + prior) / (n + PRIOR - y - prior))
        weight = side(y1, n1) - side(y0, n0)
        z = weight / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        least = LEAST_Z * (len(kept) / FOLDS) ** 0.5  # z grows with the root of the number of texts
        weights.append(F.when((y1 + y0 >= 5) & (F.abs(z) >= least), weight).alias("w" if left_out is None else f"w{left_out}"))
    names = ["w", *[f"w{f}" for f in range(FOLDS)]]
    return counts.select("token", *weights).where(F.coalesce(*names).isNotNull())


def _read(significant: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens and weights of a written table, from all parts and without each, in blocks; 16 bytes a token
    in the driver and in each worker."""
    blocks = max(1, -(-significant.count() // READ_TOKENS))
    parts = [significant.where(F.pmod("token", F.lit(blocks)) == i).toArrow() for i in range(blocks)]
    out = []
    for name in ("w", *[f"w{f}" for f in range(FOLDS)]):
        token, weight = (np.concatenate([p.filter(p[name].is_valid()).column(c).to_numpy() for p in parts]) for c in ("token", name))
        out.append((token.view(np.uint64), weight))
    return out


class Scorer:
    """Weights of the significant tokens, the extreme-value parameters and the calibration."""

    def __init__(self, tokens: np.ndarray, weights: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.weights = tokens[order], weights[order]
        bits = max(20, (8 * len(tokens)).bit_length())  # one place in eight is taken at most
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.tokens & self.mask] = True
        self.lam, self.k = float(GRID[-1]), 1.0
        self.curve = np.full(BINS, 0.5)

    def word_weights(self, kinds: list[np.ndarray]) -> np.ndarray:
        """Of each word the weight of its longest significant token; 0 without one."""
        open_, weight = np.ones(len(kinds[0]), bool), np.zeros(len(kinds[0]))
        if not len(self.tokens):
            return weight
        for hashes in (kinds[0], *kinds[:0:-1]):
            maybe = np.flatnonzero(self.filter[hashes & self.mask] & open_)
            at = np.minimum(np.searchsorted(self.tokens, hashes[maybe]), len(self.tokens) - 1)
            known = self.tokens[at] == hashes[maybe]
            maybe, at = maybe[known], at[known]
            open_[maybe], weight[maybe] = False, self.weights[at]
        return weight

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """How surprising all segments together are; of none above the level, what the best falls short of it."""
        if not segments:
            return LOW
        excess = self.lam * np.array([s for _, _, s in segments]) - np.log(self.k * n + 1)
        over = excess[excess > 0].sum()
        return float(min(HIGH, np.interp(over, _SUM, _SURPRISE)) if over > 0 else max(LOW, excess.max()))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        return np.interp(evidence, centres, self.curve)


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa)."""
    positive = np.flatnonzero(weights > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(weights)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for p in positive.tolist():
        start, end, left, right = p, p + 1, float(total[p]), float(total[p + 1])
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, end, left, right))
    return [(a, b, r - x) for a, b, x, r in stack]


def _texts(scorer: Scorer, column: pa.Array):
    """For each text: its words' weights less the drift, and the words' byte ranges."""
    data, offsets = wordhash.buffers(column)
    for i, j in wordhash.steps(offsets):
        starts, ends, first, kinds = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        weights = scorer.word_weights(kinds) - DRIFT
        for r in range(j - i):
            a, b, lead = first[r], first[r + 1], offsets[i + r] - offsets[i]
            yield weights[a:b], starts[a:b] - lead, ends[a:b] - lead


def _apart(scorers: list[Scorer], column: pa.Array, fold: np.ndarray):
    """For each text: its words' weights by the whole model, and by the one that was learned without its part."""
    data, offsets = wordhash.buffers(column)
    for i, j in wordhash.steps(offsets):
        _, _, first, kinds = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        whole, apart, of = scorers[0].word_weights(kinds) - DRIFT, np.zeros(len(kinds[0])), np.repeat(fold[i:j], np.diff(first))
        for f in range(FOLDS):
            apart[of == f] = scorers[1 + f].word_weights([k[of == f] for k in kinds]) - DRIFT
        for r in range(j - i):
            yield whole[first[r] : first[r + 1]], apart[first[r] : first[r + 1]]


def _moments(train: DataFrame, shared) -> DataFrame:
    """Over the texts that aren't toxic, by model: texts, words, and for each of GRID the sums of
    exp(lambda weight) over words and of n exp(-lambda best segment) over texts."""

    def run(batches):
        total = np.zeros((1 + FOLDS, 2 + 2 * len(GRID)))
        for batch in batches:
            fold = batch.column(1).to_numpy()
            for f, pair in zip(fold.tolist(), _apart(shared.value, batch.column(0), fold)):
                for model, weights in zip((0, 1 + f), pair):
                    if len(weights):
                        values, times = np.unique(weights, return_counts=True)
                        best = max((s for _, _, s in segments(weights)), default=0.0)
                        total[model] += np.concatenate([[1, len(weights)], np.exp(np.outer(GRID, values)) @ times, len(weights) * np.exp(-GRID * best)])
        yield pa.RecordBatch.from_arrays([pa.array(range(1 + FOLDS), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["model", "sums"])

    return train.where(~F.col("toxic")).select("text", "fold").mapInArrow(trimmed(run), "model int, sums array<double>")


def _spread(train: DataFrame, shared) -> DataFrame:
    """(toxic, bin, n): texts by their evidence from the model that was learned without their part."""

    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            fold, toxic = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(int)
            for f, y, (_, weights) in zip(fold.tolist(), toxic.tolist(), _apart(shared.value, batch.column(0), fold)):
                e = shared.value[1 + f].evidence(segments(weights), len(weights))
                total[y, min(BINS - 1, int((e - LOW) / (HIGH - LOW) * BINS))] += 1
        y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(total[y, at])], names=["toxic", "bin", "n"])

    return train.select("text", "fold", "toxic").mapInArrow(trimmed(run), "toxic int, bin int, n long")


def _monotone(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Shares by bin that never fall (pool adjacent violators), drawn towards the whole's share by one
    text; bins without a text lie on the line between their neighbours."""
    base = (toxic.sum() + 0.5) / (toxic.sum() + other.sum() + 1)
    full = np.flatnonzero(toxic + other)
    if not len(full):
        return np.full(len(toxic), base)
    pools: list[tuple[float, float, int]] = []
    for t, o in zip(toxic[full], other[full]):
        t, o, k = float(t), float(o), 1
        while pools and pools[-1][0] * (t + o) >= t * (pools[-1][0] + pools[-1][1]):
            before = pools.pop()
            t, o, k = t + before[0], o + before[1], k + before[2]
        pools.append((t, o, k))
    shares = np.maximum.accumulate(np.concatenate([np.full(k, (t + base) / (t + o + 1)) for t, o, k in pools]))
    return np.interp(np.arange(len(toxic)), full, shares)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """From every text of ``docs`` with a label. An id with several labels is toxic if one says so."""
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col).cast("int")) > 0).alias("toxic"))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    train = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, F.col("id") == F.col("_id")).select("id", "text", "toxic")
    work = Tables(spark, "toxicity")
    train = _without_copies(train, work)
    scorers = [Scorer(*x) for x in _read(work.write("significant", _log_odds(work.write("counts", _presence(train)))))]
    work.drop("counts", "significant")
    shared = spark.sparkContext.broadcast(scorers)
    sums = _moments(train, shared).select("model", F.posexplode("sums").alias("i", "x")).groupBy("model", "i").agg(F.sum("x").alias("x")).collect()
    shared.destroy()
    moments = np.zeros((1 + FOLDS, 2 + 2 * len(GRID)))
    for r in sums:
        moments[r["model"], r["i"]] = r["x"]
    for scorer, (m, n, *rest) in zip(scorers, moments):
        if n:
            above = np.flatnonzero(np.array(rest[: len(GRID)]) / n >= 1)
            at = max(0, above[0] - 1) if len(above) else len(GRID) - 1
            scorer.lam, y = float(GRID[at]), rest[len(GRID) + at]
            scorer.k = float(m / y) if y else 1.0
    shared = spark.sparkContext.broadcast(scorers)
    counts = np.zeros((2, BINS))
    for r in _spread(train, shared).groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["toxic"], r["bin"]] = r["n"]
    shared.destroy()
    work.only()
    scorers[0].curve = (1 - RISE) * _monotone(counts[1], counts[0]) + RISE * np.arange(1, BINS + 1) / (BINS + 1)
    return scorers[0]


def score_texts(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``score`` (0 to 1), ``predicted`` (1 if score >= threshold),
    ``evidence``, and ``passages``: the significant segments (first and last byte, score).

    Null, empty or wordless texts have the least evidence and its score. Rows are taken one by one:
    repeated rows and null ids come out as they went in. Other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        scorer = shared.value
        for batch in batches:
            evidence, passages = [], []
            for weights, starts, ends in _texts(scorer, batch.column(1)):
                found = segments(weights)
                level = np.log(scorer.k * len(weights) + 1)
                evidence.append(scorer.evidence(found, len(weights)))
                passages.append([{"start": int(starts[a]), "end": int(ends[b - 1]), "score": s} for a, b, s in found if scorer.lam * s > level])
            score = scorer.score(np.array(evidence)) if evidence else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, pa.float64()), pa.array(passages, passage)], names=[id_col, "score", "predicted", "evidence", "passages"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, score double, predicted int, evidence double, passages array<struct<start:long,end:long,score:double>>")
