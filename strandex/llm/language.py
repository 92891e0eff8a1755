"""Language identification: script ranges, word scores, and Viterbi over the words.

A word is a run of letters (ASCII letters, or bytes of other characters). The script of its letters
narrows the languages to those that are written in it. Its score per language is the sum of log
probabilities of its byte trigrams (with word ends) and of the word as a whole, relative to the best.
Viterbi with a penalty for every switch labels the words, and so spans of one language; a document is
of the language that most of its letters are labelled with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandex.llm import wordhash
from strandex.llm.runtime import Tables

#: Hashed trigrams, then hashed words.
GRAMS, WORDS = 1 << 16, 1 << 16
FEATURES, PART = GRAMS + WORDS, 1 << 12
SCRIPTS = 24
#: Log-probability that a switch between two words costs, and prior counts of a feature.
SWITCH, PRIOR = 12.0, 0.5
#: A language is written in a script if this share of its letters is.
SCRIPT_SHARE = 0.01
_DAMP = 0.5  # trigrams overlap, so that their evidence counts less than if they were independent


def _tables():
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    letter[128:] = True
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    low[~letter] = 0
    # Script of a character by its first two bytes: ranges of code points, at the precision of 64 points.
    ranges = [(0xC0, 0x24F, 1), (0x370, 0x3FF, 2), (0x400, 0x52F, 3), (0x530, 0x58F, 4), (0x590, 0x5FF, 5), (0x600, 0x77F, 6), (0x900, 0x97F, 7), (0x980, 0x9FF, 8), (0xA00, 0xBFF, 9), (0xB80, 0xBFF, 10), (0xC00, 0xDFF, 11), (0xE00, 0xE7F, 12), (0xE80, 0xEFF, 13), (0xF00, 0xFFF, 14), (0x1000, 0x109F, 15), (0x10A0, 0x10FF, 16), (0x1100, 0x11FF, 17), (0x1200, 0x139F, 18), (0x1E00, 0x1EFF, 1), (0x1F00, 0x1FFF, 2), (0x3040, 0x30FF, 19), (0x3400, 0x9FFF, 20), (0xAC00, 0xD7AF, 17), (0xF900, 0xFAFF, 20)]
    script = np.zeros(1 << 16, np.int8)
    for low_point, high_point, k in ranges:
        for point in range(low_point, high_point + 1, 16):
            b = chr(point).encode()
            script[b[0] * 256 + b[1]] = k
    return letter, low, script


_LETTER, _LOW, _SCRIPT = _tables()


def _features(data: np.ndarray, offsets: np.ndarray):
    """Start, end, script and hash of each word, the first word of each row, and the trigram before each byte."""
    starts, ends, first = wordhash.spans(data, offsets, ~_LETTER)
    x = _LOW[data]
    up = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1  # À-Þ to à-þ
    x[up] |= 0x20
    pad = np.zeros(len(x) + 2, np.uint32)
    pad[1:-1] = x
    edge = np.zeros(len(x) + 1, bool)
    edge[offsets] = True
    before, after = pad[:-2].copy(), pad[2:].copy()
    before[edge[:-1]] = 0
    after[edge[1:]] = 0
    gram = ((before << 16) | (pad[1:-1] << 8) | after) * np.uint32(0x9E3779B1) >> np.uint32(16)
    word = wordhash.hashes(x, starts, ends)
    pair = data[:-1].astype(np.int64) * 256 + data[1:] if len(data) > 1 else np.zeros(0, np.int64)
    kind = np.zeros(len(data), np.int8)
    kind[:-1] = np.where(data[:-1] >= 0xC2, _SCRIPT[pair], 0)
    kind[(data < 128) & _LETTER[data]] = 1
    script = np.maximum.reduceat(kind, starts) if len(starts) else np.zeros(0, np.int8)
    return starts, ends, script, word, first, gram


def _word_slot(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(40)).astype(np.int64) % WORDS + GRAMS


def _counts(train: DataFrame) -> DataFrame:
    """(lang, part, counts): feature counts of all training texts, and in part -1 letters by script."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            data, offsets = wordhash.buffers(batch.column(0))
            for i, j in wordhash.steps(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, script, word, first, gram = _features(part, offsets[i : j + 1] - offsets[i])
                inside, slot = _LETTER[part], _word_slot(word)
                row_of_byte = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                row_of_word = np.repeat(np.arange(j - i), np.diff(first))
                for lang in set(langs[i:j]):
                    mine = langs[i:j] == lang
                    got = total.setdefault(lang, np.zeros(FEATURES + PART, np.int64))
                    got[:GRAMS] += np.bincount(gram[inside & mine[row_of_byte]], minlength=GRAMS)
                    own = mine[row_of_word]
                    got[:FEATURES] += np.bincount(slot[own], minlength=FEATURES)
                    got[FEATURES : FEATURES + SCRIPTS] += np.bincount(script[own], weights=(ends - starts)[own], minlength=SCRIPTS)[:SCRIPTS].astype(np.int64)
        for lang, got in total.items():
            parts = got.reshape(-1, PART)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts.tolist(), pa.list_(pa.int64()))], names=["lang", "part", "counts"])

    def add(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(-1, PART)
            for key, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), values):
                total[key] = total[key] + x if key in total else x.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], names=["lang", "part", "counts"])

    kind = "lang string, part int, counts array<long>"
    return train.mapInArrow(count, kind).repartition("part").mapInArrow(add, kind)


class Model:
    """Languages, log-probabilities of the features by language, and the scripts of each language."""

    def __init__(self, rows):
        counts: dict[str, np.ndarray] = {}
        for r in rows:
            counts.setdefault(r["lang"], np.zeros((FEATURES // PART + 1, PART)))[r["part"]] += np.asarray(r["counts"])
        self.langs = sorted(counts)
        logs, scripts = [], []
        for lang in self.langs:
            flat = counts[lang].ravel()
            parts = [x + PRIOR for x in (flat[:GRAMS], flat[GRAMS:FEATURES])]
            logs.append(np.concatenate([np.log(x / x.sum()) for x in parts]))
            letters = flat[FEATURES : FEATURES + SCRIPTS]
            scripts.append(letters >= SCRIPT_SHARE * max(1, letters.sum()))
        self.logs = np.array(logs, np.float32).T.copy() if logs else np.zeros((FEATURES, 0), np.float32)
        self.scripts = np.array(scripts).T.copy() if logs else np.zeros((SCRIPTS, 0), bool)


def fit_languages(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From every text with a language. What comes to the driver has a fixed size per language."""
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return Model(_counts(rows).toLocalIterator())


def _emissions(model: Model, starts, ends, script, word, gram) -> np.ndarray:
    """Relative log-likelihood of each word by language; those of other scripts are ruled out. Bytes are
    looked at in pieces: what a text needs is 4 bytes for each word and language."""
    out = np.zeros((len(starts), len(model.langs)), np.float32)
    for i, j in wordhash.blocks(starts, ends, max(1 << 12, (1 << 20) // max(1, len(model.langs)))):
        base = starts[i]
        total = np.vstack([np.zeros((1, len(model.langs))), np.cumsum(model.logs[gram[base : ends[j - 1]]], axis=0, dtype=np.float64)])
        score = _DAMP * (total[ends[i:j] - base] - total[starts[i:j] - base]) + _DAMP * model.logs[_word_slot(word[i:j])]
        allowed = model.scripts[np.clip(script[i:j], 0, SCRIPTS - 1)]
        allowed[~allowed.any(axis=1)] = True
        score -= score.max(axis=1, keepdims=True)
        score = np.maximum(score, -4 * SWITCH)  # a single odd word can't force two switches by much
        out[i:j] = np.where(allowed, score, -8 * SWITCH)
    return out


def viterbi(emissions: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The label of each word. Rows run side by side, longest first: word t of all rows is one step."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begins, lengths = first[:-1][order], n[order]
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(most), "left")  # rows with more than t words
    labels = np.zeros(len(emissions), np.int16)
    stays = np.zeros(emissions.shape, bool)
    best_before = np.zeros(len(emissions), np.int16)
    state, final = None, np.zeros(len(lengths), np.int16)
    for t in range(most):
        m = int(active[t])
        at = begins[:m] + t
        if t == 0:
            state = emissions[at].copy()
        else:
            gone = len(state) - m
            if gone:
                final[m : m + gone] = state[m:].argmax(axis=1)
                state = state[:m]
            top = state.argmax(axis=1)
            switch = state[np.arange(m), top] - penalty
            stay = state >= switch[:, None]
            stays[at], best_before[at] = stay, top
            state = np.where(stay, state, switch[:, None]) + emissions[at]
            state -= state.max(axis=1, keepdims=True)
    if most:
        final[: len(state)] = state.argmax(axis=1)
    now = final
    for t in range(most - 1, -1, -1):
        m = int(active[t])
        at = begins[:m] + t
        labels[at] = now[:m]
        if t:
            kept = stays[at, now[:m]]
            now[:m] = np.where(kept, now[:m], best_before[at])
    return labels


def _spans(labels, starts, ends, langs):
    cut = np.flatnonzero(np.diff(labels)) + 1
    return [{"start": int(starts[a]), "end": int(ends[b - 1]), "lang": langs[labels[a]]} for a, b in zip([0, *cut], [*cut, len(labels)])]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, ``lang_pred`` and ``score`` (0 to 1); with_spans: also ``spans``
    (array of first and last byte, and language).

    A null text or one without a letter: ``und``, score 0, no spans. The score is the share of the
    letters that are labelled with the language, times how surely the words of the text as a whole
    prefer it to the next. Ties go to the language first by name. Without any learned language every
    text is ``und``. Rows are taken one by one: repeated rows and null ids come out as they went in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<start:long,end:long,lang:string>>"

    def run(batches):
        model = shared.value
        k = len(model.langs)
        for batch in batches:
            data, offsets = wordhash.buffers(batch.column(1))
            has_letter = batch.column(2).to_numpy(zero_copy_only=False)
            parts, words, count = [], [], 0
            lang, score, spans = [], [], []

            def flush():
                if not words:
                    return
                emissions = np.vstack([w[0] for w in words])
                size = np.concatenate([w[1] for w in words])
                first = np.concatenate([[0], np.cumsum(np.concatenate([w[2] for w in words]))])
                labels = viterbi(emissions, first)
                letters = np.zeros((len(first) - 1, k))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                np.add.at(letters, (row, labels), size)
                total = np.zeros((len(first) - 1, k))
                for c in range(k):
                    total[:, c] = np.bincount(row, emissions[:, c], len(first) - 1)
                best = letters.argmax(axis=1)
                share = letters.max(axis=1) / np.maximum(1, letters.sum(axis=1))
                rest = total.copy()
                rest[np.arange(len(best)), best] = -np.inf
                lead = np.clip(total[np.arange(len(best)), best] - rest.max(axis=1, initial=-np.inf), -50, 50)
                lang.extend(model.langs[b] for b in best)
                score.extend((share / (1 + np.exp(-lead / 4))).tolist())
                if with_spans:
                    where = np.concatenate([w[3] for w in words]), np.concatenate([w[4] for w in words])
                    spans.extend(_spans(labels[a:b], where[0][a:b], where[1][a:b], model.langs) if b > a else [] for a, b in zip(first[:-1], first[1:]))
                words.clear()

            if k:
                for i, j in wordhash.steps(offsets):
                    part = data[offsets[i] : offsets[j]]
                    starts, ends, script, word, first, gram = _features(part, offsets[i : j + 1] - offsets[i])
                    lead = np.repeat(offsets[i:j] - offsets[i], np.diff(first))
                    words.append((_emissions(model, starts, ends, script, word, gram), (ends - starts).astype(float), np.diff(first), starts - lead, ends - lead))
                    count += len(starts)
                    if count > 4_000_000:
                        flush()
                        count = 0
                flush()
            none = ~has_letter if k else np.ones(len(has_letter), bool)
            lang = ["und" if x else y for x, y in zip(none.tolist(), lang or ["und"] * len(none))]
            score = [0.0 if x else y for x, y in zip(none.tolist(), score or [0.0] * len(none))]
            out = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                spans = [[] if x else y for x, y in zip(none.tolist(), spans or [[]] * len(none))]
                out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "lang_pred", "score", "spans"][: len(out)])

    rows = docs.select(id_col, text_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double" + (f", spans {span}" if with_spans else ""))
