"""Benchmark decontamination by winnowing.

Words are hashed; of every WINDOW consecutive word K-grams the least hash is kept as a fingerprint,
on both sides by the same rule. Two texts that share SPAN = K + WINDOW - 1 words in a row share the
grams of that run and so its fingerprint: no shared run of that length is missed. The fingerprints
of the documents are looked up among those of the benchmark, and every hit is extended to both
sides, word by word, along its alignment; a run of SPAN words or more counts. Items of fewer than
SPAN words count as one window of all their words.

A benchmark of up to BLOCK_BYTES is held in memory by the tasks, and the documents are scanned once
and never shuffled. A larger one is dealt to small blocks: the fingerprints of the documents, thinned
by a bitmap of bounded size, are joined with those of the blocks, and only texts that share one with
a block are sent to it, in groups of a bounded size, to be extended. Both ways read the documents
once for their fingerprints and find the same.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandex.llm import wordhash
from strandex.llm.runtime import Tables, trimmed

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
#: Bytes of a benchmark that is held whole, and of a block of a larger one, about (items are dealt by hash).
BLOCK_BYTES, PART_BYTES = 8 << 20, 1 << 20
#: Bytes of documents that one task extends against a block, about.
GROUP_BYTES = 32 << 20
#: Fingerprints of a benchmark that are broadcast to the join (12 bytes each); beyond, it is a shuffle in which
#: a document's fingerprints go to one of SALT places of each value, so that one in many texts is spread.
BROADCAST_MARKS, SALT = 1 << 20, 8
#: Bits of the bitmap at most (32 MB).
BITMAP_BITS = 28
_FILTER_BITS = 20
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of ``words``, and for each run of SPAN words the least of its grams."""
    grams = wordhash.grams(words, K)
    m = len(words) - SPAN + 1
    if m <= 0:
        return grams, np.zeros(0, np.uint64)
    least = grams[:m].copy()
    for j in range(1, WINDOW):
        np.minimum(least, grams[j : j + m], out=least)
    return grams, least


def _position(grams: np.ndarray, start: int) -> int:
    return start + int(np.argmin(grams[start : start + WINDOW]))


class Block:
    """Fingerprints and words of some benchmark items."""

    def __init__(self, ids: list[str], texts: pa.Array):
        self.ids, self.words = ids, list(wordhash.documents(texts, wordhash.NOT_ALNUM))
        at: dict[int, set[tuple[int, int]]] = defaultdict(set)
        short: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, words in enumerate(self.words):
            if 0 < len(words) < SPAN:
                short[len(words)][int(wordhash.grams(words, len(words))[0])].add(i)
                continue
            grams, least = _fingerprints(words)
            # Of windows of the same words, the first: a run of repeated words isn't met once for each of them.
            for start in np.unique(wordhash.grams(words, SPAN), return_index=True)[1].tolist():
                value = int(least[start])
                at[value].add((i, _position(grams, start)))
        self.at = {k: sorted(v) for k, v in at.items()}
        self.short = {n: {k: sorted(v) for k, v in x.items()} for n, x in short.items()}
        self.filters = {n: self._filter(x) for n, x in [(0, self.at), *self.short.items()] if x}

    @staticmethod
    def _filter(keys: dict[int, object]) -> np.ndarray:
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[np.fromiter(keys, np.uint64, len(keys)) & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return out

    def _known(self, n: int, values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Places whose value is a key."""
        if n not in self.filters or not len(values):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filters[n][values & np.uint64((1 << _FILTER_BITS) - 1)] & valid)
        keys = self.at if n == 0 else self.short[n]
        return np.array([i for i, v in zip(maybe.tolist(), values[maybe].tolist()) if v in keys], np.int64)

    def scan(self, words: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """For each text of a step with a hit: runs of hit words [start, end), and items.

        ``words``: of all texts in a row; ``first``: where each text begins, and the end.
        """
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = defaultdict(lambda: ([], set()))
        grams, least = _fingerprints(words)
        starts = self._known(0, least, row[: len(least)] == row[SPAN - 1 :] if len(least) else np.zeros(0, bool))
        done: dict[tuple[int, int, int], int] = {}
        for start in starts.tolist():
            p, r = _position(grams, start), int(row[start])
            for item, q in self.at[int(least[start])]:
                line = (r, item, p - q)
                if done.get(line, -1) >= p:  # inside a run that was extended before
                    continue
                mine, its = words[first[r] : first[r + 1]], self.words[item]
                at = p - int(first[r])
                back, ahead = min(at, q), min(len(mine) - at, len(its) - q)
                same = mine[at - back : at + ahead] == its[q - back : q + ahead]
                if not same[back]:
                    done[line] = p
                    continue
                gaps = np.flatnonzero(~same)
                k = int(np.searchsorted(gaps, back))
                low = int(gaps[k - 1]) + 1 if k else 0
                high = int(gaps[k]) if k < len(gaps) else len(same)
                done[line] = p - back + high - 1
                if high - low >= SPAN:
                    out[r][0].append((at - back + low, at - back + high))
                    out[r][1].add(item)
        for n, keys in self.short.items():
            values = wordhash.grams(words, n)
            for start in self._known(n, values, row[: len(values)] == row[n - 1 :] if len(values) else np.zeros(0, bool)).tolist():
                r = int(row[start])
                out[r][0].append((start - int(first[r]), start - int(first[r]) + n))
                out[r][1].update(keys[int(values[start])])
        return out


def _covered(runs: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _steps(column: pa.Array):
    """Words of about STEP_BYTES of texts at a time, and where each text begins."""
    data, offsets = wordhash.buffers(column)
    for i, j in wordhash.steps(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = wordhash.spans(part, offsets[i : j + 1] - offsets[i], wordhash.NOT_ALNUM)
        yield wordhash.hashes(part, starts, ends), first


def _scan(block: Block, column: pa.Array) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """For each text: its number of words, its runs, and the ids of its items."""
    n_words, runs, items = [], [], []
    for words, first in _steps(column):
        hits = block.scan(words, first)
        n_words += np.diff(first).tolist()
        for r in range(len(first) - 1):
            got = hits.get(r, ((), ()))
            runs.append([{"start": a, "end": b} for a, b in sorted(set(got[0]))])
            items.append(sorted({block.ids[x] for x in got[1]}))
    return n_words, runs, items


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def _item_marks(batches):
    """Per item: its block, its number of words if it is short, else 0, and its fingerprints."""
    for batch in batches:
        marks, short = [], []
        for words in wordhash.documents(batch.column(1), wordhash.NOT_ALNUM):
            small = len(words) < SPAN
            short.append(len(words) if small else 0)
            marks.append(np.unique(_fingerprints(words)[1]) if not small else wordhash.grams(words, len(words)) if len(words) else np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.int32()), _lists(marks)], names=["block", "short", "marks"])


def _text_marks(words: np.ndarray, first: np.ndarray, lengths: list[int], bitmap: np.ndarray) -> list[np.ndarray]:
    """For each text its different fingerprints that the bitmap holds, and those of short items' ``lengths``."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n, found in [(SPAN, _fingerprints(words)[1]), *((n, wordhash.grams(words, n)) for n in lengths)]:
        if len(found):
            slot = found & np.uint64(64 * len(bitmap) - 1)
            known = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            at = np.flatnonzero(known.astype(bool) & (row[: len(found)] == row[n - 1 :]))
            rows.append(row[at])
            values.append(found[at])
    r, v = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((v, r))
    r, v = r[order], v[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.split(v[new], np.searchsorted(r[new], np.arange(1, len(first) - 1)))


def _bitmap(marks: DataFrame, n: int) -> np.ndarray:
    """One bit for each value of the low bits of the fingerprints, in words of 64, eight bits a fingerprint if they fit."""
    bits = min(BITMAP_BITS, max(10, (8 * n).bit_length()))
    words = marks.select((F.col("value").bitwiseAND(F.lit((1 << bits) - 1))).alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["i"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return out


def _joined(keyed: DataFrame, kind: str, items: DataFrame, n: int, work: Tables) -> DataFrame:
    """Scans texts against the blocks that they share a fingerprint with: id, hash, n_words, runs, items."""
    spark = keyed.sparkSession
    items = work.write("items", items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")))
    own = work.write("own", items.select("block", "text").mapInArrow(trimmed(_item_marks), "block int, short int, marks array<long>"))
    lengths = sorted(r[0] for r in own.where("short > 0").select("short").distinct().collect())
    marks = work.write("marks", own.select("block", F.explode("marks").alias("value")).distinct())
    n_marks = marks.count()
    bitmap = spark.sparkContext.broadcast(_bitmap(marks, n_marks))

    def look(batches):
        for batch in batches:
            n_words, values = [], []
            for words, first in _steps(batch.column(1)):
                n_words += np.diff(first).tolist()
                values += _text_marks(words, first, lengths, bitmap.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n_words, pa.int64()), _lists(values)], names=["id", "hash", "n_bytes", "n_words", "marks"])

    sized = keyed.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    seen = work.write("seen", sized.mapInArrow(trimmed(look), f"id {kind}, hash long, n_bytes long, n_words long, marks array<long>"))
    bitmap.unpersist()
    values = seen.select("id", "hash", "n_bytes", F.explode("marks").alias("value"))
    if n_marks <= BROADCAST_MARKS:
        met = values.join(F.broadcast(marks), "value")
    else:
        met = values.withColumn("salt", F.pmod("hash", F.lit(SALT)).cast("int")).join(marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["value", "salt"])
    pairs = work.write("pairs", met.groupBy("id", "hash", "block").agg(F.max("n_bytes").alias("n_bytes")))
    parts = work.write("parts", pairs.groupBy("block").agg(F.ceil(F.sum("n_bytes") / GROUP_BYTES).cast("int").alias("n_parts")))
    parts = F.broadcast(parts) if n <= BROADCAST_MARKS else parts
    part = F.pmod(F.xxhash64("id", "hash"), F.greatest("n_parts", F.lit(1))).cast("int")
    wanted = pairs.join(parts, "block").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "block", part.alias("part"))
    # Rows that repeat an id and its text are one text here.
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).groupBy("id", "hash", "block", "part").agg(F.first("text").alias("text"))
    dealt = items.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_parts"), F.lit(1)) - 1))).select("block", "part", "id", "text")

    def meet(docs: pa.Table, own: pa.Table) -> pa.Table:
        if not docs.num_rows:
            runs = items = []
        else:
            _, runs, items = _scan(Block(own["id"].to_pylist(), own["text"]), docs["text"])
        return pa.table({"id": docs["id"], "hash": docs["hash"], "runs": pa.array(runs, _SPAN), "items": pa.array(items, pa.list_(pa.string()))})

    hits = texts.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(meet, f"id {kind}, hash long, runs array<struct<start:long,end:long>>, items array<string>")
    hits = hits.where(F.size("runs") > 0).groupBy("id", "hash").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = work.write("hits", hits.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "runs", "items"))
    work.only("seen", "hits")
    joined = seen.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    return joined.select("id", "hash", "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit, n_items, items_sha256, contaminated, and ``runs``
    (array of start and end word of what is shared) and ``items`` (ids as sorted strings).

    A null or empty text has no words and no hits. An empty benchmark hits nothing. Items with a
    null or wordless text never occur; a null item id counts as the empty string, and items that
    repeat an id count once. Repeated rows of ``docs`` each get their result. Other columns are
    not carried, so that their names can't clash.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    if size > BLOCK_BYTES:
        return _report(_joined(rows.withColumn("hash", F.xxhash64("text")), kind, items, math.ceil(size / PART_BYTES), Tables(spark, "decontam")), id_col)
    table = items.toArrow()
    shared = spark.sparkContext.broadcast(Block(table["id"].to_pylist(), table["text"]))

    def run(batches):
        for batch in batches:
            yield _reported(batch.column(0), id_col, *_scan(shared.value, batch.column(1)))

    return _flagged(rows.mapInArrow(trimmed(run), _columns(id_col, kind)))


def _columns(id_col: str, kind: str) -> str:
    return f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, runs array<struct<start:long,end:long>>, items array<string>"


def _reported(ids: pa.Array, id_col: str, n_words: list[int], runs: list[list[dict]], items: list[list[str]]) -> pa.RecordBatch:
    hit = [_covered([(x["start"], x["end"]) for x in r]) for r in runs]
    sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
    arrays = [ids, pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array(runs, _SPAN), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "runs", "items"])


def _flagged(found: DataFrame) -> DataFrame:
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _report(found: DataFrame, id_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield _reported(batch.column(0), id_col, *(batch.column(c).to_pylist() for c in ("n_words", "runs", "items")))

    return _flagged(found.mapInArrow(trimmed(run), _columns(id_col, found.schema["id"].dataType.simpleString())))
