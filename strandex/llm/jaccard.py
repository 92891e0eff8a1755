"""Exact n-gram Jaccard join with classes, by vertical partitioning.

A document's set is the distinct hashes of its word n-grams; the hash order is the global n-gram
order, cut into FRAGMENTS ranges. Overlaps of a pair are counted in each fragment on its own and
summed per pair. What remains is to verify few pairs, and still all that can matter:

1. Equal sets are one set from here on.
2. Each set has a sketch, its first SKETCH n-grams in the global order (the whole set up to WHOLE).
   If two sets link, every n-gram of their union is shared with a probability of 3/4 or more,
   independently of the order; they share fewer than SHARED of the sketch in less than 1e-12 of all
   links (in none if the sets are taken whole).
3. Each n-gram of the sketches has a pivot: of the sets that hold it, the one whose sketch is held
   most by other sets too, the middle of a group of near copies. Sets are compared with pivots only,
   and links make classes. A group costs one pair per member, not one per pair.
4. Sets that share SHARED sketch n-grams with sets of other classes stay open. For these alone the
   whole sets are looked at, by the exact prefix principle: n-grams that no other class holds come
   first, then the rarest, and linked sets must meet in the first n - ceil(3/4 n) + 1 of them. Sets
   that meet, directly or over others, make a neighbourhood; no link leaves one. A neighbourhood is
   cut into tiles of a bounded number of n-grams, and a pair of tiles is compared in one task: overlaps
   are counted fragment by fragment and summed, for the sets outside the largest class against all.
   A task returns a spanning forest of the links between classes, never pairs, so that a group costs
   a row per member. This finds every link between classes: they are exact whatever the pivots were.

``exact`` takes as sketch the first n - ceil(3/4 n) + SHARED n-grams instead, which holds the first
SHARED that linked sets have in common, without a probability: more rows, the same classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandex.llm import wordhash
from strandex.llm.runtime import Tables, trimmed

SKETCH, SHARED, WHOLE = 48, 12, 96
FRAGMENTS = 8
#: Sketch n-grams that a set shares with a pivot to be compared with it (fewer if the sketch is small).
#: Of no effect on the result, as step 4 is exact.
WITH_PIVOT = 4
#: n-grams of a tile, about; those of a task are twice as many. Places of shared n-grams looked up at once.
TILE, AT_ONCE = 1 << 20, 1 << 20
_CUTS = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
#: Ids broadcast to the texts at most (8 bytes each).
BROADCAST_IDS = 4_000_000

_SALT = np.array([0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03], np.uint64)


def shingle_sets(column: pa.Array, n: int):
    """For each text its sorted distinct n-gram hashes; a text of fewer words is one gram."""
    for words in wordhash.documents(column, wordhash.WHITE):
        if len(words) == 0:
            yield np.zeros(0, np.uint64)
        else:
            yield np.unique(wordhash.grams(words, min(n, len(words))))


def _longs(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _profile(docs: DataFrame, n: int, percent: int, exact: bool) -> DataFrame:
    """id, size, two hashes of the whole set, and its sketch."""

    def head(size):
        if exact:
            return size + percent * size // -100 + SHARED
        return size if size <= WHOLE else SKETCH

    def run(batches):
        for batch in batches:
            size, sums, sketch = [], [], []
            for grams in shingle_sets(batch.column(1), n):
                size.append(len(grams))
                sums.append([int(wordhash.mix(grams ^ s).sum(dtype=np.uint64)) for s in _SALT])
                sketch.append(grams[: head(len(grams))])
            a, b = (pa.array(np.array([x[k] for x in sums], np.uint64).view(np.int64)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), a, b, _longs(sketch)], names=["id", "n", "s1", "s2", "sketch"])

    return docs.mapInArrow(trimmed(run), "id long, n long, s1 long, s2 long, sketch array<long>")


def _exploded(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, gram) of the whole sets, of n grams."""

    def rows(ids, parts):
        size = np.array([len(x) for x in parts], np.int64)
        gram = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), size)), pa.array(np.repeat(size, size)), pa.array(gram.view(np.int64))], names=["id", "n", "gram"])

    def run(batches):
        for batch in batches:
            ids, parts, held = [], [], 0
            for doc, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n)):
                ids.append(doc)
                parts.append(grams)
                held += len(grams)
                if held > 100_000:
                    yield rows(ids, parts)
                    ids, parts, held = [], [], 0
            yield rows(ids, parts)

    return docs.mapInArrow(trimmed(run), "id long, n long, gram long")


def _fragments(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, s, fragment, grams): each set, of n grams and with the hash s, cut at fixed points of the global order."""

    def rows(ids, size, sums, frag, parts):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(frag, pa.int32()), _longs(parts)], names=["id", "n", "s", "fragment", "grams"])

    def run(batches):
        for batch in batches:
            held = ids, size, sums, frag, parts = [], [], [], [], []
            for doc, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n)):
                own = int(wordhash.mix(grams ^ _SALT[0]).sum(dtype=np.uint64))
                for f, part in enumerate(np.split(grams, np.searchsorted(grams, _CUTS))):
                    if len(part):
                        for x, y in zip(held, (doc, len(grams), own, f, part)):
                            x.append(y)
                if len(ids) >= 4096:
                    yield rows(*held)
                    held = ids, size, sums, frag, parts = [], [], [], [], []
            yield rows(*held)

    return docs.mapInArrow(trimmed(run), "id long, n long, s long, fragment int, grams array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, work: Tables, name: str, repeated: bool) -> DataFrame:
    """Of the pairs (a, b, na, nb) those that link, by overlaps counted per fragment and summed for each
    set of a with each of b. If ids repeat, a fragment of a set is taken once."""
    ids = work.write(f"{name}_ids", pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct())
    segments = _fragments(_of_ids(docs, ids), n)
    segments = work.write(f"{name}_segments", segments.dropDuplicates(["id", "n", "s", "fragment"]) if repeated else segments)
    left = segments.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, ["a", "na"]).join(right, ["b", "nb", "fragment"]).select("a", "b", "na", "nb", "sa", "sb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("overlap"))
    whole = partial.groupBy("a", "b", "na", "nb", "sa", "sb").agg(F.sum("overlap").alias("overlap"))
    links = work.write(f"{name}_links", whole.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b").distinct())
    work.drop(f"{name}_ids", f"{name}_segments")
    return links


def components(links: DataFrame, work: Tables, name: str) -> DataFrame:
    """(v, c): for every end of a link the least id that links reach. Links are (a, b) with a < b.

    Each round joins the ends' labels to the links, hooks every class to the least class that a link
    joins it to, and resolves chains of hooks by doubling. Only tables of links and labels move;
    labels are read from written tables, so that a class that holds most links can be split.
    """
    labels, step = None, 0
    while True:
        if labels is None:
            crossing = links.select(F.col("b").alias("high"), F.col("a").alias("low"))
        else:
            at_a, at_b = labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), labels.select(F.col("v").alias("b"), F.col("c").alias("cb"))
            crossing = links.join(at_a, "a").join(at_b, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low"))
        hooks = work.write(f"{name}_hooks{step}", crossing.groupBy(F.col("high").alias("v")).agg(F.min("low").alias("c")))
        if labels is not None and hooks.isEmpty():
            return labels
        jump = 0
        while True:  # c of v becomes c of c of v, until all c are ends of chains
            up = hooks.select(F.col("v").alias("c"), F.col("c").alias("up"))
            moved = work.write(f"{name}_jump{step}_{jump}", hooks.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"), F.col("up").isNotNull().alias("moved")))
            hooks, jump = moved.select("v", "c"), jump + 1
            if moved.where("moved").isEmpty():
                break
        up = hooks.select(F.col("v").alias("c"), F.col("c").alias("up"))
        if labels is None:
            ends = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
            new = ends.join(hooks, "v", "left").select("v", F.coalesce("c", "v").alias("c"))
        else:
            new = labels.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
        labels = work.write(f"{name}_labels{step}", new)
        work.drop(f"{name}_hooks{step}", *[f"{name}_jump{step}_{k}" for k in range(jump)], *[f"{name}_labels{step - 1}"] * (step > 0))
        step += 1


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids (column i)."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs["id"] == ids["i"], "left_semi")


def _need(n: str, percent: int):
    """Members that a set of n shares at least with a linked set."""
    return F.ceil(percent * F.col(n) / 100)


def _fits(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pivot_links(sets: DataFrame, grams: DataFrame, docs: DataFrame, n: int, percent: int, work: Tables, repeated: bool) -> DataFrame:
    """Links between sets and pivots (step 3)."""
    middle = grams.groupBy("id").agg((F.sum(F.log2("k")) / F.max("size")).alias("score"))
    scored = grams.join(middle, "id")
    pivots = work.write("pivots", scored.groupBy("gram").agg(F.max(F.struct("score", (-F.col("id")).alias("least"), "n")).alias("p")).select("gram", (-F.col("p.least")).alias("pivot"), F.col("p.n").alias("np")))
    met = grams.join(pivots, "gram").where((F.col("id") != F.col("pivot")) & _fits("n", "np", percent))
    pairs = met.groupBy("id", "pivot", "n", "np", "size").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= F.least(F.lit(WITH_PIVOT), F.ceil(F.col("size") / 4)))
    first = F.col("id") < F.col("pivot")
    pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), F.when(first, F.col("n")).otherwise(F.col("np")).alias("na"), F.when(first, F.col("np")).otherwise(F.col("n")).alias("nb")).distinct()
    pairs = work.write("pivot_pairs", _plausible(work.write("pivot_met", pairs), sets, percent))
    work.drop("pivots", "pivot_met")
    return _verified(pairs, docs, n, percent, work, "pivot", repeated)


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches allow a link."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("sketch").alias("kb")), "b").join(sets.select(F.col("id").alias("a"), F.col("sketch").alias("ka")), "a")
    need = F.least(F.lit(SHARED), _need("na", percent), _need("nb", percent))
    return both.where(F.size(F.array_intersect("ka", "kb")) >= need).select("a", "b", "na", "nb")


def _open_sets(grams: DataFrame, labels: DataFrame, docs: DataFrame, n: int, percent: int, work: Tables, repeated: bool) -> DataFrame:
    """(id, n, c, e, head, grams) of the sets that may link with one of another class (step 4): the
    n-grams that other classes hold too, their number, and which of them are the prefix."""
    classed = work.write("classed", grams.join(labels.withColumnRenamed("v", "id"), "id", "left").select("gram", "id", "n", F.coalesce("c", "id").alias("c")))
    several = work.write("several", classed.groupBy("gram").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("gram"))
    shared = classed.join(several, "gram").groupBy("id", "n", "c").agg(F.count(F.lit(1)).alias("m"))
    unsettled = work.write("unsettled", shared.where(F.col("m") >= F.least(F.lit(SHARED), _need("n", percent))).select(F.col("id").alias("i"), F.col("n").alias("ni"), "c"))
    work.drop("classed", "several")
    whole = _exploded(_of_ids(docs, unsettled.select("i").distinct()), n)
    whole = whole.distinct() if repeated else whole
    whole = work.write("whole", whole.join(unsettled, (F.col("id") == F.col("i")) & (F.col("n") == F.col("ni"))).select("id", "gram", "n", "c"))
    mixed = work.write("mixed", whole.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("gram", "df"))
    own = whole.join(mixed, "gram").groupBy("id", "n", "c").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("held"))
    # n - e n-grams come before these e; of the prefix, so many are left for these.
    left = F.size("held") - _need("n", percent) + 1
    gram = F.transform("held", lambda x: x["gram"])
    return own.where(left > 0).select("id", "n", "c", F.size("held").cast("long").alias("e"), F.slice(gram, F.lit(1), left.cast("int")).alias("head"), gram.alias("grams"))


def _neighbourhoods(open_: DataFrame, work: Tables) -> DataFrame:
    """(v, c): for each open set with a prefix n-gram in common with another the least id of its neighbourhood."""
    prefix = open_.select("id", F.explode("head").alias("gram"))
    first = prefix.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("gram", "a")
    star = prefix.join(first, "gram").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    return components(work.write("star", star), work, "near")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """The members dealt to pairs of tiles (bin, t, x, y), with ``left`` for those of tile x. Small
    neighbourhoods share a bin. Of a large one, members of the largest class meet all others, but not each other."""
    by_class = members.groupBy("near", "c").agg(F.sum("e").alias("w"))
    each = by_class.groupBy("near").agg(F.sum("w").alias("total"), F.max(F.struct("w", "c")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1")
    bins = members.agg(F.sum("e").alias("w")).select(F.ceil(F.coalesce("w", F.lit(0)) / tile).cast("int") + 1).first()[0]
    each = each.select(F.col("near").alias("_near"), F.col("most.c").alias("_c"), (F.col("total") <= tile).alias("bin"), F.ceil((F.col("total") - F.col("most.w")) / tile).alias("s"), F.ceil(F.col("most.w") / tile).alias("l"))
    at = members.join(each, F.col("near") == F.col("_near"))
    inner, place = F.col("c") != F.col("_c"), F.xxhash64("id")
    block = F.when(F.col("bin"), 0).when(inner, F.pmod(place, F.col("s"))).otherwise(F.col("s") + F.pmod(place, F.col("l")))
    other = F.when(F.col("bin"), 0).when(inner, F.col("s") + F.col("l") - 1).otherwise(F.col("s") - 1)
    t = F.when(F.col("bin"), F.pmod(F.xxhash64("near"), F.lit(bins))).otherwise(F.col("near"))
    dealt = at.select("bin", t.alias("t"), "near", "id", "n", "c", "grams", block.cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), other.cast("long"))).alias("other"))
    return dealt.select("bin", "t", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"), "near", "id", "n", "c", "grams")


def overlaps(grams: np.ndarray, places: np.ndarray, rows: np.ndarray, m: int, least: int) -> np.ndarray:
    """How many of the sorted ``grams`` each of m sets holds: counted in each fragment and summed. The sets
    are given as n-grams in order (``places``) and the set of each (``rows``). Stops when none can reach ``least``."""
    total, left = np.zeros(m, np.int64), len(grams)
    for part in np.split(grams, np.searchsorted(grams, _CUTS)):
        low, high = np.searchsorted(places, part, "left"), np.searchsorted(places, part, "right")
        ends = np.cumsum(high - low)
        at = 0
        while at < len(part):  # so many n-grams at once that their places are few
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            size = (high - low)[at:to]
            where = np.repeat(low[at:to] - np.cumsum(size) + size, size) + np.arange(size.sum())
            total += np.bincount(rows[where], minlength=m)
            at = to
        left -= len(part)
        if total.max(initial=0) + left < least:
            return np.zeros(m, np.int64)
    return total


def forest(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (row, row) of a left with a right set that join different classes; each joins two that were apart."""
    label, out = label.copy(), []
    flat = np.concatenate([sets[r] for r in right]) if len(right) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    places, rows = flat[order], np.repeat(np.arange(len(right)), [len(sets[r]) for r in right])[order]
    for x in left:
        if (label[right] == label[x]).all():
            continue
        shared = overlaps(sets[x], places, rows, len(right), -(-percent * int(n[x]) // 100))
        for y in right[(100 * shared >= percent * (n[x] + n[right] - shared)) & (shared > 0)]:
            if label[y] != label[x]:
                out.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return out


def _compare(percent: int):
    """A pair of tiles, or a bin of neighbourhoods -> links (a, b) that join classes."""

    def run(table: pa.Table) -> pa.Table:
        near, ids, n, c = (table.column(k).to_numpy() for k in ("near", "id", "n", "c"))
        left, own = table.column("left").to_numpy(), table.column("x")[0] == table.column("y")[0]
        grams = table.column("grams").combine_chunks()
        flat, at = grams.flatten().to_numpy().view(np.uint64), grams.offsets.to_numpy()
        at = at - at[0]
        sets = [np.sort(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        links = []
        order = np.argsort(near, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            if own:
                classes, count = np.unique(c[rows], return_counts=True)
                links += forest(sets, n, c, rows[c[rows] != classes[count.argmax()]], rows, percent)
            else:
                links += forest(sets, n, c, rows[left[rows]], rows[~left[rows]], percent)
        a, b = (np.array([ids[x[k]] for x in links], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def similar_sets(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles`` and ``component_id``.

    Two texts link when 100 * intersection >= percent * union of their n-gram sets (percent at least
    75, for which the sketch is proven, unless ``exact``). component_id is the least id that links reach, the own one
    included. A null or empty text, or one without words, has no set: n_shingles 0, linked with
    nothing. Repeated rows count once and get the same result; the texts of one id are one member, which
    links where one of them does. A null id takes part as no one: its row gets
    n_shingles and a null component. Other columns are not carried.
    """
    if percent < 75 and not exact:
        raise ValueError("the sketch is proven for 75 percent and more")
    work = Tables(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = work.write("full", _profile(docs, n, percent, exact))
    same = full.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2")
    sets = work.write("sets", same.agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")))
    profile = work.write("profile", full.select("id", "n", "s1", "s2"))
    work.drop("full")
    repeated = not profile.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()

    each = sets.select("id", "n", F.size("sketch").cast("long").alias("size"), F.explode("sketch").alias("gram"))
    several = work.write("shared", each.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    grams = work.write("grams", each.join(several, "gram"))
    work.drop("shared")
    links = _pivot_links(sets, grams, docs, n, percent, work, repeated)
    labels = components(links, work, "classes")
    open_ = work.write("open", _open_sets(grams, labels, docs, n, percent, work, repeated))
    work.drop("grams", "whole", "mixed", "unsettled")
    if not open_.isEmpty():
        near = _neighbourhoods(open_, work).select(F.col("v").alias("id"), F.col("c").alias("near"))
        members = work.write("members", open_.join(near, "id").select("near", "id", "n", "c", "e", "grams"))
        found = _tiles(members, TILE).groupBy("bin", "t", "x", "y").applyInArrow(_compare(percent), "a long, b long")
        found = work.write("found", found.where("a <> b").distinct())
        if not found.isEmpty():
            links = work.write("links", links.union(found).distinct())
            labels = components(links, work, "all_classes")
        work.drop("star", "members", "found")
    work.drop("open")
    # Back from sets to documents.
    named = work.write("named", sets.select("n", "s1", "s2", "id").join(labels.withColumnRenamed("v", "id"), "id", "left").select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("c", "id").alias("c")))
    work.only("profile", "named")
    out = profile.join(named, (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
