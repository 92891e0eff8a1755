"""Embedding columns: combining, naming and pooling arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, functions as F

# Tracks in the order of embedding names, and the fields that hold them.
TRACKS = ("cage", "dnase", "atac", "rnaseq")
NAME = r"^(concat|add)_(tss_)?((?:cage|dnase|atac|rnaseq)(?:_(?:cage|dnase|atac|rnaseq))*)(?:_pca([0-9.]+))?$"


def field(track: str, tss: bool = False) -> str:
    if track not in TRACKS:
        raise ValueError(f"no track {track!r}")
    return f"concat_{'rna_seq' if track == 'rnaseq' else track}_{'tss500_mean' if tss else 'mean'}"


def embedding_names(widths: Mapping[str, int]) -> list[str]:
    """All embeddings that fields of these widths support: every set of tracks, whole or near the start,
    side by side, or summed over the two halves if all widths are even; then every other field."""
    names, used = [], set()
    for tss in (False, True):
        have = [t for t in TRACKS if widths.get(field(t, tss), 0) > 0]
        used |= {field(t, tss) for t in have}
        for k in range(1, len(have) + 1):
            for tracks in combinations(have, k):
                even = all(widths[field(t, tss)] % 2 == 0 for t in tracks)
                names += [f"{mode}_{'tss_' if tss else ''}{'_'.join(tracks)}" for mode in (("concat", "add") if even else ("concat",))]
    return names + [f for f, w in widths.items() if w > 0 and f not in used and f not in names]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False)))


def halves_sum(v: Column) -> Column:
    """First half plus second half; an odd width gives null."""
    h = (F.size(v) / 2).cast("int")
    return F.when(F.size(v) % 2 == 0, F.zip_with(F.slice(v, F.lit(1), h), F.slice(v, h + 1, h), lambda a, b: a + b))


def combine(blocks: Sequence[Column], mode: str) -> Column:
    """``concat``: side by side; ``add``: each block's halves summed first."""
    if mode not in ("concat", "add"):
        raise ValueError(f"no mode {mode!r}")
    return F.concat(*[halves_sum(b) if mode == "add" else b for b in blocks])


def embedding(name: str, columns: Sequence[str]) -> Column:
    """The column ``name`` itself if it is stored, else derived from the track fields."""
    if name in columns:
        return F.col(name)
    mode, *rest = name.split("_")
    tss = rest[:1] == ["tss"]
    fields = [field(t, tss) for t in rest[tss:]]
    missing = [f for f in fields if f not in columns]
    if mode not in ("concat", "add") or not fields or missing:
        raise ValueError(f"{name}: not an embedding of these fields {missing}")
    return combine([F.col(f) for f in fields], mode)


def masked_mean(values: Column, mask: Column, least: float = 1e-8) -> Column:
    """Mean of an array where the mask is 1; 0 if it is nowhere."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, b: a + b)
    n = F.aggregate(mask, F.lit(0.0), lambda a, b: a + b)
    return total / F.greatest(n, F.lit(least))


def prefix_mean(values: Column, k: int = 500) -> Column:
    """Mean of the first k values, whatever they are; of all if there are fewer."""
    head = F.slice(values, 1, k)
    return F.aggregate(head, F.lit(0.0), lambda a, b: a + b) / F.size(head)


def name_parts(name: Column) -> tuple[Column, Column, Column, Column]:
    """mode, near the start, tracks in the usual order, PCA suffix (null without one)."""
    tracks = F.regexp_extract(name, NAME, 3)
    ordered = F.array_join(F.filter(F.array(*[F.when(F.array_contains(F.split(tracks, "_"), t), F.lit(t)) for t in TRACKS]), lambda x: x.isNotNull()), "_")
    return F.regexp_extract(name, NAME, 1), F.regexp_extract(name, NAME, 2) != "", ordered, F.nullif(F.regexp_extract(name, NAME, 4), F.lit(""))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
