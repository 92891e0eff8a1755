"""From sequences to pooled embeddings: a pluggable model inside one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandex.functions import sequence

TSS = 500
#: token ids (n, L) -> track values by field of the model, each (n, L, channels).
Tracks = dict[str, np.ndarray]
Model = Callable[[np.ndarray], Tracks]


@dataclass(frozen=True)
class Limits:
    """What a packaged model takes: greatest length, a multiple, least length, sequences of a batch."""

    longest: int = sequence.LIMIT
    multiple: int = sequence.MULTIPLE
    least: int = sequence.LEAST
    batch: int = 32

    def status(self, length: int, batch: int = 1) -> str:
        return "too_long" if length > self.longest else "too_many" if batch > self.batch else "ok"


def limits(file_name: str) -> Limits:
    """From the name of a package: ..._dyn_a100... takes any length, ..._L<n>_... one length only."""
    if "_dyn_a100" in file_name:
        return Limits()
    fixed = re.search(r"_L(\d+)_", file_name)
    if not fixed:
        raise ValueError(f"{file_name}: no length in the name")
    n = int(fixed[1])
    return Limits(n, n, n, 32)


def stub_model(ids: np.ndarray, channels: Sequence[tuple[str, int]] = (("cage", 2), ("dnase", 1), ("atac", 1), ("rna_seq", 3))) -> Tracks:
    """A deterministic stand-in: channel c of a track is ids * (c + 1) modulo 7, by track."""
    return {name: np.stack([(ids * (c + 1) + k) % 7 for c in range(n)], axis=2).astype(np.float32) for k, (name, n) in enumerate(channels)}


def pooled(values: np.ndarray, valid: np.ndarray, tss: int = TSS) -> tuple[np.ndarray, np.ndarray]:
    """Mean over valid positions, and over the first ``tss`` positions whatever they are."""
    mask = valid[:, :, None].astype(np.float64)
    body = (values * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-8)
    return body, values[:, :tss].astype(np.float64).mean(axis=1)


def batch_rows(length: int, large: bool = True) -> int:
    """Sequences of a batch by their length (see functions.sequence.batch_size)."""
    if length >= 300_000:
        return 1
    for most, n in ((8192, 16), (25344, 8), (51712, 4), (124672, 2), (197888, 1)):
        if length <= most:
            return n * (2 if large else 1)
    return 2


def with_padding_length(df: DataFrame) -> DataFrame:
    """Adds ``pad``: the common padded length of the gene's sequences, from one small aggregate."""
    per_gene = df.groupBy("gene_id").agg(sequence.padding_length(F.max(F.greatest(F.length("ref_seq"), F.length("hap1"), F.length("hap2")))).alias("pad"))
    return df.join(per_gene, "gene_id")


def embed(df: DataFrame, make_model: Callable[[], Model] | None = None, package: Limits = Limits()) -> DataFrame:
    """gene_id, subject, field, vector: both haplotypes' pooled tracks side by side, in long form.

    ``df``: gene_id, subject, ref_seq, hap1, hap2. ``make_model`` runs once per worker. Track values
    never leave the pass. Longer sequences than the
    package takes give one row with a status, and no batch is larger than it takes.
    """
    rows = with_padding_length(df).select("gene_id", "subject", "hap1", "hap2", "pad")
    table = np.full(0x110000, sequence.UNKNOWN, np.int16)
    for token, i in sequence.IDS.items():
        if len(token) == 1:
            table[ord(token)] = i

    def ids_of(text: str, length: int) -> np.ndarray:
        out = np.full(length, sequence.PAD, np.int16)
        codes = np.frombuffer(text[:length].encode("utf-32-le"), np.uint32)
        out[: len(codes)] = table[codes]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model() if make_model else stub_model
        for batch in batches:
            out = []
            for (gene, pad), group in batch.groupby(["gene_id", "pad"], sort=False):
                status = package.status(int(pad))
                if status != "ok":
                    out += [(gene, s, None, None, status) for s in group["subject"]]
                    continue
                step = min(batch_rows(int(pad)), package.batch)
                for k in range(0, len(group), step):
                    part, both = group.iloc[k : k + step], []
                    for hap in ("hap1", "hap2"):
                        ids = np.stack([ids_of(t or "", int(pad)) for t in part[hap]])
                        tracks = model(ids)
                        both.append({n: pooled(v, ids != sequence.PAD) for n, v in tracks.items()})
                    for name in both[0]:
                        for which, region in enumerate(("mean", f"tss{TSS}_mean")):
                            joined = np.hstack([b[name][which] for b in both])
                            out += [(gene, s, f"concat_{name}_{region}", v.tolist(), "ok") for s, v in zip(part["subject"], joined)]
            yield pd.DataFrame(out, columns=["gene_id", "subject", "field", "vector", "status"])

    return rows.mapInPandas(run, "gene_id string, subject string, field string, vector array<double>, status string")
