"""URL filters: rules by host and path, and gradient-boosted trees on lexical features.

DataFrame functions only. The trees are fitted on labelled URLs, of which a bounded sample is first
summed by binned features: what reaches the driver is a table of cells with counts. The fitted trees
are one SQL expression.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled URLs that the trees are fitted on at most (about, by a hash of the URL), bins of a feature.
SAMPLE, BINS = 20_000, 12
TREES, DEPTH, RATE, RIDGE = 24, 3, 0.3, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null without one). Rules are (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(letters, F.lit(0.0), lambda total, c: total - F.when((c == "") | (n == 0), 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last label of the host without a port."""
    return F.regexp_extract(host, r"([^.:]*)(?::\d*)?$", 1)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def features(url: Column, rates: dict[str, float], sizes: dict[str, float], base: float) -> dict[str, Column]:
    """Lexical features of a URL; suffix statistics come as tables, with at most as many rows as the sample."""
    text = F.coalesce(url, F.lit(""))
    h, p = host(text), path(text)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    length = F.length(text).cast("double")
    last = suffix(h)
    table = lambda values, other: F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(values)), "map<string,double>"), last), F.lit(other)) if values else F.lit(other)
    return {
        "length": length,
        "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"),
        "depth": _count(p, "/"),
        "labels": _count(h, "."),
        "digit_ratio": F.when(length > 0, _count(text, "0123456789") / length).otherwise(0.0),
        "host_digits": _count(h, "0123456789"),
        "hyphens": _count(h, "-_"),
        "path_marks": _count(p, "-_.%~"),
        "entropy": _entropy(h),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0),
        "secure": text.startswith("https:").cast("double"),
        "suffix_rate": table(rates, base),
        "suffix_size": table(sizes, 0.0),
    }


@dataclass
class Trees:
    """Boosted trees over binned features: each is (feature, bin) splits in heap order and leaf values."""

    names: list[str] = field(default_factory=list)
    cuts: dict[str, list[float]] = field(default_factory=dict)
    rates: dict[str, float] = field(default_factory=dict)
    sizes: dict[str, float] = field(default_factory=dict)
    base_rate: float = 0.5
    bias: float = 0.0
    trees: list[tuple[list[tuple[int, int] | None], list[float]]] = field(default_factory=list)

    def margin(self, url: Column) -> Column:
        """Log-odds of block."""
        given = features(url, self.rates, self.sizes, self.base_rate)

        def walk(splits, leaves, at=0):
            if at >= len(splits):
                return F.lit(leaves[at - len(splits)])
            if splits[at] is None:
                return walk(splits, leaves, 2 * at + 1)
            f, b = splits[at]
            name = self.names[f]
            return F.when(F.col(f"_f.{name}") <= self.cuts[name][b], walk(splits, leaves, 2 * at + 1)).otherwise(walk(splits, leaves, 2 * at + 2))

        self.inputs = F.struct(*[c.alias(n) for n, c in given.items()])
        trees = [walk(*t) for t in self.trees]
        return F.lit(self.bias) + (F.aggregate(F.array(*trees), F.lit(0.0), lambda a, b: a + b) if trees else F.lit(0.0))


def _boost(cells: np.ndarray, n: np.ndarray, positive: np.ndarray, bins: list[int]) -> tuple[float, list]:
    """Newton boosting of the logistic loss on cells of equal binned features."""
    rate = (positive.sum() + 0.5) / (n.sum() + 1)
    bias = float(np.log(rate / (1 - rate)))
    margin, trees = np.full(len(n), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = positive - n * p, n * p * (1 - p)
        node, splits = np.zeros(len(n), np.int64), []
        for depth in range(DEPTH):
            for at in range(2**depth - 1, 2 ** (depth + 1) - 1):
                rows = np.flatnonzero(node == at)
                best, gain = None, 1e-6
                for f, m in enumerate(bins):
                    gl, hl = (np.cumsum(np.bincount(cells[rows, f], x[rows], m)) for x in (g, h))
                    if not len(gl):
                        continue
                    got = gl**2 / (hl + RIDGE) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + RIDGE) - gl[-1] ** 2 / (hl[-1] + RIDGE)
                    b = int(np.argmax(got[:-1])) if m > 1 else 0
                    if m > 1 and got[b] > gain:
                        best, gain = (f, b), float(got[b])
                splits.append(best)
                node[rows] = 2 * at + 1 if best is None else 2 * at + 1 + (cells[rows, best[0]] > best[1])
        leaf = node - len(splits)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        margin += value[leaf]
        trees.append((splits, value.tolist()))
    return bias, trees


def fit_trees(labelled: DataFrame, url_col: str = "url", block_col: str = "block") -> Trees:
    """From URLs with a boolean label (rows with nulls are left out). Without rows: a model that says 1/2."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(block_col).cast("int").alias("block")).where("url IS NOT NULL AND block IS NOT NULL")
    total = rows.count()
    stride = max(1, -(-total // SAMPLE))
    rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(stride)) == 0)
    by_suffix = rows.groupBy(suffix(host(F.col("url"))).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")).orderBy("s").collect()  # as many as the sample has rows at most
    if not by_suffix:
        return Trees()
    base = sum(r["b"] for r in by_suffix) / sum(r["n"] for r in by_suffix)
    out = Trees(rates={r["s"]: (r["b"] + 10 * base) / (r["n"] + 10) for r in by_suffix}, sizes={r["s"]: float(np.log(r["n"])) for r in by_suffix}, base_rate=base)
    given = features(F.col("url"), out.rates, out.sizes, base)
    out.names = list(given)
    table = rows.select("block", *[c.alias(k) for k, c in given.items()])
    marks = table.agg(*[F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 1000).alias(k) for k in out.names]).first()
    out.cuts = {k: sorted(set(marks[k])) for k in out.names}
    bin_of = lambda k: sum(((F.col(k) > c).cast("int") for c in out.cuts[k]), F.lit(0))
    cells = table.groupBy(*[bin_of(k).alias(k) for k in out.names]).agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")).collect()
    at = np.array([[r[k] for k in out.names] for r in cells])
    order = np.lexsort(at.T[::-1])  # the same sums in every run
    n, b = np.array([r["n"] for r in cells], float), np.array([r["b"] for r in cells], float)
    out.bias, out.trees = _boost(at[order], n[order], b[order], [len(out.cuts[k]) + 1 for k in out.names])
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: Trees, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` (chance of block) and ``verdict``.

    The longest rule that fits decides, else block at a score above 1/2: a model without labelled rows
    allows. A null url has an empty host and path and is scored as the empty text. Columns of ``pages``
    with the new names are replaced; others may have any name.
    """
    url = F.col(url_col)
    new = ("host", "path", "rule", "verdict", "score")
    margin = model.margin(url)
    names = [c for c in pages.columns if c not in new or c == url_col]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host(url).alias("host"), path(url).alias("path"), model.inputs.alias("_f"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("row", "host", "path", rule.alias("rule"), (1 / (1 + F.exp(-margin))).alias("score"), verdict.alias("says"))
    final = F.coalesce("says", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], "host", "path", "rule", "score", final.alias("verdict"))
