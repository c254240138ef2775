"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for all other urls.

Features, suffix statistics and tree scores are DataFrame expressions. Suffix statistics count all labelled urls. The trees
are fitted on the driver to a bounded sample of different labelled urls, as histograms of gradients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import settle

#: The trees are fitted on this many different labelled urls at most, those with the least hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, LEAST_ROWS, BINS, RIDGE = 30, 3, 0.2, 20, 32, 1.0
PRIOR_WEIGHT = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null where none fits. Of equals the first in order of text."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in reversed(ranked):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    size = F.length(text).cast("double")

    def add(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.when(size > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


FEATURES = [
    "url_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "host_digits", "hyphens",
    "parameters", "query_chars", "fragment", "secure", "url_entropy", "host_entropy", "suffix_rate", "suffix_seen",
]


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds the lexical features, and ``suffix``, the last two labels of the host. Needs columns host and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    size = F.length(text).cast("double")
    return df.withColumns({
        "url_chars": size,
        "host_chars": F.length("host").cast("double"),
        "path_chars": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/[^/]"),
        "labels": _count(F.col("host"), r"[^.]+"),
        "digit_share": F.when(size > 0, _count(text, "[0-9]") / size).otherwise(0.0),
        "host_digits": _count(F.col("host"), "[0-9]"),
        "hyphens": _count(F.col("host"), "-"),
        "parameters": _count(query, "[^&]+"),
        "query_chars": F.length(query).cast("double"),
        "fragment": text.contains("#").cast("double"),
        "secure": text.startswith("https:").cast("double"),
        "url_entropy": _entropy(text),
        "host_entropy": _entropy(F.col("host")),
        "suffix": F.substring_index("host", ".", -2),
    })


@dataclass
class Trees:
    """A boosted model: a tree is ``(feature, threshold, low, high)`` or a leaf value; ``start`` is the first score."""

    start: float
    prior: float
    trees: list

    def score(self) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _as_column(tree)
        return total


def _as_column(tree: tuple | float) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, low, high = tree
    return F.when(F.col(FEATURES[feature]) <= float(threshold), _as_column(low)).otherwise(_as_column(high))


def boost(x: np.ndarray, y: np.ndarray, prior: float) -> Trees:
    """Trees of depth three for log loss, by sums of gradients over at most ``BINS`` quantile bins a feature."""
    start = float(np.log(prior / (1 - prior)))
    model = Trees(start, prior, [])
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), start)

    def grow(rows: np.ndarray, depth: int) -> tuple | float:
        total_g, total_h = slope[rows].sum(), curve[rows].sum()
        best = (1e-9, None, None)
        if depth and len(rows) >= 2 * LEAST_ROWS:
            for j, edges in enumerate(cuts):
                at = bins[rows, j]
                n = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
                g = np.cumsum(np.bincount(at, slope[rows], len(edges) + 1))[:-1]
                h = np.cumsum(np.bincount(at, curve[rows], len(edges) + 1))[:-1]
                gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        _, feature, edge = best
        if feature is None:
            value = float(-RATE * total_g / (total_h + RIDGE))
            score[rows] += value
            return value
        low = bins[rows, feature] <= edge
        return (feature, float(cuts[feature][edge]), grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = chance - y, chance * (1 - chance)
        model.trees.append(grow(np.arange(len(y)), DEPTH))
    return model


@dataclass
class Fitted:
    """Trees and the suffix statistics that their features need: ``(suffix, bad, seen)``, a row for each suffix of a labelled url."""

    trees: Trees
    suffixes: DataFrame


def _with_suffix(df: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """Adds the suffix features. Columns own_bad and own_seen of ``df`` are what its own url counts for, so labels don't tell themselves."""
    bad = F.coalesce("bad", F.lit(0.0)) - F.col("own_bad")
    seen = F.coalesce("seen", F.lit(0.0)) - F.col("own_seen")
    rate = (bad + PRIOR_WEIGHT * prior) / (seen + PRIOR_WEIGHT)
    return df.join(suffixes, "suffix", "left").withColumns({"suffix_rate": rate, "suffix_seen": F.log1p(seen)})


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", train_rows: int = TRAIN_ROWS) -> Fitted:
    """Learn from rows of url and label (1: block).

    Rows without a label are left out. A url that repeats is learnt from once, with the label that most of its rows have (of
    equals block), and all its rows count for its suffix. The trees see at most ``train_rows`` urls, the suffix statistics
    all. Without labels of both kinds, as of an empty table, all urls score alike.
    """
    known = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    known = known.groupBy("url").agg(F.sum("label").cast("double").alias("own_bad"), F.count("*").cast("double").alias("own_seen"))
    host, path = host_and_path(F.col("url"))
    known = settle(known.withColumns({"host": host, "path": path, "suffix": F.substring_index(host, ".", -2)}), "labelled-urls")
    suffixes = settle(known.groupBy("suffix").agg(F.sum("own_bad").alias("bad"), F.sum("own_seen").alias("seen")), "suffixes")
    counts = suffixes.agg(F.sum("bad"), F.sum("seen")).first()
    prior = ((counts[0] or 0) + 1) / ((counts[1] or 0) + 2)  # type: ignore[index]
    sample = lexical(known.orderBy(F.xxhash64("url"), "url").limit(train_rows), "url")
    label = (2 * F.col("own_bad") >= F.col("own_seen")).cast("int").alias("label")
    rows = _with_suffix(sample, suffixes, prior).orderBy(F.xxhash64("url"), "url").select(*FEATURES, label).collect()
    matrix = np.asarray([tuple(r) for r in rows], np.float64).reshape(-1, len(FEATURES) + 1)
    return Fitted(boost(matrix[:, :-1], matrix[:, -1], prior), suffixes)


def ruled(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, url, host, path, rule, said)`` of each row; rule and said, its verdict, are null where no rule fits."""
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, said = rule_columns(rules, F.col("host"), F.col("path"))
    return base.withColumns({"rule": rule, "said": said})


def judge(pages: DataFrame, rules: list[Rule], fitted: Fitted | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row for each row of ``pages``: the rule's verdict, or else the trees'.

    Without ``fitted`` the trees learn from the urls of ``pages`` that a rule decides. A null url has empty host and
    path; very long urls are read whole; repeated rows repeat; an empty table gives an empty result; other columns
    aren't looked at.
    """
    base = ruled(pages, rules, id_col, url_col)
    if fitted is None:
        fitted = fit(base.where(F.col("said").isNotNull()).select("url", (F.col("said") == "block").cast("int").alias("label")))
    ready = lexical(base, "url").withColumns({"own_bad": F.lit(0.0), "own_seen": F.lit(0.0)})
    scored = _with_suffix(ready, fitted.suffixes, fitted.trees.prior).withColumn("score", fitted.trees.score())
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0, "block").otherwise("allow")).alias("verdict")
    )
