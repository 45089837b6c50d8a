"""Rules and gradient-boosted trees over lexical features of URLs; DataFrame functions only.

Rules settle the URLs they fit and label them for training. The others are judged by trees
on binned features: length, depth, digit ratio, entropy, parameter and separator counts, and
statistics of the host's suffix, which are counted over all rows. A tree grows level by
level: one aggregation sums gradients per node, feature and bin, and the driver reads these
sums (at most ``2**depth * features * 32`` rows) to choose the splits. Sums are of whole
millionths, so their order does not matter and reruns agree.

Trees are fitted on at most :data:`SAMPLE` labelled rows, those of the smallest hashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.session import cut_lineage

SAMPLE = 16_384
FEATURES = ("length", "host_length", "labels", "depth", "segment", "digits", "entropy", "parameters", "hyphens", "special", "suffix_count",
            "suffix_depth", "suffix_length", "secure")
_UNIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Boost:
    trees: int = 10
    depth: int = 3
    rate: float = 0.4
    ridge: float = 1.0


def parse(text: str, verdict: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(verdict, host, "/" + path)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "(?!^)")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(F.greatest(p, F.lit(1e-12))))).otherwise(F.lit(0.0))


def _bin(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(31)).cast("int")


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with ``f``, the binned features in the order of :data:`FEATURES`.

    Needs ``_url, _host, _path``. The suffix is the last two labels of the host.
    """
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    urls = urls.withColumn("_suffix", F.substring_index(host, ".", -2)).withColumn("_depth", _count(path, "/"))
    stats = urls.groupBy("_suffix").agg(
        F.count("*").alias("_n"), F.avg("_depth").alias("_mean_depth"), F.avg(F.length("_url")).alias("_mean_length"))
    joined = urls.join(stats, "_suffix")
    total = F.length(url)
    f = F.array(
        _bin(total / 4), _bin(F.length(host) / 2), _bin(_count(host, "\\.")), _bin(F.col("_depth")),
        _bin(F.length(F.substring_index(path, "/", -1))), _bin(31 * _count(url, "[0-9]") / F.greatest(total, F.lit(1))),
        _bin(6 * _entropy(host)), _bin(_count(url, "=")), _bin(_count(host, "-")), _bin(_count(url, "[%_~;@!$,+*]")),
        _bin(2 * F.log2(F.col("_n"))), _bin(4 * F.col("_mean_depth")), _bin(F.col("_mean_length") / 4),
        F.when(url.startswith("https:"), F.lit(1)).otherwise(F.lit(0)))
    return joined.withColumn("f", f)


def _leaf(tree: list, f: Column) -> Column:
    """The value of the leaf that features fall into; a tree is ``(feature, bin, left, right)`` or a number."""
    if isinstance(tree, float):
        return F.lit(tree)
    feature, cut, left, right = tree
    return F.when(F.get(f, F.lit(feature)) <= cut, _leaf(left, f)).otherwise(_leaf(right, f))


def margin(trees: list, start: float, f: Column) -> Column:
    out = F.lit(start)
    for t in trees:
        out = out + _leaf(t, f)
    return out


def _split(sums: dict[tuple[int, int], tuple[int, int]], ridge: float) -> tuple[tuple[int, int] | None, int, int]:
    """The best ``(feature, bin)`` of a node, and the node's sums of gradients and curvatures."""
    per: dict[int, list[tuple[int, int, int]]] = {}
    for (feature, b), (g, h) in sums.items():
        per.setdefault(feature, []).append((b, g, h))
    g_all, h_all = (sum(x[i] for x in per[min(per)]) for i in (1, 2))
    worth = lambda g, h: (g / _UNIT) ** 2 / (h / _UNIT + ridge)
    best, gain = None, 1e-6
    for feature in sorted(per):
        g = h = 0
        for b, dg, dh in sorted(per[feature])[:-1]:
            g, h = g + dg, h + dh
            won = worth(g, h) + worth(g_all - g, h_all - h) - worth(g_all, h_all)
            if won > gain + 1e-9:
                best, gain = (feature, b), won
    return best, g_all, h_all


def boosted(rows: DataFrame, how: Boost) -> tuple[list, float]:
    """Trees and starting margin for ``y`` (0 or 1) from the binned features ``f``."""
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    start = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    trees: list = []
    if len(counts) < 2:
        return trees, start
    for _ in range(how.trees):
        p = 1 / (1 + F.exp(-margin(trees, start, F.col("f"))))
        graded = rows.select("f", F.round((p - F.col("y")) * _UNIT).cast("long").alias("g"), F.round(p * (1 - p) * _UNIT).cast("long").alias("h"))
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        front = [1]
        for level in range(how.depth + 1):
            at = F.lit(1)
            for node in sorted(splits):
                feature, cut = splits[node]
                at = F.when(at == node, F.when(F.get("f", F.lit(feature)) <= cut, F.lit(2 * node)).otherwise(F.lit(2 * node + 1))).otherwise(at)
            placed = graded.select(at.alias("node"), "g", "h", F.posexplode("f").alias("feature", "bin")).filter(F.col("node").isin(front))
            sums: dict[int, dict] = {}
            for r in placed.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r.node, {})[r.feature, r.bin] = (r.g, r.h)
            following = []
            for node in front:
                best, g, h = _split(sums[node], how.ridge) if node in sums else (None, 0, 0)
                if best is None or level == how.depth:
                    leaves[node] = -how.rate * (g / _UNIT) / (h / _UNIT + how.ridge)
                else:
                    splits[node] = best
                    following += [2 * node, 2 * node + 1]
            front = following
            if not front:
                break

        def grown(node: int):
            return leaves[node] if node in leaves else (*splits[node], grown(2 * node), grown(2 * node + 1))

        trees.append(grown(1))
    return trees, start


def judged(pages: DataFrame, rules: Sequence[Rule], how: Boost = Boost(), sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``score`` is the trees' probability of ``block``, above one half a block where no rule
    fits. A null url, or one without ``://``, has an empty host and path and is judged by
    its features alone. Without rules that fit anything, or with rules of one verdict, the
    score is the same for all. Repeated rows come out as often as they come; other columns
    are not looked at. No rows, no result.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = address(url)
    rows = pages.select("page_id", url.alias("_url"), host.alias("_host"), path.alias("_path"))
    name, verdict = fitting(rules, F.col("_host"), F.col("_path"))
    rows = cut_lineage(lexical(rows.withColumn("rule", name).withColumn("_ruled", verdict)).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "_ruled", "f", F.xxhash64("_url").alias("_hash")))
    labelled = rows.filter("rule is not null").orderBy("_hash", "page_id").limit(sample)
    known = cut_lineage(labelled.select((F.col("_ruled") == "block").cast("int").alias("y"), "f"))
    trees, start = boosted(known, how)
    score = 1 / (1 + F.exp(-margin(trees, start, F.col("f"))))
    own = F.when(score > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), F.round(score, 9).alias("score"))
