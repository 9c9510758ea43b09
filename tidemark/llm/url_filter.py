"""Operator 10: URL filtering by rules, and by gradient-boosted trees on lexical features.

Everything is a DataFrame expression.  URLs that a rule decides are the labelled ones; from
those of four hosts in five a small ensemble of regression trees on the logistic loss learns
length, depth, digit ratio, entropy, parameter count and the block rate of host suffixes.

A suffix's rate for a labelled URL comes from other hosts' URLs (folds of hosts take turns),
never from its own label.  A suffix that no other labelled host has is a value of its own,
and half of the labelled URLs are learned from as if theirs were such, so that the trees know
how to judge by the other features alone.

Features fall into bins, and a sample of bounded size shrinks to one row per combination of
bins, so a tree level is one aggregation of gradients by node, feature and bin.  The trees
become a CASE expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ALLOW, BLOCK = "allow", "block"
#: Rules of the registered query: verdict, host and path.
RULES = ((ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/"))
#: About so many labelled URLs are sampled to fit the trees; statistics and bin borders take all.
SAMPLE = 200_000
TREES, DEPTH, RATE, RIDGE = 12, 3, 0.3, 1.0
#: Labelled URLs added to each suffix's, at the overall rate.
PRIOR = 20.0
#: Hosts fall into so many parts; the labelled URLs of the first are held out, the others take turns in suffix rates.
PARTS = 5
UNSEEN = -1.0
FEATURES = ("length", "depth", "digits", "entropy", "params", "suffix_rate")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null: its host is the URL's or a parent of it, and its path begins the URL's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules=RULES) -> Column:
    return reduce(lambda out, r: F.when(rule == r[1], F.lit(r[0])).otherwise(out), rules, F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Bits of Shannon entropy of a string's characters."""
    n = F.length(text).cast("double")
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    shares = F.transform(letters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(-F.aggregate(shares, F.lit(0.0), lambda total, p: total + p * F.log2(p)), F.lit(0.0))


def _lexical(rows: DataFrame) -> DataFrame:
    url, n = F.coalesce("url", F.lit("")), F.length(F.coalesce("url", F.lit(""))).cast("double")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": n,
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digits": F.coalesce(F.regexp_count(url, F.lit("[0-9]")) / F.nullif(n, F.lit(0.0)), F.lit(0.0)),
            "entropy": F.round(_entropy(url), 6),
            "params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
        }
    )


def _trees(binned: DataFrame, base: float) -> list:
    """Boosted trees on ``(f0, f1, ..., n, y)`` rows: each a nested ``(feature, bin, left, right)`` or a leaf's value."""
    trees: list = []
    names = [f"f{k}" for k in range(len(FEATURES))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).alias("bin")) for k, c in enumerate(names)]))
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-_score(trees, base)))
        rows = binned.withColumns({"g": F.col("y") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        tree = 0.0  # grows from a leaf; a leaf is named by its way from the root
        leaves = {0: ()}
        for _ in range(DEPTH):
            node = F.lit(-1)
            for number, way in leaves.items():
                node = F.when(_on(way), F.lit(number)).otherwise(node)
            # At most nodes x features x bins rows.
            sums = rows.withColumn("node", node).select("node", each.alias("e"), "g", "h").groupBy("node", "e.feature", "e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            grown = {}
            for number, way in leaves.items():
                cut = _best_cut([r for r in sums if r["node"] == number])
                if cut:
                    grown[2 * number + 1], grown[2 * number + 2] = (*way, (*cut[:2], True)), (*way, (*cut[:2], False))
                    for k, value in zip((2 * number + 1, 2 * number + 2), cut[2:], strict=True):
                        tree = _put(tree, grown[k], value)
            leaves = grown
            if not leaves:
                break
        if tree == 0.0:
            break
        trees.append(tree)
    return trees


def _on(way: tuple) -> Column:
    return reduce(lambda c, step: c & ((F.col(f"f{step[0]}") <= step[1]) == F.lit(step[2])), way, F.lit(True))


def _put(tree, way: tuple, value: float):
    """``tree`` with ``value`` in the leaf at the end of ``way``."""
    if not way:
        return value
    feature, cut, low = way[0]
    _, _, left, right = tree if isinstance(tree, tuple) else (feature, cut, 0.0, 0.0)
    return (feature, cut, _put(left, way[1:], value), right) if low else (feature, cut, left, _put(right, way[1:], value))


def _best_cut(sums: list) -> tuple | None:
    """``(feature, bin, left value, right value)`` of the split with the most gain; ties go to the first."""
    best, found = 1e-6, None
    for feature in range(len(FEATURES)):
        bins = sorted((r["bin"], r["g"], r["h"]) for r in sums if r["feature"] == feature)
        g, h = math.fsum(b[1] for b in bins), math.fsum(b[2] for b in bins)
        left_g = left_h = 0.0
        for cut, dg, dh in bins[:-1]:
            left_g, left_h = left_g + dg, left_h + dh
            right_g, right_h = g - left_g, h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g**2 / (h + RIDGE)
            if gain > best + 1e-9:
                best, found = gain, (feature, cut, round(RATE * left_g / (left_h + RIDGE), 9), round(RATE * right_g / (right_h + RIDGE), 9))
    return found


def _score(trees: list, base: float) -> Column:
    def value(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        feature, cut, left, right = tree
        return F.when(F.col(f"f{feature}") <= cut, value(left)).otherwise(value(right))

    return reduce(lambda total, t: total + value(t), trees, F.lit(float(base)))


def _suffix_rates(learned: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """Block rates ``suffix, suffix_rate`` of all learned URLs, and ``suffix, part, suffix_rate`` of those of the other parts."""
    each = learned.groupBy("suffix", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    whole = each.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))

    def smoothed(s: Column, n: Column) -> Column:
        return F.when(n > 0, (s + PRIOR * rate) / (n + PRIOR))

    others = each.join(whole, "suffix").select("suffix", "part", smoothed(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("suffix_rate"))
    return whole.select("suffix", smoothed(F.col("all_s"), F.col("all_n")).alias("suffix_rate")), others


def filtered(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """``id, host, path, rule, verdict, block_score, held_out`` for each row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path and no rule; the trees judge
    it by its other features.  Without URLs that a rule decides, the trees allow all.
    ``held_out`` marks URLs of hosts that the trees haven't learned from.  Rows with equal or
    null ids or URLs each keep a row; other columns aren't read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("ruled", _verdict(F.col("rule"), rules))
    rows = stored(_lexical(rows).withColumn("part", F.pmod(F.crc32("host"), F.lit(PARTS))), "urls")
    learned = rows.where("ruled IS NOT NULL AND part > 0").withColumn("y", (F.col("ruled") == BLOCK).cast("long"))
    total, blocked = learned.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def with_rate(df: DataFrame, rates: DataFrame, on: list[str]) -> DataFrame:
        return df.join(rates, on, "left").withColumn("suffix_rate", F.round(F.coalesce("suffix_rate", F.lit(UNSEEN)), 9))

    if not blocked or blocked == total:
        base, trees, binned = (-1.0 if not blocked else 1.0), [], rows
    else:
        base = math.log(blocked / (total - blocked))
        whole, others = _suffix_rates(learned, blocked / total)
        known = with_rate(learned, others, ["suffix", "part"])
        known = known.withColumn("suffix_rate", F.when(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2)) == 0, F.col("suffix_rate")).otherwise(F.lit(UNSEEN)))
        marks = known.agg(*[F.percentile_approx(c, F.array(*[F.lit(k / 16) for k in range(1, 16)]), 10_000).alias(c) for c in FEATURES]).first()
        cuts = {c: sorted(set(marks[c])) for c in FEATURES}

        def in_bins(df: DataFrame) -> DataFrame:
            bins = {f"f{k}": reduce(lambda n, cut, c=c: n + (F.col(c) > cut).cast("int"), cuts[c], F.lit(0)) for k, c in enumerate(FEATURES)}
            return df.withColumns(bins)

        share = min(1.0, sample / total)
        names = [f"f{k}" for k in range(len(FEATURES))]
        picked = in_bins(known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share * (1 << 20)))
        combined = stored(picked.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).coalesce(8), "bins")
        trees, binned = _trees(combined, base), in_bins(with_rate(rows, whole, ["suffix"]))
    score = F.round(1 / (1 + F.exp(-_score(trees, base))), 9)
    out = binned.withColumn("block_score", score).withColumn("verdict", F.coalesce("ruled", F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW)))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "block_score", (F.col("part") == 0).alias("held_out"))
