"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

Everything is DataFrame expressions: features, their bins, gradients and the
histograms behind each split are SQL aggregations; the driver only sees one
histogram a tree level (nodes x features x bins, whatever the table's size) and
writes the next tree as a CASE expression. A URL that a rule fits gets the rule's
verdict; those URLs are also the labelled ones from which the trees learn, and
any frame of labelled URLs can take their place.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the
URL's path starts with the rule's path; the longest rule (host and path) wins.

Suffix statistics: how many URLs end in the host's last two labels (log), how many
of the labelled ones there are blocked, smoothed, and the same for the first path
segment. Every suffix and segment has its own row; the table is sent to the executors
if its counted rows allow it, else joined. A labelled URL's own label must not tell its
verdict, so its block rates come from the ``FOLDS - 1`` folds of URLs (by hash) that it
is not in; the trees learn from such rates, and URLs without a label get those of all.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is judged by the trees; without labelled URLs of both kinds the
method's verdict is allow; repeated rows are judged alike; a very long URL is read
whole; cuts that gain alike go to the first feature and the smallest bin; an empty
table gives an empty result; extra columns stay, and those of the added names are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import hash_sample
from strandloom.plans import scratch

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BINS, TREES, DEPTH, RATE, RIDGE, FOLDS = 16, 8, 3, 0.5, 1.0, 5
#: The suffix table is sent to the executors up to this many rows of about 150 bytes, else joined.
MAX_SENT_ROWS = 200_000
#: Labelled URLs used to grow trees at most; statistics and features cover all URLs.
MAX_TRAIN_URLS = 20_000
FEATURES = ("url_length", "host_length", "depth", "digit_share", "entropy", "n_params", "n_labels", "hyphens", "suffix_log_count", "suffix_block_rate", "segment_log_count", "segment_block_rate")


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """With host and path (columns of these names are replaced)."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, F.lit("://"))
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return df.withColumns({"host": _lower_ascii(host), "path": F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)})


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """With rule (null where none fits) and ruled, its verdict."""
    host, path = F.col("host"), F.col("path")
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(url), F.lit(""))), F.lit(FOLDS)).cast("int")


def _suffix(n: int) -> Column:
    return F.substring_index(F.col("host"), ".", -n)


def _segment() -> Column:
    return F.split_part(F.col("path"), F.lit("/"), F.lit(2))


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits: -sum over distinct characters."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(c, ""))
    share = F.transform(chars, lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(df: DataFrame, url: str, stats: DataFrame, sent: bool = True) -> DataFrame:
    """With the array column ``__x`` of FEATURES; ``__label``, if it has one, says which rates are a URL's own."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"\?([^#]*)", 1)).otherwise("")
    joined = df.withColumns({"__a": _suffix(2), "__b": _segment(), "__fold": _fold(url)})
    for k, kind in (("a", "suffix"), ("b", "segment")):
        side = stats.filter(F.col("kind") == kind).select(F.col("key").alias(f"__{k}"), F.col("log_count").alias(f"__{k}_count"), F.col("rate").alias(f"__{k}_all"), F.col("fold_rate").alias(f"__{k}_fold"))
        joined = joined.join(F.broadcast(side) if sent else side, f"__{k}", "left")
    labelled = F.col("__label").isNotNull() if "__label" in df.columns else F.lit(False)
    rate = {k: F.when(labelled, F.get(f"__{k}_fold", F.col("__fold"))).otherwise(F.col(f"__{k}_all")) for k in "ab"}
    x = [
        F.length(u), F.length("host"), F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))), F.length(F.regexp_replace(u, r"[^0-9]", "")) / n, _entropy(u),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), F.size(F.split("host", r"\.")), F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))),
        *(c for k in "ab" for c in (F.coalesce(f"__{k}_count", F.lit(0.0)), F.coalesce(rate[k], F.lit(0.5)))),
    ]
    return joined.withColumn("__x", F.array(*[c.cast("double") for c in x])).drop("__fold", *[f"__{k}{v}" for k in "ab" for v in ("", "_count", "_all", "_fold")])


def suffix_stats(df: DataFrame, url: str = "url") -> DataFrame:
    """kind, key, log_count, smoothed block rate, and that rate without each fold, of host suffixes and path segments; over all rows of ``df``."""
    keys = F.array(F.struct(F.lit("suffix").alias("kind"), _suffix(2).alias("key")), F.struct(F.lit("segment").alias("kind"), _segment().alias("key")))
    both = df.select(F.explode(keys).alias("k"), "__label", _fold(url).alias("fold")).select("k.kind", "k.key", "__label", "fold")

    def rate(without: int | None = None) -> Column:
        use = F.col("__label") if without is None else F.when(F.col("fold") != without, F.col("__label"))
        return (F.coalesce(F.sum(use), F.lit(0)) + 1) / (F.count(use) + 2)

    return both.groupBy("kind", "key").agg(F.log1p(F.count("*")).alias("log_count"), rate().alias("rate"), F.array(*[rate(f) for f in range(FOLDS)]).alias("fold_rate"))


@dataclass
class UrlModel:
    """Cut points of each feature, and the trees as nested (feature, bin, left, right) or leaf values."""

    cuts: list[list[float]]
    trees: list
    bias: float
    stats: DataFrame
    sent: bool


def _margin(bins: Column, trees: list, bias: float) -> Column:
    def walk(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        f, b, left, right = t
        return F.when(bins[f] <= b, walk(left)).otherwise(walk(right))

    total = F.lit(float(bias))
    for t in trees:
        total = total + walk(t)
    return total


def _binned(x: Column, cuts: list[list[float]]) -> Column:
    """Number of cut points that the value exceeds, for each feature."""
    count = [F.lit(0) if not c else sum((F.when(x[f] > v, 1).otherwise(0) for v in c), F.lit(0)) for f, c in enumerate(cuts)]
    return F.array(*count)


def _grow(rows: DataFrame, trees: list, bias: float):
    """One more tree: a histogram of gradients for each level, the best cut for each node."""
    p = 1 / (1 + F.exp(-_margin(F.col("bins"), trees, bias)))
    rows = rows.withColumns({"g": (F.col("label") - p) * F.col("n"), "h": p * (1 - p) * F.col("n")})
    paths: dict[int, tuple] = {}  # node -> (feature, bin); node k has children 2k and 2k + 1
    values: dict[int, float] = {}

    def node() -> Column:
        def at(k: int) -> Column:
            if k not in paths:
                return F.lit(k)
            f, b = paths[k]
            return F.when(F.col("bins")[f] <= b, at(2 * k)).otherwise(at(2 * k + 1))

        return at(1)

    for level in range(DEPTH):
        hist: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        found = rows.select(node().alias("node"), F.posexplode("bins").alias("f", "b"), "g", "h").groupBy("node", "f", "b").agg(F.sum(F.round("g", 9).cast("decimal(28,9)")).alias("g"), F.sum(F.round("h", 9).cast("decimal(28,9)")).alias("h"))
        for r in found.collect():  # at most nodes x features x bins
            hist.setdefault((r["node"], r["f"]), {})[r["b"]] = (float(r["g"]), float(r["h"]))
        for k in sorted({k for k, _ in hist} if level else {1}):
            if k < 1 << level:
                continue
            best = (1e-6, None)
            for f in range(len(FEATURES)):
                cells = sorted(hist.get((k, f), {}).items())
                tg, th = sum(v[0] for _, v in cells), sum(v[1] for _, v in cells)
                values[k] = RATE * tg / (th + RIDGE)
                a = b = 0.0
                for at, (g, h) in cells[:-1]:
                    a, b = a + g, b + h
                    gain = a * a / (b + RIDGE) + (tg - a) ** 2 / (th - b + RIDGE) - tg * tg / (th + RIDGE)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, at, RATE * a / (b + RIDGE), RATE * (tg - a) / (th - b + RIDGE)))
            if best[1]:
                f, at, left, right = best[1]
                paths[k] = (f, at)
                values[2 * k], values[2 * k + 1] = left, right

    def build(k: int):
        return (*paths[k], build(2 * k), build(2 * k + 1)) if k in paths else values.get(k, 0.0)

    return build(1)


def fit(df: DataFrame, url: str = "url", max_train_urls: int = MAX_TRAIN_URLS) -> UrlModel:
    """Learn from the rows of ``df`` (with host, path) whose ``__label`` is 1 (block) or 0 (allow)."""
    spark = df.sparkSession
    stats = scratch.cut(suffix_stats(df, url), "url-stats")
    sent = stats.count() <= MAX_SENT_ROWS
    labelled = df.filter(F.col("__label").isNotNull())
    rows = lexical(hash_sample(labelled, url, max_train_urls), url, stats, sent).select(F.col("__label").alias("label"), F.col("__x").alias("x"))
    rows, path = scratch.write(rows, "url-train")
    some = rows.agg(F.count("*").alias("n"), F.sum("label").alias("k"), *[F.percentile_approx(F.col("x")[f], [i / BINS for i in range(1, BINS)], 10_000).alias(f"q{f}") for f in range(len(FEATURES))]).first()
    n, k = some["n"], some["k"] or 0
    if not 0 < k < n:
        return UrlModel([[] for _ in FEATURES], [], -20.0, stats, sent)
    cuts = [sorted(set(some[f"q{f}"])) for f in range(len(FEATURES))]
    packed, path2 = scratch.write(rows.select("label", _binned(F.col("x"), cuts).alias("bins")).groupBy("label", "bins").agg(F.count("*").alias("n")).coalesce(2), "url-bins")
    bias = math.log(k / (n - k))
    trees: list = []
    for _ in range(TREES):
        trees.append(_grow(packed, trees, bias))
    scratch.drop(spark, path, path2)
    return UrlModel(cuts, trees, bias, stats, sent)


def judge(df: DataFrame, url: str = "url", rules=RULES, max_train_urls: int = MAX_TRAIN_URLS) -> DataFrame:
    """``df`` with host, path, rule, score (chance of block by the trees) and verdict."""
    ruled = apply_rules(split_url(df, url), rules)
    marked = ruled.withColumn("__label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    model = fit(marked.select(url, "host", "path", "__label"), url, max_train_urls)
    scored = lexical(marked, url, model.stats, model.sent).withColumn("__bins", _binned(F.col("__x"), model.cuts))
    p = 1 / (1 + F.exp(-_margin(F.col("__bins"), model.trees, model.bias)))
    return scored.withColumn("score", p).withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("ruled", "__label", "__x", "__bins")
