"""URL filters: explicit rules first, gradient-boosted trees for the rest.

A rule names a host and a path prefix (``example.org/es/``); it fits the host
and all its subdomains where the path starts with the prefix, and the longest
fitting rule decides. URLs that a rule decides are the labelled ones: boosted
trees are fitted to them on lexical features (length, depth, digit ratio,
entropy, parameter counts, and statistics of the host's suffixes), and judge
every URL that no rule fits. The host's suffix statistics are smoothed shares
of allowed URLs per top and second level, counted over all labelled URLs by
Spark; the table of all suffixes is staged and joined to the URLs.

The trees are fitted on at most ``TRAIN_ROWS`` labelled URLs, chosen by a hash.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged like any other; without labelled URLs of both
verdicts the method allows (or repeats the one verdict seen). Repeated rows
repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed, prepare, stage_table

# Fixed values of the result contract: (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TRAIN_ROWS = 20_000  # the documented bound of the labelled sample
TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 32
PRIOR = 20.0  # pseudo-counts of the suffix shares

FEATURES = ("url_chars", "host_chars", "path_chars", "path_depth", "host_labels", "digit_ratio", "entropy",
            "parameters", "first_part_chars", "path_digits", "top_share", "second_share", "top_count", "second_count")


def host_path(url: str) -> tuple[Column, Column]:
    """Host and path of the column named ``url``; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    # A-Z only: other letters keep their case
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict (null where no rule fits)."""
    host, path = host_path("url")
    df = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


LEVELS = {"top": 1, "second": 2}


def _suffix(levels: int) -> Column:
    return F.substring_index("host", ".", -levels)


def suffixes(host: str) -> tuple[str, str]:
    parts = host.rsplit(".", 2)
    return parts[-1], ".".join(parts[-2:])


def stats_of(table: DataFrame, hosts: list[str]) -> dict[str, tuple[float, float]]:
    """The rows of the suffix table that these hosts need."""
    need = sorted({s for h in hosts for s in suffixes(h)})
    if not need:
        return {}
    wanted = table.sparkSession.createDataFrame([(s,) for s in need], "suffix string")
    return {r["suffix"]: (r["p"], r["n"]) for r in table.join(wanted, "suffix", "left_semi").collect()}


def features(urls: list[str | None], hosts: list[str], paths: list[str], stats: DataFrame | dict[str, tuple[float, float]], share: float) -> np.ndarray:
    """``stats``: the suffix table, or the part of it that the hosts need."""
    if isinstance(stats, DataFrame):
        stats = stats_of(stats, hosts)
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths)):
        url = url or ""
        codes = np.frombuffer(url.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        count = np.bincount(codes) if len(codes) else np.zeros(1, dtype=int)
        q = count[count > 0] / max(1, len(codes))
        query = url.partition("?")[2].partition("#")[0]
        parts = [p for p in path.split("/") if p]
        top, second = suffixes(host)
        t, s = stats.get(top, (share, 0.0)), stats.get(second, (share, 0.0))
        out[i] = (len(url), len(host), len(path), len(parts), host.count(".") + 1 if host else 0,
                  sum(ch.isdigit() for ch in url) / max(1, len(url)), float(-(q * np.log2(q)).sum()) if len(q) else 0.0,
                  len([p for p in query.split("&") if p]), len(parts[0]) if parts else 0, sum(ch.isdigit() for ch in path),
                  t[0], s[0], np.log1p(t[1]), np.log1p(s[1]))
    return out


@dataclass
class BoostedTrees:
    """Boosted regression trees for the logistic loss, split on quantile bins."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, cut, value per node

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            n = 2 ** (depth + 1) - 1
            feature, cut, value = np.full(n, -1), np.zeros(n), np.zeros(n)
            at = np.zeros(len(y), dtype=int)
            for node in range(n):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                G, H = g[rows].sum(), h[rows].sum()
                value[node] = rate * G / (H + 1.0)
                if node >= 2 ** depth - 1:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    b = binned[rows, f]
                    left_g = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(cuts[f]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(cuts[f]) + 1))[:-1]
                    gain = left_g ** 2 / (left_h + 1) + (G - left_g) ** 2 / (H - left_h + 1) - G ** 2 / (H + 1)
                    gain[(left_h < 1e-3) | (H - left_h < 1e-3)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                if best[1] >= 0:
                    _, f, k = best
                    feature[node], cut[node] = f, cuts[f][k]
                    at[rows] = 2 * node + 1 + (binned[rows, f] > k)
            z += value[at]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > cut[at]), at)
            z += value[at]
        return 1 / (1 + np.exp(-z))


def _judge(model_var):
    def run(batches):
        share, trees = model_var.value
        for b in batches:
            stats = {}
            for level in ("top", "second"):
                suffix, p, n = (b.column(f"{level}{c}").to_pylist() for c in ("", "_p", "_n"))
                stats.update((k, (v, w)) for k, v, w in zip(suffix, p, n) if v is not None)
            x = features(b.column("url").to_pylist(), b.column("host").to_pylist(), b.column("path").to_pylist(), stats, share)
            p = trees.predict(x) if trees is not None else np.full(len(x), share)
            names = [n for n in b.schema.names if not n.startswith(("top", "second"))]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(p, pa.float64())], names=[*names, "score"])
    return run


def train(spark: SparkSession, ruled: DataFrame, n_rows: int = TRAIN_ROWS):
    """(suffix table, share of allowed URLs, trees) from the URLs that a rule decides.

    The suffix table (suffix, p, n) is a staged DataFrame with all suffixes of labelled URLs;
    without URLs of both verdicts there is none (an empty dict) and no trees.
    """
    labelled = ruled.where("rule_verdict is not null").withColumn("y", (F.col("rule_verdict") == "allow").cast("int"))
    total = labelled.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not total[0] or total[1] in (0, total[0]):
        return {}, 1.0 if not total[0] or total[1] else 0.0, None
    share = total[1] / total[0]
    levels = F.array(*(_suffix(k) for k in LEVELS.values()))
    n, allowed = F.count(F.lit(1)).cast("double"), F.sum("y").cast("double")
    stats = stage_table(spark, labelled.select(F.explode(F.array_distinct(levels)).alias("suffix"), "y").groupBy("suffix")
                        .agg(((allowed + PRIOR * share) / (n + PRIOR)).alias("p"), n.alias("n")), "suffixes")
    # By url and page, so that one url on many pages does not fill the sample.
    rows = least_hashed(labelled.select("url", "host", "path", "y", "page_id"), ["url", "page_id"], n_rows, total[0]).collect()
    x = features([r["url"] for r in rows], [r["host"] for r in rows], [r["path"] for r in rows], stats, share)
    return stats, share, BoostedTrees().fit(x, np.array([r["y"] for r in rows], dtype=float))


def judge(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page."""
    prepare(spark)
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    ruled = with_rules(base, rules)
    stats, share, trees = train(spark, ruled)
    model = spark.sparkContext.broadcast((share, trees))
    # Spark broadcasts the suffix table where it is small; otherwise it splits the partitions of a very common suffix.
    known = ruled
    for level, k in LEVELS.items():
        known = known.withColumn(level, _suffix(k))
        if trees is None:
            known = known.withColumns({f"{level}_{c}": F.lit(None).cast("double") for c in "pn"})
        else:
            known = known.join(stats.select(F.col("suffix").alias(level), *(F.col(c).alias(f"{level}_{c}") for c in "pn")), level, "left")
    known = known.select("page_id", "url", "host", "path", "rule", "rule_verdict", *(f"{x}{c}" for x in LEVELS for c in ("", "_p", "_n")))
    schema = "page_id bigint, url string, host string, path string, rule string, rule_verdict string, score double"
    method = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return known.mapInArrow(_judge(model), schema).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score")
