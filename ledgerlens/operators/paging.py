"""Pages by position and substring search over a stored summary.

``write_paged`` stores the summary once per sort mode, range-partitioned and
sorted on the mode's order, so that every file is a run of consecutive
positions. The index has one row per file: how many rows it holds under each
filter (rated, x402, both, none) and how many lie before it. A page at any
offset is then a look at the index and one or two files; the work and the
memory of a page depend on the file size, not on the offset. A table of n rows
has at most sqrt(n) files per mode, however few rows a file is asked to hold:
index and files then grow alike, and neither outgrows the other.

Searches use trigram posting lists: for every three characters that occur in
an agent's id, owner or URI (folded to lower case) the ranks of the agents that
hold them, in chunks of ``CHUNK`` consecutive ranks. The rarest trigrams of a
term are intersected chunk by chunk, and the agents that remain are read (only
the files that hold their ranks) and compared with the whole term once. Terms
of one or two characters are compared with every agent.

A version is written aside and named by the pointer last, as all sinks here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshot import POINTER, current_version, new_run_id, put_text
from .rank import global_row_number
from .serve import SORT_MODES, ListRequest, filter_agents, page, parse_limit, parse_offset, search_predicate, sort_columns

ROWS_PER_FILE = 100_000
CHUNK = 1 << 16  # ranks a posting list covers; bounds its length
RAREST = 4  # trigrams of a term that are intersected before agents are read

#: Rows of a file under each filter; the column names of the index.
FILTERS = {(False, False): "rows", (True, False): "rated", (False, True): "x402", (True, True): "rated_x402"}


def _mode(sort: str | None) -> str:
    sort = "recent" if sort == "recency" else sort
    return sort if sort in SORT_MODES else "rank"


def _counts() -> list[Column]:
    rated, x402 = F.col("feedback_count") > 0, F.coalesce(F.col("x402"), F.lit(False))
    return [F.count(F.lit(1)).alias("rows"), F.count_if(rated).alias("rated"), F.count_if(x402).alias("x402"),
            F.count_if(rated & x402).alias("rated_x402")]


def _part(column: str = "path") -> Column:
    """The number of the range partition that wrote a file."""
    return F.regexp_extract(column, r"part-(\d+)", 1).cast("int")


# ---------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------

def grams(text: Column) -> Column:
    """The distinct trigrams of a text, folded to lower case; none where it has fewer than three characters."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    at = F.when(F.size(chars) >= 3, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
    # The characters are bound once, as the argument of a transform, not once per position.
    bound = F.transform(F.array(F.struct(chars.alias("c"), at.alias("at"))),
                        lambda s: F.transform(s["at"], lambda i: F.concat(F.get(s["c"], i), F.get(s["c"], i + 1), F.get(s["c"], i + 2))))
    return F.array_distinct(F.coalesce(bound[0], F.array().cast("array<string>")))


def posting_lists(summary: DataFrame) -> DataFrame:
    """(gram, chunk, ranks): ascending ranks of the agents that hold a trigram, at most CHUNK in a row."""
    held = F.array_distinct(F.flatten(F.array(*(grams(F.col(c).cast("string")) for c in ("agent_id", "owner_address", "token_uri")))))
    return (summary.select("rank", F.explode(held).alias("gram"))
            .groupBy("gram", F.floor(F.col("rank") / CHUNK).cast("bigint").alias("chunk"))
            .agg(F.sort_array(F.collect_list("rank")).alias("ranks")))


def write_paged(summary: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE, run_id: str | None = None) -> str:
    """Store ``summary`` for paging and search and switch the pointer to the new version."""
    spark = summary.sparkSession
    version = f"v={run_id or new_run_id()}"
    base = f"{root.rstrip('/')}/{version}"
    summary.write.mode("errorifexists").parquet(f"{base}/rows")
    stored = spark.read.schema(summary.schema).parquet(f"{base}/rows")
    n = stored.count()
    files = max(1, min(-(-n // rows_per_file), math.isqrt(n)))
    index = None
    for mode in SORT_MODES:
        order = sort_columns(mode)
        stored.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{base}/pages/mode={mode}")
        part = spark.read.schema(summary.schema).parquet(f"{base}/pages/mode={mode}")
        counts = (part.groupBy(F.col("_metadata.file_path").alias("path")).agg(*_counts(), F.max("computed_at").alias("computed_at"))
                  .select(F.lit(mode).alias("mode"), _part().alias("part"), "path", *FILTERS.values(), "computed_at"))
        index = counts if index is None else index.unionByName(counts)
    # One row per file and mode.
    before = Window.partitionBy("mode").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in FILTERS.values()))
    index.coalesce(1).sortWithinPartitions("mode", "part").write.parquet(f"{base}/index")
    lists = posting_lists(stored)
    lists.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk").write.parquet(f"{base}/postings")
    postings = spark.read.parquet(f"{base}/postings")
    (postings.groupBy("gram").agg(F.sum(F.size("ranks")).alias("agents"), F.count(F.lit(1)).alias("chunks"))
     .repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{base}/grams"))
    put_text(spark, f"{root.rstrip('/')}/{POINTER}", version)
    return version


# ---------------------------------------------------------------------------
# Reading
# ---------------------------------------------------------------------------

class PagedSummary:
    """A stored version, opened for pages, envelopes and searches."""

    def __init__(self, spark: SparkSession, root: str):
        version = current_version(spark, root)
        if version is None:
            raise ValueError(f"nothing stored under {root}")
        self.spark, self.base = spark, f"{root.rstrip('/')}/{version}"
        self.index = spark.read.parquet(f"{self.base}/index")
        self.schema = spark.read.parquet(f"{self.base}/rows").schema

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def page(self, req: ListRequest) -> DataFrame:
        """The rows that ``serve.list_agents`` gives for ``req``."""
        limit, offset, order = parse_limit(req.limit), parse_offset(req.offset), sort_columns(req.sort)
        if req.q and req.q.strip():
            found = global_row_number(filter_agents(self.matches(req.q), None, req.x402, req.rated), order, "_at")
            return found.where((F.col("_at") > offset) & (F.col("_at") <= offset + limit)).orderBy("_at").drop("_at")
        kind = FILTERS[(req.rated, req.x402)]
        first, rows = F.col(f"{kind}_before"), F.col(kind)
        hits = (self.index.where((F.col("mode") == _mode(req.sort)) & (first < offset + limit) & (first + rows > offset))
                .select("path", first.alias("first")).orderBy("first").collect())
        skip = offset - hits[0]["first"] if hits else 0
        return page(filter_agents(self._files([h["path"] for h in hits]), None, req.x402, req.rated), order, limit, skip)

    def envelope(self, req: ListRequest, source: str = "live") -> DataFrame:
        """``serve.list_envelope`` from the index alone; a search counts its matches."""
        limit, offset = parse_limit(req.limit), parse_offset(req.offset)
        kind = FILTERS[(req.rated, req.x402)]
        sums = self.index.where(F.col("mode") == "rank").agg(F.coalesce(F.sum(kind), F.lit(0)).alias("total"), F.max("computed_at").alias("computed_at"))
        if req.q and req.q.strip():
            found = filter_agents(self.matches(req.q), None, req.x402, req.rated).agg(F.count(F.lit(1)).alias("found"))
            sums = sums.join(F.broadcast(found)).select(F.col("found").alias("total"), "computed_at")  # one row each
        count = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - F.lit(offset)))
        return sums.select(F.lit(source).alias("source"), "computed_at", F.col("total").cast("bigint").alias("total"),
                           count.cast("bigint").alias("count"), (F.lit(offset) + count < F.col("total")).alias("has_more"))

    def candidates(self, q: str) -> DataFrame | None:
        """Ranks of the agents that hold the rarest trigrams of a term, a superset of its matches; None for short terms."""
        wanted = self.spark.range(1).select(grams(F.lit(q.strip())).alias("g")).first()["g"]
        if not wanted:
            return None
        known = (self.spark.read.parquet(f"{self.base}/grams").where(F.col("gram").isin(wanted))
                 .orderBy("agents", "gram").collect())  # as many rows as the term has trigrams
        none = self.spark.createDataFrame([], "rank bigint")
        if len(known) < len(wanted):
            return none
        rare = [r["gram"] for r in known[:RAREST]]
        lists = self.spark.read.parquet(f"{self.base}/postings").where(F.col("gram").isin(rare))
        both = lists.groupBy("chunk").agg(F.collect_list("ranks").alias("l")).where(F.size("l") == len(rare))
        return both.select(F.explode(F.aggregate(F.slice("l", 2, len(rare)), F.col("l")[0], F.array_intersect)).alias("rank"))

    def candidate_files(self, ranks: DataFrame) -> list[str]:
        """The files of rank order that hold ``ranks``: one row per file reaches the driver."""
        files = self.index.where("mode = 'rank' and rows > 0").select("path", (F.col("rows_before") + 1).alias("first"), (F.col("rows_before") + F.col("rows")).alias("last"))
        sums = files.agg(F.count(F.lit(1)).alias("files"), F.max("last").alias("rows")).first()
        if not sums["files"]:
            return []
        # The files are consecutive runs of ranks. Cut into blocks of their mean size, every rank meets the few files of its
        # block: a join by key, not of every rank with every file. At most two blocks per file in the mean.
        size = -(-sums["rows"] // sums["files"])
        blocks = files.select("path", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))).alias("block"))
        hit = (ranks.select("rank", F.floor(F.col("rank") / size).alias("block")).join(F.broadcast(blocks), "block")
               .where((F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last"))))
        return [r["path"] for r in hit.select("path").distinct().collect()]

    def matches(self, q: str) -> DataFrame:
        """The agents whose id, owner or URI holds the term."""
        ranks = self.candidates(q)
        if ranks is None:
            return filter_agents(self.spark.read.schema(self.schema).parquet(f"{self.base}/rows"), q)
        paths = self.candidate_files(ranks)
        if 2 * len(paths) > self.index.where("mode = 'rank'").count():  # a folder is listed at once, files one by one
            paths = [f"{self.base}/pages/mode=rank"]
        rows = self._files(paths)
        return rows.join(ranks, "rank", "left_semi").select(*self.schema.names).where(search_predicate(q))
