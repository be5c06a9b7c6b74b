"""Line dedup: lines found in several documents stay in one, by levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower case; keys of at
least ``chars`` code points are compared, by two 64-bit hashes. The index is a set of sorted
runs: tables with a row a key (documents and lines that have it, the largest doc_id), in
buckets by hash and sorted in each. Documents come in batches:

1. The batch's lines are summed by key, before and after one shuffle.
2. That merges with each run, bucket by bucket: keys which a run has already settled (in
   ``documents`` documents or more, in one with a larger doc_id) are anti-joined away, as nothing
   in the batch can change what becomes of them.
3. The rest is the batch's own run, at level 0. ``fanout`` runs of a level are compacted into one
   of the next: their counts added, their largest doc_id kept.

When all batches are in, the runs are compacted into one, and the lines meet its frequent keys.
Keys with a noticeable part of a batch's lines are marked as heavy (a batch has fewer of them than
the reciprocal of that part), stay in the runs, and meet the lines by broadcast; so no task
gets all lines of a key. Batches are ranges of doc_id from the largest down, so that most frequent
keys settle early. Every step is a DataFrame operation.

A null or empty text is one empty line. A null doc_id counts for nothing and loses nothing.
Rows that share a doc_id are one document: each row's lines fare alike, wherever they stand. A key
that occurs several times in its largest doc_id stays there each time. Very long texts are
split whole; a document may lose all its lines, and stays with an empty text. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import HOT, bucket_files, bucketed, drop_bucketed, settle, shuffle_width

CHARS, DOCUMENTS, BATCHES, FANOUT = 20, 3, 4, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    k = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    plain = F.octet_length(k) == F.length(k)
    return F.when(plain, F.lower(k)).otherwise(F.translate(k, _UPPER, _LOWER))


def _split(docs: DataFrame) -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """doc_id, row (tells rows of one doc_id apart), pos, h, g of every line whose key is long enough."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(_split(docs)).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"))


class LineRuns:
    """The index: runs by level, each a table of h, g, n_docs, top, heavy in the order of its hashes."""

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS, fanout: int = FANOUT) -> None:
        self.spark, self.documents, self.fanout = spark, documents, fanout
        self.buckets = shuffle_width(spark)
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, lines: DataFrame, heavy: float) -> None:
        """Add the lines of new documents; a key with more than ``heavy`` of them is marked."""
        own = lines.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"))
        own = own.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top"), (F.sum("n") > heavy).alias("heavy"))
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.documents).select(*KEY, F.col("top").alias("seen"))
            same = [own[c] == settled[c] for c in KEY]
            own = own.join(settled, [*same, settled["seen"] > own["top"], ~own["heavy"]], "left_anti")
        self._put(own, 0)
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                self._compact(self.levels[i], i + 1)

    def whole(self) -> DataFrame:
        """All keys in one run."""
        names = [t for level in self.levels for t in level]
        if len(names) > 1:
            self._compact(names, len(self.levels))
        return self.runs()[0]

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(bucketed(run, "run", KEY, self.buckets))

    def _compact(self, names: list[str], level: int) -> None:
        names = list(names)
        # Read as plain files: Spark 4.1 takes a union of bucketed scans for partitioned as they are, but sets their partitions side by side.
        rows = bucket_files(self.spark, names)
        self._put(rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"), F.max("heavy").alias("heavy")), level)
        self.levels = [[t for t in held if t not in names] for held in self.levels]
        for t in names:
            drop_bucketed(self.spark, t)


def _in_batches(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """``lines`` with their batch: equal parts of the doc_ids, the largest first."""
    at = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at))).alias("b")).first()["b"] or []
    batch = reduce(lambda a, b: a + (F.col("doc_id") <= F.lit(b)).cast("int"), bounds, F.lit(0))
    return lines.withColumn("batch", batch).sortWithinPartitions("batch")


def line_dedup(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    lines = settle(_in_batches(hashed_lines(docs, chars), docs, batches), "lines")
    index = LineRuns(spark, documents, fanout)
    for batch, n in sorted(map(tuple, lines.groupBy("batch").count().collect())):
        index.add(lines.where(F.col("batch") == batch).select("doc_id", *KEY), n * HOT)
    if not index.levels:
        gone = lines.select("doc_id", "row", F.array("pos").alias("p"))
    else:
        frequent = index.whole().where(F.col("n_docs") >= documents).select(*KEY, "top", "heavy")
        hot = F.broadcast(frequent.where("heavy"))
        line = lines.select("doc_id", "row", "pos", *KEY)
        met = line.join(hot, KEY).unionByName(line.join(hot.select(*KEY), KEY, "left_anti").join(frequent.where("not heavy"), KEY))
        gone = met.where("doc_id <> top").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    rows = docs.withColumn("row", F.xxhash64("text")).join(gone, ["doc_id", "row"], "left").withColumn("lines", _split(docs))
    n, k = F.size("lines"), F.size("p")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("p", i - 1) + 1)
    end = lambda i: F.coalesce(F.get("p", i), n)
    between = F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.slice("lines", start(i) + 1, end(i) - start(i))))
    kept = F.when(F.col("p").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(between, "\n"))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.when(F.col("p").isNull(), 0).otherwise(k).cast("long").alias("n_dropped"), kept.alias("kept_text"))
