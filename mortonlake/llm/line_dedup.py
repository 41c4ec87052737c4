"""Line deduplication by a suffix array over line-ID sequences.

Lines that hold a word are the letters; a document is their sequence. Suffixes are
ranked by prefix doubling: rank over 1 line, then over 2, 4, 8 ... from the pair of
ranks at a position and half a length on. Each round sorts the distinct pairs by range
and numbers them with the suffixes before them, so ranks are positions in the suffix
array, equal for suffixes with a common prefix of that length: its longest-common-prefix
intervals. Only suffixes whose prefix repeats go on, so rounds shrink quickly.

A run counts if it has at least min_words words. The shortest such runs from each line
on, and back from each line, are named by two overlapping ranks; an interval that
holds one several times keeps the copy that comes first in (doc_id, line) order. The
union of the later copies is the union of all maximal repeated runs' later copies.
Sorts and counts are over distinct pairs, so a line that a third of all documents share
is one row there; it meets its own occurrences only in joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, small_batches, table

MIN_WORDS = 3


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows, with a list for each of what their lines have: halves of the hash, and the lengths of the shortest runs."""
        for b in batches:
            high, low, on, back, upto_row = [], [], [], [], [0]
            for text in b.column("__text").to_pylist():
                lines = [(x, n) for x in (text or "").encode("utf-8", "replace").split(b"\n") if (n := len(x.split()))]
                upto_row.append(upto_row[-1] + len(lines))
                if not lines:
                    continue
                upto = np.concatenate([[0], np.cumsum([n for _, n in lines])])
                k = np.arange(len(lines))
                end = np.searchsorted(upto, upto[:-1] + min_words)  # one after the shortest run from k on
                start = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
                on += np.where(end <= len(lines), end - k, 0).tolist()
                back += np.where(start >= 0, k - start + 1, 0).tolist()
                for x, _ in lines:
                    h = xxhash.xxh3_128_intdigest(x)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & ((1 << 64) - 1)) - (1 << 63))
            offsets = pa.array(upto_row, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for v, kind in ((high, pa.int64()), (low, pa.int64()), (on, pa.int32()), (back, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "a", "b", "run_on", "run_back"])

    return run


def ranks(suffixes: DataFrame, name: str) -> DataFrame:
    """(uid, j, rank) of the suffixes whose pair (a, b) others have too; the rank counts the suffixes with smaller pairs."""
    pairs = suffixes.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = table(pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("part", F.spark_partition_id()), f"{name}-pairs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pairs.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # one row a partition
    inside = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pairs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), F.col("part") == F.col("part_")).select("a", "b", (F.col("inside") + F.col("shift")).alias("rank"))
    return table(suffixes.join(numbered, ["a", "b"]).select("uid", "j", "rank"), name)


def later_runs(lines: DataFrame, order: DataFrame) -> DataFrame:
    """(uid, s, len): shortest runs of enough words, from line s on, that an earlier place holds too."""
    runs = lines.select("uid", F.explode(F.array_distinct(F.array(F.struct(F.col("j").alias("s"), F.col("run_on").alias("len")), F.struct((F.col("j") - F.col("run_back") + 1).alias("s"), F.col("run_back").alias("len"))))).alias("r")).select("uid", "r.s", "r.len").filter("len > 0")
    longest = lines.agg(F.greatest(F.max("run_on"), F.max("run_back"))).first()[0] or 0
    levels, size, now = [], 1, ranks(lines.select("uid", "j", "a", "b"), "suffix-ranks-1")
    while longest >= size:
        levels.append(now.select("uid", "j", F.lit(size).alias("size"), "rank"))
        if longest < 2 * size:
            break
        half = Window.partitionBy("uid").orderBy("j").rangeBetween(size, size)
        paired = now.select("uid", "j", F.col("rank").alias("a"), F.max("rank").over(half).alias("b")).filter("b is not null")
        size *= 2
        now = ranks(paired, f"suffix-ranks-{size}")
        if now.isEmpty():
            break
    if not levels:
        return runs.select("uid", "s", "len").limit(0)
    stack = levels[0]
    for x in levels[1:]:
        stack = stack.unionByName(x)
    runs = runs.filter(F.col("len") < 2 * size).withColumn("size", F.expr("shiftleft(1, length(bin(len)) - 1)"))
    first = stack.select("uid", F.col("j").alias("s"), "size", F.col("rank").alias("a"))
    second = stack.select("uid", F.col("j").alias("t"), "size", F.col("rank").alias("b"))
    named = runs.distinct().join(first, ["uid", "s", "size"]).withColumn("t", F.expr("s + len - size")).join(second, ["uid", "t", "size"])
    named = table(named.join(order, "uid").select("uid", "s", "len", "a", "b", F.struct("place", "s").alias("at")), "line-runs")
    # written, so that the join shuffles either side for itself and Spark can split a run that very many documents share
    intervals = table(named.groupBy("len", "a", "b").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1").drop("n"), "line-intervals")
    return named.join(intervals, ["len", "a", "b"]).filter("at != first").select("uid", "s", "len")


def _rewrite(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone, all_lines = [], [], []
            for text, spans in zip(b.column("__text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                worded = [i for i, x in enumerate(lines) if x.encode("utf-8", "replace").split()]
                drop = {worded[k] for x in spans or () for k in range(x["s"], x["s"] + x["len"])}
                gone.append(sorted(drop))
                all_lines.append(len(worded))
                kept = [x for i, x in enumerate(lines) if i not in drop]
                texts.append(text if not drop else "" if len(drop) == len(worded) else "\n".join(kept))
            by = dict(zip(b.schema.names, b.columns, strict=True)) | {"__text": pa.array(texts, pa.string()), "__gone": pa.array(gone, pa.list_(pa.int32())), "__lines": pa.array(all_lines, pa.int32())}
            yield pa.RecordBatch.from_arrays([by[n] for n in names], names)

    return run


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text without later copies of repeated runs of lines, deleted_lines (numbers from 0) and n_lines (those with a word).

    The first copy is that of the least doc_id (null last), of equal doc_id the least hash of the
    text, then the earlier line; it also counts within a document. Runs are compared by 128-bit
    hashes of their lines, byte for byte otherwise. Lines without a word stay, unless
    all lines with words go: the text is then empty. Null text stays null. Repeated rows
    are copies of each other. An empty table gives an empty result. Columns deleted_lines and n_lines
    are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c not in ("deleted_lines", "n_lines")]
    cols = [f"__c{i}" if c != "text" else "__text" for i, c in enumerate(names)]
    kinds = ", ".join(f"`{c}` {docs.schema[n].dataType.simpleString() if n != 'text' else 'string'}" for c, n in zip(cols, names, strict=True))
    numbered = docs.select(*[F.col(n).cast("string").alias(c) if n == "text" else F.col(n).alias(c) for c, n in zip(cols, names, strict=True)], F.monotonically_increasing_id().alias("uid"))
    stored = table(numbered.mapInArrow(_lines(min_words), f"{kinds}, uid long, a array<long>, b array<long>, run_on array<int>, run_back array<int>"), "line-docs")
    key = f"__c{names.index('doc_id')}"
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64("__text").alias("hash"), F.col("uid").alias("row"))
    lines = stored.select("uid", F.posexplode(F.arrays_zip("a", "b", "run_on", "run_back")).alias("j", "x")).select("uid", "j", "x.*")
    spans = later_runs(lines, stored.select("uid", place.alias("place"))).groupBy("uid").agg(F.collect_list(F.struct("s", "len")).alias("spans"))  # at most two spans a line of one document
    joined = stored.select(*cols, "uid").join(spans.withColumnRenamed("uid", "uid_"), F.col("uid") == F.col("uid_"), "left")
    out = [*cols, "__gone", "__lines"]
    return joined.select(*cols, "spans").mapInArrow(_rewrite(out), f"{kinds}, `__gone` array<int>, `__lines` int").toDF(*names, "deleted_lines", "n_lines")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("deleted_lines").cast("long").alias("n_deleted"), F.array_join("deleted_lines", " ").alias("deleted_lines"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def oracle() -> str:
    same = f"a.doc_id = b.doc_id AND a.j <= b.j AND b.upto - a.upto + a.n >= {MIN_WORDS}"
    return f"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
counted AS (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM split),
w AS (SELECT *, row_number() OVER d AS j, sum(n) OVER d AS upto FROM counted WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
runs AS (SELECT a.doc_id, a.j AS s, min(b.j) AS e FROM w a JOIN w b ON {same} GROUP BY ALL UNION SELECT b.doc_id, max(a.j), b.j FROM w a JOIN w b ON {same} GROUP BY b.doc_id, b.j),
held AS (SELECT r.doc_id, r.s, r.e, string_agg(x, chr(10) ORDER BY w.j) AS content FROM runs r JOIN w ON w.doc_id = r.doc_id AND w.j BETWEEN r.s AND r.e GROUP BY ALL),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS nth FROM held) WHERE nth > 1),
gone AS (SELECT DISTINCT w.doc_id, w.line FROM later r JOIN w ON w.doc_id = r.doc_id AND w.j BETWEEN r.s AND r.e),
total AS (SELECT c.doc_id, count(*) FILTER (n > 0) AS n_lines, count(g.line) AS n_deleted, coalesce(string_agg(CAST(g.line AS VARCHAR), ' ' ORDER BY g.line), '') AS deleted_lines,
  coalesce(string_agg(x, chr(10) ORDER BY c.line) FILTER (g.line IS NULL), '') AS rest FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.line = c.line GROUP BY c.doc_id)
SELECT doc_id, n_lines, n_deleted, deleted_lines, md5(CASE WHEN n_deleted > 0 AND n_deleted = n_lines THEN '' ELSE rest END) AS text_md5 FROM total"""
