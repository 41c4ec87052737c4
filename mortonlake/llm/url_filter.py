"""URL filters by a cascade of Bloom filters, exact over the corpus's own keys.

A rule is a host and a path prefix, written as one key (`example.com/en/`). The keys
that could match a URL are its host and each parent domain, each with those
prefixes of its path whose length some rule has. All such keys of the corpus are
the universe. Level 0 encodes the listed keys; level 1 the universe's keys that
level 0 wrongly takes for listed; level 2 the listed keys that level 1 wrongly
takes; and so on until a level has no false positive. The depth of the first level
that rejects a key then tells exactly whether it is listed, for every key of the
universe, without a join against the list.

Levels are built shard by shard of the keys' hash, so that no filter exceeds
SHARD_KEYS keys, and bits are set where the keys are: tasks send the words of
their own bitmaps, which are merged by OR. The driver holds the filters, about 1.5
bytes for each listed key, and sends at most BROADCAST_BYTES at a time; keys of further
shards take further passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches, table

BITS_PER_KEY, HASHES, SHARD_KEYS, BROADCAST_BYTES, MAX_LEVELS = 12, 8, 1 << 20, 64 << 20, 64
#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that could match, longest first, of equal length the longer host first."""
    parts = F.split(host, r"\.")
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    cuts = F.array(*[F.lit(int(n)) for n in lengths]).cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.char_length(path)), lambda n: F.substr(path, F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct((-F.char_length(h) - F.char_length(p)).alias("order"), (-F.char_length(h)).alias("host"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit numbers, one row a key; each level hashes anew, or a false positive would stay one."""
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    with np.errstate(over="ignore"):
        a = (a ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        step = (b + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        step ^= (step >> np.uint64(33)) << np.uint64(1)
        return (a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


def _depth(levels: dict, h1: np.ndarray, h2: np.ndarray, shards: int) -> np.ndarray:
    """For each key the number of levels that take it; -1 where its shard isn't in levels."""
    out = np.full(len(h1), -1, np.int64)
    shard = h1.view(np.uint64) % np.uint64(shards)
    for s in np.unique(shard).tolist():
        if s not in levels:
            continue
        alive = np.flatnonzero(shard == s)
        out[alive] = len(levels[s])
        for n, bitmap in enumerate(levels[s]):
            spots = _spots(h1[alive], h2[alive], n, len(bitmap) * 8)
            yes = ((bitmap[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            out[alive[~yes]] = n
            alive = alive[yes]
    return out


class Cascade:
    """Exact membership in `listed` for the keys of `universe`, both DataFrames with h1 and h2."""

    def __init__(self, spark: SparkSession, listed: DataFrame, universe: DataFrame, shards: int | None = None) -> None:
        listed = table(listed.select("h1", "h2").distinct(), "bloom-listed")
        others = table(universe.select("h1", "h2").distinct().join(listed, ["h1", "h2"], "left_anti"), "bloom-others")
        self.shards = shards or max(1, -(-listed.count() // SHARD_KEYS))
        self.spark, self.levels, sides, depth = spark, {}, (listed, others), 0
        live = [listed, others]  # the keys of either side that all levels so far take
        while depth < MAX_LEVELS:
            inside = live[depth % 2]
            sizes = {r[0]: r[1] for r in inside.groupBy(self._shard().alias("s")).count().collect()}
            if not sizes:
                break
            made = self._build(inside, sizes, depth)
            for s, bitmap in made.items():
                self.levels.setdefault(s, []).append(bitmap)
            other = 1 - depth % 2
            passed = self.test(live[other], "__d").filter(F.col("__d") > depth).select("h1", "h2")
            live[other] = table(passed, "bloom-level")
            depth += 1
        else:
            raise RuntimeError("two keys share their 128-bit hash: the cascade cannot tell them apart")

    def _shard(self) -> Column:
        return F.when(F.col("h1") >= 0, F.col("h1") % self.shards).otherwise(F.pmod(F.pmod(F.col("h1"), F.lit(self.shards)) + F.lit((1 << 64) % self.shards), F.lit(self.shards))).cast("long")

    def _groups(self) -> list[dict]:
        """The shards dealt into groups of at most BROADCAST_BYTES."""
        groups, size = [{}], 0
        for s, levels in sorted(self.levels.items()):
            n = sum(len(x) for x in levels)
            if groups[-1] and size + n > BROADCAST_BYTES:
                groups.append({})
                size = 0
            groups[-1][s] = levels
            size += n
        return groups

    def _build(self, inside: DataFrame, sizes: dict[int, int], level: int) -> dict[int, np.ndarray]:
        # a level is added to a shard only where all levels before it exist
        bits = {s: max(64, -(-n * BITS_PER_KEY // 64) * 64) for s, n in sizes.items()}
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maps: dict[int, np.ndarray] = {}
            for b in batches:
                h1, h2 = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
                shard = h1.view(np.uint64) % np.uint64(shards)
                for s in np.unique(shard).tolist():
                    spots = _spots(h1[shard == s], h2[shard == s], level, bits[s]).ravel()
                    own = maps.setdefault(s, np.zeros(bits[s] // 8, np.uint8))
                    np.bitwise_or.at(own, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
            for s, own in maps.items():
                words = own.view(np.int64)
                at = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(words[at])], ["s", "word", "bits"])

        merged = inside.mapInArrow(run, "s long, word long, bits long").groupBy("s", "word").agg(F.bit_or("bits").alias("bits"))
        merged = table(merged, "bloom-bits") if len(bits) > 1 else merged
        out = {s: np.zeros(n // 64, np.int64) for s, n in bits.items()}
        for s in out:  # a shard at a time: SHARD_KEYS bounds the rows that come to the driver at once
            for r in merged.filter(F.col("s") == s).collect():
                out[s][r[1]] = r[2]
        return {s: x.view(np.uint8) for s, x in out.items()}

    def test(self, df: DataFrame, name: str, array: bool = False, hashed: tuple[str, str] = ("h1", "h2")) -> DataFrame:
        """df (columns `hashed`, or arrays of them) with the depth of each key: odd is listed."""
        kind = "array<bigint>" if array else "bigint"
        shards = self.shards
        for k, group in enumerate(self._groups()):
            sent = self.spark.sparkContext.broadcast(group)  # at most BROADCAST_BYTES, more shards take more passes

            @F.pandas_udf(kind)
            def depth(h1, h2, sent=sent):
                import pandas as pd

                if not array:
                    return pd.Series(_depth(sent.value, h1.to_numpy(np.int64), h2.to_numpy(np.int64), shards))
                flat = [np.concatenate([np.zeros(0, np.int64), *x.tolist()]).astype(np.int64) for x in (h1, h2)]
                got = _depth(sent.value, *flat, shards)
                return pd.Series(np.split(got, np.cumsum([len(x) for x in h1])[:-1])) if len(h1) else pd.Series([], dtype=object)

            step = depth(*map(F.col, hashed))
            df = df.withColumn(name, step) if not k else df.withColumn(f"{name}_", step).withColumn(name, F.zip_with(name, f"{name}_", lambda a, b: F.greatest(a, b)) if array else F.greatest(name, f"{name}_")).drop(f"{name}_")
        return df

    def listed(self, depth: Column) -> Column:
        """A key whose depth is odd was taken last by a level of listed keys."""
        return depth % 2 == 1


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: host, path, verdict (allow or block). The longest key that matches decides;
    of equal length the longer host; a key listed as both is a block. Without a match
    the verdict is the default, as the key is not on the list. Null URLs and URLs without
    `://` have an empty host and path and get the default. Rows with equal URLs are judged
    each. Columns named like the added ones are replaced.
    """
    spark = pages.sparkSession
    small_batches(spark, 5000)
    made = ("host", "path", "rule", "verdict")
    rules = rules.select(F.concat("host", "path").alias("key"), F.char_length("path").alias("n"), "verdict").distinct()
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())  # path lengths that rules have: some hundreds at most
    names = [c for c in pages.columns if c not in made]
    inner = pages.select(*names).toDF(*[c if c == "url" else f"c{i}" for i, c in enumerate(names)])  # no name of the caller's meets one of these steps
    urls = inner.withColumns({"host": host_of(), "path": path_of()})
    keyed = urls.withColumn("__keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = urls.select("host", "path").distinct().select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    universe = table(universe.select(*[h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("key")), 1)]), "bloom-universe")
    cascades = {}
    for verdict in ("block", "allow"):
        listed = rules.filter(F.col("verdict") == verdict).select(*[h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("key")), 1)])
        cascades[verdict] = Cascade(spark, listed, universe)
    out = keyed.withColumns({"__h1": F.transform("__keys", lambda k: hashes(k)[0]), "__h2": F.transform("__keys", lambda k: hashes(k)[1])})
    for verdict, cascade in cascades.items():
        out = cascade.test(out, f"__{verdict}", True, ("__h1", "__h2")) if cascade.levels else out.withColumn(f"__{verdict}", F.transform("__keys", lambda k: F.lit(0).cast("long")))
    hit = F.filter(F.transform("__keys", lambda k, i: F.when(F.get("__block", i) % 2 == 1, F.struct(k.alias("rule"), F.lit("block").alias("verdict"))).when(F.get("__allow", i) % 2 == 1, F.struct(k.alias("rule"), F.lit("allow").alias("verdict")))), lambda x: x.isNotNull())
    out = out.withColumn("__hit", F.get(hit, F.lit(0)))
    return out.select(*urls.columns, F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict")).toDF(*names, *made)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(load(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    url = "coalesce(url, '')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    best = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    return f"""
WITH parts AS (SELECT page_id, regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1) AS raw, regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in best)} END AS rule,
CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in best)} ELSE 'allow' END AS verdict FROM hosts"""
