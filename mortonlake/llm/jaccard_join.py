"""Near duplicates by the Jaccard similarity of word shingles, with Bayesian pruning of candidates.

1. Documents with equal shingle sets (exact copies among them) form a class; one of each goes on.
2. Candidates share a band of their MinHash signature. A pair of Jaccard 0.8 misses all
   32 bands of 4 with probability 5e-8.
3. In a bucket, pairs compare their signatures 16 values at a time. With m of n equal, the
   posterior of the similarity (uniform prior) is Beta(m + 1, n - m + 1); a pair is dropped
   when its chance to reach the threshold falls below the tolerance. A pair is
   handled in the first band that it shares, so no pair has to be made distinct.
4. What is left is verified exactly on the sets.

A bucket of up to LIGHT members emits its surviving pairs, at most LIGHT for each
document and band. A larger one is split into blocks of BLOCK members by hash; each pair of blocks is
verified where it is, with the sets, and emits only counts and a spanning forest of
its links. So no task holds an unbounded bucket, no row is made for each pair of a large
group, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, load, small_batches, table
from .components import components
from .shingles import MinHash, mixed, shingle_set, word_hashes

SHINGLE, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE, LIGHT, BLOCK = 5, 0.8, 32, 4, 16, 1e-7, 64, 1024


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n comparisons a pair with fewer than m equal values is dropped."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() >= tolerance * p.sum():
                out.append((n, m))
                break
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS * ROWS)
        for b in batches:
            high, low, sizes, sigs = [], [], [], []
            words, at = word_hashes(b.column("text"))
            for i in range(b.num_rows):
                s = shingle_set(words[at[i] : at[i + 1]], k)
                sizes.append(len(s))
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                high.append((h >> 64) - (1 << 63))
                low.append((h & ((1 << 64) - 1)) - (1 << 63))
                sigs.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["uid", "id", "high", "low", "n", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(b.num_rows, BANDS, ROWS // 2)
        key = np.zeros(sig.shape[:2], np.uint64)
        for i in range(ROWS // 2):
            key = mixed(key ^ sig[:, :, i]) + np.uint64(i)
        cid = np.asarray(b.column("cid").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(cid, BANDS))], ["band", "key", "cid"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = word_hashes(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([shingle_set(words[at[i] : at[i + 1]], k).tobytes() for i in range(b.num_rows)], pa.binary())], ["cid", "shingles"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(sig: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray, band: int, threshold: float, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) that this band has to verify."""
    a, b = (s.reshape(len(s), BANDS, ROWS) for s in (sig, other))
    ok = np.minimum(size[:, None], other_size[None, :]) >= threshold * np.maximum(size[:, None], other_size[None, :])
    ok &= (a[:, None, band] == b[None, :, band]).all(axis=2)
    for earlier in range(band):
        ok &= ~(a[:, None, earlier] == b[None, :, earlier]).all(axis=2)
    i, j = np.nonzero(ok)
    same = np.zeros(len(i), np.int32)
    done = 0
    for n, m in least:
        for at in range(0, len(i), 1 << 18):
            part = slice(at, at + (1 << 18))
            same[part] += (sig[i[part], done:n] == other[j[part], done:n]).sum(axis=1)
        keep = same >= m
        i, j, same, done = i[keep], j[keep], same[keep], n
    return i, j


def _light(threshold: float, least: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], []]
        for g in _groups(batches, ["band", "key"]):
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(g.num_rows, -1)
            size, cid, band = g.column("n").to_numpy(), g.column("cid").to_numpy(), int(g.column("band")[0].as_py())
            i, j = _candidates(sig, size, sig, size, band, threshold, least)
            keep = cid[i] < cid[j]
            out[0].append(cid[i[keep]])
            out[1].append(cid[j[keep]])
            if len(out[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])
                out = [[], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    return run


LINKS = "a long, b long, a_links long, b_links long"


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("a_set"), b.column("b_set"), strict=True)):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both / (len(s) + len(t) - both) >= threshold:
                    keep.append(i)
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b"), got.column("b_copies"), got.column("a_copies")], ["a", "b", "a_links", "b_links"])

    return run


def _incidence(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(shared)), np.float32)
    for k, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        at[at == len(shared)] = 0
        m[k, at[shared[at] == s]] = 1
    return m


def _heavy(threshold: float, least: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["band", "key", "x", "y"]):
            order = np.argsort(g.column("cid").to_numpy(), kind="stable")
            g = g.take(pa.array(order))
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(g.num_rows, -1)
            cid, copies, block = (g.column(c).to_numpy() for c in ("cid", "copies", "block"))
            sets = [np.frombuffer(s, np.uint64) for s in g.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            x, y, band = (int(g.column(c)[0].as_py()) for c in ("x", "y", "band"))
            rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
            links, parent = np.zeros(len(cid), np.int64), list(range(len(cid)))
            edges: list[tuple[int, int]] = []

            def root(v: int, parent: list[int] = parent) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            for at in range(0, len(rows), 256):
                own = rows[at : at + 256]
                i, j = _candidates(sig[own], size[own], sig[cols], size[cols], band, threshold, least)
                i, j = own[i], cols[j]
                if x == y:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                left, right = np.unique(i), np.unique(j)
                every, n = np.unique(np.concatenate([sets[k] for k in np.union1d(left, right)]), return_counts=True)
                every = every[n > 1]  # what one set alone has adds to no intersection
                both = np.zeros((len(left), len(right)), np.float32)
                for c in range(0, len(every), 8192):
                    both += _incidence([sets[k] for k in left], every[c : c + 8192]) @ _incidence([sets[k] for k in right], every[c : c + 8192]).T
                inter = both[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)
                hit = inter / (size[i] + size[j] - inter) >= threshold
                i, j = i[hit], j[hit]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for u, v in zip(i.tolist(), j.tolist()):
                    p, q = root(u), root(v)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((u, v))
            e = np.array(edges, np.int64).reshape(-1, 2)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid[e[:, 0]], cid[some]])), pa.array(np.concatenate([cid[e[:, 1]], cid[some]])), pa.array(np.concatenate([np.zeros(len(e), np.int64), links[some]])), pa.array(np.zeros(len(e) + len(some), np.int64))], ["a", "b", "a_links", "b_links"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, tolerance: float = TOLERANCE, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """uid, doc_id, class_id, copies_of, copies and n_links of every row of docs, which must have a unique uid, doc_id and text.

    class_id: the least doc_id of the connected component of links; copies_of: the least doc_id
    with the same shingle set; copies: how many rows have that set; n_links: how many other
    rows have a Jaccard similarity of at least threshold. Null and empty texts have no
    shingle, link to none and are a class each; texts of fewer than five words link only
    to texts of the same words. Rows that repeat a doc_id are documents of their own; a null doc_id
    comes last. An empty table gives an empty result.
    """
    least = least_matches(threshold, tolerance)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("uid", F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    signed = table(texts.mapInArrow(_signatures(shingle), f"uid long, id {kind}, high long, low long, n long, sig binary"), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    groups = signed.filter("n > 0").groupBy("high", "low").agg(first, F.count("*").alias("copies"))
    classes = table(groups.select("high", "low", F.col("first.uid").alias("cid"), F.col("first.id").alias("id"), "copies"), "classes")
    ours = table(classes.join(signed.select("uid", "n", "sig"), F.col("cid") == F.col("uid")).select("cid", "copies", "n", "sig"), "class-signatures")

    keyed = table(ours.select("cid", "sig").mapInArrow(_bands, "band int, key long, cid long"), "bands")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = table(keyed.join(sizes, ["band", "key"]), "band-members")
    forget(keyed)
    few = members.filter(F.col("size") <= light).join(ours, "cid").select("band", "key", "cid", "n", "sig")
    pairs = table(few.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(_light(threshold, least), "a long, b long"), "pairs")
    many = members.filter(F.col("size") > light)
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(many.select("cid")).distinct()
    sets = table(texts.join(wanted, F.col("uid") == F.col("cid")).select("cid", "text").mapInArrow(_sets(shingle), "cid long, shingles binary"), "shingle-sets")
    owned = sets.join(ours.select("cid", "copies"), "cid")
    side = lambda s: owned.select(F.col("cid").alias(s), F.col("shingles").alias(f"{s}_set"), F.col("copies").alias(f"{s}_copies"))
    verified = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set", "a_copies", "b_copies").mapInArrow(_verify(threshold), LINKS)
    blocks = F.ceil(F.col("size") / block).cast("int")
    spread = many.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("band", "key", "cid", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    spread = spread.join(ours, "cid").join(sets, "cid")
    dense = spread.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y").select("band", "key", "x", "y", "block", "cid", "copies", "sig", "shingles").mapInArrow(_heavy(threshold, least), LINKS)
    links = table(verified.unionByName(dense), "links")

    roots = components(links.filter("a <> b"))
    count = links.select(F.col("a").alias("id"), F.col("a_links").alias("n")).unionByName(links.select(F.col("b").alias("id"), F.col("b_links").alias("n"))).groupBy("id").agg(F.sum("n").alias("n_links"))
    named = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").join(count.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = table(named.withColumnRenamed("id", "copies_of"), "class-links")
    least_id = named.groupBy("root").agg(F.min(F.struct(F.col("copies_of").isNull().alias("none"), F.col("copies_of").alias("id"), "cid")).alias("least"))
    named = named.join(least_id, "root").select("high", "low", "copies_of", "copies", F.col("least.id").alias("class_id"), F.col("least.cid").alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("linked"))
    out = signed.select("uid", F.col("id").alias("doc_id"), "high", "low", "n").join(named, ["high", "low"], "left")
    alone = F.col("n") == 0
    return out.select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copies_of")).alias("copies_of"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("copies")).alias("copies"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("linked") + F.col("copies") - 1).alias("n_links"),
        (alone | (F.col("keeper") == F.col("uid"))).alias("keep"),
    )


def with_uid(docs: DataFrame) -> DataFrame:
    """docs written with a unique number for each row."""
    return table(docs.drop("uid").withColumn("uid", F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. Texts without words are kept."""
    inner = [f"__c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    stored = with_uid(docs.toDF(*inner))
    found = near_duplicates(stored, **options).filter("keep").select(F.col("uid").alias("uid_"))
    return stored.join(found, F.col("uid") == F.col("uid_"), "left_semi").select(*inner).toDF(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(with_uid(load(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "class_id", "copies_of", "copies", "n_links")


def oracle() -> str:
    """Every pair that shares a shingle, and the closure of the links: for small tables with unique doc_id."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - {SHINGLE - 1}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) END AS g FROM words),
each AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM each a JOIN each b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE similarity >= {THRESHOLD} UNION ALL SELECT b, a FROM pairs WHERE similarity >= {THRESHOLD}),
reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT s.doc_id, class_id, CASE WHEN len(g) > 0 THEN min(s.doc_id) OVER (PARTITION BY g) ELSE s.doc_id END AS copies_of, CASE WHEN len(g) > 0 THEN count(*) OVER (PARTITION BY g) ELSE 1 END AS copies, coalesce(n, 0) AS n_links
FROM sets s JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)"""
