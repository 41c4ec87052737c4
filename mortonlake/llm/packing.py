"""Packing of documents into sequences of at most one window, by non-negative least squares.

Every document is tokenised once into a written table. What fills whole windows is
cut off and stands alone; the histogram of the lengths that remain has at most
window - 1 entries however large the corpus is, so the driver holds it. Over it the
columns are shallow combinations (one length some times and another once, or three
lengths) that fill a window exactly. Coordinate descent solves for non-negative repeat counts that come closest
to the histogram; they are rounded down to what the histogram holds. Documents take
the slots of their length by rank. What rounding leaves over is laid end to end
greedily and cut at the windows' ends. So every sequence is a full window, but for the
last partial one, which is cut into powers of two: no padding at all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, load, running, small_batches, table

WINDOW, END_ID, CACHE, FREQUENT, REPEATS, SWEEPS = 4096, 2, 700_000, 64, 12, 30
TOKENIZER = "word_bpe_49k.json"

_loaded: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Between an ASCII letter and a symbol the tokeniser's pieces always end.
EDGE = r"([a-z])([!-/:-@\[-`{-~])"


class Chunks:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by chunks between ASCII white space and edges.

    The tokeniser lower-cases, and its pieces never reach over white space or from a letter to a
    symbol, so a lower-cased chunk always has the same ids. Arrow splits the texts, finds
    their distinct chunks, looks these up and joins the ids; only new chunks are Python
    objects. At most CACHE chunks are remembered, some 50 MB.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.chunks, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        # new chunks are encoded together, apart by a chunk that is one id
        self.bar = next((x for x in "\u00a7\u00b6\u00a9" if len(self.of.encode(x, add_special_tokens=False).ids) == 1), None)
        self.bar_id = self.of.encode(self.bar, add_special_tokens=False).ids[0] if self.bar else -1

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), 1024):
            some = chunks[at : at + 1024]
            text = f" {self.bar} ".join(some)
            if self.bar is None or "<|" in text or any(self.bar in w for w in some):
                out += [np.array(e.ids, "<u4").tobytes() for e in self.of.encode_batch_fast(some, add_special_tokens=False)]
                continue
            ids = np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4")
            ends = [*np.flatnonzero(ids == self.bar_id).tolist(), len(ids)]
            raw, start = ids.tobytes(), 0
            for e in ends:
                out.append(raw[4 * start : 4 * e])
                start = e + 1
        return out

    def look_up(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks."""
        if len(self.chunks) > CACHE:
            self.chunks, self.ids = self.chunks[:0], self.ids[:0]
        at = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(pc.is_null(at))
        at = np.array(at.fill_null(-1))
        if len(new):
            at[at < 0] = len(self.chunks) + np.arange(len(new))
            self.chunks = pa.concat_arrays([self.chunks, new])
            self.ids = pa.concat_arrays([self.ids, pa.array(self._encode(new.to_pylist()), pa.binary())])
        return self.ids.take(pa.array(at))

    def encode(self, texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=EDGE, replacement=r"\1 \2")
        # a text with a special token in it stays as it is
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, marked))
        each = words.flatten().dictionary_encode()
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, self.look_up(each.dictionary).take(each.indices)), b"")


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:  # once for each Python worker
            _loaded[path] = Chunks(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in gathered(batches):
            ids = pc.binary_join_element_wise(_loaded[path].encode(b.column("__text")), end, b"")
            names = [n for n in b.schema.names if n != "__text"]
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], ids, pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())], [*names, "ids", "n_tokens"])

    return run


def tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, order: Column | None = None) -> DataFrame:
    """(uid, doc_id, ids, n_tokens) of every row, written once; uid is unique also where doc_id is not, and rises with order (default: that of the scan)."""
    small_batches(docs.sparkSession)
    slim = docs.select((F.monotonically_increasing_id() if order is None else order).alias("uid"), "doc_id", F.col("text").cast("string").alias("__text"))
    schema = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long"
    return table(slim.mapInArrow(_tokenise(path or tokenizer_path(), end_id), schema), "tokens", "zstd")


def _count(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Chunks(path)
        for b in gathered(batches):
            n = pc.add(pc.cast(pc.divide(pc.binary_length(_loaded[path].encode(pc.cast(b.column(name), pa.string()))), 4), pa.int64()), 1)
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names[:-1], name, f"{name}_n"])

    return run


def counted(docs: DataFrame, out: str, path: str | None = None) -> DataFrame:
    """docs with, in column out, how many ids packing makes of each text, its end included; written once."""
    small_batches(docs.sparkSession)
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    copy = "__text"
    slim = docs.toDF(*inner).withColumn(copy, F.col(inner[docs.columns.index("text")]).cast("string"))
    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(slim.columns, slim.schema.fields, strict=True))
    got = slim.mapInArrow(_count(path or tokenizer_path(), copy), f"{kinds}, `{copy}_n` long")
    return table(got.drop(copy).toDF(*docs.columns, out), "token-counts")


def combinations(have: np.ndarray, window: int, frequent: int = FREQUENT, repeats: int = REPEATS) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that occur and fill the window exactly: one length up to `repeats` times and another once, and triples that hold two of the lengths with most tokens."""
    found = set()
    for k in range(1, repeats + 1):
        for a in np.flatnonzero(have[1 : -(-window // k)]) + 1:
            b = window - k * int(a)
            if 0 < b < len(have) and have[b]:
                found.add(tuple(sorted((int(a),) * k + (b,))))
    top = [x for x in sorted(np.argsort(-have * np.arange(len(have)), kind="stable")[:frequent].tolist()) if have[x]]
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if 0 < c < len(have) and have[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def nnls(columns: list[tuple[int, ...]], have: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that minimises the squared distance of sum(x * column) from have, by cyclic coordinate descent."""
    left, x = [float(v) for v in have], [0.0] * len(columns)
    norm = [sum(c.count(v) ** 2 for v in set(c)) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, c in enumerate(columns):
            step = max(sum(left[v] for v in c) / norm[k], -x[k])
            if step:
                x[k] += step
                moved += abs(step)
                for v in c:
                    left[v] -= step
        if moved <= 1e-3 * (1 + sum(x)):
            break
    return np.array(x)


def plan(have: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, rank after the last, first sequence, offset) and how many sequences they fill."""
    columns = combinations(have, window)
    x, free, taken, slots, base = nnls(columns, have), have.astype(np.int64).copy(), np.zeros(len(have), np.int64), [], 0
    for k in sorted(range(len(columns)), key=lambda k: (-sum(columns[k]), len(columns[k]), k)):
        c = columns[k]
        n = min(int(x[k] + 1e-6), *[int(free[v]) // c.count(v) for v in set(c)])
        if n <= 0:
            continue
        offset = 0
        for v in c:
            slots.append((v, int(taken[v]), int(taken[v]) + n, base, offset))
            taken[v] += n
            free[v] -= n
            offset += v
        base += n
    return slots, base


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, order: Column | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) that hold each token once.

    ids: the piece's token ids as little-endian unsigned 32-bit numbers. Null and empty
    texts are their end id alone; rows with equal doc_id are packed each; a document
    longer than the window is cut. Columns other than doc_id and text are not used.
    No document gives no piece. order: a unique long >= 0 of each row; sequences are then
    numbered by the first of their rows in it.
    """
    spark = docs.sparkSession
    stored = tokens(docs, path, end_id, order)
    slim = stored.select("uid", "n_tokens", (F.col("n_tokens") % window).cast("int").alias("rest"), F.expr(f"n_tokens div {window}").alias("whole"))
    have = np.zeros(window, np.int64)
    for r in slim.filter("rest > 0").groupBy("rest").count().collect():  # at most window - 1 rows
        have[r[0]] = r[1]
    slots, sequences = plan(have, window)
    fits = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "slot int, low long, high long, first long, offset long")
    ranked = running(slim.filter("rest > 0").withColumn("__one", F.lit(1)), "__one", "uid", "rank", ("rest",)).drop("__one")
    placed = ranked.join(F.broadcast(fits), (F.col("rest") == F.col("slot")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")  # fits: at most 3 slots a combination, bounded by the window
    placed = table(placed.select("uid", "rest", "whole", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence"), "offset"), "packing-slots")
    exact = placed.filter("sequence is not null").select("uid", (F.col("whole") * window).alias("start"), F.col("rest").cast("long").alias("length"), F.col("sequence").alias("sequence_id"), "offset")

    tape = table(running(placed.filter("sequence is null").select("uid", "rest", "whole"), "rest", "uid", "at"), "packing-tape")
    total = tape.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    ends, at = [], total // window * window
    for k in range(window.bit_length(), -1, -1):
        if (total - total // window * window) >> k & 1:
            at += 1 << k
            ends.append(at)
    tail = F.array(*[F.lit(int(e)) for e in ends]).cast("array<bigint>")
    inner = F.when(F.expr(f"(at + rest - 1) div {window} > at div {window}"), F.array(F.expr(f"(at div {window} + 1) * {window}"))).otherwise(F.array().cast("array<bigint>"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.col("at"), F.col("at") + F.col("rest")), inner, F.filter(tail, lambda e: (e > F.col("at")) & (e < F.col("at") + F.col("rest"))))))
    tape = tape.withColumn("cuts", cuts).select("*", F.posexplode(F.slice("cuts", 1, F.size("cuts") - 1)).alias("k", "begin")).withColumn("end", F.col("cuts")[F.col("k") + 1])
    full = total // window
    window_no = F.expr(f"begin div {window}")
    last = F.when(window_no >= full, F.size(F.filter(tail, lambda e: e <= F.col("begin")))).otherwise(0)  # which of the last window's powers of two
    opened = F.when(window_no >= full, F.coalesce(F.array_max(F.filter(tail, lambda e: e <= F.col("begin"))), F.lit(full * window))).otherwise(window_no * window)
    greedy = tape.select("uid", (F.col("whole") * window + F.col("begin") - F.col("at")).alias("start"), (F.col("end") - F.col("begin")).alias("length"), (F.lit(sequences) + window_no + last).alias("sequence_id"), (F.col("begin") - opened).alias("offset"))

    sequences += full + len(ends)
    many = slim.filter("whole > 0").select("uid", "whole")
    many = running(many, "whole", "uid", "at").select("uid", F.posexplode(F.expr("sequence(1L, whole)")).alias("k", "x"), "at")
    alone = many.select("uid", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.lit(sequences) + F.col("at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = exact.unionByName(greedy).unionByName(alone)
    if order is not None:
        pieces = _in_order(table(pieces, "packing-pieces"))
    joined = stored.join(pieces.withColumnRenamed("uid", "uid_"), F.col("uid") == F.col("uid_"))
    return joined.select("doc_id", "start", "length", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")


def _in_order(pieces: DataFrame) -> DataFrame:
    """pieces, whose sequences are numbered anew by their least uid: a range shuffle of one row a sequence."""
    first = pieces.groupBy("sequence_id").agg(F.min("uid").alias("first")).repartitionByRange("first", "sequence_id").sortWithinPartitions("first", "sequence_id")
    placed = table(first.select("sequence_id", F.monotonically_increasing_id().alias("place"), F.lit(1).alias("one")), "packing-order")
    numbers = running(placed, "one", "place", "number").select("sequence_id", "number")
    return pieces.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number")).drop("number")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
