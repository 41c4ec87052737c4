"""Language-model scores by a small causal self-attention model, trained and run in numpy.

Words are counted over all training documents; counts of subword ids follow from
them. The model (one attention layer with a causal mask, one feed-forward layer) gives the
next id from a window of ids in two steps, both from the context: a softmax over GROUPS
groups of ids, and one over the MEMBERS of the group. Only the rarest ids, some hundredths
of a per cent of a corpus's, share a few members; the counts give an id within such a member, so
every text has a probability. Two small softmaxes cost a sixteenth of one over all members.
Weights start at the counts' frequencies and are trained in rounds: each task runs Adam
over its own training windows and the results are averaged. Every window of every
training document trains, once, in one of the rounds.

A document is scored in overlapping windows, in batches: each token once, with at
least OVERLAP tokens before it in its window unless the text starts there.

The unigram base score needs the counts of all words. Those of the most frequent words,
at most COMMON, go to every task; other words are joined by key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, gathered, load, small_batches, table

MODEL, BOS, EOS = "piece_bpe_32k.model", 1, 2
LENGTH, OVERLAP, BATCH, WIDTH, HIDDEN = 64, 8, 128, 16, 48
GROUPS, MEMBERS, BINS, INPUTS = 32, 32, 16, 2048
SINGLES = GROUPS * MEMBERS - BINS
ROUNDS, RATE, TRAIN_BATCH = 4, 0.04, 64
AT_ONCE, SPAN, TINY = 32, 32, 1e-20
COMMON, REMEMBERED = 200_000, 700_000

_pieces: dict = {}


class Pieces:
    """Subword ids of words as bytes of 16-bit numbers; at most REMEMBERED words are remembered, some 50 MB."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("more than 65,536 subwords")

    @staticmethod
    def of(path: str) -> Pieces:
        if path not in _pieces:  # once for each Python worker
            _pieces[path] = Pieces(path)
        return _pieces[path]

    def look_up(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        if len(self.words) > REMEMBERED:
            self.words, self.ids = self.words[:0], self.ids[:0]
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        at = np.array(at.fill_null(-1))
        if len(new):
            at[at < 0] = len(self.words) + np.arange(len(new))
            encoded = self.model.encode(new.to_pylist(), num_threads=1)
            offsets = np.r_[0, np.cumsum([2 * len(x) for x in encoded])].astype("<i4")
            flat = np.fromiter(chain.from_iterable(encoded), "<u2", offsets[-1] // 2)
            self.words = pa.concat_arrays([self.words, new])
            self.ids = pa.concat_arrays([self.ids, pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])])
        return self.ids.take(pa.array(at))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a batch of texts, as numbers of its distinct words, and the text that each is from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))  # A-Z alone change, and the six separators alone split
    flat, text = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    real = np.asarray(pc.binary_length(flat)) > 0  # before a leading or after a trailing separator lies an empty one
    if not real.all():
        flat, text = flat.filter(pa.array(real)), text[real]
    return flat.dictionary_encode(), text


def ids_of(pieces: Pieces, words: pa.DictionaryArray, text: np.ndarray, n: int) -> pa.Array:
    """The ids of n texts, each with its end, as bytes of 16-bit numbers."""
    raw = pieces.look_up(words.dictionary).take(words.indices)
    offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=n))].astype(np.int32)
    return pc.binary_join_element_wise(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), raw), b""), np.array([EOS], "<u2").tobytes(), b"")


def flattened(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array; and where each text starts, with the array's length last."""
    start = np.r_[0, np.cumsum(np.asarray(pc.binary_length(ids)))] // 2
    return np.frombuffer(b"".join(ids.to_pylist()), "<u2").astype(np.int64), start


class Classes:
    """Classes and input rows of ids, from the counts of ids."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        smooth = counts + 0.5
        tail = smooth[order[SINGLES:]]
        share = np.minimum((np.cumsum(tail) / tail.sum() * BINS).astype(int), BINS - 1) if len(tail) else np.zeros(0, int)
        self.of = np.empty(len(counts), np.int64)
        self.of[order[:SINGLES]] = np.arange(min(SINGLES, len(counts)))  # groups of about equally frequent ids
        self.of[order[SINGLES:]] = SINGLES + share
        mass = np.bincount(self.of, smooth, minlength=SINGLES + BINS)
        self.inside = np.log(smooth / mass[self.of])
        self.prior = np.log((mass + 1e-9) / mass.sum())
        self.input = np.where(rank < INPUTS - BINS, rank, INPUTS - BINS + np.maximum(self.of - SINGLES, 0))


class Model:
    """Weights by name; float32."""

    NAMES = ("embed", "place", "q", "k", "v", "o", "up", "up0", "down", "out", "out0", "in", "in0")

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w = w
        self.mask = np.tril(np.ones((LENGTH, LENGTH), np.float32))

    @staticmethod
    def fresh(prior: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        shapes = {"embed": (INPUTS, WIDTH), "place": (LENGTH, WIDTH), **{k: (WIDTH, WIDTH) for k in "qkvo"}, "up": (WIDTH, HIDDEN), "up0": (HIDDEN,), "down": (HIDDEN, WIDTH), "out": (WIDTH, GROUPS), "in": (GROUPS, WIDTH, MEMBERS)}
        w = {n: (rng.normal(0, 0.3 if n == "embed" else 0.05 if n == "place" else s[-2] ** -0.5 if len(s) > 1 else 1, s) * (n != "up0")).astype(np.float32) for n, s in shapes.items()}
        prior = prior.reshape(GROUPS, MEMBERS)
        most = prior.max(axis=1, keepdims=True)
        group = most + np.log(np.exp(prior - most).sum(axis=1, keepdims=True))
        return Model(w | {"out": w["out"] * 0.1, "in": w["in"] * 0.1, "out0": group[:, 0].astype(np.float32), "in0": (prior - group).astype(np.float32)})

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def filled(self, v: np.ndarray) -> Model:
        w, at = {}, 0
        for n in self.NAMES:
            size = self.w[n].size
            w[n] = v[at : at + size].reshape(self.w[n].shape).astype(np.float32)
            at += size
        return Model(w)

    def hidden(self, rows: np.ndarray, safe: bool = False) -> tuple:
        """rows: windows of input rows. What the backward pass needs; last, the output of the layers.

        Places attend in spans, each to no place after the span's last: a quarter of the square is never computed.
        The column of ones beside the values sums the weights, so these are never divided.
        safe: take the greatest from each row first, needed where exp leaves the range of float32.
        """
        w, n = self.w, rows.shape[1]
        x = w["embed"][rows]
        x += w["place"][:n]
        q, k = self._times(x, w["q"] * np.float32(WIDTH**-0.5)), self._times(x, w["k"])
        v = self._with_ones(self._times(x, w["v"]))
        both, weights = np.empty_like(v), []
        with np.errstate(over="ignore", invalid="ignore"):
            for a, b in self._spans(n):
                e = q[:, a:b] @ k[:, :b].transpose(0, 2, 1)
                if safe:
                    e[:, :, a:b][:, self.mask[a:b, a:b] == 0] = -np.inf
                    e -= e.max(axis=2, keepdims=True)
                np.exp(e, out=e)
                e[:, :, a:b] *= self.mask[a:b, a:b]
                np.matmul(e, v[:, :b], out=both[:, a:b])
                weights.append(e)
            total = both[:, :, WIDTH:]
            fine = safe or self._in_range(total)
        if not fine:
            return self.hidden(rows, True)
        mixed = both[:, :, :WIDTH] / total
        y = self._times(mixed, w["o"])
        y += x
        u = self._times(y, w["up"])
        u += w["up0"]
        np.maximum(u, 0, out=u)
        h = self._times(u, w["down"])
        h += y
        return x, q, k, v, weights, total, mixed, y, u, h

    @staticmethod
    def _spans(n: int) -> list[tuple[int, int]]:
        return [(a, min(a + SPAN, n)) for a in range(0, n, SPAN)]

    @staticmethod
    def _in_range(total: np.ndarray) -> bool:
        return bool(total.min() > TINY and total.max() < 1 / TINY) if total.size else True

    @staticmethod
    def _with_ones(x: np.ndarray) -> np.ndarray:
        out = np.empty((*x.shape[:-1], x.shape[-1] + 1), x.dtype)
        out[..., :-1] = x
        out[..., -1] = 1
        return out

    @staticmethod
    def _times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """x @ m as one product of matrices."""
        return (x.reshape(-1, x.shape[-1]) @ m).reshape(*x.shape[:-1], m.shape[1])

    def _softmax(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of each row, with the rows' sums. What they lack of the true ones cancels."""
        with np.errstate(over="ignore"):
            e = np.exp(z)
            total = e @ np.ones(z.shape[1], np.float32)
        if not self._in_range(total):  # so rare that the greatest is sought only then
            e = np.exp(z - z.max(axis=1, keepdims=True))
            total = e @ np.ones(z.shape[1], np.float32)
        return e, total

    def _heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the groups and of the members, each with its bias as the last row."""
        return np.concatenate([self.w["out"], self.w["out0"][None]]), np.concatenate([self.w["in"], self.w["in0"][:, None]], axis=1)

    @staticmethod
    def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order that brings the places of a group together, and each group there is with its range in it."""
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        return order, [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]

    def logs(self, rows: np.ndarray, target: np.ndarray, skip: int) -> np.ndarray:
        """Natural logs of the classes' probabilities at each place of each window after the first `skip`."""
        f = np.empty((len(rows), rows.shape[1] - skip, WIDTH + 1), self.w["out"].dtype)
        f[..., WIDTH] = 1
        for at in range(0, len(rows), AT_ONCE):
            f[at : at + AT_ONCE, :, :WIDTH] = self.hidden(rows[at : at + AT_ONCE])[-1][:, skip:]
        f = f.reshape(-1, WIDTH + 1)
        group, member = np.divmod(target[:, skip:].ravel(), MEMBERS)
        out, inside = self._heads()
        every = np.arange(len(f))
        e, total = self._softmax(f @ out)
        found = e[every, group].astype(np.float64) / total
        order, ranges = self._by_group(group)
        f, z = f[order], np.empty((len(f), MEMBERS), f.dtype)
        for i, a, b in ranges:
            np.matmul(f[a:b], inside[i], out=z[a:b])
        e, total = self._softmax(z)
        found[order] *= e[every, member[order]].astype(np.float64) / total
        return np.log(np.maximum(found, 1e-30)).reshape(len(rows), -1)

    def gradient(self, rows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, rows.shape[1]
        x, q, k, v, weights, total, mixed, y, u, h = self.hidden(rows)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        f = flat(self._with_ones(h))
        group, member = np.divmod(target.ravel(), MEMBERS)
        out, inside = self._heads()
        every = np.arange(len(f))

        def error(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            e, total = self._softmax(z)
            e *= (1 / (total * np.float32(len(f))))[:, None]
            e[every, at] -= np.float32(1 / len(f))
            return e

        z = error(f @ out, group)
        g_out, g_in = f.T @ z, np.zeros_like(inside)
        dh = z @ w["out"].T
        order, ranges = self._by_group(group)
        f, z, back = f[order], np.empty((len(f), MEMBERS), f.dtype), np.empty_like(dh)
        for i, a, b in ranges:
            np.matmul(f[a:b], inside[i], out=z[a:b])
        z = error(z, member[order])
        for i, a, b in ranges:
            np.matmul(f[a:b].T, z[a:b], out=g_in[i])
            np.matmul(z[a:b], w["in"][i].T, out=back[a:b])
        g = {"out": g_out[:-1], "out0": g_out[-1], "in": g_in[:, :-1], "in0": g_in[:, -1]}
        dh[order] += back
        dh = dh.reshape(h.shape)
        g["down"] = flat(u).T @ flat(dh)
        du = self._times(dh, w["down"].T)
        du *= u > 0
        g |= {"up": flat(y).T @ flat(du), "up0": np.ones(len(f), np.float32) @ flat(du)}
        dy = self._times(du, w["up"].T)
        dy += dh
        g["o"] = flat(mixed).T @ flat(dy)
        dm = self._with_ones(self._times(dy, w["o"].T))
        dm[..., WIDTH] = -np.einsum("bij,bij->bi", dm[..., :WIDTH], mixed)  # beside the ones of v: what the softmax takes off
        dm /= total
        dq, dk, dv = np.empty_like(q), np.zeros_like(k), np.zeros_like(k)
        for (a, b), e in zip(self._spans(n), weights, strict=True):
            dv[:, :b] += e.transpose(0, 2, 1) @ dm[:, a:b, :WIDTH]
            ds = dm[:, a:b] @ v[:, :b].transpose(0, 2, 1)
            ds *= e
            np.matmul(ds, k[:, :b], out=dq[:, a:b])
            dk[:, :b] += ds.transpose(0, 2, 1) @ q[:, a:b]  # q holds the scale
        dq *= np.float32(WIDTH**-0.5)
        dx = dy + self._times(dq, w["q"].T) + self._times(dk, w["k"].T) + self._times(dv, w["v"].T)
        g |= {"q": flat(x).T @ flat(dq), "k": flat(x).T @ flat(dk), "v": flat(x).T @ flat(dv), "place": np.zeros_like(w["place"])}
        g["place"][:n] = dx.sum(axis=0)
        order = np.argsort(rows.ravel().astype(np.int16), kind="stable")  # rows of one id together
        ids = rows.ravel()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["embed"] = np.zeros_like(w["embed"])
        g["embed"][ids[first]] = np.add.reduceat(flat(dx)[order], first, axis=0)
        return g

    def train(self, rows: np.ndarray, target: np.ndarray, rate: float, state: dict | None = None) -> Model:
        """state: Adam's moments and steps, kept from batch to batch."""
        state = {} if state is None else state
        w = {n: a.copy() for n, a in self.w.items()}
        m, v = (state.setdefault(k, {n: np.zeros_like(a) for n, a in w.items()}) for k in "mv")
        now = Model(w)
        for at in range(0, len(rows), TRAIN_BATCH):
            t = state["t"] = state.get("t", 0) + 1
            for n, g in now.gradient(rows[at : at + TRAIN_BATCH], target[at : at + TRAIN_BATCH]).items():
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.01 * (g * g - v[n])
                w[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-6)
        return now


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in gathered(batches, 16 << 20):
        words, _ = words_of(b.column("text"))
        n = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n.astype(np.int64))], ["word", "n"])


def _subwords(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        total = np.zeros(pieces.model.get_piece_size(), np.int64)
        for b in batches:
            encoded = pieces.model.encode(b.column("word").to_pylist(), num_threads=1)
            sizes = [len(x) for x in encoded]
            flat = np.fromiter(chain.from_iterable(encoded), np.int64, sum(sizes))
            np.add.at(total, flat, np.repeat(b.column("c").to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def training_windows(classes: Classes, flat: np.ndarray, start: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Input rows and target classes of the windows that train in this round; over all rounds each token is in one window. flat and start as from flattened."""
    n = np.diff(start)
    parts = -(-n // LENGTH)
    owner = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    hashed = np.array([zlib.crc32(flat[s : min(e, s + 64)]) for s, e in zip(start[:-1].tolist(), start[1:].tolist())], np.int64)
    now = np.flatnonzero((hashed[owner] + nth) % ROUNDS == turn)
    now = np.random.default_rng(turn).permutation(now)  # windows of one text go to different steps
    first, end = start[owner[now]] + nth[now] * LENGTH, start[owner[now] + 1][:, None]
    place = first[:, None] + np.arange(LENGTH)[None, :]
    before = flat[np.clip(place - 1, 0, max(0, len(flat) - 1))]
    before[nth[now] == 0, 0] = BOS
    rows = classes.input[np.where(place <= end, before, EOS)]
    return rows, classes.of[np.where(place < end, flat[np.minimum(place, len(flat) - 1)], EOS)]


def _local(sent, turn: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, classes), n, state = sent.value, 0, {}
        for b in gathered(batches, 4 << 20):
            x, y = training_windows(classes, *flattened(b.column("ids")), turn)
            model = model.train(x, y, rate, state)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([(model.vector() * np.float64(n)).tobytes()], pa.binary())], ["n", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0.0, None
    for b in batches:
        for k, raw in zip(b.column("n").to_pylist(), b.column("sums").to_pylist(), strict=True):
            n, sums = n + k, np.frombuffer(raw, np.float64) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])


def train(texts: DataFrame, classes: Classes) -> Model:
    """texts: column ids, as ids_of gives them."""
    spark = texts.sparkSession
    model = Model.fresh(classes.prior)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model, classes))  # some 50,000 numbers, and three for each subword
        own = texts.select("ids").mapInArrow(_local(sent, turn, RATE / (1 + turn)), "n double, sums binary")
        # added up in two steps: few results reach the driver, however many tasks there are
        some = own.repartition(4).mapInArrow(_add, "n double, sums binary").collect()
        if some:
            model = model.filled(sum(np.frombuffer(r.sums, np.float64) for r in some) / sum(r.n for r in some))
    return model


def score_windows(model: Model, classes: Classes, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log probability of each text; flat and start as from ids_of."""
    step, n = LENGTH - OVERLAP, np.diff(start)
    out = np.add.reduceat(classes.inside[flat], start[:-1]) if len(n) else np.zeros(0)
    later = np.maximum(0, -(-(n - LENGTH) // step))  # windows after a text's first, which score what no window before them has
    rows, target = classes.input[flat], classes.of[flat]
    bos = classes.input[BOS]
    owner = np.repeat(np.arange(len(n)), later)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(later) - later, later) + 1
    for own, k, skip in ((np.arange(len(n)), np.zeros(len(n), np.int64), 0), (owner, nth, OVERLAP)):
        held = np.minimum(LENGTH, n[own] - k * step)
        order = np.argsort(held, kind="stable")  # windows of about one length together: no place after a text's end is computed but for a longer window beside it
        own, k, held = own[order], k[order], held[order]
        for part in range(0, len(own), BATCH):
            o, at = own[part : part + BATCH], k[part : part + BATCH, None] * step + np.arange(held[part : part + BATCH].max())[None, :]
            place, ok = start[o][:, None] + at, at < n[o][:, None]
            x = rows[np.clip(place - 1, 0, len(rows) - 1)]
            x[at == 0] = bos
            logs = model.logs(x, target[np.minimum(place, len(rows) - 1)], skip)
            np.add.at(out, o, (logs * ok[:, skip:]).sum(axis=1))
    return out


TEXT = "n_tokens long, known long, base double, ids binary"


def _texts(path: str, common, ends: int):
    """A row for each text, with its ids; and a row for each of its words that is not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, (listed, logs, end) = Pieces.of(path), common.value
        names = ["uid", "doc_id", "n_tokens", "known", "base", "ids", "word", "times"]
        for b in gathered(batches):
            pa.default_memory_pool().release_unused()
            n = b.num_rows
            words, text = words_of(b.column("text"))
            at = np.asarray(words.indices)
            known = logs[np.asarray(pc.index_in(words.dictionary, value_set=listed).fill_null(-1))][at]
            missed = np.isnan(known)
            pairs, times = np.unique(text[missed] * len(words.dictionary) + at[missed], return_counts=True)
            total, held = np.bincount(text, minlength=n), np.bincount(text[~missed], minlength=n)
            base = np.bincount(text[~missed], known[~missed], minlength=n) + end
            uid, doc_id, m = b.column("uid"), b.column("doc_id"), len(pairs)
            yield pa.RecordBatch.from_arrays([uid, doc_id, pa.array(total + 1, pa.int64()), pa.array(held + (ends > 0), pa.int64()), pa.array(base), ids_of(pieces, words, text, n), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
            of, which = np.divmod(pairs, max(1, len(words.dictionary)))
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(of)), *[pa.nulls(m, k) for k in (doc_id.type, pa.int64(), pa.int64(), pa.float64(), pa.binary())], words.dictionary.take(pa.array(which)), pa.array(times, pa.int64())], names)

    return run


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classes = sent.value
        for b in batches:
            score = score_windows(model, classes, *flattened(b.column("ids"))) / np.log(10)
            keep = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(score, pa.float64())], [*keep, "score"])

    return run


def lm_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learnt from rows outside fold 1 of 5.

    Null text is empty: it has the end alone. Rows that repeat a doc_id are scored each. If no
    row is in the training folds, counts are zero and the model is its start. An
    empty table gives an empty result. Columns other than doc_id and text are not used.
    """
    spark, path = docs.sparkSession, path or model_path()
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    learn = texts.filter(fold(F.col("doc_id"), 5) != 1)
    counts = table(learn.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    ends = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole, distinct = total.n + ends, total.v + (ends > 0)
    # the least count of the at most COMMON words that go to every task
    sized = counts.selectExpr("c", "greatest(length(bin(c)) - 5, 0) as shift").selectExpr("shiftright(c, shift) as head", "shift")
    buckets = sized.groupBy("head", "shift").count().collect()  # some hundred rows
    least, held = float("inf"), 0
    for head, shift, n in sorted(buckets, key=lambda r: -(r[0] << r[1])):
        held += n
        if held > COMMON:
            break
        least = head << shift
    below = whole + 0.5 * (distinct + 1)
    log = lambda c: float(np.log10((c + 0.5) / below))
    top = counts.filter(F.col("c") >= least).collect() if least < float("inf") else []
    common = pa.array([r.word for r in top], pa.string()), np.array([*[log(r.c) for r in top], np.nan]), log(ends)  # the last: not common
    pieces = Pieces.of(path)
    ids = np.zeros(pieces.model.get_piece_size())
    for r in counts.mapInArrow(_subwords(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row a subword
        ids[r.id] = r.n
    ids[EOS] += ends
    classes = Classes(ids)

    numbered = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    send = spark.sparkContext.broadcast
    stored = table(numbered.mapInArrow(_texts(path, send(common), ends), f"uid long, doc_id {kind}, {TEXT}, word string, times long"), "lm-texts")
    whole_texts = stored.filter("word is null").drop("word", "times")
    model = train(whole_texts.filter(fold(F.col("doc_id"), 5) != 1), classes)
    scored = whole_texts.mapInArrow(_score(send((model, classes))), f"uid long, doc_id {kind}, n_tokens long, known long, base double, score double")
    rare = stored.filter("word is not null").select("uid", "word", "times").join(counts.select("word", "c"), "word", "left")
    value = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(below)))
    rare = rare.groupBy("uid").agg(F.sum(F.col("times") * value).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("also"))
    out = scored.join(rare, "uid", "left")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(whole)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))
