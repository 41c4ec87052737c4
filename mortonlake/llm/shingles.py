"""Word hashes, word shingles and MinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts, and where each text's begin, with their number last. Only the batch's distinct words are hashed."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))  # the six characters of common.SPACE
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0  # before a leading or after a trailing separator lies an empty one
    upto = np.r_[0, np.cumsum(real)][np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    if not real.all():
        flat = flat.filter(pa.array(real))
    each = flat.dictionary_encode()
    distinct = pc.cast(each.dictionary, pa.binary() if each.type.value_type == pa.string() else pa.large_binary()).to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return known[np.asarray(each.indices)] if len(known) else np.zeros(0, np.uint64), upto


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * MULTIPLIER + h[i : i + n]
    return mixed(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles, sorted. A text of fewer than k words, but at least one, is one shingle."""
    if 0 < len(h) < k:
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, k))


class MinHash:
    def __init__(self, n: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The least of each hash function's high halves over the set, which must not be empty."""
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 512):
            s = shingles[at : at + 512]
            np.minimum(out, (self.a[:, None] * s[None, :] + self.b[:, None]).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)
