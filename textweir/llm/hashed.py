"""Hashed text features over byte buffers, and small linear models on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .wordscan import ALNUM, Words, mix, text_bytes

_U = np.uint64
_SALT = _U(0xD1B54A32D192ED03)


def _runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``size`` (at most 8) bytes inside a word, and the word it is in."""
    padded = np.concatenate((words.raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray(shape=(len(words.raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    counts = np.maximum(words.end - words.start - (size - 1), 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) + np.repeat(words.start - (np.cumsum(counts) - counts), counts)
    return lanes[at] & _U((1 << 8 * size) - 1), owner


def word_features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of all words and of all runs of four and five bytes inside words, with
    repeats; and the number of words of each text."""
    words = Words(texts, ALNUM)
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    with np.errstate(over="ignore"):
        ids, owners = [mix(words.hash * _SALT)], [of]
        for size in (4, 5):
            runs, owner = _runs(words, size)
            ids.append(mix(runs * _SALT + _U(size)))
            owners.append(of[owner])
    return (np.concatenate(ids) & _U(buckets - 1)).astype(np.int64), np.concatenate(owners), np.diff(words.first)


def frequent_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that says that a text has ``ids`` often."""
    return (ids * 0x9E3779B1 + 0x7F4A7C15) & (buckets - 1)


def marks(ids: np.ndarray, of: np.ndarray, n_words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (bucket, text), ordered by text: what occurs, and what is one word in a hundred (and two) or more."""
    both, counts = np.unique(of * buckets + ids, return_counts=True)
    text = both // buckets
    often = (counts >= 2) & (100 * counts >= n_words[text])
    both = np.unique(np.concatenate((both, text[often] * buckets + frequent_bucket(both[often] % buckets, buckets))))
    return both % buckets, both // buckets


def byte_features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of three bytes (case kept), and the bounds of each text's runs."""
    raw, offsets = text_bytes(texts)
    counts = np.maximum(np.diff(offsets) - 2, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], counts)
    code = raw.astype(np.uint32)
    gram = code[at] | code[at + 1] << np.uint32(8) | code[at + 2] << np.uint32(16)
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64), bounds


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 200) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression: Nesterov's method, fixed rounds.

    The loss is a sum over rows; the step is one over a bound of its curvature.
    """
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest eigenvalue of x'x, by power iteration
        v = x.T @ (x @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = np.float32(1.0 / (0.3 * float(np.linalg.norm(x @ v)) ** 2 + ridge))
    penalty = np.full(len(w), ridge, np.float32)
    penalty[-1] = 0.0
    ahead = w
    for k in range(rounds):
        after = ahead - step * (x.T @ (sigmoid(x @ ahead) - y) + penalty * ahead)
        ahead = after + np.float32(k / (k + 3)) * (after - w)
        w = after
    return w.astype(np.float64)
