"""Words and word n-grams of Arrow text columns, as numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a maximal run of letters and numbers of the lower-cased text.
SEPARATOR = r"[^\p{L}\p{N}]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words(NamedTuple):
    """Words of some texts: ``codes[offsets[i]:offsets[i + 1]]`` are those of text i, as indices of ``vocab``."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each vocabulary entry."""
        return hash_strings(self.vocab)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int64), self.counts())


_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each string's bytes; nulls hash as empty strings."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)))
    starts = offsets[:-1]
    return mix((sums[offsets[1:]] - sums[starts]) * _powers(_INVERSE, len(raw) + 1)[starts] + np.uint64(1))


def words(text: pa.Array) -> Words:
    """Words of each text; null and empty texts have none."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    parts = pc.split_pattern_regex(pc.utf8_lower(text), SEPARATOR)
    encoded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    codes = encoded.indices.to_numpy()
    blank = pc.index(encoded.dictionary, "").as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return Words(offsets, codes, encoded.dictionary)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(word_hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word position the hash of the n words from there, and whether they lie within one text."""
    total = len(word_hashes)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    valid = np.arange(total) + n <= ends
    if total < n:
        return np.full(total, NONE), valid
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word_hashes * _powers(_BASE, total), dtype=np.uint64)))
    out = np.full(total, NONE)
    out[: total - n + 1] = (sums[n:] - sums[: total - n + 1]) * _powers(_INVERSE, total - n + 1)
    return mix(out), valid


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; sorting in place of ``np.unique``'s hashing, which is slower here."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over ``values[i:i + width]``, cut off at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = op(out[: len(out) - step], out[step:]) if step < len(out) else out[: len(out) - step]
        have += step
    return out


def minimizers(hashes: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is least in some window of that many consecutive positions.

    Which position a window selects depends on its content alone, so two texts that share ``window``
    consecutive n-grams share a selected one.
    """
    h = np.where(valid, np.minimum(hashes, NONE - np.uint64(1)), NONE)
    least = sliding(h, window, np.minimum)
    best = sliding(least[::-1], window, np.maximum)[::-1]
    return np.flatnonzero(valid & (best == h))
