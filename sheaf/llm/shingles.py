"""Shingle hashes of whole texts, a batch at a time.

Words are split and told apart by Arrow's kernels; a word is lower-cased and hashed once for each
batch. Everything after that is arithmetic on one array of the batch's words, so a short
text costs no more than its words. A set is the ascending distinct hashes of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
U = np.uint64
#: Odd multipliers of a shingle's words by their place.
PLACE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of every i, count[i] of them, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def bounds(count: np.ndarray) -> np.ndarray:
    """Where each of parts of these lengths begins, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def pieces(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is whole all the same."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = np.flatnonzero(np.diff(size // most, prepend=0)).tolist()
    edges = sorted({0, *cut, batch.num_rows})
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, text after text, and where each text begins."""
    import xxhash

    # Arrow splits at the six ASCII spaces only, and lower() on bytes knows A-Z only: the words of the contract.
    # (Arrow's own ascii_lower is not used: its version 23 misreads slices of large strings.)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    found = lists.flatten()
    start = lists.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
    coded = found.dictionary_encode()
    words = map(bytes.lower, coded.dictionary.cast(pa.large_binary()).to_pylist())
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, U)
    return hashes[full], bounds(full)[start - start[0]]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, one after another, and where each begins. With fewer than five words, the whole sequence is one shingle."""
    h, start = word_hashes(texts)
    words = np.diff(start)
    windows = np.maximum(words - (SHINGLE - 1), 0)
    with np.errstate(over="ignore"):
        out = np.full(max(len(h) - SHINGLE + 1, 0), U(SHINGLE))
        for i, m in enumerate(PLACE):
            out += h[i : len(out) + i] * U(m)
        out = mix(out)[spans(start[:-1], windows)]
        short = np.flatnonzero((words > 0) & (words < SHINGLE))
        if len(short):
            n = words[short]
            part, place = spans(start[short], n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            sums = np.add.reduceat(h[part] * np.array(PLACE, U)[place], np.cumsum(n) - n, dtype=U)
            at = bounds(windows)[short]  # such a text has no window yet: it gets one here
            out = np.insert(out, at, mix(sums + n.astype(U)))
            windows[short] = 1
    begin = bounds(windows)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][windows > 0]] = True
    return out[new], bounds(new)[begin]


def set_ids(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit hashes of each whole set; 0 for empty ones."""
    n = np.diff(start)
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D):
            total = np.zeros(len(n), U)
            if len(flat):
                total[n > 0] = np.add.reduceat(mix(flat ^ U(seed)), start[:-1][n > 0])
            out.append(np.where(n > 0, mix(total + n.astype(U) * U(0xD6E8FEB86659FD93)), U(0)).view(np.int64))
    return out[0], out[1]
