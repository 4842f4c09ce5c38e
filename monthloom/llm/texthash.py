"""Vectorised hashing of words and word shingles over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; the arrays that one chunk needs stay near 35 MB.
CHUNK_BYTES = 500_000
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}
#: ASCII capitals to small letters, all word separators to space.
LOWER = bytes(range(256)).translate(
    bytes.maketrans(
        bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5
    )
)


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts (lower-cased, separated by a space), starts and ends of their words, and each text's first word."""
    joined = b" ".join([*texts, b""]).translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    word = data != 32
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, "i8")
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and each text's first word (one entry more than texts)."""
    data, starts, ends, first = word_spans(texts)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INV, n + 1)[starts] if len(starts) else sums[:0]
    return mixed(h + (ends - starts).astype(np.uint64)), first


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` words in a row; of all its words if it has fewer."""
    for a, b in chunks(texts):
        h, first = word_hashes(texts[a:b])
        n = max(0, len(h) - width + 1)
        runs = np.zeros(n, np.uint64)
        for j in range(width):
            runs += h[j : j + n] * _PLACE[j]
        runs = mixed(runs)
        for s, e in zip(first.tolist(), first[1:].tolist()):
            if e - s >= width:
                yield np.unique(runs[s : e - width + 1])
            elif e > s:
                yield mixed((h[s:e] * _PLACE[: e - s]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(e - s))
            else:
                yield h[:0]
