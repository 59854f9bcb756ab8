"""Content-defined pieces of texts, shared by the repeated-phrase and the suffix-array operator.

A *window* is ``length`` consecutive units (words or bytes) of one text.  Among the
``length - gram + 1`` gram hashes inside a window the smallest is its *anchor*; equal windows
therefore have equal anchors, wherever they stand.  A maximal run of windows with one anchor
(at one place: the leftmost) is a *piece*; no two windows of a piece are equal.  Grouping pieces by anchor brings every pair of equal windows into one group
while shuffling about one short row per ``(length - gram) / 2`` units instead of one per unit.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20

_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=_U)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=_U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


#: Hash of each byte value.
BYTE_HASH = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """c with (c[j] - c[i]) * BASE_INV**i a hash of h[i:j]."""
    c = np.empty(len(h) + 1, dtype=_U)
    c[0] = 0
    np.cumsum(h * powers(BASE, len(h)), out=c[1:])
    return c


def spans_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(BASE_INV, len(c))[start] + (end - start).astype(_U))


def grams(h: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive units; gram is a power of two."""
    m = 1
    while m < gram:
        h = (h[:-m] * _U(0x2127599BF4325C37) + h[m:]) * _U(0x880355F21E6D1965)
        h ^= h >> _U(29)
        m *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while m * 2 <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def cut(h: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Pieces of the texts whose units are h[bounds[i]:bounds[i+1]].

    Returns arrays (text, start, windows, anchor, piece): start is the first unit inside its
    text, piece a 64-bit hash of all units that the piece's windows cover."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),) * 2
    if len(h) < length:
        return none
    gram_hash = grams(h, gram)
    low = sliding_min(gram_hash, length - gram + 1)
    sizes = np.diff(bounds)
    usable = np.maximum(sizes - length + 1, 0)
    if not usable.any():
        return none
    text_of = np.repeat(np.arange(len(sizes)), usable)
    first = np.repeat(bounds[:-1], usable)
    inner = np.arange(len(text_of)) - np.repeat(np.cumsum(usable) - usable, usable)
    at = first + inner
    value = low[at]
    edge = np.empty(len(at), dtype=bool)
    edge[0] = True
    np.not_equal(value[1:], value[:-1], out=edge[1:])
    edge[1:] |= text_of[1:] != text_of[:-1]
    edge[1:] |= gram_hash[at[:-1]] == value[:-1]  # the leftmost anchor has left the window
    run = np.flatnonzero(edge)
    n_windows = np.diff(np.append(run, len(at)))
    begin = at[run]
    c = prefix_hash(h)
    piece = spans_hash(c, begin, begin + n_windows + length - 1)
    return text_of[run], inner[run], n_windows, mix(value[run]).view(np.int64), piece.view(np.int64)


def string_buffers(array):
    """(bytes, offsets) of an Arrow string or binary array without nulls."""
    import pyarrow as pa

    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of texts with about ``size`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray):
    """Byte start and end of each word [^\\x20\\x09-\\x0D]+ and, per text, the range of its words."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.empty(len(raw), dtype=bool)
    edge[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    border = offsets[:-1][(offsets[:-1] < len(raw))]
    edge[border] = inside[border]
    start = np.flatnonzero(edge)
    stop = np.empty(len(raw), dtype=bool)
    stop[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=stop[:-1])
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = inside[last]
    end = np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans_hash(prefix_hash(BYTE_HASH[raw]), start, end)
