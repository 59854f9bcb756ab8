"""Burrows-Wheeler transforms of shards of strings and their merge by interleave refinement.

A shard's transform lists its suffixes in order; with each it keeps the symbol of STEP bytes
that stands before the suffix and the rank of the suffix that starts with that symbol.  The
merge never compares suffixes across shards: it starts from shard order and re-deals the
interleaved transforms by symbol, STEP bytes deeper with each pass.  Where two neighbours part,
their common prefix is known; a block that stays together down to the wanted depth is a
repeated interval.  Neighbours that nothing shares are left out of later passes.
"""

from __future__ import annotations

import numpy as np

STEP = 4


class Shards:
    """Transforms of the strings raw[offsets[i]:offsets[i+1]], string i in shard[i]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, shard: np.ndarray, depth: int):
        sizes = np.diff(offsets)
        pad = 8
        base = offsets[:-1] + np.arange(len(sizes)) * pad
        text = np.zeros(len(raw) + pad * len(sizes) + pad, dtype=np.uint8)
        at = np.arange(len(raw)) + np.repeat(np.arange(len(sizes)) * pad, sizes)
        text[at] = raw
        self.begin, self.end = base, base + sizes
        counts = sizes + 1
        self.string = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
        self.pos = (np.repeat(base, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int64)
        key = text[:-7].astype(np.uint64)
        for k in range(1, 8):
            key = (key << np.uint64(8)) | text[k : len(text) - 7 + k]
        order = self._sorted(key, shard, depth)
        self.pos, self.string = self.pos[order], self.string[order]
        rank = np.full(len(text) + 1, -1, dtype=np.int32)
        rank[self.pos] = np.arange(len(order), dtype=np.int32)
        before = self.pos - STEP
        inside = before >= self.begin[self.string]
        symbols, ids = np.unique((key[before[inside]] >> np.uint64(64 - 8 * STEP)).astype(np.uint32), return_inverse=True)
        kind = np.uint16 if len(symbols) < 65535 else np.uint32
        self.none = np.iinfo(kind).max
        self.symbol = np.full(len(order), self.none, dtype=kind)
        self.symbol[inside] = ids
        self.previous = np.full(len(order), -1, dtype=np.int32)
        self.previous[inside] = rank[before[inside]]

    def _sorted(self, key: np.ndarray, shard: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes by (shard, first depth bytes); only tied ones are looked at deeper."""
        group = shard[self.string].astype(np.int64)
        order = np.lexsort((key[self.pos], group))
        group, k = group[order], key[self.pos[order]]
        done = 8
        while True:
            edge = np.empty(len(order), dtype=bool)
            edge[:1] = True
            edge[1:] = (group[1:] != group[:-1]) | (k[1:] != k[:-1])
            alone = edge & np.append(edge[1:], True)
            if done >= depth or alone.all():
                return order
            ids = np.cumsum(edge)
            tied = np.flatnonzero(~alone)
            where = self.pos[order[tied]]
            nxt = key[np.minimum(where + done, self.end[self.string[order[tied]]])]
            sub = np.lexsort((nxt, ids[tied]))
            order[tied] = order[tied[sub]]
            group = ids
            k = np.zeros(len(order), dtype=np.uint64)
            k[tied] = nxt[sub]
            done += 8


def merged_intervals(shards: Shards, depth: int):
    """Suffixes that share at least ``depth`` bytes with another one, and their interval ids.

    depth is a multiple of STEP.  Returns (ranks, interval, passes' block counts)."""
    idx = np.arange(len(shards.pos), dtype=np.int32)
    block = np.zeros(len(idx), dtype=np.int32)
    parted = []
    for _ in range(depth // STEP):
        s = shards.symbol[idx]
        has = s != shards.none
        idx, block, s = idx[has], block[has], s[has]
        dealt = np.argsort(s, kind="stable")
        idx, s, block = shards.previous[idx[dealt]], s[dealt], block[dealt]
        edge = np.empty(len(idx) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        parted.append(int(edge.sum()) - 1)
        keep = ~(edge[:-1] & edge[1:])
        block = np.cumsum(edge[:-1], dtype=np.int32)[keep]
        idx = idx[keep]
        if not len(idx):
            break
    return idx, block, parted
