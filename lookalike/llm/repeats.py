"""Windows that recur across all texts: the distributed frame of operators 3 and 10.

    documents --md5--> exact copies (rows without text)
    documents --by id--> texts ----------------------------------------+--> marked documents
                           |                                           |
                         pieces --by anchor--> groups --> full marks --+
                                                 |                     |
                          several wordings: bodies, windows --by key--> resolver --> marks

Texts cross the network once, by id; that exchange is read three times.  Exact copies count
as one text, so that a text that a third of all rows repeat adds no piece of its own.

No key gathers many rows in one task.  Equal pieces are collapsed batch by batch before they are
shuffled: all but one of a batch are settled on the spot.  What still meets in a group are
different wordings of one anchor; at most HOT of them go to a resolver as whole bodies.  Anchors
with more (*heavy* ones are known beforehand from a share of the texts, which steers rows and
never results) are dealt window by window under a 128-bit hash of the whole window, again
collapsed batch by batch, so that a window costs a task one row for each batch that has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.llm import pieces as P
from lookalike.llm.common import joined_to_facts, keyed, written

#: Wordings of one anchor beyond which its windows are dealt by their own hashes.
HOT = 2000
#: One text in SHARE is looked at to find heavy anchors, which have at least LEAST pieces there.
SHARE, LEAST = 16, 64
#: Bytes of piece texts that a resolver gets at once (a group, of HOT bodies at most, is never cut).
BUCKET_BYTES = 2 << 20
#: Bytes of texts whose equal pieces or windows are collapsed together.
BATCH_BYTES = 16 << 20

#: loc = start << 16 | WINDOWWISE | windows << 2 | NEED | MULTI.  Before groups are made, NEED
#: alone says that a piece is settled, and both flags that it goes to the windows.
NEED, MULTI, WINDOWWISE = 1, 2, 1 << 15
WINDOWS = 0x1FFF


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    kind: str  # "byte" or "word"
    length: int
    gram: int
    first_stays: bool  # whether the first occurrence of a window is left unmarked

    def split(self, raw: np.ndarray, offsets: np.ndarray):
        """(hash per unit, units' range per text, byte start and end per unit)"""
        if self.kind == "byte":
            return P.BYTE_HASH[raw], offsets, None, None
        start, end, bounds = P.word_spans(raw, offsets)
        return P.word_hashes(raw, start, end), bounds, start, end


def _pack(start, windows, flags=0):
    return (np.asarray(start, np.int64) << 16) | (np.asarray(windows, np.int64) << 2) | flags


def _twins(key: tuple[np.ndarray, ...], uid: np.ndarray, loc: np.ndarray, first_stays: bool):
    """Rows of equal key: (settled, first, many).  settled rows are surely marked, as a twin is
    here; first are the ones that go on for their key, many those of them that have twins."""
    order = np.argsort(key[0])
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[0][order][1:] == key[0][order][:-1]
    shared = order[same[1:] | same[:-1]]
    shared = shared[np.lexsort((loc[shared], uid[shared], *(k[shared] for k in key)))]
    new = np.ones(len(shared) + 1, bool)
    new[1:-1] = np.logical_or.reduce([k[shared[1:]] != k[shared[:-1]] for k in key])
    later, many = shared[~new[:-1]], np.zeros(len(uid), bool)
    many[shared[new[:-1] & ~new[1:]]] = True
    first = np.ones(len(uid), bool)
    first[later] = False
    return (~first if first_stays else ~first | many), first, many


def _spread(uid: np.ndarray, loc: np.ndarray) -> np.ndarray:
    return P.mix((uid * (1 << 20) + loc).astype(np.uint64)).view(np.int64)


def _pieces(units: Units, heavy: np.ndarray) -> Callable:
    names = ["_key", "_piece", "_uid", "_loc"]

    def settled(parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, piece, uid, loc = (np.concatenate(x) for x in zip(*parts, strict=True))
        done, first, many = _twins((piece, key), uid, loc, units.first_stays)
        hot = first & np.isin(key, heavy)
        plain = first & ~hot
        groups = [(key[plain], piece[plain], uid[plain], loc[plain] | np.where(many[plain], MULTI, 0))]
        for rows, flags in ((done & ~plain, NEED), (hot, NEED | MULTI)):
            u, x = uid[rows], loc[rows]
            groups.append((_spread(u, x), np.zeros(len(u), np.int64), u, x | flags))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*groups, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("_uid").to_numpy(zero_copy_only=False)
            raw, off = P.string_buffers(batch.column("_text"))
            live = batch.column("_later").is_null().to_numpy(zero_copy_only=False)
            parts, size = [], 0
            for i, j in P.slices(off):
                o = off[i : j + 1] - off[i]
                h, bounds, _, _ = units.split(raw[off[i] : off[j]], o)
                text, start, n, anchor, piece = P.cut(h, bounds, units.length, units.gram)
                keep = live[i + text]
                parts.append((anchor[keep], piece[keep], uid[i + text[keep]], _pack(start[keep], n[keep])))
                size += int(o[-1])
                if size >= BATCH_BYTES:
                    yield from settled(parts)
                    parts, size = [], 0
            yield from settled(parts)

    return run


def _groups(units: Units) -> Callable:
    """Rows come sorted by (_key, _piece, _uid, _loc); state is one row and one pending wording."""
    names = ["_uid", "_loc", "_key"]

    def rows(uid, loc, key):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (uid, loc, key)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, judged already
        carry = None  # rows still to judge
        pend = None  # first wording of its key; a second one has not come yet

        def judge(k, p, u, loc, known):
            """The first ``known`` rows; the one after them is only looked at."""
            nonlocal last, pend
            n = known
            if not n:
                return
            pk = np.concatenate([[k[0] if last is None else last[0]], k[: n - 1]])
            pp = np.concatenate([[p[0] if last is None else last[1]], p[: n - 1]])
            new_key = k[:n] != pk
            if last is None:
                new_key[0] = True
            new_piece = new_key | (p[:n] != pp)
            same_next = np.zeros(n, dtype=bool)
            m = min(n, len(k) - 1)
            same_next[:m] = (k[1 : m + 1] == k[:m]) & (p[1 : m + 1] == p[:m])
            several = same_next | (loc[:n] & MULTI > 0)
            full = ~new_piece if units.first_stays else ~new_piece | several
            out = []
            if full.any():
                x = loc[:n][full] & ~MULTI
                out.append(rows(u[:n][full], x, _spread(u[:n][full], x)))
            rep = np.flatnonzero(new_piece)
            if len(rep):
                later = ~new_key[rep]
                if pend is not None and later[0]:
                    out.append(rows(*pend))
                pend = None
                follows = np.append(later[1:], False)
                need = later | follows
                mark = np.where(several[rep], MULTI, 0) | NEED
                if need.any():
                    r = rep[need]
                    out.append(rows(u[r], loc[r] | mark[need], k[r]))
                if not later[-1]:
                    r = rep[-1]
                    pend = ([u[r]], [loc[r] | mark[-1]], [k[r]])
            last = (k[n - 1], p[n - 1])
            yield from out

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_piece", "_uid", "_loc")]
            known = cols[3] & NEED > 0
            if known.any():
                key, _, u, loc = (c[known] for c in cols)
                yield rows(u, np.where(loc & MULTI, loc & ~MULTI | WINDOWWISE, loc & ~NEED), key)
                cols = [c[~known] for c in cols]
            if carry is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            yield from judge(*cols, len(cols[0]) - 1)
            carry = [c[-1:] for c in cols]
        if carry is not None:
            yield from judge(*carry, 1)

    return run


def _texts(units: Units) -> Callable:
    """What the groups need of their pieces: bodies under the group's key, or all windows of hot
    anchors, each under its own hash (_key, _body: a second one)."""
    names = ["_key", "_body", "_uid", "_loc"]

    def settled(parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, second, uid, loc = (np.concatenate(x) for x in zip(*parts, strict=True))
        done, first, many = _twins((key, second), uid, loc, units.first_stays)
        done &= ~(first & many)  # that one is told to the resolver, which marks it
        out = [(key[first], second[first], uid[first], loc[first] | np.where(many[first], MULTI, 0)), (_spread(uid[done], loc[done]), second[done], uid[done], loc[done] | NEED)]
        key, second, uid, loc = (np.concatenate(x) for x in zip(*out, strict=True))
        body = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, 8 * len(key) + 1, 8, dtype=np.int32).tobytes()), pa.py_buffer(second.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(key), body, pa.array(uid), pa.array(loc | WINDOWWISE)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = P.string_buffers(batch.column("_text"))
            marks = batch.column("_marks")
            flat = marks.flatten()
            moff = np.concatenate([[0], np.cumsum(marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            loc = flat.field("_loc").to_numpy(zero_copy_only=False)
            key = flat.field("_key").to_numpy(zero_copy_only=False)
            hot = flat.field("_hot").to_numpy(zero_copy_only=False).astype(bool) | (loc & WINDOWWISE > 0)
            owner = np.repeat(np.arange(len(marks)), np.diff(moff))
            need = np.flatnonzero(loc & NEED)
            uid = batch.column("_uid").to_numpy(zero_copy_only=False)
            data = raw.tobytes()
            keys, bodies, uids, locs, windows, size = [], [], [], [], [], 0
            seen, words = -1, None
            for i in need:
                t = owner[i]
                start, n, multi = int(loc[i]) >> 16, (int(loc[i]) >> 2) & WINDOWS, int(loc[i]) & MULTI
                if units.kind == "word":
                    if t != seen:
                        seen, words = t, data[off[t] : off[t + 1]].split()
                    body = b" ".join(words[start : start + n + units.length - 1])
                else:
                    b = off[t] + start
                    body = data[b : b + n + units.length - 1]
                if not hot[i]:
                    keys.append(key[i]); bodies.append(body); uids.append(uid[t]); locs.append(_pack(start, n, multi))
                    continue
                one, two = _window_hashes(units, body, n)
                windows.append((one, two, np.full(n, uid[t], np.int64), _pack(start + np.arange(n), 1)))
                size += 32 * n
                if size >= BATCH_BYTES:
                    yield from settled(windows)
                    windows, size = [], 0
            yield from settled(windows)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)), pa.array(bodies, pa.binary()), pa.array(np.array(uids, np.int64)), pa.array(np.array(locs, np.int64))], names)

    return run


def _window_hashes(units: Units, body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each of the body's n windows."""
    raw = np.frombuffer(body, np.uint8)
    h, _, _, _ = units.split(raw, np.array([0, len(raw)]))
    at = np.arange(n)
    one, two = (P.spans_hash(P.prefix_hash(x), at, at + units.length).view(np.int64) for x in (h, P.mix(h + np.uint64(0xA0761D6478BD642F))))
    return one, two


def _resolved(resolve: Callable, first_stays: bool) -> Callable:
    """Collects buckets of whole groups; equal texts in a group are met once.  Windows that come
    under their own hashes are settled as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(uid, loc):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(uid, np.int64)), pa.array(np.asarray(loc, np.int64))], ["_uid", "_loc"])

        def flush():
            if len(bodies) > 1 or (bodies and multi[0]):
                u, m = resolve(bodies, np.array(uids, np.int64), np.array(locs, np.int64) & ~MULTI, np.array(multi, bool), np.array(groups, np.int64))
                if len(u):
                    yield out(u, m)

        bodies, uids, locs, multi, groups, size, key, group = [], [], [], [], [], 0, None, 0
        window, head = None, None  # the window met last, and its first row unless that is marked
        for batch in batches:
            again_u, again_l = [], []
            for k, b, u, loc in zip(batch.column("_key").to_pylist(), batch.column("_body").to_pylist(), batch.column("_uid").to_pylist(), batch.column("_loc").to_pylist(), strict=True):
                if loc & WINDOWWISE:
                    at = loc & ~(WINDOWWISE | NEED | MULTI)
                    if loc & NEED:
                        again_u.append(u); again_l.append(at)
                    elif (k, b) == window:
                        again_u.append(u); again_l.append(at)
                        if head is not None and not first_stays:
                            again_u.append(head[0]); again_l.append(head[1])
                        head = None
                    else:
                        window, head = (k, b), (u, at)
                        if loc & MULTI and not first_stays:
                            again_u.append(u); again_l.append(at)
                            head = None
                    continue
                if k != key:
                    if size >= BUCKET_BYTES:
                        yield from flush()
                        bodies, uids, locs, multi, groups, size, group = [], [], [], [], [], 0, 0
                    key, group = k, group + 1
                elif bodies and bodies[-1] == b:
                    again_u.append(u)
                    again_l.append(loc & ~MULTI)
                    multi[-1] = True
                    if not first_stays:
                        again_u.append(uids[-1])
                        again_l.append(locs[-1] & ~MULTI)
                    continue
                bodies.append(b); uids.append(u); locs.append(loc); multi.append(bool(loc & MULTI)); groups.append(group)
                size += len(b)
            if again_u:
                yield out(again_u, again_l)
        yield from flush()

    return run


def marked(docs: DataFrame, units: Units, resolve: Callable, digest: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """digest gets batches with _uid, _id, _text, _copies (rows of that text), _later (null: the
    first of them) and _marks, _more (lists of loc: windows to mark), with carry also _rest; it yields rows of schema,
    followed by _rest.  Carried columns travel with the texts, so no later join is needed."""
    base = keyed(docs, id_col, text_col, carry)
    cols = [*base.columns, "_copies", "_later"]
    out = T._parse_datatype_string(schema)
    if carry:
        out.add("_rest", base.schema["_rest"].dataType)
    hashed = base.select("_uid", F.md5("_text").alias("_hash"))
    same = hashed.groupBy("_hash").agg(F.min("_uid").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    copies = written(joined_to_facts(hashed, same, "_hash", "_copies").select("_uid", "_copies", F.when(F.col("_uid") != F.col("_first"), F.col("_first")).alias("_later")))
    longs = "_key long not null, _piece long not null, _uid long not null, _loc long not null"
    heavy = _heavy(base, units, longs)
    texts = base.repartition("_uid").join(copies, "_uid", "left")
    cut = texts.select(*cols).mapInArrow(_pieces(units, heavy), longs)
    groups = cut.repartition("_key").sortWithinPartitions("_key", "_piece", "_uid", "_loc").mapInArrow(_groups(units), "_uid long not null, _loc long not null, _key long not null").repartition("_key")
    # _top is asked for only to read all columns: pruned ones would make the exchange another.
    tally = groups.groupBy("_key").agg(F.sum(F.col("_loc").bitwiseAND(NEED)).alias("_n"), F.max("_uid").alias("_top"))
    hot = tally.where(f"_n > {HOT} and _top is not null").select("_key", F.lit(True).alias("_hot"))
    marks = groups.join(hot, "_key", "left").groupBy("_uid").agg(F.collect_list(F.struct("_loc", "_key", F.coalesce("_hot", F.lit(False)).alias("_hot"))).alias("_marks"))
    # The same join serves both readers: with other columns or filters its exchanges would differ.
    every = texts.join(marks, "_uid", "left")
    bodies = every.select(*cols, "_marks").mapInArrow(_texts(units), "_key long not null, _body binary not null, _uid long not null, _loc long not null")
    more = bodies.repartition("_key").sortWithinPartitions("_key", "_body", "_uid", "_loc").mapInArrow(_resolved(resolve, units.first_stays), "_uid long, _loc long")
    extra = more.groupBy("_uid").agg(F.collect_list("_loc").alias("_more"))
    return every.join(extra, "_uid", "left").select(*cols, F.col("_marks._loc").alias("_marks"), "_more").mapInArrow(digest, out)


def _heavy(base: DataFrame, units: Units, longs: str) -> np.ndarray:
    """Anchors that would fill half a task of a shuffle, by a share of the texts: twice the
    number of shuffle partitions at most."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = base.where(F.pmod(F.xxhash64("_uid"), F.lit(SHARE)) == 0).select("_uid", "_text", F.lit(None).cast("long").alias("_later"))
    counts = written(some.mapInArrow(_pieces(units, np.zeros(0, np.int64)), longs).where(F.col("_loc").bitwiseAND(NEED) == 0).groupBy("_key").count())
    least = max((counts.agg(F.sum("count")).first()[0] or 0) / (2 * parts), LEAST)
    return np.array([r[0] for r in counts.where(F.col("count") > least).select("_key").collect()], np.int64)


def mark_lists(batch: pa.RecordBatch):
    """Per row, arrays (start, windows) of what groups and resolver marked."""
    for a, b in zip(batch.column("_marks").to_pylist(), batch.column("_more").to_pylist(), strict=True):
        x = np.array([v for v in a or () if not v & NEED] + (b or []), dtype=np.int64)
        yield x >> 16, (x >> 2) & WINDOWS


def covered(n: int, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of n units lie in a marked window."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, start, 1)
    np.subtract.at(d, start + windows + length - 1, 1)
    return np.cumsum(d[:n]) > 0
