"""Operator 10: removal of repeated byte strings with merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller id, or
same document, earlier start) is marked.  Candidates come from :mod:`lookalike.llm.repeats`;
in each bucket the differing piece texts form shards with their own transforms, which are
merged by interleave refinement (:mod:`lookalike.llm.bwt`); the merge's repeated intervals
say which windows recur, and the least occurrence of each interval stays.

Nulls count as empty texts; texts under ``length`` bytes are returned whole; repeated rows are
documents of their own (the earlier one stays); an empty table gives no rows; other columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm import bwt
from lookalike.llm import pieces as P
from lookalike.llm.common import table
from lookalike.llm.repeats import Units, _pack, covered, mark_lists, marked

#: Shards of a bucket at most; the wordings of a group are dealt to different ones.
SHARDS = 64


def _resolver(length: int):
    def resolve(bodies, uid, loc, multi, group):
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies], np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(bodies)), windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        # Stretches whose window fingerprints recur: equal windows have equal ones, so none is lost.
        at = off[owner] + inner
        prints = P.spans_hash(P.prefix_hash(P.BYTE_HASH[raw]), at, at + length)
        order = np.argsort(prints)
        ranked = prints[order]
        twin = np.zeros(len(prints) + 1, bool)
        twin[1:-1] = ranked[1:] == ranked[:-1]
        again = np.zeros(len(prints), bool)
        again[order] = twin[1:] | twin[:-1]
        head = np.flatnonzero(again & np.r_[True, ~again[:-1] | (owner[1:] != owner[:-1])])
        if not len(head):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tail = np.flatnonzero(again & np.r_[~again[1:] | (owner[1:] != owner[:-1]), True])
        run_of, first, size = owner[head], inner[head], tail - head + length
        lo = off[run_of] + first
        run_off = np.concatenate([[0], np.cumsum(size)])
        text = raw[np.repeat(lo - run_off[:-1], size) + np.arange(run_off[-1])]
        number = np.arange(len(run_of)) - np.searchsorted(group[run_of], group[run_of])
        shards = bwt.Shards(text, run_off, number % SHARDS, length)
        ranks, interval, _ = bwt.merged_intervals(shards, length)
        string = shards.string[ranks]
        start = (loc[run_of[string]] >> 16) + first[string] + shards.pos[ranks] - shards.begin[string]
        who = uid[run_of[string]]
        by = np.lexsort((start, who, interval))
        earliest = np.r_[True, interval[by][1:] != interval[by][:-1]]
        by = by[~earliest]
        by = by[np.lexsort((start[by], who[by]))]
        who, start = who[by], start[by]
        if not len(who):
            return who, start
        edge = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (start[1:] > start[:-1] + 1)])
        last = np.append(edge[1:], len(who)) - 1
        return _split(who[edge], start[edge], start[last] - start[edge] + 1)

    return resolve


def _split(who, start, n, most=4096):
    """Runs as locs; a loc holds fewer than 8192 windows."""
    parts = -(-n // most)
    rep = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
    return who[rep], _pack(start[rep] + k * most, np.minimum(n[rep] - k * most, most))


def _digest(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            raw, off = P.string_buffers(batch.column("_text"))
            data = raw.tobytes()
            for i, ((start, n), later) in enumerate(zip(mark_lists(batch), batch.column("_later").to_pylist(), strict=True)):
                body = data[off[i] : off[i + 1]]
                spans = 0
                kept = body
                if later is not None and len(body) >= length:
                    kept, spans = b"", 1
                elif len(start):
                    gone = covered(len(body), start, n, length)
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out["n_bytes"].append(len(body))
                out["n_removed"].append(len(body) - len(kept))
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
            rest = [batch.column("_rest")] if "_rest" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("_uid"), batch.column("_id").cast(pa.int64()), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string()), *rest],
                ["_uid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *(["_rest"] if rest else [])],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and with
    carry _rest, a struct of those columns.

    kept_text (null unless with_text) drops bytes of a character that a span cuts apart, so that
    it stays valid UTF-8.  ``length`` is a multiple of four."""
    if length % bwt.STEP or length < 40:
        raise ValueError("length must be a multiple of 4, 40 at least")
    units = Units("byte", length, 32, first_stays=True)
    schema = "_uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return marked(docs, units, _resolver(length), _digest(length, with_text), schema, id_col, text_col, carry).drop("_uid")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated spans; a document of which nothing stays goes."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = remove_repeats(docs, with_text=True, carry=rest).where("length(kept_text) > 0 or n_removed = 0")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"_rest.{c}").alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
p AS (SELECT r, k, md5_number(substring(t, 2 * k - 1, 200)) AS h FROM (SELECT r, t, unnest(range(1, len(t) // 2 - 98)) AS k FROM d WHERE len(t) >= 200)),
b AS (SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY h ORDER BY r, k) AS i FROM p) WHERE i > 1),
e AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM b),
n AS (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS i FROM e),
g AS (SELECT r, i, min(k) AS lo, max(k) + 100 AS hi FROM n GROUP BY r, i),
f AS (SELECT r, i, hi AS lo2, coalesce(lead(lo) OVER (PARTITION BY r ORDER BY lo), 1000000000000) AS hi2, lo, hi FROM g),
s AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans,
             substring(any_value(t), 1, 2 * (min(lo) - 1)) || string_agg(substring(t, 2 * lo2 - 1, 2 * (least(hi2, len(t) // 2 + 1) - lo2)), '' ORDER BY lo) AS kept
      FROM f JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, t))) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""
