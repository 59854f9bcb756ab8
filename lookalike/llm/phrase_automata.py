"""Operator 3: substring dedup with repeated-phrase automata.

A window is ``words`` consecutive words; every word covered by a window that also starts
anywhere else goes, first occurrences too.  :mod:`lookalike.llm.repeats` shards the piece texts
of all documents by anchor.  In each shard recurring passages are confirmed, maximal runs of
them become the patterns of one Aho-Corasick automaton (pyahocorasick), and all piece texts of
the shard stream through it, which locates every occurrence exactly.

Nulls have no words; texts under ``words`` words stay whole; repeated rows are documents of
their own (and so repeat each other); an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lookalike.llm import pieces as P
from lookalike.llm.common import table
from lookalike.llm.repeats import Units, _pack, covered, mark_lists, marked


def _locate(patterns: list[bytes], texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(pattern, text, byte where it starts) of every occurrence between word borders."""
    automaton = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        automaton.add_word((b" " + p + b" ").decode("latin-1"), k)
    automaton.make_automaton()
    sizes = [len(p) for p in patterns]
    for t, text in enumerate(texts):
        for end, k in automaton.iter((b" " + text + b" ").decode("latin-1")):
            yield k, t, end - sizes[k] - 1


def _resolver(words: int):
    def resolve(bodies, uid, loc, multi, group):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        start, end, bounds = P.word_spans(raw, off)
        windows = np.diff(bounds) - words + 1
        owner = np.repeat(np.arange(len(bodies)), windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = bounds[owner] + inner
        prints = P.spans_hash(P.prefix_hash(P.word_hashes(raw, start, end)), at, at + words)
        # Passages are confirmed by their counts; a run goes on while the same pieces hold it.
        _, ids = np.unique(prints, return_inverse=True)
        recurs = np.bincount(ids, weights=1 + multi[owner]) >= 2
        salt = P.mix(np.arange(1, len(bodies) + 1, dtype=np.uint64))
        holders = np.zeros(len(recurs), np.uint64)
        np.add.at(holders, ids, salt[owner])
        hit = recurs[ids]
        if not hit.any():
            return none
        runs = hit.copy()
        runs[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]) & (holders[ids[1:]] == holders[ids[:-1]]))
        head = np.flatnonzero(runs)
        numbered = np.cumsum(runs)
        size = np.bincount(numbered[hit], minlength=len(head) + 1)[1:]
        first = at[head]
        passages = list({raw[start[a] : end[a + m + words - 2]].tobytes(): None for a, m in zip(first, size, strict=True)})
        found = np.zeros(len(hit), bool)
        base = np.cumsum(windows) - windows

        def stream(patterns):
            """Marks the places of patterns that the automaton meets twice or more."""
            lengths = [p.count(b" ") + 1 for p in patterns]
            places: list[list[tuple[int, int]]] = [[] for _ in patterns]
            for k, t, byte in _locate(patterns, bodies):
                places[k].append((t, base[t] + int(np.searchsorted(start, off[t] + byte)) - bounds[t]))
            for length, met in zip(lengths, places, strict=True):
                if sum(1 + multi[t] for t, _ in met) >= 2:
                    for _, w in met:
                        found[w : w + length - words + 1] = True

        stream(passages)
        if (missed := np.flatnonzero(hit & ~found)).size:  # a passage that some holder has in parts
            stream(list({raw[start[a] : end[a + words - 1]].tobytes(): None for a in at[missed]}))
        edge = np.flatnonzero(found & np.r_[True, ~found[:-1] | (owner[1:] != owner[:-1])])
        last = np.flatnonzero(found & np.r_[~found[1:] | (owner[1:] != owner[:-1]), True])
        return uid[owner[edge]], _pack((loc[owner[edge]] >> 16) + inner[edge], last - edge + 1)

    return resolve


def _digest(words: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
            raw, off = P.string_buffers(batch.column("_text"))
            data = raw.tobytes()
            for i, ((start, n), copies) in enumerate(zip(mark_lists(batch), batch.column("_copies").to_pylist(), strict=True)):
                said = kept = data[off[i] : off[i + 1]].split()
                if copies is not None and copies > 1 and len(said) >= words:
                    kept = []
                elif len(start):
                    gone = covered(len(said), start, n, words)
                    kept = [w for w, g in zip(said, gone.tolist(), strict=True) if not g]
                body = b" ".join(kept)
                out["n_words"].append(len(said))
                out["n_removed"].append(len(said) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(body).hexdigest())
                out["kept"].append(body.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def remove_phrases(docs: DataFrame, words: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (if with_text)."""
    if words < 16:
        raise ValueError("words must be 16 at least")
    units = Units("word", words, 8, first_stays=False)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return marked(docs, units, _resolver(words), _digest(words, with_text), schema, id_col, text_col)


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, k, md5_number(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
b AS (SELECT r, k FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS x FROM b),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
s AS (SELECT u.r, count(g.x) AS n_removed, string_agg(CASE WHEN g.x IS NULL THEN word END, ' ' ORDER BY u.x) AS kept FROM u LEFT JOIN g ON u.r = g.r AND u.x = g.x GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""
