"""Operator 13: phrase collocations counted with broadcast double-array tries.

``encode`` cuts the texts of a language into blocks, each with the list of its own words and the
text as numbers into that list (0: end of a piece).  Words are counted over all blocks by joins, and
those that are frequent get a number, by language and falling count; the blocks are then written once more in
these numbers, with 0 for all other words, which no frequent phrase can hold.  No list of words is
ever broadcast.

Phrases grow a word at a time.  A phrase of k words can be frequent only if both its parts of k - 1
words are; a block tallies the phrases of k words that it holds and both of whose parts are in the
tries of level k - 1, and the tallies' sum, a bound of the phrase's count, decides whether it is a
candidate of level k.  The candidates go into double-array tries, at most TRIE phrases each, split by
the phrase, that are broadcast in rounds of at most ROUND bytes.  A block meets every trie of its
language: numpy advances the states of all its text positions at once, a level for each word, counts
the accepting states with one bincount, and Spark sums the blocks.  These counts are the phrases'.

Null texts are empty; a null language is ``und``, one with the language of that name; repeated rows
and null ids are documents of their own; very long texts may be a block of their own; an empty
table gives no rows; other columns are not looked at.  Ties go as the contract of ``collocations`` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookalike.llm import pieces as P
from lookalike.llm.common import table, written
from lookalike.llm.inverted import _Codes
from lookalike.sources.ranges import ranked

#: Bytes of text in a block; phrases in a trie; bytes of tries that are broadcast at once.
BLOCK_BYTES, TRIE, ROUND = 8 << 20, 1 << 16, 64 << 20
#: Tallies that a task keeps; text positions that are worked on at once.
TALLY, SLICE = 1 << 20, 1 << 19
#: Places of a double array that are tried at once.
WINDOW = 2048
#: A-Z are lower-cased, ends of pieces become one sign.
_SIGNS = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words, and ``.`` for the end of a piece."""
    return text.translate(_SIGNS).replace(b".", b" . ").split()  # only spaces and tabs are left to split at


def encode(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, n, codes): a block; words[i] occurs n[i] times; codes are places in words from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Codes, list, list]] = {}  # of each language: numbers of its words, parts of the text, bytes

        def block(lang: str) -> pa.RecordBatch:
            codes, parts, _ = open_.pop(lang)
            text = np.concatenate(parts)
            n = np.bincount(text, minlength=len(codes))[1:]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([list(codes)[1:]], pa.list_(pa.binary())), pa.array([n], pa.list_(pa.int64())), pa.array([text.tobytes()])], ["lang", "words", "n", "codes"])

        for batch in batches:
            raw, off = P.string_buffers(batch.column(1))
            for k, lang in enumerate(batch.column(0).to_pylist()):
                codes, parts, size = open_.setdefault(lang, (_Codes({b".": 0}), [], [0]))
                said = words_of(raw[off[k] : off[k + 1]].tobytes())
                parts += [np.fromiter(map(codes.__getitem__, said), np.int32, len(said)), np.zeros(1, np.int32)]
                size[0] += int(off[k + 1] - off[k])
                if size[0] >= BLOCK_BYTES or sum(s[0] for _, _, s in open_.values()) >= 4 * BLOCK_BYTES:
                    yield block(lang)
        for lang in list(open_):
            yield block(lang)

    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, "lang string, words array<binary>, n array<long>, codes binary")


def numbered(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, text): blocks in the words' numbers.  blocks has ``block``; words has lang, word, id."""
    said = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    found = said.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, codes, ids = (c[i] for c in batch.columns)
                code = np.frombuffer(codes.as_py(), np.int32)
                new = np.zeros(code.max(initial=0) + 1, np.int32)
                pairs = ids.values
                new[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                text = new[code]
                live = text > 0  # of several ends in a row one says it all
                keep = live | np.r_[True, live[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([text[keep].tobytes()])], ["lang", "text"])

    return blocks.select("block", "lang", "codes").join(found, "block").select("lang", "codes", "ids").mapInArrow(run, "lang string, text binary")


class Trie:
    """A double array over word numbers: from state s the word w leads to base[s] + w if check there is s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, phrase: np.ndarray):
        self.base, self.check, self.phrase = base, check, phrase

    @classmethod
    def of(cls, phrases: np.ndarray, names: np.ndarray) -> Trie:
        """phrases: distinct rows of word numbers, names: a number for each."""
        order = np.lexsort(phrases.T[::-1])
        phrases, names = phrases[order], names[order]
        k = phrases.shape[1]
        top = int(phrases.max()) - int(phrases.min()) + 1
        size = top + 4 * len(phrases) * k + 1024
        base, check, phrase = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int64)
        free = np.ones(size, bool)
        free[0] = False  # the root
        state, group = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        low = dense = 1
        for level in range(k):
            # children: runs of equal (prefix, word); parents in order of the number of their children
            new = np.r_[True, (group[1:] != group[:-1]) | (phrases[1:, level] != phrases[:-1, level])]
            first = np.flatnonzero(new)
            parent, word = group[first], phrases[first, level]
            begin = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            count = np.diff(np.append(begin, len(parent)))
            placed = np.empty(len(first), np.int64)
            for p in np.argsort(-count, kind="stable"):
                children = slice(begin[p], begin[p] + count[p])
                w = word[children]
                low += int(np.argmax(free[low:]))
                at = low
                if count[p] > 1:
                    dense = max(dense, low)
                    at = dense
                    while True:  # all places of a window at once: those for the smallest word at which all words are free
                        if at + WINDOW + w[-1] - w[0] >= len(free):
                            more = WINDOW + top + len(free) // 4
                            base, check = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32))
                            phrase, free = np.append(phrase, np.full(more, -1, np.int64)), np.append(free, np.ones(more, bool))
                        fits = free[at : at + WINDOW].copy()
                        if fits.sum() < WINDOW // 16 and at == dense:
                            dense += WINDOW  # what is left there is for single words
                        for x in w[1:] - w[0]:
                            fits &= free[at + x : at + x + WINDOW]
                        if fits.any():
                            at += int(np.argmax(fits))
                            break
                        at += WINDOW
                elif at + top >= len(free):
                    more = top + len(free) // 4
                    base, check = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32))
                    phrase, free = np.append(phrase, np.full(more, -1, np.int64)), np.append(free, np.ones(more, bool))
                to = at - w[0] + w
                base[state[first[children.start]]] = at - w[0]
                check[to] = state[first[children.start]]
                free[to] = False
                placed[children] = to
            run = np.cumsum(new) - 1
            state, group = placed[run], run
        phrase[state] = names
        end = int(np.flatnonzero(~free)[-1]) + 1
        return cls(base[:end], check[:end], phrase[:end])

    def run(self, text: np.ndarray, k: int) -> np.ndarray:
        """The state after the k words from each place, 0 if the trie has no such path."""
        state = np.zeros(max(len(text) - k + 1, 0), np.int32)
        for i in range(0, len(state), SLICE):  # all positions of a slice at once
            live = np.arange(i, min(i + SLICE, len(state)), dtype=np.int32)
            at = np.zeros(len(live), np.int32)
            for level in range(k):
                word = text[live + level]
                to = self.base[at].astype(np.int64) + word
                ok = (word > 0) & (to >= 0) & (to < len(self.check))
                ok[ok] = self.check[to[ok]] == at[ok]
                live, at = live[ok], to[ok].astype(np.int32)
            state[live] = at
        return state


def tries(phrases: DataFrame, k: int) -> DataFrame:
    """(lang, trie, base, check, phrase): candidates (lang, id, words) in tries of some TRIE phrases."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for i in range(batch.num_rows):
                lang, rows = batch.column(0)[i].as_py(), batch.column(1)[i].values
                words = rows.field("words").flatten().to_numpy().reshape(-1, k)
                made = Trie.of(words, rows.field("id").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *(pa.array([x.tobytes()]) for x in (made.base, made.check, made.phrase))], ["lang", "base", "check", "phrase"])

    sizes = phrases.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TRIE).alias("shards"))
    split = phrases.join(F.broadcast(sizes), "lang").groupBy("lang", F.pmod(F.xxhash64("words"), "shards").alias("shard"))  # a row a language
    return written(split.agg(F.collect_list(F.struct("id", "words")).alias("rows")).select("lang", "rows").mapInArrow(run, "lang string, base binary, check binary, phrase binary").withColumn("trie", F.monotonically_increasing_id()))


def rounds(made: DataFrame) -> list[DataFrame]:
    """The tries, dealt so that each round holds some ROUND bytes."""
    size = made.agg(F.coalesce(F.sum(F.length("base") + F.length("check") + F.length("phrase")), F.lit(0))).first()[0]
    n = max(1, -(-size // ROUND))
    return [made.where(F.pmod(F.xxhash64("base", "check", "lang"), F.lit(n)) == i) for i in range(n)]


class _Tally:
    """Counts of pairs of numbers below 2**31, added up over the blocks of a task; some TALLY of them
    are sent on at a time."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, first: np.ndarray, then: np.ndarray) -> None:
        for i in range(0, len(first), SLICE):
            self._add(first[i : i + SLICE], then[i : i + SLICE])

    def _add(self, first: np.ndarray, then: np.ndarray) -> None:
        keys, n = np.unique(first.astype(np.int64) << 32 | then, return_counts=True)
        if len(self.keys):
            keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[new], np.add.reduceat(n, new)
        self.keys, self.n = keys, n

    def full(self, least: int | None = None) -> Iterator[pa.RecordBatch]:
        if len(self.keys) >= (TALLY if least is None else least):
            for i in range(0, len(self.keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(self.keys[i : i + (1 << 16)]), pa.array(self.n[i : i + (1 << 16)])], ["pair", "n"])
            self.__init__()


def pairs(blocks: DataFrame) -> DataFrame:
    """(first, then, n): how often two frequent words follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for text in batch.column(0):
                x = np.frombuffer(text.as_buffer(), np.int32)
                both = (x[:-1] > 0) & (x[1:] > 0)
                tally.add(x[:-1][both], x[1:][both])
                yield from tally.full()
        yield from tally.full(0)

    found = blocks.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.select(F.shiftright("pair", 32).alias("first"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("then"), "n")


def counted(blocks: DataFrame, made: DataFrame, k: int, longer: bool) -> DataFrame:
    """(first, then, n): n occurrences of the phrase numbered ``first``, if ``then`` is 0; else of that
    phrase with the word numbered ``then`` after it (only if ``longer``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, tuple[np.ndarray, _Tally]] = {}  # of each trie

        def named(phrase: np.ndarray, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:  # states become phrases; a second number of 0 is the phrase itself
                pair = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(phrase[pair >> 32]), pa.array(pair & 0xFFFFFFFF), part.column(1)], ["first", "then", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                text, base, check, phrase = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns[:4], (np.int32, np.int32, np.int32, np.int64), strict=True))
                state = Trie(base, check, phrase).run(text, k)
                n = np.bincount(state, minlength=1)
                n[0] = 0
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(phrase[hit]), pa.array(np.zeros(len(hit), np.int64)), pa.array(n[hit])], ["first", "then", "n"])
                if longer and len(state):
                    names, tally = tallies.setdefault(batch.column(4)[i].as_py(), (phrase.copy(), _Tally()))
                    state, after = state[:-1], text[k:]
                    both = (state > 0) & (after > 0)
                    tally.add(state[both], after[both])
                    yield from named(names, tally.full(TALLY // len(tallies)))
        for names, tally in tallies.values():
            yield from named(names, tally.full(0))

    parts = [blocks.join(F.broadcast(r), "lang").select("text", "base", "check", "phrase", "trie").mapInArrow(run, "first long, then long, n long") for r in rounds(made)]
    return reduce(DataFrame.unionByName, parts).groupBy("first", "then").agg(F.sum("n").alias("n"))


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Arrow batches of some ``size`` bytes in the jobs that run inside, as a row may be a whole block."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, words, f)): all words of each language; phrases of 1 to ``longest`` words with
    f >= least occurrences, words as texts."""
    with batches_of(docs.sparkSession, BLOCK_BYTES):
        cut = written(encode(docs, text_col, lang_col).withColumn("block", F.monotonically_increasing_id()))
        said = cut.select("lang", F.explode(F.arrays_zip("words", "n")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.n").alias("f"))
        totals = cut.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
        often = said.where(F.col("f") >= least).withColumn("_rare", -F.col("f"))
        words = written(ranked(written(often), ["lang", "_rare", "word"], "id").select("lang", "word", F.col("word").cast("string").alias("name"), F.col("id").cast("int").alias("id"), "f"))
        blocks = written(numbered(cut, words))
        grams = [words.select("lang", F.array("name").alias("words"), "f")]

        names = words.select(F.col("id").alias("then"), F.col("name").alias("last"))
        firsts = words.select("lang", F.col("id").alias("first"), F.col("name").alias("head"))
        found = written(pairs(blocks).where(F.col("n") >= least)).join(firsts, "first").join(names, "then")
        level = found.select("lang", F.array(F.col("first").cast("int"), F.col("then").cast("int")).alias("ids"), F.array("head", "last").alias("words"))
        for k in range(2, longest + 1):
            level = written(level.withColumn("id", F.monotonically_increasing_id()))
            sums = written(counted(blocks, tries(level.select("lang", "id", F.col("ids").alias("words")), k), k, k < longest).where(F.col("n") >= least))
            level = level.join(sums.where("then = 0").select(F.col("first").alias("id"), F.col("n").alias("f")), "id")
            grams.append(level.select("lang", "words", "f"))
            if k < longest:  # both parts are frequent: the first is a phrase of this level, and so must the rest be
                more = sums.where("then > 0").join(level.select(F.col("id").alias("first"), "lang", "ids", "words"), "first").join(names, "then")
                more = more.select("lang", F.concat("ids", F.array(F.col("then").cast("int"))).alias("ids"), F.concat("words", F.array("last")).alias("words"))
                level = more.join(level.select(F.col("lang").alias("_lang"), F.col("ids").alias("_rest")), (F.col("lang") == F.col("_lang")) & (F.slice("ids", 2, k) == F.col("_rest")), "left_semi")
    return totals, reduce(DataFrame.unionByName, grams)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A phrase with a occurrences is cut in two parts with l and r occurrences where
    floor(2000000 a / (l + r)) is least, at the earliest such place.  A phrase inside a longer one that
    has at least 80 in 100 of its occurrences is left out.  Equal scores go by a, then by the phrase."""
    totals, found = phrases(docs, least, longest, text_col, lang_col)
    grams = written(found)
    part = lambda name: grams.select(F.col("lang"), F.col("words").alias(f"_{name}"), F.col("f").alias(name))
    several = grams.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = several.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", 1, F.col("k")).alias("_l"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("_r"))
    cuts = cuts.join(part("l"), ["lang", "_l"]).join(part("r"), ["lang", "_r"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div cast(l + r as decimal(20,0))")
    scored = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))))
    inside = several.where(F.size("words") > 2).select("lang", "a", F.explode(within).alias("words")).groupBy("lang", "words").agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "words"], "left").where(F.expr("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"))
    named = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")  # a row a language


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, (VALUES (1), (2), (3), (4)) AS s(m) WHERE len(w) >= m) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
x AS (SELECT c.*, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
      JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
s AS (SELECT lang, phrase, a, l, r, score FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
b AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
      FROM s LEFT JOIN b ON b.lang = s.lang AND b.phrase = s.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""
