"""Collocations counted over a prefix-free parse of the corpus."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.llm.common import saved, table

LONGEST = 3               # words of a phrase
LEAST = 10                # occurrences of a candidate
TOP = 2000                # phrases reported per language
CHUNK_WORDS = 32          # one word window in so many ends a chunk
CHUNK_MOST = 256          # words, for texts without such windows
COVERED_PERCENT = 50      # share of a phrase's occurrences inside a longer one that drops it
HELD = 100_000            # distinct chunks that a task sums before it passes them on
HELD_BYTES = 4 << 20      # of texts or chunks that a task looks at together
FILTER_BITS = 25          # 2 ** bits: the filter of frequent phrases, 4 MB

_SPLIT = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + b".,;:!?\x0a\x0b\x0c\x0d",
                         bytes(range(ord("a"), ord("z") + 1)) + b"\n" * 10)
_BLANK, _TAB, _END = 32, 9, 10
_PAIRS = "lang string, gram string, f bigint"
# Odd multipliers for hashes of words; any fixed ones do.
_BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(2).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: np.ndarray, gap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``starts``; the bytes of ``gap`` belong to none."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, sizes)
    values = _BYTE[raw[starts[0]:]] * _PLACE[place & 1023]
    values[gap[starts[0]:]] = 0
    return np.add.reduceat(values, starts - starts[0])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each on; shorter by n - 1 than ``words``."""
    count = max(len(words) - n + 1, 0)
    h = words[:count].copy()
    for i in range(1, n):
        h = (h * _STEP) ^ words[i:i + count]
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


def parse(text: bytes, overlap: int, modulus: int = CHUNK_WORDS, most: int = CHUNK_MOST) -> list[bytes]:
    """Chunks of a text: words with one blank between them.

    Pieces, the parts between punctuation and line ends, end chunks.  Inside a piece a window of
    ``overlap`` words whose hash is 0 modulo ``modulus`` ends a chunk and begins the next one, so equal
    passages are cut alike wherever they stand; so do windows every ``most`` words where none
    is found.  The last chunk of a piece ends with a line feed.
    """
    a = np.frombuffer(text.translate(_SPLIT) + b"\n", np.uint8)
    gap = (a == _BLANK) | (a == _TAB) | (a == _END)
    turn = np.diff(np.concatenate(([1], gap.view(np.int8))))
    starts, stops = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    n = len(starts)
    if not n:
        return []
    number = np.cumsum(a == _END)[starts]              # of the word's piece
    begins = np.append(True, np.diff(number) > 0)
    room = np.zeros(n, bool)                           # a window fits into the piece
    room[:max(n - overlap + 1, 0)] = number[:max(n - overlap + 1, 0)] == number[overlap - 1:]
    hit = np.zeros(n, bool)
    windows = window_hashes(word_hashes(a, gap, starts), overlap)
    hit[:len(windows)] = windows % np.uint64(modulus) == 0
    at = np.arange(n)
    cut = begins | (hit & room)
    since = at - np.maximum.accumulate(np.where(cut, at, 0))
    cut |= room & (since > 0) & (since % most == 0)
    # The words again, one byte between them.
    keep = ~gap
    keep[stops] = True
    data = a[keep]
    ends = np.cumsum(stops - starts + 1) - 1           # of each word in data
    data[ends] = np.where(np.append(begins[1:], True), _END, _BLANK)
    first = np.flatnonzero(cut)
    following = np.append(first[1:], n)
    ended = np.append(begins[first[1:]], True)
    last = np.where(ended, following, following + overlap) - 1
    buffer = data.tobytes()
    return [buffer[x:y] for x, y in zip((ends - (stops - starts))[first].tolist(),
                                        (ends[last] + ended).tolist())]


def _rows(lang: str, grams: list[bytes], f) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(grams), 50_000):
        part = pa.array(grams[i:i + 50_000], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part,
                                          pa.array(f[i:i + 50_000], pa.int64())], ["lang", "gram", "f"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST) -> DataFrame:
    """The distinct chunks of all texts with their frequency in the parse: ``lang``, ``gram``, ``f``."""
    overlap = longest - 1
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        waiting: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def look() -> Iterator[pa.RecordBatch]:
            for name, texts in waiting.items():
                held[name].update(parse(b"\n".join(texts), overlap))
            waiting.clear()
            if sum(map(len, held.values())) > HELD:
                yield from passed()

        def passed() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                yield from _rows(name, list(counts), list(counts.values()))
            held.clear()

        for b in batches:
            for name, t in zip(b.column("lang"), b.column("t")):
                t = t.as_py()
                waiting[name.as_py()].append(t)
                size += len(t)
                if size > HELD_BYTES:
                    yield from look()
                    size = 0
        yield from look()
        yield from passed()

    return rows.mapInArrow(run, _PAIRS).groupBy("lang", "gram").agg(F.sum("f").alias("f"))


class _Words:
    """The words of an array of chunks."""

    def __init__(self, chunks: pa.Array):
        chunks = chunks.cast(pa.large_binary())
        _, offsets, data = chunks.buffers()
        edges = np.frombuffer(offsets, np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
        self.bytes = data[edges[0]:edges[-1]].to_pybytes() if data else b""
        raw, edges = np.frombuffer(self.bytes, np.uint8), edges - edges[0]
        self.last = raw[edges[1:] - 1] == _END
        begun = np.zeros(len(raw) + 1, bool)
        begun[1:] = raw == _BLANK
        begun[edges] = True
        self.starts = np.flatnonzero(begun[:-1])
        at = np.searchsorted(self.starts, edges)
        # A word ends before the blank in front of the next one, or with its chunk.
        self.stops = np.append(self.starts[1:], len(raw)) - 1
        self.stops[at[1:] - 1] = edges[1:] - self.last
        self.sizes = np.diff(at)
        self.place = np.arange(len(self.starts)) - np.repeat(at[:-1], self.sizes)
        self.raw, self.gap = raw, (raw == _BLANK) | (raw == _END)
        self.hashes = word_hashes(raw, self.gap, self.starts)

    def codes(self) -> tuple[np.ndarray, int]:
        """A number for each distinct word, and how many there are."""
        data = self.raw[~self.gap]
        offsets = np.append(0, np.cumsum(self.stops - self.starts))
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [
            None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)


def _level(n: int, overlap: int, frequent: Callable[[], np.ndarray] | None):
    """Phrases of n words in distinct chunks, times the chunk's frequency.

    A chunk that the piece goes on after leaves the phrases that begin in its last ``overlap``
    words to the next chunk, which begins with them: each occurrence counts once.  Of n > 1 words
    only phrases whose two parts of n - 1 words pass the filter are counted.  For n = 1 a row without
    phrase sums all words.
    """
    def phrases(lang: str, chunks: pa.Array, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = _Words(chunks)
        f = np.repeat(f, words.sizes)
        mine = words.place < np.repeat(words.sizes - np.where(words.last, n - 1, overlap), words.sizes)
        if n > 1:
            bits = frequent()
            h = window_hashes(words.hashes, n - 1) & np.uint64(len(bits) * 8 - 1)
            good = bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1
            mine[len(good) - 1:] = False
            mine[:len(good) - 1] &= (good[:-1] & good[1:]).astype(bool)
        at = np.flatnonzero(mine)
        if not len(at):
            return
        codes, base = words.codes()
        key = codes[at]
        for i in range(1, n):
            key = (np.unique(key, return_inverse=True)[1] if i > 1 else key) * base + codes[at + i]
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        sums = np.bincount(group, f[at]).astype(np.int64)      # exact below 2 ** 53
        x, y = words.starts[at[first]].tolist(), words.stops[at[first] + n - 1].tolist()
        raw = words.bytes
        yield from _rows(lang, [raw[a:b] for a, b in zip(x, y)], sums)
        if n == 1:
            yield from _rows(lang, [None], [int(f[at].sum())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                waiting.append(b)
                size += b.nbytes
                if size <= HELD_BYTES:
                    continue
            if waiting:
                held = pa.Table.from_batches(waiting).combine_chunks()
                langs = held["lang"].dictionary_encode().combine_chunks()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    part = held.filter(pa.array(langs.indices.to_numpy() == i))
                    yield from phrases(lang, part["gram"].combine_chunks(), part["f"].to_numpy())
            waiting, size = [], 0
    return run


def _filter(grams: DataFrame, n: int, bits: int) -> Callable[[], np.ndarray]:
    """A bitmap of the hashes of phrases of n words, 2 ** bits whatever their number."""
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _Words(b.column("gram"))
            h = window_hashes(words.hashes, n)[words.place[:len(words.hashes) - n + 1] == 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array((h & np.uint64((1 << bits) - 1)).astype(np.int64))], ["slot"])

    words = (grams.where("gram is not null").select("gram").mapInArrow(slots, "slot bigint")
             .groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow())
    whole = np.zeros(1 << (bits - 6), np.int64)
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    known = grams.sparkSession.sparkContext.broadcast(whole.tobytes())
    return lambda: np.frombuffer(known.value, np.uint8)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST,
           least: int = LEAST, filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """Tables of the phrases of 1, 2, ... ``longest`` words with at least ``least`` occurrences:
    ``lang``, ``gram``, ``f``; the first also has a row without ``gram`` with all words of a language.
    Counts are exact; the filter only spares phrases that can't be frequent."""
    chunks = saved(dictionary(docs, text, lang, longest), "phrase-chunks")
    out: list[DataFrame] = []
    for n in range(1, longest + 1):
        frequent = _filter(out[-1], n - 1, filter_bits) if out else None
        found = chunks.mapInArrow(_level(n, longest - 1, frequent), _PAIRS) \
            .groupBy("lang", "gram").agg(F.sum("f").alias("f")) \
            .where((F.col("f") >= least) | F.col("gram").isNull())
        out.append(saved(found, f"phrases-{n}"))
    return out


def _first(phrase: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), 1, k), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST,
                 least: int = LEAST, top: int = TOP, covered_percent: int = COVERED_PERCENT,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per language, the phrases of 2 to ``longest`` words whose words come together most:
    ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and line ends and into words at
    blanks and tabs.  ``a`` counts a phrase's occurrences, overlaps included, ``l`` and ``r`` those of its
    parts at the cut that scores least (the first of equal ones), ``n`` all words;
    score = floor(1000000 a a / (l r)) in exact arithmetic.  Phrases with at least ``least``
    occurrences count, without those of which a longer one holds ``covered_percent`` of a.

    1. Prefix-free parsing: content-triggered overlapping chunks, distinct ones with their frequency.
    2. Phrases inside distinct chunks, weighted by that, a length at a time (``counts``).
    3. Joins of the frequent phrases with their parts, and a rank per language.

    Null and empty texts and texts of separators have no words; a null language is ``und``; repeated
    rows count again; an empty table gives an empty result; other columns are ignored.  A text of
    any length is parsed whole; chunks hold at most 258 words, so a text without punctuation or
    without a trigger is many rows.  Sums are made per task before each shuffle, so a frequent
    word or chunk sends one row a task.
    """
    levels = counts(docs, text, lang, longest, least, filter_bits)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    known = grams.where("gram is not null")
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)
    found = found.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a")) \
        .withColumn("size", F.size(F.split("phrase", " ", -1)))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .withColumn("first", _first(F.col("phrase"), F.col("k"))) \
        .withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    left = known.select("lang", F.col("gram").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r"))
    # decimal(16) holds any count, decimal(38) a million times its square.
    whole = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .withColumn("up", (F.lit(1000000).cast("decimal(7,0)") * (whole["a"] * whole["a"]))
                          .cast("decimal(38,0)"))
              .withColumn("down", whole["l"] * whole["r"])
              .withColumn("score", F.expr("up div down").cast("long"))
              .groupBy("lang", "phrase", "a", "size")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # All shorter phrases of at least two words inside each longer one.
    parts = (found.where("size > 2").withColumn("words", F.split("phrase", " ", -1))
             .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
             .groupBy("lang", F.expr("array_join(slice(words, i, m), ' ')").alias("phrase"))
             .agg(F.max("a").alias("longer")))
    sizes = levels[0].where("gram is null").select("lang", F.col("f").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (scored.join(parts, ["lang", "phrase"], "left")
            .where(f"coalesce(100 * longer < {int(covered_percent)} * a, true)")
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .join(sizes, "lang")
            .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))


def op11_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM w, (VALUES (1), (2), (3)) sizes(size))),
c AS (SELECT lang, size, gram, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY lang),
o AS (SELECT *, string_split(gram, ' ') AS ws FROM c WHERE f >= 10),
parts AS (
  SELECT *, unnest(range(1, size)) AS k FROM o WHERE size > 1),
halves AS (
  SELECT lang, size, gram, f, k, ws, array_to_string(ws[1:k], ' ') AS first,
         array_to_string(ws[k + 1:], ' ') AS rest FROM parts),
cuts AS (
  SELECT x.lang, x.size, x.gram AS phrase, x.f AS a, k, y.f AS l, z.f AS r,
         (1000000 * x.f * x.f) // (y.f * z.f) AS score
  FROM halves x JOIN o y ON y.lang = x.lang AND y.gram = x.first
  JOIN o z ON z.lang = x.lang AND z.gram = x.rest),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
    FROM o WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
