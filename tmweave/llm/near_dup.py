"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import SHINGLE_WORDS, SIMILARITY, components, saved, table

# 24 bands of 5: a pair of similarity 0.8 misses all bands with probability 7e-5, one of 0.9
# with 4e-10; a pair of similarity 0.3 meets in one with probability 0.06.
BANDS, ROWS = 24, 5
BLOCK_NODES = 256            # texts of a bucket that are compared at once, two such blocks at most
BLOCK_BYTES = 16 << 20       # and their bytes
SMALL_BUCKET = 32            # nodes of a bucket that is dealt by its least node, so that texts are cut up once
KNOWN = 1 << 22              # shingles that are kept for the next group
BROADCAST_NODES = 500_000    # nodes that are sent to the texts (40 bytes each); else texts are shuffled
BROADCAST_GONE = 2_000_000   # ids and digests, some 100 bytes each
CHUNK = 3 << 20              # bytes of text whose shingles are handled at once

WORD = re.compile(r"[^\W_]+")
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9,
                                          0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Vocabulary(dict):
    """Word to 64-bit hash; starts anew when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"),
                                                        digest_size=8).digest(), "little")
        return h


def weighted_shingles(text: str | None, vocabulary: dict, k: int = SHINGLE_WORDS):
    """Hashes (ascending) and counts of the k-word shingles of the lower-cased words; a text of
    1 to k-1 words is one shingle; a wordless or null text has none."""
    words = WORD.findall((text or "").lower())
    h = np.array([vocabulary[w] for w in words], np.uint64)
    if len(h) == 0:
        return h, np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        size = min(k, len(h))
        s = np.full(len(h) - size + 1, len(h) if len(h) < k else 0, np.uint64)
        for j in range(size):
            s = _mix(s ^ h[j:len(h) - size + 1 + j])
    return np.unique(s, return_counts=True)


def shingle_sets(texts, vocabulary: dict, k: int = SHINGLE_WORDS):
    """``weighted_shingles`` of many texts at once: the sizes of the sets, their hashes and their
    counts, both end to end."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    total = int(n.sum())
    h = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(words)), np.uint64, total)
    begin = np.cumsum(n) - n
    number = np.maximum(n - k + 1, np.minimum(n, 1))
    end = np.cumsum(number)
    owner = np.repeat(np.arange(len(n)), number)
    place = np.arange(len(owner)) + (begin - (end - number))[owner]
    with np.errstate(over="ignore"):
        longer = np.concatenate([h, np.zeros(k, np.uint64)])
        s = np.zeros(total, np.uint64)
        for j in range(k):
            s = _mix(s ^ longer[j:total + j])
        s = s[place]
        for size in range(1, k):
            short = np.flatnonzero(n == size)
            one = np.full(len(short), size, np.uint64)
            for j in range(size):
                one = _mix(one ^ h[begin[short] + j])
            s[end[short] - 1] = one
    for i, j in zip((end - number).tolist(), end.tolist()):
        s[i:j].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return (np.bincount(owner[first], minlength=len(n)), s[first],
            np.diff(np.append(first, len(s))))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int,
                    k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signatures of ``n`` weighted sets: an (n, k) array of dart ids (0: empty set).

    The region of an element with weight x is [0, x) by time.  It is cut into the weight bands
    [0,1), [1,2), [2,4), ...; in each, darts arrive as a Poisson process whose rate is the
    band's width, every dart with a hashed arrival time, weight and coordinate that depend on
    element, band and number alone.  A set keeps the darts below its weights, and per
    coordinate the earliest.  Only the times up to about (k ln k + 2 k) / total weight are
    thrown, which fills all coordinates of most sets; the others go on to twice the time.  Two
    sets agree in a coordinate with probability sum(min) / sum(max) of their weights.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    with np.errstate(divide="ignore"):
        limit = np.exp2(np.ceil(np.log2((k * math.log(k) + 2 * k) / total)))
    todo = total > 0
    with np.errstate(over="ignore"):
        while todo.any():
            here = slice(None) if todo.all() else todo[owner]
            own, elem, wt = owner[here], element[here], weight[here]
            best, who = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
            band, low, width = 0, 0.0, 1.0
            while len(own):
                base = _mix(elem ^ _mix(np.full(1, band, np.uint64)))
                at, j, most, first = np.zeros(len(own)), 0, limit[own], own * k
                part = None if (wt >= low + width).all() else wt      # None: all darts are below
                while len(at):
                    dart = _mix(base + np.uint64(j) * _GOLD)
                    u = (dart >> np.uint64(11)).astype(float)
                    u += 0.5
                    u /= 2.0 ** 53
                    at -= np.log(u, out=u) / width
                    alive = at < most
                    at, base, dart, most, first = (x[alive] for x in (at, base, dart, most, first))
                    more = _mix(dart ^ _M1)
                    key = first + ((more >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
                    hit = at < best[key]
                    if part is not None:
                        part = part[alive]
                        hit &= low + width * ((more & np.uint64(0xFFFFFFFF)).astype(float) / 2.0 ** 32) < part
                    key, when, dart = key[hit], at[hit], dart[hit]
                    np.minimum.at(best, key, when)
                    # Of equal times the first dart: assigned last.
                    won = np.flatnonzero(when == best[key])[::-1]
                    who[key[won]] = dart[won]
                    j += 1
                band, low, width = band + 1, low + width, width if band == 0 else width * 2
                rest = wt > low
                own, elem, wt = own[rest], elem[rest], wt[rest]
            filled = (best < np.inf).reshape(n, k).all(axis=1)
            done = todo & filled
            out[done] = np.maximum(who.reshape(n, k)[done], np.uint64(1))
            todo &= ~filled
            limit[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    with np.errstate(over="ignore"):
        key = _mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :].repeat(len(signatures), 0)
        parts = signatures.reshape(len(signatures), bands, rows)
        for j in range(rows):
            key = _mix(key ^ parts[:, :, j])
    return key.view(np.int64)


def sign(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``doc_id``, ``text_key`` (of the exact text), ``bytes``, ``digest`` (of the weighted shingle set, null
    if empty) and ``bands`` for every row; one pass without a shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text).cast("binary"))
                       .alias("text_key"), F.octet_length(text).alias("bytes"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _Vocabulary()
        for b in batches:
            digests, bands = [], []
            bytes_to = b["bytes"].fillna(0).cumsum().to_numpy()
            start = 0
            while start < len(b):
                # Texts of about CHUNK bytes, one at least.
                done = bytes_to[start - 1] if start else 0
                stop = max(int(np.searchsorted(bytes_to, done + CHUNK, "right")), start + 1)
                sizes, h, c = shingle_sets(b["t"].iloc[start:stop], vocabulary, k)
                sig = dart_signatures(np.repeat(np.arange(len(sizes)), sizes), h, c.astype(float), len(sizes))
                ends = np.cumsum(sizes)
                digests += [hashlib.md5(h[i:j].tobytes() + c[i:j].tobytes()).digest() if j > i else None
                            for i, j in zip((ends - sizes).tolist(), ends.tolist())]
                bands += list(band_keys(sig))
                start = stop
            yield b[["doc_id", "text_key", "bytes"]].assign(digest=digests, bands=bands)

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_key string, "
                                 "bytes int, digest binary, bands array<bigint>")


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (hashes, counts)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts (``node``, ``t``) have a similarity of at least
    ``threshold``.  The joins leave equal ``b`` together, so its shingles are made once."""
    rows = (pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, last, held = _Vocabulary(), None, None
        for p in batches:
            keep = []
            for b, ta, tb in zip(p["b"], p["ta"], p["tb"]):
                if b != last:
                    last, held = b, weighted_shingles(tb, vocabulary, k)
                keep.append(similarity(weighted_shingles(ta, vocabulary, k), held) >= threshold)
            yield p.loc[keep, ["a", "b"]]

    return rows.mapInPandas(run, "a bigint, b bigint")


def overlaps(sets: list) -> np.ndarray:
    """Sums of minima of the counts for all pairs of (hashes, counts), by products of indicator
    matrices over slices of the shingles that at least two sets have."""
    n = len(sets)
    if n == 2:
        (h, c), (other, counts) = sets
        at = np.minimum(np.searchsorted(h, other), len(h) - 1)
        both = h[at] == other
        return np.full((2, 2), float(np.minimum(c[at[both]], counts[both]).sum()))
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    count = np.concatenate([c for _, c in sets])
    _, column, users = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True,
                                 return_counts=True)
    column = np.where(users > 1, np.cumsum(users > 1) - 1, -1)[column]
    keep = column >= 0
    owner, count, column = owner[keep], count[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, count, column = owner[order], count[order], column[order]
    low = np.zeros((n, n))
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (start, start + width))
        x = np.zeros((n, width), np.float32)
        x[owner[i:j], column[i:j] - start] = count[i:j]
        before = 0
        for value in np.unique(count[i:j]):
            layer = (x >= value).astype(np.float32)
            low += float(value - before) * (layer @ layer.T)
            before = value
    return low


def connections(node: np.ndarray, part: np.ndarray, main: np.ndarray, sets: list, across: bool,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (two ends) that connect what the links of one block (or between the largest component
    and the rest, ``across``) connect: at most one per node."""
    low = overlaps(sets)
    total = np.array([c.sum() for _, c in sets], float)
    with np.errstate(invalid="ignore"):
        close = low >= threshold * (total[:, None] + total[None, :] - low)
    close &= part[:, None] != part[None, :]
    if across:
        close &= main[:, None] != main[None, :]
    i, j = np.nonzero(close)
    label = np.arange(len(node))
    while True:                                               # least label of the neighbours
        nxt = label.copy()
        np.minimum.at(nxt, i, label[j])
        if (nxt == label).all():
            break
        label = nxt
    some = label != np.arange(len(node))
    return node[some], node[label[some]]


def _blocks(open_: DataFrame) -> DataFrame:
    """Deal the nodes of every open bucket to groups whose pairs together are all pairs in different
    components.  The largest component of a bucket is compared with the rest only, block by
    block, and the rest with itself; a group holds two blocks at most."""
    per_part = open_.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("w"))
    buckets = per_part.groupBy("key").agg(F.max(F.struct("n", "part", "w")).alias("m"),
                                          F.sum("n").alias("n"), F.sum("w").alias("w"))

    def number(n, w):
        return F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(w / BLOCK_BYTES)).cast("bigint")

    n_rest = F.col("n") - F.col("m.n")
    buckets = saved(buckets.select(
        "key", F.col("m.part").alias("main"), n_rest.alias("n_rest"),
        number(F.col("m.n"), F.col("m.w")).alias("main_blocks"),
        number(n_rest, F.col("w") - F.col("m.w")).alias("rest_blocks")), "dup-buckets")
    rows = open_.join(buckets, "key").withColumn("in_main", F.col("part") == F.col("main"))
    zero = F.lit(0).cast("bigint")

    def group(across, p, q):
        return F.struct(F.lit(across).alias("across"), p.alias("p"), q.alias("q"))

    def upto(n):
        return F.sequence(zero, n - 1)

    own_main = F.pmod(F.xxhash64("node"), F.col("main_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("rest_blocks"))
    none = F.filter(F.array(group(True, zero, zero)), lambda g: F.lit(False))
    with_main = F.transform(upto(F.col("main_blocks")), lambda i: group(True, i, own))
    with_rest = F.when(F.col("n_rest") > 1, F.transform(
        upto(F.col("rest_blocks")),
        lambda j: group(False, F.least(own, j), F.greatest(own, j)))).otherwise(none)
    groups = F.when(F.col("in_main"), F.transform(
        upto(F.col("rest_blocks")), lambda j: group(True, own_main, j))) \
        .otherwise(F.concat(with_main, with_rest))
    return rows.select("home", "key", "node", "part", "in_main", F.explode(groups).alias("g")) \
        .select("home", "key", "g.*", "node", "part", "in_main")


def linked_across(open_: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Edges between nodes of open buckets (``key``, ``node``, ``part``, ``bytes``) that connect all
    components with a link between them.  Buckets of one ``home`` follow each other in a task, so
    the texts that they share are cut into shingles once."""
    unit = ["home", "across", "p", "q"]
    keys = [*unit, "key"]
    rows = _blocks(open_).join(texts.select("node", "t"), "node") \
        .repartition(*unit).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, held = _Vocabulary(), None                # held: the group that may go on
        known, size, last = {}, 0, None                       # sets of the nodes of this unit

        def edges(b: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
            nonlocal size, last
            node, part, main, text = (b[c].to_numpy() for c in ("node", "part", "in_main", "t"))
            here = list(zip(*(b[c].iloc[starts[:-1]] for c in unit)))
            found = []
            for now, s, e in zip(here, starts, starts[1:]):
                if now != last or size > KNOWN:
                    known.clear()
                    size, last = 0, now
                own = node[s:e].tolist()
                new = [i for i, x in enumerate(own) if x not in known]
                if new:
                    sizes, h, c = shingle_sets(text[s:e][new], vocabulary, k)
                    ends = np.cumsum(sizes)
                    size += len(h)
                    for i, x, y in zip(new, (ends - sizes).tolist(), ends.tolist()):
                        known[own[i]] = h[x:y], c[x:y]
                found.append(connections(node[s:e], part[s:e], main[s:e].astype(bool),
                                         [known[x] for x in own], bool(now[1]), threshold))
            a, z = (np.concatenate(x) for x in zip(*found))
            return pd.DataFrame({"a": a, "b": z})

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            change = np.zeros(len(b) - 1, bool)
            for c in keys:
                v = b[c].to_numpy()
                change |= v[1:] != v[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist()]
            held = b.iloc[starts[-1]:]
            if len(starts) > 1:
                yield edges(b, starts)
        if held is not None and len(held):
            yield edges(held, [0, len(held)])

    return rows.mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    threshold: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """Near-duplicate classes: ``doc_id``, ``class_id`` (the least doc_id of the class, itself
    included), ``class_size``, ``kept`` (the document that stands for its class) and ``text_key``
    (md5 of the text), one row per input row.

    Two texts are linked if the weighted Jaccard similarity of their k-word shingles is at least
    ``threshold``; classes are the connected components.  Texts with equal shingles are
    one node from the start.  Wordless and null texts are linked with nothing; repeated rows are
    copies; null doc_ids take part and are never the least if another id is there; an
    empty table gives an empty result; other columns are ignored.

    Candidates are the nodes that share a band.  All pairs of a band's bucket are never
    written out: each node meets the leader of its bucket, and what became connected is left
    out.  The nodes of a bucket that are still in different components are compared in blocks
    inside a task, which gives at most one edge per node; so no candidate link is lost.  Texts
    are joined for verification only, one per node.
    """
    signed = saved(sign(docs, doc_id, text, k), "dup-signed")
    nodes = saved(signed.where("digest is not null").groupBy("digest")
                  .agg(F.min("text_key").alias("text_key"), F.max("bytes").alias("bytes"),
                       F.first("bands").alias("bands"))
                  .withColumn("node", F.monotonically_increasing_id()), "dup-nodes")
    buckets = nodes.select("node", "bytes", F.explode("bands").alias("key"))
    shared = saved(buckets.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader"))
                   .where("size > 1").select("key", "leader"), "dup-shared")
    members = saved(buckets.join(shared, "key"), "dup-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi") \
        .select("node", "text_key")
    wanted = saved(wanted, "dup-wanted")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = saved(docs.select(F.md5(F.col(text).cast("binary")).alias("text_key"),
                              F.col(text).alias("t"))
                  .join(wanted, "text_key").select("node", "t").dropDuplicates(["node"]), "dup-texts")

    stars = members.where("node <> leader").select(F.col("node").alias("a"),
                                                   F.col("leader").alias("b")).distinct()
    links = saved(verified(stars, texts, threshold, k), "dup-links")
    parts = saved(components(links, "dup"), "dup-parts")
    member = members.select("key", "node", "bytes").join(parts, "node", "left") \
        .select("key", "node", "bytes", F.coalesce("component", "node").alias("part"))
    # Buckets of the same nodes (so many, the least, the greatest, 128 bits of hash) hold the same
    # links: one of them stays.
    nodes_of = [F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"),
                F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    mixed = member.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), *nodes_of) \
        .where("lo <> hi").groupBy("n", "first", "last", "x", "y").agg(F.min("key").alias("key"))
    mixed = saved(mixed.select("key", F.when(F.col("n") <= SMALL_BUCKET, F.col("first"))
                               .otherwise(F.col("key")).alias("home")), "dup-mixed")
    open_ = saved(member.join(mixed, "key"), "dup-open")
    more = saved(linked_across(open_, texts, threshold, k), "dup-links")
    parts = components(links.union(more), "dup")
    whole = saved(nodes.select("digest", "node").join(parts, "node", "left")
                  .select("digest", F.coalesce("component", "node").alias("part")), "dup-whole")
    rows = saved(signed.select("doc_id", "text_key", "digest").join(whole, "digest", "left"),
                 "dup-rows")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = saved(rows.where("part is not null").groupBy("part").agg(
        F.min(one).alias("first"), F.count("*").alias("class_size")), "dup-classes")
    alone = F.col("part").isNull()
    return rows.join(least, "part", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | one.eqNullSafe(F.col("first"))).alias("kept"), "text_key")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the least doc_id (null ids last).  Rows are
    told apart by id and text; of rows equal in both, one stays.  Wordless texts all stay.

    The rows that go are known by id and digest; up to ``BROADCAST_GONE`` of them (counted) are sent
    to the tasks, so no text is moved.  Beyond, texts are shuffled once to meet them."""
    classes = saved(near_duplicates(docs, doc_id, text), "dup-result")
    key = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    gone = saved(classes.where(~F.col("kept")).select(*key).distinct(), "dup-gone")

    def same(other: DataFrame):
        return (docs[doc_id].eqNullSafe(other["_id"])
                & F.md5(docs[text].cast("binary")).eqNullSafe(other["_key"]))

    if gone.count() <= BROADCAST_GONE:
        gone = F.broadcast(gone)
    rest = docs.join(gone, same(gone), "left_anti")
    again = saved(classes.where("kept and class_size > 1").groupBy("doc_id", "text_key").count()
                  .where("count > 1").select(*key), "dup-again")
    if not again.limit(1).count():
        return rest
    once = docs.join(again, same(again), "left_semi").dropDuplicates([doc_id, text])
    return rest.join(again, same(again), "left_anti").unionByName(once)


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (SELECT doc_id, s, count(*) AS c FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 5
          THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
          ELSE [array_to_string(w, ' ') || ' #' || len(w)] END) AS s FROM w WHERE len(w) > 0)
      GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS low
      FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE low >= 0.8 * (na.n + nb.n - low)),
r AS (SELECT doc_id, doc_id AS reach FROM documents
      UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT doc_id, min(reach) AS class_id FROM r GROUP BY ALL)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept
FROM c
"""
