"""Byte-level BPE over a vocabulary of ranks: encoding to ids and decoding of ids."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
MEMO_PIECES = 300_000     # distinct pre-tokens whose ids a task remembers
MEMO_CHARS = 64           # longest of those
SLICE_BYTES = 2 << 20     # texts that a task holds at once, one text at least
WHOLE_CHARS = 1 << 20     # longer texts are matched MATCHES pre-tokens at a time
MATCHES = 200_000         # pre-tokens that are looked up together
MANY = 24                 # positions of a bucket from which they are joined as arrays


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in
                (line.split() for line in f if line.strip())}


def _joins(ranks: dict[bytes, int], most: int) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """All pairs of tokens that are a token together, as sorted keys, and its ranks; and the ranks
    that can make a pair of a lower one.  A token is named by its rank, a byte that is none by a
    number above ``most``."""
    number = {bytes([i]): most + 1 + i for i in range(256)} | ranks
    get, keys, joined = number.get, [], []
    for token, r in ranks.items():
        for k in range(1, len(token)):
            left = get(token[:k])
            if left is None:
                continue
            right = get(token[k:])
            if right is not None:
                keys.append(left << 32 | right)
                joined.append(r)
    keys, joined = np.array(keys, np.int64), np.array(joined, np.int64)
    order = np.argsort(keys)
    keys, joined = keys[order], joined[order]
    lowers = {r for part in (keys >> 32, keys & 0xFFFFFFFF) for r in part[part > joined].tolist()}
    return keys, joined, lowers


def piece_encoder(ranks: dict[bytes, int]) -> Callable[[list[bytes]], list[bytes]]:
    """A function from the bytes of pre-tokens to their packed ids.

    The pre-tokens lie one behind the other; no join crosses from one to the next.  Tokens are a
    linked list over the bytes: ``after[i]`` is the start of the token behind the one at ``i``,
    ``before[i]`` the start of the one in front, -1 at the start of a pre-token.  ``pair[i]`` is
    the rank of the token at ``i`` joined with the next one, -1 if that is no token.

    The queue has a bucket per rank with the positions whose join waits there, and a bitmap of two
    levels: a bit per bucket in words of ``width`` bits, and a bit per word.  Find first set on
    both gives the least rank; its bucket is taken from left to right.  A position whose ``pair``
    changed since it was queued is stale and skipped.  A join can't queue its own rank, for its
    bytes are part of the new pairs'; should it queue a lower one, the rest of the bucket waits.
    Every join queues two positions at most, so n bytes take O(n log n), whatever their joins.

    A bucket of ``MANY`` positions and more is joined at once, in arrays.  That equals left to
    right where no join can queue a lower rank.  Where one can, only the first position of every
    pre-token is joined, for pre-tokens don't touch each other, and the rest of the bucket waits;
    if that would leave most of it, it is taken from left to right after all.
    """
    most, get, longest = max(ranks.values(), default=0), ranks.get, max(map(len, ranks), default=0)
    bits = max(4, (most.bit_length() + 1) // 2)
    width, low = 1 << bits, (1 << bits) - 1
    bit = [1 << i for i in range(width)]
    ones = np.array([get(bytes([i]), most + 1 + i) for i in range(256)])
    twos = np.array([get(bytes([i, j]), -1) for i in range(256) for j in range(256)])
    keys, joined, lowers = _joins(ranks, most)

    def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(left), -1)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, joined[at], -1)

    def encode(pieces: list[bytes]) -> list[bytes]:
        text, sizes = b"".join(pieces), np.array([len(p) for p in pieces], np.int64)
        n, ends = len(text), np.cumsum(sizes)
        if not n:
            return [b""] * len(pieces)
        codes = np.frombuffer(text, np.uint8).astype(np.int64)
        edges = ends[sizes > 0]                        # behind the last byte of a pre-token
        pairs = np.append(twos[codes[:-1] * 256 + codes[1:]], -1)
        pairs[edges - 1] = -1
        front = np.arange(-1, n)
        front[np.append(edges, 0)] = -1
        owner = np.repeat(np.arange(len(pieces)), sizes)
        # The first joins, bucket by bucket.
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0):]
        buckets, words, top = {}, [0] * ((most >> bits) + 1), 0
        # Machine integers, both as an array of Python's and as one of numpy's over the same bytes.
        (pair, pairs), (before, befores), (after, afters), (token, tokens) = (
            (a := array("q", np.ascontiguousarray(x, np.int64).tobytes()), np.frombuffer(a, np.int64))
            for x in (pairs, front, np.arange(1, n + 1), ones[codes]))

        def queue(starts: np.ndarray, found: np.ndarray) -> None:
            """Puts positions, in order of the ranks ``found``, into their buckets."""
            nonlocal top
            firsts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist()]
            starts = starts.tolist()
            for s, a, b in zip(found[firsts].tolist(), firsts, [*firsts[1:], len(starts)]):
                if s in buckets:
                    buckets[s] += starts[a:b]
                else:
                    buckets[s] = starts[a:b]
                    words[s >> bits] |= bit[s & low]
                    top |= 1 << (s >> bits)

        def join(at: np.ndarray, r: int) -> None:
            """Joins the tokens at all these positions with the next ones; none of them overlap."""
            gone = afters[at]
            end = afters[gone]
            inner = befores[end] >= 0
            afters[at], tokens[at], tokens[gone], pairs[gone] = end, r, -1, -1
            befores[end[inner]] = at[inner]
            pairs[at] = -2
            previous = befores[at]
            previous = previous[previous >= 0]
            starts = np.concatenate([at[inner], previous[pairs[previous] != -2]])
            pairs[at] = -1
            found = ranks_of(tokens[starts], tokens[afters[starts]])
            pairs[starts] = found
            order = np.argsort(found, kind="stable")
            order = order[np.searchsorted(found[order], 0):]
            if len(order):
                queue(starts[order], found[order])

        if len(order):
            queue(order, pairs[order])
        while top:
            w = (top & -top).bit_length() - 1
            r = (w << bits) + (words[w] & -words[w]).bit_length() - 1
            waiting = buckets.pop(r)
            words[w] ^= bit[r & low]
            if not words[w]:
                top ^= 1 << w
            waiting.sort()
            if len(waiting) >= MANY:
                now = np.array(waiting)
                now = now[pairs[now] == r]
                if r in lowers:
                    whose = owner[now]
                    first = np.append(True, whose[1:] != whose[:-1])[:len(now)]
                    if 4 * np.count_nonzero(first) >= len(now):
                        rest = now[~first]
                        if len(now):
                            join(now[first], r)
                        if len(rest):
                            queue(rest, np.full(len(rest), r))
                        continue
                else:
                    # Of positions that overlap, as in aaa, every second one.
                    over = np.append(False, afters[now[:-1]] == now[1:])[:len(now)]
                    if over.any():
                        place = np.arange(len(now))
                        now = now[(place - np.maximum.accumulate(np.where(over, 0, place))) % 2 == 0]
                    if len(now):
                        join(now, r)
                    continue
            least = r
            for at, i in enumerate(waiting):
                if pair[i] != r:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                token[i], token[gone], pair[gone], pair[i] = r, -1, -1, -1
                joins = []
                if before[end] >= 0:
                    before[end] = i
                    joins.append((i, after[end]))
                if before[i] >= 0:
                    joins.append((before[i], end))
                for start, stop in joins:
                    # Slices stay as short as the longest token.
                    s = get(text[start:stop]) if stop - start <= longest else None
                    if s is None:
                        pair[start] = -1
                        continue
                    pair[start] = s
                    if s in buckets:
                        buckets[s].append(start)
                    else:
                        buckets[s] = [start]
                        words[s >> bits] |= bit[s & low]
                        top |= 1 << (s >> bits)
                    if s < least:
                        least = s
                if least < r:
                    rest = waiting[at + 1:]
                    if rest:
                        buckets[r] = rest
                        words[w] |= bit[r & low]
                        top |= 1 << w
                    break
        live = (tokens >= 0) & (tokens <= most)
        packed = tokens[live].astype("<u4").tobytes()
        stops = np.append(0, 4 * np.cumsum(live))[np.append(0, ends)].tolist()
        return [packed[a:b] for a, b in zip(stops, stops[1:])]

    return encode


class _Coder:
    """Texts to packed ids: the distinct pre-tokens of some texts at a time are encoded
    together, and short ones are remembered, in bounded number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks, self.pieces = ranks, piece_encoder(ranks)
        self.find, self.memo = regex.compile(pattern), {}

    def windows(self, text: str) -> Iterator[list[str]]:
        if len(text) <= WHOLE_CHARS:
            yield self.find.findall(text)
            return
        matches = (m.group() for m in self.find.finditer(text))
        while part := list(islice(matches, MATCHES)):
            yield part

    def texts(self, texts: list[str]) -> list[bytes]:
        parts, held, size = [[] for _ in texts], [], 0
        for k, text in enumerate(texts):
            for window in self.windows(text):
                held.append((parts[k], window))
                size += len(window)
                if size >= MATCHES:
                    self.flush(held)
                    held, size = [], 0
        self.flush(held)
        return [b"".join(p) for p in parts]

    def flush(self, held: list[tuple[list[bytes], list[str]]]) -> None:
        memo = self.memo
        if len(memo) > MEMO_PIECES:
            memo.clear()
        new = [w for w in set().union(*(window for _, window in held)) if w not in memo]
        raw = [w.encode() for w in new]
        # A pre-token that is a token as a whole is that token.
        whole = [self.ranks.get(p) for p in raw]
        memo.update((w, r.to_bytes(4, "little")) for w, r in zip(new, whole) if r is not None)
        other = [i for i, r in enumerate(whole) if r is None]
        memo.update(zip([new[i] for i in other], self.pieces([raw[i] for i in other])))
        for part, window in held:
            part.append(b"".join(map(memo.__getitem__, window)))
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES``."""
    sizes = column.cast(pa.large_binary()).buffers()[1]
    ends = np.frombuffer(sizes, np.int64)[column.offset:column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """The ids of every whole text: ``doc_id``, ``n_tokens``, ``ids``.

    ``ids`` holds the ids one after the other as little-endian unsigned 32-bit integers.  Each
    match of ``pattern`` is a pre-token; one that is a token as a whole is that token, any other
    is joined by rank, the leftmost of equal ranks first.  Special strings are ordinary text.
    Letters and numbers are what the ``regex`` library takes for them.

    A null or empty text has 0 tokens and empty ids; a repeated row keeps its row; an empty table
    gives an empty result; other columns are ignored.  Texts are independent of each other: no
    shuffle, and a lost task costs its own texts.  A task holds the vocabulary, a bounded memory
    of short pre-tokens, some megabytes of texts and, of a longer text, some pre-tokens at a time.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))   # one vocabulary
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(ranks.value, pattern)
        for b in batches:
            for start, stop in _slices(b.column("t")):
                part = b.slice(start, stop - start)
                ids = coder.texts(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the bytes that its packed ``ids`` stand for, as ``out``.

    Null ids give null, empty ids empty bytes.  An id that the vocabulary lacks, or bytes that are
    not whole ids, fail the job.  A column named like ``out`` is replaced.
    """
    vocabulary = {rank: token for token, rank in load_ranks(ranks_path).items()}
    known = encoded.sparkSession.sparkContext.broadcast(
        [vocabulary.get(i) for i in range(max(vocabulary, default=-1) + 1)])
    rows = encoded.drop(out) if out != ids else encoded
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(known.value, pa.large_binary())
        for b in batches:
            at = names.index(ids)
            for start, stop in _slices(b.column(at)):
                part = b.slice(start, stop - start)
                packed = part.column(at).to_pylist()
                got = tokens.take(pa.array(np.frombuffer(b"".join(p or b"" for p in packed), "<u4")))
                if got.null_count:
                    raise ValueError("an id that the vocabulary lacks")
                # The bytes of all tokens lie one behind the other.
                _, offsets, data = got.buffers()
                stops = np.frombuffer(offsets, np.int64)[
                    np.cumsum([0] + [len(p or b"") // 4 for p in packed])].tolist()
                texts = [None if p is None else data[x:y].to_pybytes()
                         for p, x, y in zip(packed, stops, stops[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())],
                                                 [*names, out])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, `{out}` binary")


def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers
    path = public_tokenizers.path(RANKS)
    coded = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode(coded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
