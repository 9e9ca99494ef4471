"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import saved, table

TOKENIZER = "byte_bpe_50k.json"
HEAD_UNITS = 300_000         # most frequent pre-tokens sent to every task
HEAD_CHARS = 40              # longest of those, so the table has a fixed bound
HELD_UNITS = 150_000         # distinct pre-tokens that a task holds before it passes them on
HELD_CHUNKS = 20_000         # pieces of other texts whose pre-tokens a task remembers
WHOLE_CHARS = 1 << 20        # longer texts are cut BATCH_UNITS pre-tokens at a time
BATCH_UNITS = 25_000         # pre-tokens passed on together
STABLE = "\u0530"
# Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_ROWS = 500             # texts whose rare pre-tokens a task holds at once
LIMIT = 1024

# A blank before a character that is not white space always begins a pre-token, so a text may
# be cut there first.  The pieces repeat much, and the library's pre-tokenizer runs on the
# distinct ones.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r"\s\s")


def chunks(segment: str) -> list[str]:
    """Pieces of ``segment``, each with its leading blank."""
    if not segment:
        return []
    if _ODD.search(segment) or segment[-1] == " ":
        parts = _CUT.split(segment)
    else:
        parts = segment.split(" ")
    out = [" " + p for p in parts[1:]]
    if parts[0]:
        out.append(parts[0])
    return out


def _special(path: str) -> list[str]:
    from tokenizers import Tokenizer
    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


def _tallier(path: str, special: list[str]):
    """From a text to the frequencies of its pre-tokens, as the library cuts it, and the number of
    special strings in it (the library cuts texts at those before anything else).

    Where the library's pre-tokenizer is the byte-level one with its own pattern, texts of
    characters below ``STABLE``, whose classes no Unicode version changes any more, are cut by that
    pattern directly, some pre-tokens at a time.  Other texts are cut at blanks first, and the
    library cuts the distinct pieces.
    """
    import regex
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    with open(path, encoding="utf-8") as f:
        kind = json.load(f).get("pre_tokenizer") or {}
    direct = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") \
        and kind.get("use_regex", True)
    pattern, late = regex.compile(BYTE_LEVEL), re.compile(f"[^\0-{chr(ord(STABLE) - 1)}]")
    cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
    seen: dict = {}

    def units(chunk: str) -> list[str]:
        if len(seen) > HELD_CHUNKS:
            seen.clear()
        got = seen[chunk] = [chunk[a:b] for _, (a, b) in split(chunk)]
        return got

    def tally(text: str) -> tuple[Counter, int]:
        segments = cut.split(text) if special and any(s in text for s in special) else [text]
        freq: Counter = Counter()
        for s in segments:
            if direct and (s.isascii() or not late.search(s)):
                if len(s) <= WHOLE_CHARS:
                    freq.update(pattern.findall(s))
                    continue
                found = (m.group() for m in pattern.finditer(s))
                while part := list(islice(found, BATCH_UNITS)):
                    freq.update(part)
                continue
            for chunk, n in Counter(chunks(s)).items():
                for u in seen.get(chunk) or units(chunk):
                    freq[u] += n
        return freq, len(segments) - 1

    return tally


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text",
                 doc_id: str = "doc_id", limit: int = LIMIT,
                 head_units: int = HEAD_UNITS) -> DataFrame:
    """Tokens of every whole text: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Equal to the length of the tokenizer's own encoding without added special tokens;
    special strings inside a text are one token each.  Null and empty texts have 0 bytes and
    0 tokens; repeated rows keep their rows; an empty table gives an empty result; other
    columns are ignored.

    1. Frequencies of the distinct pre-tokens (the library's own) of all texts: summed per task,
       then by key.
    2. The tokenizer runs once per distinct pre-token; only the number is kept.
    3. Per text, frequencies times numbers are summed.  The numbers of the ``head_units``
       most frequent pre-tokens of at most ``HEAD_CHARS`` characters (a bounded table)
       are looked up in the task, so common words are never shuffled; the others are
       joined by key and summed.
    """
    spark = docs.sparkSession
    special = _special(tokenizer_path)
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _tallier(tokenizer_path, special)

        def passed(freq: Counter) -> Iterator[pa.RecordBatch]:
            items = iter(freq.items())
            while part := list(islice(items, BATCH_UNITS)):
                names, numbers = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["unit", "freq"])
            freq.clear()

        total: Counter = Counter()
        for b in batches:
            for t in b.column("t"):
                total.update(tally(t.as_py())[0])
                if len(total) > HELD_UNITS:      # pass on what is held, keep the memory bounded
                    yield from passed(total)
        yield from passed(total)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task is one core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer_path)
        for b in batches:
            names, out = b.column("unit").to_pylist(), []
            for i in range(0, len(names), 1000):
                out += [len(e) for e in tok.encode_batch(names[i:i + 1000],
                                                         add_special_tokens=False)]
            yield b.append_column("n", pa.array(out, pa.int64()))

    units = saved(rows.select("t").mapInArrow(distinct, "unit string, freq bigint")
                  .groupBy("unit").agg(F.sum("freq").alias("freq"))
                  .mapInArrow(pieces, "unit string, freq bigint, n bigint")
                  # Eight classes of frequency per power of two.
                  .withColumn("cls", F.floor(F.log2("freq") * 8).cast("int")), "token-units")
    # The head: the highest classes that hold at most head_units pre-tokens (some hundred rows).
    short = units.where(F.length("unit") <= HEAD_CHARS)
    least, room = None, head_units
    for c in short.groupBy("cls").count().orderBy(F.desc("cls")).collect():
        room -= c["count"]
        if room < 0:
            break
        least = c["cls"]
    head = short.where(F.col("cls") >= least).select("unit", "n").toArrow() if least is not None \
        else pa.table({"unit": [], "n": []})
    known = spark.sparkContext.broadcast(dict(zip(head["unit"].to_pylist(), head["n"].to_pylist())))

    def known_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, numbers = _tallier(tokenizer_path, special), known.value
        for b in batches:
            for start in range(0, len(b), SLICE_ROWS):
                part = b.slice(start, SLICE_ROWS)
                sums, owner, names, counts = [], [0], [], []
                for t in part.column("t"):
                    freq, total = tally(t.as_py())
                    other = {}
                    for u, c in freq.items():
                        n = numbers.get(u)
                        if n is None:
                            other[u] = c
                        else:
                            total += n * c
                    sums.append(total)
                    names += other
                    counts += other.values()
                    owner.append(len(names))
                rest = pa.ListArray.from_arrays(pa.array(owner, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["unit", "c"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("n_bytes"), pa.array(sums, pa.int64()), rest],
                    ["doc", "n_bytes", "known", "rest"])

    kind = dict(rows.dtypes)["doc"]
    known_part = saved(
        rows.withColumn("n_bytes", F.octet_length("t").cast("long"))
        .mapInArrow(known_sums, f"doc {kind}, n_bytes bigint, known bigint, "
                                 "rest array<struct<unit:string,c:bigint>>")
        .withColumn("row", F.monotonically_increasing_id()), "token-known")
    rest = (known_part.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r"))
            .join(units.select("unit", "n"), F.col("r.unit") == F.col("unit"))
            .groupBy("row").agg(F.sum(F.col("r.c") * F.col("n")).alias("more")))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return (known_part.select("row", "doc", "n_bytes", "known").join(rest, "row", "left")
            .select(F.col("doc").alias("doc_id"), "n_bytes", total.cast("long").alias("n_tokens"),
                    (total > limit).alias("over_limit")))


def op6_token_counts(spark, sf_dir):
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
