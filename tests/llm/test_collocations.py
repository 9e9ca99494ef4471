"""Phrase collocations against a plain count of every phrase."""

import random
from collections import Counter, defaultdict

import re

from tmweave.llm.collocations import collocations, counts, parse

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, longest=3, least=3, top=50, percent=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i:i + size])] += 1
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(len(t) > len(g) and 100 * b >= percent * a
                   and any(t[i:i + len(g)] == g for i in range(len(t) - len(g) + 1))
                   for t, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, vocabulary, docs):
    rng = random.Random(seed)
    words = [rng.choice(["é", "x", "Q", "ß"]) + str(i) for i in range(vocabulary)]
    shared = " ".join(rng.choices(words, k=80))
    out = []
    for i in range(docs):
        body = " ".join(rng.choices(words, k=rng.randrange(60)))
        out.append((rng.choice(["", ". ", ",\t", "\r\n", "  "]).join([body, shared, body]),
                    rng.choice(["en", "de", None])))
    return out


def test_equals_plain_count(spark):
    for seed, vocabulary in ((1, 6), (2, 40)):
        docs = corpus(seed, vocabulary, 60)
        df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
        assert rows(collocations(df, least=3, top=50)) == plain(docs)
        # The filter of frequent phrases never changes the result, however full it is.
        assert rows(collocations(df, least=3, top=50, filter_bits=6)) == plain(docs)


def test_longer_phrases(spark):
    docs = corpus(3, 5, 40)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert rows(collocations(df, longest=4, least=4, top=30)) == plain(docs, 4, 4, 30)


def test_chunks_overlap_and_cover():
    rng = random.Random(5)
    for overlap in (1, 2, 3):
        words = [str(rng.randrange(9)).encode() for _ in range(900)]
        chunks = parse(b" ".join(words), overlap)
        joined = chunks[0].split()
        for c in chunks[1:]:
            assert joined[-overlap:] == c.split()[:overlap]
            joined += c.split()[overlap:]
        assert joined == words and len(chunks) > 3 and [c[-1:] == b"\n" for c in chunks].count(True) == 1
        # The cuts come from the content: a passage in another place is cut alike.
        again = parse(b"z " * 7 + b"\t".join(words), overlap)
        assert set(chunks[2:]) <= set(again)
    assert max(len(c.split()) for c in parse(b"a " * 5000, 2)) <= 258


def test_pieces_lower_only_ascii():
    assert parse("Ä B.c\x0bD\t  e,,".encode(), 2) == ["Ä b\n".encode(), b"c\n", b"d e\n"]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, gram string, f long, n long, phrase string"
    empty = spark.createDataFrame([], schema)
    assert rows(collocations(empty)) == []
    some = [(1, None, "en", "a", 1, 1, "p"), (None, "", None, None, None, None, None),
            (1, " .,\t\n", "en", "a", 1, 1, "p"), (2, "one two " * 3000, None, "a", 1, 1, "p"),
            (2, "one two " * 3000, None, "a", 1, 1, "p"), (3, "un,deux", "", "a", 1, 1, "p")]
    df = spark.createDataFrame(some, schema)
    assert rows(collocations(df)) == plain([(r[1], r[2]) for r in some], least=10, top=2000)


def test_exact_beyond_64_bits(spark):
    # a = 4,000,000: a million times its square passes 64 bits.
    df = spark.createDataFrame([("so so " * 50000, "x")] * 40, "text string, lang string")
    got = {r["phrase"]: r for r in collocations(df).collect()}
    a, f = 40 * 99998, 40 * 100000
    assert got["so so so"]["a"] == a
    assert got["so so so"]["score"] == min(1000000 * a * a // (f * 40 * 99999), 1000000)


def test_counts_hold_totals(spark):
    df = spark.createDataFrame([("a b a b a b", "x")], "text string, lang string")
    one, two, three = (sorted(tuple(r)[1:] for r in d.collect() if r["gram"]) for d in counts(df, least=2))
    assert one == [("a", 3), ("b", 3)] and two == [("a b", 3), ("b a", 2)] and three == [("a b a", 2), ("b a b", 2)]
