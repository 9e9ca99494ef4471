"""Decontamination, near duplicates and embeddings against brute force."""

import itertools
import random

import numpy as np
import regex

from tmweave.llm import common, decontam, near_dup, vectors_dup

VOCABULARY = [f"{a}{b}" for a in "bcdfgklm" for b in ("a", "el", "or", "us", "in", "ath")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def shingles(text, k=5):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, 5)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(
        spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def contained(docs, items, t=0.8):
    out = {}
    sets = {i: set(shingles(x)) for i, x in items}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    for d, text in docs:
        # An item of fewer than five words is one shingle, looked for at its own width.
        s = set(shingles(text)).union(*[shingles(text, w) for w in range(1, 5)])
        for q, i in first.items():
            if q and len(q & s) >= t * len(q) - 1e-9:
                out[(d, i)] = max(out.get((d, i), 0), len(q & s))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(6, 60))) for i in range(30)]
    items += [(90, items[0][1]), (91, None), (92, ""), (93, "two words"), (94, "!!"),
              (95, "Zebra"), (96, "one two three four"), (97, "two words")]
    docs = [(i, sentence(rng, rng.randrange(1, 300))) for i in range(60)]
    for j in range(60):
        item = rng.choice(items[:30])[1]
        docs.append((100 + j, f"{sentence(rng, 50)} {edited(rng, item, j % 5).upper()}, {sentence(rng, 400)}"))
    docs += [(7, items[3][1]), (None, items[4][1]), (300, "Two, words!"), (301, None), (302, ""),
             (303, " ".join([items[5][1]] * 300)), (303, items[5][1]), (304, "a zebra, and then two WORDS more"),
             (305, "zebra"), (306, "one two three"), (307, "zero one two three four five"), (308, "words two zebras")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    expected = contained(docs, items)
    for limit in (decontam.BROADCAST_ROWS, 0):
        got = {(r["doc_id"], r["item_id"]): r["shared"]
               for r in decontam.contaminated(d, b, broadcast_rows=limit).collect()}
        assert got == expected
    # Hot shingles only come last: a table where most are hot gives the same rows.
    assert {(r["doc_id"], r["item_id"]) for r in
            decontam.contaminated(d, b, hot_items=0).collect()} == set(expected)
    assert {(304, 93), (304, 95), (305, 95), (307, 96)} <= set(expected)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {x for x, _ in expected}
    assert sorted(r[0] for r in kept.collect()) == sorted(i for i, t in docs if i not in bad or (
        i == 7 and t != items[3][1]))
    assert decontam.contaminated(d.limit(0), b).count() == decontam.contaminated(d, b.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    for size, weights in ((400, np.ones(400)), (40, rng.integers(1, 9, 40)), (1, np.array([1])),
                          (3, np.array([5000, 1, 70]))):
        other = weights.copy()
        other[::3] = other[::3] * 2
        sig = near_dup.dart_signatures(np.repeat([0, 1], size), np.tile(base[:size], 2),
                                       np.concatenate([weights, other]).astype(float), 2, k=2000)
        true = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
        assert (sig > 0).all() and abs((sig[0] == sig[1]).mean() - true) < 0.05


def classes(texts, t=0.8):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = []
    for x in texts:
        c = {}
        for s in shingles(x):
            c[s] = c.get(s, 0) + 1
        sets.append(c)
    for a, b in itertools.combinations(range(len(texts)), 2):
        low = sum(min(c, sets[b].get(s, 0)) for s, c in sets[a].items())
        total = sum(sets[a].values()) + sum(sets[b].values()) - low
        if total and low >= t * total:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = sentence(rng, 90)
    texts += [edited(rng, base, rng.randrange(0, 4)) for _ in range(90)]      # links and non-links mixed
    texts += [edited(rng, t, 1) for t in texts[:20]] + texts[:5] + ["one two"] * 3 + ["One, two!"]
    texts += ["word " * 3000, "word " * 2999, None, "", "?!"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    rows = {r["doc_id"]: r for r in near_dup.near_duplicates(d).collect()}
    expected = classes(texts)
    assert [rows[i]["class_id"] for i in range(len(texts))] == expected
    assert all(rows[i]["class_size"] == expected.count(expected[i]) for i in rows)
    kept = near_dup.keep_first(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_blocks_of_a_bucket_lose_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = sentence(rng, 60)
    texts = [edited(rng, base, rng.randrange(0, 5)) for _ in range(70)]
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 7)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(d).collect()}
    assert [rows[i] for i in range(len(texts))] == classes(texts)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 40), sentence(rng, 40)
    d = spark.createDataFrame([(1, a), (1, a), (None, a), (None, b), (2, a), (None, None)], "doc_id long, text string")
    kept = [(r[0], r[1]) for r in near_dup.keep_first(d).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (None, b), (None, None)], key=repr)
    assert near_dup.near_duplicates(d.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = [v for v in base]
    x += [base[0] + rng.normal(size=16) * s for s in np.linspace(0.01, 0.6, 60)]
    x += [base[1]] * 4 + [base[1] * 7, base[2] * 1e200, -base[3]]
    rows = [(i, [float(f) for f in v], i) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [], 0),
             (n + 4, [float("inf")] * 16, 0), (n + 5, [None] + [1.0] * 15, 0), (n + 6, [1.0, 0.0], 0),
             (n + 7, [1.0, 0.001], 0)]
    unit = np.stack([v / np.abs(v).max() for v in x])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    label = np.arange(n)
    while True:
        nxt = np.array([min(label[i], *label[close[i]]) if close[i].any() else label[i] for i in range(n)])
        if (nxt == label).all():
            break
        label = nxt
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    for block in (1024, 5):
        got = {r["vec_id"]: r for r in vectors_dup.near_vectors(d, block=block).collect()}
        assert [got[i]["n_links"] for i in range(n)] == close.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(n)] == label.tolist()
        assert [got[n + i]["n_links"] for i in range(8)] == [0] * 6 + [1, 1]
        assert got[n + 7]["component_id"] == n + 6 and not got[n + 7]["kept"]
    assert vectors_dup.near_vectors(d.limit(0)).count() == 0


def test_shingle_sets_are_those_of_each_text():
    rng = random.Random(3)
    texts = [None, "", " .", "a", "A a", "a b c d", "a b c d e", "é b " * 40] + [
        " ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(50)]
    vocabulary = near_dup._Vocabulary()
    sizes, hashes, counts = near_dup.shingle_sets(texts, vocabulary, 5)
    want = [near_dup.weighted_shingles(t, vocabulary, 5) for t in texts]
    assert sizes.tolist() == [len(h) for h, _ in want]
    assert (hashes == np.concatenate([h for h, _ in want])).all()
    assert (counts == np.concatenate([c for _, c in want])).all()


def test_buckets_of_the_same_texts_are_compared_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    other = words[:18] + ["x"] + words[18:280] + [f"y{i}" for i in range(20)]
    seen, linked_across = [], near_dup.linked_across

    def counted(open_, *rest):
        seen.append((open_.select("key").distinct().count(), open_.select("node").distinct().count()))
        return linked_across(open_, *rest)

    monkeypatch.setattr(near_dup, "linked_across", counted)
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    near_dup.near_duplicates(d, threshold=0.99).collect()
    assert seen == [(1, 2)]
