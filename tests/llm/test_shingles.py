"""Near-duplicates by exact shingle sets, against all pairs."""

import itertools
import random

import numpy as np

import corpus_pipeline
from skein.llm import shingles, simhash


def grams(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(rows):
    """id -> smallest id reachable over pairs of at least 0.8, and the similarities of all pairs."""
    sets = {i: grams(t) for i, t in rows}
    label, pairs = {i: i for i in sets}, {(a, b): similarity(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    changed = True
    while changed:
        changed = False
        for (a, b), s in pairs.items():
            if s >= 0.8 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label, pairs


def corpus():
    """Pairs of texts at similarities on both sides of 0.8, chains, a large cluster, short and empty texts."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for n in range(160):
        words = [word() for _ in range(r.choice((40, 104, 250)))]
        cut = round(len(words) * (0.05 + 0.25 * n / 160))
        texts += [words, words[: len(words) - cut] + [word() for _ in range(r.randrange(cut + 1))]]
    chain = [word() for _ in range(300)]
    texts += [chain[k : k + 150] for k in range(0, 150, 12)]
    hub = [word() for _ in range(120)]
    texts += [hub[:at] + [word()] + hub[at + 1 :] for at in r.choices(range(120), k=60)]
    shared = [word() for _ in range(30)]
    texts += [shared + [word() for _ in range(60)] for _ in range(40)]
    return list(enumerate([*map(" ".join, texts), "", None, "a b", "A  b", "a b c"]))


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PAIRS", 50)
    rows = corpus()
    want, pairs = brute_groups(rows)
    assert sum(0.8 <= s < 0.86 for s in pairs.values()) > 20 and sum(0.7 < s < 0.8 for s in pairs.values()) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want


def test_dedup_stage_keeps_distinct_texts(spark, sf_dir):
    rows = corpus()
    want, _ = brute_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_positional_bytes_are_shared_as_the_similarity_says():
    """Shared bytes and candidates of random pairs in bands of similarity, against what is promised."""
    r, found = np.random.default_rng(7), {}
    for band in (0.80, 0.85, 0.90):
        shared, hit = [], 0
        for _ in range(400):
            n = int(r.choice((20, 100, 400)))
            both = round(n * 2 * band / (1 + band) + 0.499)
            pool = r.integers(0, 2**64 - 1, 2 * n - both, np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
            assert shingles.jaccard(a, b) >= band
            x, y = (np.frombuffer(shingles.fingerprint(s), np.uint8) for s in (a, b))
            shared.append((x == y).mean() - shingles.jaccard(a, b))
            assert (x == y).sum() >= shingles.least_bytes(0.8)
            hit += (x == y).reshape(shingles.TABLES, shingles.WIDTH).all(axis=1).any()
        assert abs(np.mean(shared)) < 0.01
        found[band] = hit / 400
    assert min(found.values()) > 0.995
    assert shingles.fingerprint(np.zeros(0, np.uint64)) == bytes(shingles.POSITIONS)


def test_one_row_of_each_group_stays(spark):
    """Repeated ids with other texts, ties, null ids, repeated rows: against a plain loop."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "red green blue white black grey"
    rows = [(5, a, 1), (5, b, 2), (2, b, 3), (7, a, 4), (7, c, 5), (7, c, 6), (7, c, 6), (None, a, 7), (None, "alone", 8), (9, "", 9), (9, None, 10), (11, " ", 11), (12, "alone", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int").repartition(3)
    for groups in (shingles.near_duplicates(docs), simhash.near_duplicates(docs)):
        kept = simhash.keep_one(docs, groups)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()), key=repr)
        assert got == sorted([(5, a), (2, b), (7, c), (0, a), (0, "alone"), (9, ""), (12, "alone")], key=repr)


def test_recall_by_band(spark):
    """Found pairs of a table against all pairs, in each band of similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label, pairs = brute_groups(rows)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert got == label
    assert any(0.8 <= s < 1 for s in pairs.values())


def copies(n, kept=130, length=150, seed=3):
    """A text, copies that keep its beginning but end in words of their own (similar to each other by 0.76), and links among some."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**9)}"
    base = [word() for _ in range(length)]
    texts = [base, *([*base[:kept], *(word() for _ in range(length - kept))] for _ in range(n)), *([*base[:-6], *(word() for _ in range(6))] for _ in range(20))]
    texts += [[*t[:-1], word()] for t in texts[1:6]]
    return list(enumerate(map(" ".join, texts)))


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Written tables of pairs stay below the postings' rows in a group where nearly all pairs are almost similar enough."""
    rows = copies(300)
    want, pairs = brute_groups(rows)
    assert sum(0.7 < s < 0.8 for s in pairs.values()) > 40_000
    write, counts = shingles.scratch, []

    def counted(df, name):
        out = write(df, name)
        if {"u", "v"} <= set(out.columns):
            counts.append(out.count())
        return out

    monkeypatch.setattr(shingles, "scratch", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want
    assert counts and max(counts) <= shingles.TABLES * len(rows)


def test_postings_with_too_large_sets_are_compared_outside(spark, monkeypatch):
    monkeypatch.setattr(shingles, "HELD", 1)
    monkeypatch.setattr(shingles, "HEAVY", 0)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == brute_groups(rows)[0]


def test_likely_pairs_hold_all_true_ones(monkeypatch):
    """Against all pairs; and their number grows as the copies do."""
    monkeypatch.setattr(shingles, "PAIRS", 50)
    for rows in (corpus(), copies(100)):
        sets = [shingles.shingles(t, 5) for _, t in rows]
        found = {(i, j) for a, b in shingles.likely(sets, 0.8) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert all(i < j for i, j in found)
        true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i]) and shingles.jaccard(sets[i], sets[j]) >= 0.8}
        assert true and true <= found
    number = [sum(len(a) for a, _ in shingles.likely([shingles.shingles(t, 5) for _, t in copies(n)], 0.8)) for n in (200, 400)]
    assert number[1] <= 2 * number[0] + 100
