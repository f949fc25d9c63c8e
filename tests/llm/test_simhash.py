import itertools
import random

import numpy as np
import xxhash

from skein.llm import simhash
from skein.llm.components import components


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """id -> smallest id reachable, from (id, fingerprint) pairs."""
    label = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(pairs, 2):
            if bin(x ^ y).count("1") <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_blocks_cover_every_five_of_eight():
    assert all(any(set(b) <= set(s) for b in simhash.BLOCKS) for s in itertools.combinations(range(8), 5))


def test_fingerprints():
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice("abAB éÉ\n\t\x0b ") for _ in range(r.randint(0, 200)))
        assert simhash.simhash(text)[0] & (2**64 - 1) == brute_fingerprint(text)
    assert simhash.simhash("a b c d e " * 40_000) == simhash.simhash("A b c d e " * 40_000)


def test_links_are_whole(spark, monkeypatch):
    """Random fingerprints around centres, chains and hot postings, against all pairs."""
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(40)}
    fps |= {centres[0] ^ ((1 << k) - 1) for k in range(0, 30, 3)}
    pairs = [(n, f) for n, f in enumerate(sorted(fps))]
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for _, f in pairs]
    classes = spark.createDataFrame(signed, "_lane0 long")
    edges = simhash.links(simhash.postings(classes), 3)
    rows = edges.collect()
    assert all(bin((u ^ v) & (2**64 - 1)).count("1") <= 3 for u, v in rows)
    of = {x.node & (2**64 - 1): x.root for x in components(edges).collect()}
    want = brute_components(pairs)
    mine = {n: of.get(f, f"alone{n}") for n, f in pairs}
    for (a, _), (b, _) in itertools.combinations(pairs, 2):
        assert (mine[a] == mine[b]) == (want[a] == want[b])


def test_near_duplicates(spark, edge, edge_rows, no_rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge).collect())
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in edge_rows]
    label = brute_components(sorted({(i, f) for i, f in prints if i is not None}))
    want = []
    for i, f in prints:
        near = [label[j] for j, g in prints if j is not None and bin(f ^ g).count("1") <= 3]
        want.append((i is None, i or 0, f"{f:016x}", label[i] if i is not None else min(near, default=None)))
    assert got == sorted(want)
    assert simhash.near_duplicates(no_rows).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_components_of_stars_and_random_links(spark):
    """Stars need no round; stars whose centres are linked, or whose nodes have two centres, do."""
    rng = random.Random(5)
    for size, links in ((40, 20), (40, 60), (12, 8)):
        pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(links)] + [(100 + i, 100) for i in range(1, 9)] + [(300, 200), (300, 250), (200, 150)]
        root = {n: n for p in pairs for n in p}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        alone = {n for n in root if all(a == b for a, b in pairs if n in (a, b))}
        found = components(spark.createDataFrame(pairs, "u long, v long")).collect()
        assert len(found) == len(root) - len(alone)
        assert {r.node: r.root for r in found} == {n: r for n, r in root.items() if n not in alone}


def test_similar_texts_with_lanes(spark):
    r = random.Random(3)
    vocabulary = [f"w{n}" for n in range(5000)]
    rows, n = [], 0
    for g in range(30):
        words = [r.choice(vocabulary) for _ in range(300)]
        for c in range(3):
            own = list(words)
            for at in r.sample(range(300), 3 * c):
                own[at] = "new"
            rows.append((n, g, " ".join(own)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, g int, text string")
    groups = simhash.near_duplicates(docs, shingle=5, lanes=4, max_bits=simhash.bits_at(0.8, 4))
    component = {x.doc_id: x.component_id for x in groups.collect()}
    assert all(component[i] >= 3 * g for i, g, _ in rows)  # no two groups meet
    pairs = [(component[3 * g], component[3 * g + c]) for g in range(30) for c in (1, 2)]
    assert sum(a == b for a, b in pairs[::2]) >= 28  # nine tenths of the shingles shared
    kept = simhash.keep_one(docs, groups)
    assert kept.columns == docs.columns and kept.count() == len(set(component.values()))


def test_keep_one_edges(spark, edge):
    kept = simhash.keep_one(edge, simhash.near_duplicates(edge))
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 3, 6, 7, 8, 9] and kept.where("doc_id is null").count() == 2 and kept.columns == edge.columns


def test_lanes_are_independent():
    h = np.arange(1, 1000, dtype=np.uint64)
    bits = lambda x: np.unpackbits(x.view(np.uint8))
    assert abs((bits(simhash._mix(h, 1)) == bits(simhash._mix(h, 2))).mean() - 0.5) < 0.01
