"""The two operators that use built-in DataFrame work only."""

import collections
import math
import random
import zlib

import duckdb
import pytest

from skein.llm import mixing, sharding


def brute_targets(sizes, weights):
    """Water filling by repeated resharing."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 3 * sizes[i]} if w else set()
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            return target
        for i in over:
            target[i] = 3 * sizes[i]
        open_ -= over


def brute_seats(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        if weights[best] <= 0:
            break
        got[best] += 1
    return got


def test_sainte_lague_against_the_loop(spark):
    cases = {"a": ([50.0, 30.0, 20.0], 10), "b": ([1.0, 1.0, 1.0, 1.0], 6), "c": ([0.0, 0.0], 5), "d": ([7.0], 100), "e": ([1000.0, 1.0, 1.0, 3.0, 90.0], 57), "f": ([5.0, 4.0, 3.0], 1), "g": ([2.5, 2.5, 9.0], 0)}
    rows = [(g, k, w, s) for g, (ws, s) in cases.items() for k, w in enumerate(ws)]
    got = collections.defaultdict(dict)
    for r in mixing.sainte_lague(spark.createDataFrame(rows, "g string, k int, w double, s long"), ["g"], "k", "w", "s").collect():
        got[r.g][r.k] = r.quota
    for g, (ws, s) in cases.items():
        assert [got[g][k] for k in range(len(ws))] == brute_seats(ws, s), g


@pytest.mark.parametrize("copies", [1, 40])
def test_mix(spark, copies):
    rows = [(n, "w " * (n % 17), f"s{n % 5}" if n % 7 else None) for n in range(60 * copies)] + [(9000 + n, "big " * 50, "s1") for n in range(20 * copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas().merge(docs.toPandas()[["doc_id", "source"]], on="doc_id")
    out["source"] = out.source.fillna("~")
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    want = brute_targets(by["size"].tolist(), [i % 3 + 1 for i in range(len(by))])
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(by.target, want, strict=True))
    assert math.isclose(by.target.sum(), by["size"].sum())
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + 8).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == out.sort_values("doc_id").taken.tolist()
    picked = mixing.mixed(docs)
    assert picked.columns == docs.columns
    counts = collections.Counter(r.doc_id for r in picked.collect())
    assert all(counts[r.doc_id] in (math.floor(r.taken / r["size"]), math.ceil(r.taken / r["size"])) if r["size"] else counts[r.doc_id] == 0 for _, r in out.iterrows())


def test_mix_edges(spark, edge, edge_rows, no_rows, tmp_path):
    out = mixing.mix(edge)
    assert out.count() == len(edge_rows) and out.where("text is null").count() == 0 if "text" in out.columns else True
    edge.select("doc_id", "text", "source").toPandas().to_parquet(tmp_path / "d.parquet")
    want = duckdb.sql(mixing.MIX_SQL.replace("{docs}", f"'{tmp_path}/d.parquet'")).fetchall()
    key = lambda r: [(v is not None, v) if v is not None else (False, 0) for v in r]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert mixing.mix(no_rows).count() == 0 and mixing.mixed(no_rows).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(none).collect()] == [0, 0]
    assert mixing.mixed(edge).columns == edge.columns


@pytest.mark.parametrize(("n", "words"), [(200, 10), (300, 5), (100, 5), (100, 1), (1, 10)])
def test_small_sources_beside_a_large_one_meet_their_targets(spark, monkeypatch, n, words):
    """Many shards for the small source too; its target is three times its size."""
    monkeypatch.setattr(mixing, "SHARD_BITS", 4)
    rows = [(i, "w " * words, "z") for i in range(n)] + [(10_000 + i, "big " * 700, "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).where("doc_id < 10000").groupBy("source_size", "target").sum("taken").first()
    assert out.source_size == n * words and out.target == 3 * n * words and out["sum(taken)"] == out.target
    assert mixing.mixed(docs).where("doc_id < 10000").count() == 3 * n


def check_shards(rows, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return slots


def test_shard_balance_and_groups(spark):
    rows = [(n, f"text {n} " * (n % 40 + 1)) for n in range(6000)] + [(10_000 + n, "hot copy of a text") for n in range(4000)] + [(20_000 + n, f"pair {n // 2}") for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs).collect()
    check_shards(out, 16)
    load, where = collections.Counter(), collections.defaultdict(set)
    for r in out:
        load[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    mean = sum(load.values()) / 16
    assert max(load.values()) <= 1.01 * mean and min(load.values()) >= 0.97 * mean
    assert all(len(where[zlib.crc32(f"pair {n}".encode())]) == 1 for n in range(200))
    text = dict(rows)
    assert all((r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in out)
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(7)).collect()}


def test_growing_moves_little():
    loads = {arc: 100 + arc % 13 for arc in range(sharding.CELLS)}
    before, after = sharding.place(loads, 16), sharding.place(loads, 17)
    moved = sum(load for arc, load in loads.items() if before[arc] != after[arc]) / sum(loads.values())
    assert 1 / 17 <= moved < 0.25


@pytest.mark.parametrize("seed", range(6))
def test_ring_overflow_goes_clockwise(seed):
    """Against a walk over every arc: clockwise to the next virtual node whose shard has room, else to the emptiest shard."""
    r = random.Random(seed)
    shards, vnodes, cells, slack = r.randint(2, 6), r.randint(1, 8), 64, r.choice((0.0, 0.05, 0.5))
    loads = {arc: r.choice((1, 7, 10, 60)) for arc in r.sample(range(cells), r.randint(1, 64))}
    arcs, owners = sharding.ring(shards, vnodes, cells)
    at = collections.defaultdict(list)
    for arc, owner in zip(arcs, owners, strict=True):
        at[arc].append(owner)
    capacity, held, want = sum(loads.values()) / shards * (1 + slack), [0] * shards, {}
    for arc in sorted(loads, key=lambda a: (-loads[a].bit_length(), a)):
        clockwise = [s for step in range(cells) for s in at[(arc + step) % cells]]
        with_room = [s for s in clockwise if held[s] + loads[arc] <= capacity]
        want[arc] = with_room[0] if with_room else min(dict.fromkeys(clockwise), key=lambda s: held[s])
        held[want[arc]] += loads[arc]
    assert sharding.place(loads, shards, vnodes, cells, slack) == want


def test_bytes_law_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    rows = [(None, "no id at all, a copy")] * 3000 + [(7, "one id, many copies")] * 2000 + [(n, f"small row {n}") for n in range(4000)] + [(n, "ids of their own") for n in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard(docs).collect()
    check_shards(out, 16)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == collections.Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    load = collections.Counter()
    for r in out:
        load[r.shard] += r["size"]
    mean = sum(load.values()) / 16
    assert max(load.values()) <= 1.02 * mean and min(load.values()) >= 0.95 * mean
    key = lambda r: (r.doc_id or 0, r["size"], r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, sharding.shard(docs.repartition(3)).collect()))


def test_shard_edges(edge, edge_rows, no_rows):
    out = sharding.shard(edge).collect()
    check_shards(out, 16)
    assert len(out) == len(edge_rows)
    assert {(r["size"], r.text_crc32) for r in out if r.doc_id in (3, 4)} == {(1, 0)}
    assert sharding.shard(no_rows).count() == 0
