"""Media chunks, WARC archives, and the pipeline."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from skein.llm import media, warc


def test_gear_hash_is_a_window_sum():
    data = bytes(random.Random(1).randrange(256) for _ in range(200))
    h = media.gear_hash(data)
    for i in (0, 5, 31, 32, 150):
        want = sum(int(media.GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % 2**32
        assert int(h[i]) == want


def test_cuts_follow_content():
    r = random.Random(2)
    body = bytes(r.randrange(256) for _ in range(60_000))
    chunks = lambda d: {d[a:b] for a, b in zip([0, *media.cuts(d, 256, 4096, 9)[:-1]], media.cuts(d, 256, 4096, 9), strict=True)}
    ends = media.cuts(body, 256, 4096, 9)
    assert ends[-1] == len(body) and all(256 <= b - a <= 4096 for a, b in zip([0, *ends[:-2]], ends[:-1], strict=True))
    assert len(chunks(body) & chunks(b"inserted" + body)) > 0.9 * len(chunks(body))
    assert media.cuts(b"") == [0] and media.cuts(b"x") == [1]


def expected(text):
    b = (text or "").encode()
    p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
    return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44


def test_media_round_trip(edge, edge_rows, no_rows):
    out = media.chunked(edge).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in out)
    assert got == sorted((i or 0, *expected(t)) for i, t, *_ in edge_rows)
    same = [r for r in out if r.doc_id in (1, 2)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1 and len(same) == 3
    assert media.chunked(no_rows).count() == 0


def test_store_keeps_each_chunk_once(spark):
    r = random.Random(3)
    shared = "".join(r.choice("abcdefgh ") for _ in range(40_000))
    docs = spark.createDataFrame([(n, f"{n} start " + shared) for n in range(6)], "doc_id long, text string")
    _, packs, chunks, _ = media.store(docs)
    manifest = media.lists(packs)
    stored = chunks.count() + manifest.where("length > 0").count()
    assert stored == manifest.select("digest").distinct().count() < 0.5 * manifest.count()


def test_passages_shared_by_documents_are_stored_once(spark):
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = prose(6_000)
    docs = spark.createDataFrame([(n, prose(500 + 137 * n) + passage + prose(700)) for n in range(6)], "doc_id long, text string")
    _, packs, chunks, _ = media.store(docs)
    manifest = media.lists(packs)
    assert chunks.count() + manifest.where("length > 0").count() < 0.6 * manifest.count()


def test_reading_needs_every_stored_chunk(spark):
    from skein.llm.common import scratch

    r = random.Random(12)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = prose(6_000)
    docs = spark.createDataFrame([(n, prose(900) + passage) for n in range(4)] + [(10, "alone"), (11, "twice"), (12, "twice")], "doc_id long, text string").repartition(3)
    _, packs, chunks, words = media.store(docs)
    assert packs.count() == 6 and media.rebuild(packs, chunks, words).count() == 6
    gone = chunks.first().digest
    with pytest.raises(Exception, match="missing or damaged"):
        media.rebuild(packs, scratch(chunks.where(chunks.digest != gone), "less"), words).collect()


def test_bitmap_names_its_digests(spark):
    digests = [hashlib.sha256(bytes([n, 7])).digest() for n in range(200)]
    bits = media.bitmap(spark.createDataFrame([(bytearray(d),) for d in digests[:100]], "digest binary"))
    assert all(media.told(bits, d) for d in digests[:100]) and not any(media.told(bits, d) for d in digests[100:])


def test_feature_against_a_loop():
    data = media.payload("Some text, é, with a few words\n" * 9)
    x = [b - 128 for b in data]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    want = f"wav8 mean={sum(x) / len(x):.4f} rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f} crossings={crossings} chunks=3"
    assert media.feature(data, 3) == want


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        media.samples(b"RIFFxxxxNOPE")
    assert media.samples(media.wav(b"abc" * 64)) == b"abc" * 64


def test_loser_tree():
    r = random.Random(4)
    for k in range(0, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_merge_passes_of_bounded_fan_in():
    r = random.Random(9)
    for k in (0, 1, 2, 5, 30, 100):
        runs = [sorted(r.randrange(500) for _ in range(r.randrange(1, 9))) for _ in range(k)]
        assert warc.merged([list(x) for x in runs], 3) == sorted(x for run in runs for x in run)


def test_index_is_a_gapless_rank_over_ranges(spark):
    rows = [(n, f"http://h{n % 3}.com/{'hot' if n % 2 else n % 7}", f"<p>{n}</p>" * 9) for n in range(500)]
    written = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), archive_bytes=3000)
    got = sorted((r.index_pos, r.url_key, r.capture_time) for r in warc.merge_index(written, range_rows=20).collect())
    want = sorted((warc.url_key(u), warc.capture_time(i)) for i, u, _ in rows)
    assert got == [(n, *w) for n, w in enumerate(want)]


def test_url_keys():
    keys = [warc.url_key(u) for u in ("https://www.Example.com:443/A?b=C#f", "http://user@sub.example.com:8080", None, "not a url", "http://[bad", "")]
    assert keys == ["com,example)/a?b=c", "com,example,sub:8080)/", "", "not a url", "http://[bad", ""]


def pages(spark):
    big = "<p>same page é</p>" * 20
    rows = [(5, "http://b.com/", big), (3, "http://a.com/x", big), (9, None, big), (None, "http://a.com/x", big), (3, "http://a.com/x", big), (1, "http://a.com/y\r\nInjected: 1", "short"), (2, "http://c.com", "short"), (7, "http://c.com", None), (8, "http://c.com", ""), (6, "u", "x" * 300_000)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_archives(spark):
    rows, df = pages(spark)
    out = warc.archive(df).collect()
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h is not None and h.startswith("<p>same") and i != 3
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    order = sorted(out, key=lambda r: r.index_pos)
    keys = [(r.url_key, r.capture_time, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys) and [r.index_pos for r in order] == list(range(len(rows)))
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_of_bounded_size_are_whole_files(spark):
    rows, df = pages(spark)
    written = warc.write_archives(df.coalesce(1), archive_bytes=500)
    stored = written.collect()
    assert len(stored) > 3
    records = [h for a in stored for *_, h, _ in warc.read_records(a.data)]
    assert len(records) == len(rows) and all("Injected" not in h for h in records)
    whole = b"".join(zlib.decompress(a.data[r["offset"] : r["offset"] + r["length"]], 31) for a in stored for r in a.run)
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    with pytest.raises(ValueError):
        list(warc.read_records(stored[0].data[:-5]))


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from skein.llm import queries

    for name, text in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({text.strip()}) AS x").fetchall()
        assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr), name


def test_every_query_runs(spark, sf_dir):
    from skein.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    for name in ("op1_ordinal_toxicity", "op3_suffix_repetition", "op4_tree_scoring", "op6_quadratic_quality"):
        df = queries.QUERIES[name](spark, sf_dir)
        assert df.count() == spark.read.parquet(f"{sf_dir}/{'pages' if 'tree' in name else 'documents'}.parquet").count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp
    from skein.llm import quality, simhash, toxicity
    from skein.llm.common import scratch, table
    from skein.llm.bpe import codec, vocabulary_path

    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "dedup", "mixing", "bpe"]
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    kept = [docs]
    for name, stage in cp.STAGES[:-1]:
        kept.append(scratch(stage(spark, kept[-1], sf_dir), name))
        assert kept[-1].columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    model = quality.fit(docs, labels)
    assert ids[1] == sorted(i for i, t in text.items() if model.score(quality.statistics([t]))[0] >= quality.THRESHOLD)
    toxic = toxicity.fit(kept[1], labels)
    assert ids[2] == sorted(i for i in ids[1] if toxic.above(np.array([toxic.margin(text[i])]))[0, 0] < toxicity.THRESHOLD)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept[2], shingle=5, lanes=4, max_bits=simhash.bits_at(0.8, 4) + 3).collect()}
    assert ids[3] == sorted(set(groups.values())) and len({text[i] for i in ids[3]}) == len(ids[3])
    assert set(ids[4]) <= set(ids[3]) and max(collections.Counter(ids[4]).values()) <= 3
    last = cp.run(spark, sf_dir).collect()
    c = codec(vocabulary_path())
    want = sorted((i, len(c.encode(text[i])), hashlib.sha256(text[i].encode()).hexdigest()) for i in ids[4])
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in last) == want


def test_pipeline_stages_on_edges(spark, sf_dir, edge, no_rows):
    import corpus_pipeline as cp

    for docs in (edge, no_rows):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            assert name == "bpe" or out.columns == docs.columns
            assert docs is edge or not rows
