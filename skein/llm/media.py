"""Media columns: content-defined chunking of media payloads, deduplicated by joins.

A text's bytes, padded with zeros to a multiple of 64, are the samples of an 8-bit mono WAV file.  A
gear hash rolls over the file (each byte shifts the hash and adds a fixed random number; all positions at
once, by doubling the window); a chunk ends where its top bits are zero, within a least and a most
size.  Equal texts are one medium.

The store is two written tables.  ``chunks`` has the bytes of each chunk that stands in more than one place, once by its
digest; ``packs`` has a row for each medium: the ordered list of its chunks with their digests, and the bytes of those
that stand nowhere else, compressed together.  Which chunks are shared is found by an aggregation over digests and told
to the writers as a bitmap of ``FILTER_BITS`` bits (a chunk that it names wrongly is in ``chunks`` as well).  So the bytes of
a chunk are stored once, and only shared ones are shuffled.

Reading goes over the written tables only.  Packs that are whole are read where they lie; the shared chunks of the others are
joined by digest and put in order.  Every chunk's digest is verified, and only then are payload and features taken.

Hot texts are one pack and hot chunks one row in the store, rows of hot texts get their results by
broadcast, and adaptive execution splits what joins hot chunks.  A task holds one medium at a time.

Cases: a null text counts as empty (64 zero samples); null ids stay null; repeated rows give a row each and
share all values; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, join_unique, partitions, rows_of, scratch

UNIT = 64
LEAST, MOST = 256, 65_536
#: Zero bits at the hash's top that end a chunk: every 2^n bytes in the mean, beyond the least size.
TOP_BITS = 9
RATE = 8_000
LEVEL = 9
#: The compression dictionary: at most this many bytes, trained on so many first characters of at most this many texts.
DICTIONARY_BYTES, DICTIONARY_CHARS, DICTIONARY_TEXTS = 112_640, 4_096, 2_000
#: Bits of the bitmaps of shared chunks and repeated media, whatever the input: 8 MB each.
FILTER_BITS = 1 << 26
SPLITMIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _gear() -> np.ndarray:
    """A random 32-bit number per byte value, from a mixing rule."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX[1])
        return (z ^ (z >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def gear_hash(data: bytes) -> np.ndarray:
    """The rolling hash at each byte: the sum of gear[b] << age over the last 32 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
    return h


def cuts(data: bytes, least: int = LEAST, most: int = MOST, top_bits: int = TOP_BITS) -> list[int]:
    """Chunk ends of ``data``; the last is its length."""
    if len(data) <= least:
        return [len(data)]
    ends = (np.flatnonzero(gear_hash(data) >> np.uint32(32 - top_bits) == 0) + 1).tolist()
    out, start, i = [], 0, 0
    while len(data) - start > least:
        while i < len(ends) and ends[i] < start + least:
            i += 1
        end = min(ends[i] if i < len(ends) else len(data), start + most, len(data))
        out.append(end)
        start = end
    if start < len(data):
        out.append(len(data))
    return out


def payload(text: str | None) -> bytes:
    b = (text or "").encode()
    return b + bytes(max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b))


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples(file: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"data":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature(data: bytes, chunks: int) -> str:
    """Level, spread, zero crossings and chunk count of the samples."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    mean = x.sum() / len(x)
    power = (x * x).sum() / len(x)
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"wav8 mean={mean:.4f} rms={power**0.5:.4f} crossings={crossings} chunks={chunks}"


def dictionary(docs: DataFrame, id_col: str, text_col: str) -> bytes:
    """A compression dictionary from a bounded sample of rows; empty if there is too little to train on."""
    import zstandard

    rows = bounded_sample(docs, id_col, DICTIONARY_TEXTS).select(F.substring(F.coalesce(text_col, F.lit("")), 1, DICTIONARY_CHARS).alias("t")).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [wav(payload(r.t)) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def bitmap(digests: DataFrame) -> bytes:
    """A bitmap over the first bits of ``digests`` (digest); at most ``FILTER_BITS`` bits reach the driver."""
    bit = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % FILTER_BITS + 1
    pieces = digests.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for row in pieces.collect():
        at = (row.n - 1) * 4096
        out[at : at + 4096] = row.bits
    return bytes(out)


def told(bits: bytes, digest: bytes) -> bool:
    bit = int.from_bytes(digest[:4], "big") % FILTER_BITS
    return bool(bits[bit >> 3] >> (bit & 7) & 1)


def _pieces(text: str | None):
    """(seq, digest, bytes) of each chunk of a text's file."""
    file, start = wav(payload(text)), 0
    for seq, end in enumerate(cuts(file)):
        piece = file[start:end]
        yield seq, hashlib.sha256(piece).digest(), piece
        start = end


def _new(batches, most: int = 1 << 18):
    """(key, text) of each medium that the task has not met yet."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in rows_of(batch):
            found = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    found.append((key, text))
            if len(seen) > most:
                seen.clear()  # only saves repeats within a task
            yield found


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


def _places(media: DataFrame) -> DataFrame:
    """(digest, place) of each chunk of ``media`` (key, text): half its digest, and a number for its medium and position."""

    def of(batches):
        for found in _new(batches):
            rows = [(digest[:16], (int.from_bytes(key[:8], "big") + seq * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)) for key, text in found for seq, digest, _ in _pieces(text)]
            if rows:
                yield _batch(rows, "digest binary, place long")

    return media.mapInArrow(of, "digest binary, place long")


PACK = "key binary, list binary, data binary"
#: An entry of a pack's list: position, length (0 if the bytes are in ``chunks``), digest.
ENTRY = struct.Struct("<II32s")


def entry(seq: int, length: int, digest: bytes) -> bytes:
    return ENTRY.pack(seq, length, digest)


def entries_of(packed: bytes):
    return ENTRY.iter_unpack(packed)


def _packs(media: DataFrame, shared: bytes, repeated: bytes, again: bool, words: bytes) -> DataFrame:
    """The packs of the media that ``repeated`` names, or, unless ``again``, of all others."""

    def of(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for found in _new(batches):
            rows = []
            for key, text in found:
                if told(repeated, key) == again:
                    entries, own = [], []
                    for seq, digest, piece in _pieces(text):
                        here = not told(shared, digest)
                        entries.append(entry(seq, len(piece) if here else 0, digest))
                        if here:
                            own.append(piece)
                    rows.append((key, b"".join(entries), pack.compress(b"".join(own))))
            if rows:
                yield _batch(rows, PACK)

    return media.mapInArrow(of, PACK)


def _shared_chunks(media: DataFrame, shared: bytes, words: bytes) -> DataFrame:
    """(digest, data), compressed, of the chunks that ``shared`` names; each once from a task."""

    def of(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        seen: set[bytes] = set()
        for found in _new(batches):
            rows = []
            for _, text in found:
                for _, digest, piece in _pieces(text):
                    if told(shared, digest) and digest not in seen:
                        seen.add(digest)
                        rows.append((digest, pack.compress(piece)))
            if len(seen) > 1 << 18:
                seen.clear()
            if rows:
                yield _batch(rows, "digest binary, data binary")

    return media.mapInArrow(of, "digest binary, data binary")


def lists(packs: DataFrame) -> DataFrame:
    """(key, seq, length, digest): the manifest, a row for each chunk of each medium; ``length`` is 0 where the bytes are in the shared store."""

    def of(batches):
        for batch in batches:
            rows = [(key, *entry) for key, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for entry in entries_of(entries)]
            if rows:
                yield _batch(rows, "key binary, seq int, length int, digest binary")

    return packs.select("key", "list").mapInArrow(of, "key binary, seq int, length int, digest binary")


REBUILT = "key binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _described(key: bytes, entries: bytes, own: bytes, others: dict[bytes, bytes]) -> tuple:
    """A medium put together from its list, the bytes in its pack and its shared chunks; a row of ``REBUILT``."""
    parts, at = [], 0
    for n, (seq, length, digest) in enumerate(entries_of(entries)):
        piece = own[at : at + length] if length else others.get(digest, b"")
        at += length
        if seq != n or hashlib.sha256(piece).digest() != digest:
            raise ValueError("a chunk is missing or damaged")
        parts.append(piece)
    file = b"".join(parts)
    data = samples(file)
    return key, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).digest(), feature(data, len(parts))


def _unpacker(words: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def rebuild(packs: DataFrame, chunks: DataFrame, words: bytes) -> DataFrame:
    """``REBUILT`` of each medium of the written tables ``packs`` and ``chunks``."""

    def alone(batches):
        unpack = _unpacker(words)
        for batch in batches:
            for part in rows_of(batch):
                rows = [_described(key, entries, unpack.decompress(data), {}) for key, entries, data in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield _batch(rows, REBUILT)

    def joined(batches):
        unpack = _unpacker(words)
        now, others, out = None, {}, []
        for batch in batches:
            for key, digest, entries, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and key != now[0]:
                    out.append(_described(*now, others))
                    others = {}
                if entries is not None:
                    now = (key, entries, unpack.decompress(data))
                elif now and now[0] == key:
                    others[digest] = unpack.decompress(data)
                else:
                    raise ValueError("chunks of a medium without its pack")
            if len(out) > 1000:
                yield _batch(out, REBUILT)
                out = []
        if now:
            out.append(_described(*now, others))
        if out:
            yield _batch(out, REBUILT)

    def wants(batches):
        for batch in batches:
            rows = [(key, d) for key, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in {d for _, length, d in entries_of(entries) if not length}]
            if rows:
                yield _batch(rows, "key binary, digest binary")

    @F.arrow_udf("boolean")
    def whole(entries: pa.Array) -> pa.Array:
        return pa.array([all(length for _, length, _ in entries_of(e)) for e in entries.to_pylist()], pa.bool_())

    open_ = packs.where(~whole("list"))
    found = open_.select("key", "list").mapInArrow(wants, "key binary, digest binary").join(chunks, "digest")
    blank = F.lit(None).cast("binary")
    both = open_.select("key", blank.alias("digest"), "list", "data").unionByName(found.select("key", "digest", blank.alias("list"), "data"))
    dealt = both.repartition(partitions(packs.sparkSession), "key").sortWithinPartitions("key", F.col("digest").asc_nulls_first())
    return packs.where(whole("list")).mapInArrow(alone, REBUILT).unionByName(dealt.mapInArrow(joined, REBUILT))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, bytes]:
    """(rows, packs, chunks, dictionary): written tables (doc_id, n_bytes, key), ``PACK`` and (digest, data), and what the data is compressed with."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.substring(F.unhex(F.sha2(text, 256)), 1, 20)  # of the text's digest, as an identity
    rows = scratch(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), key.alias("key")), "rows")
    media = docs.select(key.alias("key"), text.alias("text"))
    words = dictionary(docs, id_col, text_col)
    repeated = bitmap(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("digest")))
    shared = bitmap(_places(media).groupBy("digest").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("digest"))
    packs = _packs(media, shared, repeated, False, words).unionByName(_packs(media, shared, repeated, True, words).dropDuplicates(["key"]))
    return rows, scratch(packs, "packs"), scratch(_shared_chunks(media, shared, words).dropDuplicates(["digest"]), "chunks"), words


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all media, read them back from their chunk lists, and describe them, a row per row of ``docs``."""
    rows, packs, chunks, words = store(docs, id_col, text_col)
    rebuilt = scratch(rebuild(packs, chunks, words), "rebuilt")
    sha = lambda c: F.lower(F.hex(c)).alias(c)
    return join_unique(rows, rebuilt, ["key"]).select("doc_id", "n_bytes", "payload_bytes", sha("payload_sha256"), "tail_crc32", "media_bytes", sha("media_sha256"), "feature")
