"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint of 64 bits is eight bytes at fixed positions.  Two fingerprints that
differ in at most three bits agree in at least five bytes (the guaranteed minimum
of shared positional bytes), and any five of eight positions hold one of the 14
blocks of the Steiner system S(3,4,8).  The index therefore keeps, per fingerprint,
one posting for each block: its four bytes with their positions.  No true pair is
missed, and postings are about 2^24 times rarer than those of single bytes, which
are hot at any real size.  Within a posting, shared positional bytes are tallied
per pair, pairs below the minimum are dropped, the rest are verified bit by bit.

Equal fingerprints are one node, so groups of copies cost one row.  A posting hands
on a spanning forest of its verified pairs, never all of them: links stay whole for
components, and their number stays below the number of rows in the postings.

With ``lanes`` above 1 the fingerprint has that many 64-bit lanes (the further ones
hash each shingle anew).  Bits only estimate a similarity, so links then are those of
the exact shingle sets (``shingles``: the same index and count filter, over shingles), whatever ``max_bits``.

Cases: a null or word-less text has fingerprint zero and links like any other; a text
with fewer words than a shingle is one shingle; repeated rows give a row each; a null
id takes no part in the smallest id of its group (all null: null); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import shingles
from skein.llm.common import join_unique, partitions, scratch, small, text_key
from skein.llm.components import components

SEED = 42
MAX_BITS = 3
#: Fixed value: the blocks of S(3,4,8); each five of eight positions include one.
BLOCKS = [
    (0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (0, 2, 4, 6),
    (0, 2, 5, 7), (1, 3, 4, 6), (1, 3, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6), (1, 2, 4, 7), (1, 2, 5, 6),
]
#: Shingles that are held as numbers at once, whatever the text's length.
CHUNK = 1 << 16
#: Rows of a posting that are compared with all its others at once.
BLOCK_ROWS = 1024


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Another well-mixed 64-bit hash of each value; lane 0 is the hash itself."""
    if lane == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def simhash(text: str | None, shingle: int = 3, lanes: int = 1) -> list[int]:
    """The lanes of one text's fingerprint, as signed 64-bit numbers."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \x20\x09-\x0D
    if not words:
        return [0] * lanes
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : min(n, at + CHUNK)].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        for lane in range(lanes):
            counts[lane] += np.unpackbits(_mix(h, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def lane_names(lanes: int) -> list[str]:
    return [f"_lane{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, text_key, one long per lane) for every row."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([simhash(t, shingle, lanes) for t in batch.to_pylist()], pa.list_(pa.int64()))

    hashed = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), of(F.col(text_col)).alias("_f"))
    return hashed.select("doc_id", "text_key", *[F.col("_f")[k].alias(name) for k, name in enumerate(lane_names(lanes))])


def hex_of(text: Column, shingle: int, lanes: int) -> Column:
    """The lanes of a text's fingerprint as one hex string."""

    @F.arrow_udf(T.StringType())
    def of(batch: pa.Array) -> pa.Array:
        return pa.array(["".join(f"{lane & (1 << 64) - 1:016x}" for lane in simhash(t, shingle, lanes)) for t in batch.to_pylist()], pa.string())

    return of(text)


def hex_fingerprint(lanes: int):
    return F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in lane_names(lanes)])


def postings(classes: DataFrame) -> DataFrame:
    """(_key, _lane0): the inverted index, a row for each fingerprint and block of positions."""

    def key(which: int, positions: tuple[int, ...]):
        total = F.lit(which).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned(F.col("_lane0"), 8 * p).bitwiseAND(F.lit(255).cast("long"))
            total = F.shiftleft(total, 8).bitwiseOR(byte)
        return total

    return classes.select(F.explode(F.array(*[key(i, p) for i, p in enumerate(BLOCKS)])).alias("_key"), "_lane0")


def links(index: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): for each posting a spanning forest of its pairs within ``max_bits``."""
    least_bytes = max(1, 8 - max_bits)  # a differing bit spoils one byte at most

    def scan(batches):
        keep_key, keep = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keep_key, keep = np.concatenate([keep_key, batch.column(0).to_numpy()]), np.concatenate([keep, batch.column(1).to_numpy().view(np.uint64)])
            if keep_key[0] == keep_key[-1]:
                continue
            done = int(np.searchsorted(keep_key, keep_key[-1]))
            yield from emit(keep_key[:done], keep[:done])
            keep_key, keep = keep_key[done:], keep[done:]
        yield from emit(keep_key, keep)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (one of a against all of b, or element by element) hold: count filter, then bits."""
        x = np.ascontiguousarray(a ^ b)
        ok = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1, dtype=np.int32) >= least_bytes
        ok[ok] = np.bitwise_count(x[ok]) <= max_bits
        return ok

    def forest(f: np.ndarray):
        """Pairs (parent, child) that span each component of one posting, by breadth-first search in blocks of rows."""
        waiting = np.arange(len(f))
        while len(waiting) > 1:
            front, waiting = waiting[:1], waiting[1:]
            while len(front) and len(waiting):
                found = np.zeros(len(waiting), bool)
                parent = np.zeros(len(waiting), np.int64)
                for at in range(0, len(waiting), BLOCK_ROWS):
                    rest = waiting[at : at + BLOCK_ROWS]
                    for a in range(0, len(front), BLOCK_ROWS):
                        ok = near(f[front[a : a + BLOCK_ROWS], None], f[None, rest])
                        hit = ok.any(axis=0) & ~found[at : at + BLOCK_ROWS]
                        parent[at : at + BLOCK_ROWS][hit] = front[a : a + BLOCK_ROWS][ok.argmax(axis=0)][hit]
                        found[at : at + BLOCK_ROWS] |= hit
                if found.any():
                    yield parent[found], waiting[found]
                front, waiting = waiting[found], waiting[~found]

    def emit(k: np.ndarray, f: np.ndarray):
        if len(k) < 2:
            return
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size = np.diff(cut)
        a = cut[:-1][size == 2]
        ok = near(f[a], f[a + 1])
        us, vs = [f[a][ok]], [f[a + 1][ok]]
        for start, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
            run = f[start : start + n]
            for p, c in forest(run):
                us.append(run[p])
                vs.append(run[c])
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    dealt = index.repartition(partitions(index.sparkSession), "_key").sortWithinPartitions("_key")
    return dealt.mapInArrow(scan, "u long, v long")


def bits_at(similarity: float, lanes: int) -> int:
    """Most differing bits of two texts whose shingle sets have this Jaccard similarity, in the mean."""
    return round(64 * lanes * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS, lanes: int = 1, similarity: float = 0.8,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_key, root) per row.

    ``component_id`` is the smallest id in the row's component, ``root`` names the component and ``text_key`` the text.
    One lane links up to ``max_bits`` differing bits, more lanes link the exact ``similarity`` of shingle sets or more.
    """
    if lanes > 1:
        printed = docs.select(id_col, text_col).withColumn("fingerprint", hex_of(F.col(text_col), shingle, lanes))
        return shingles.near_duplicates(printed, id_col, text_col, shingle, similarity, keep=("fingerprint",)).select("doc_id", "fingerprint", "component_id", "text_key", "root")
    if max_bits > MAX_BITS:
        raise ValueError("one lane guarantees five shared bytes up to three differing bits only; take more lanes")
    prints = scratch(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = scratch(prints.groupBy("_lane0").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(links(postings(classes), max_bits))
    linked = scratch(found.join(classes.withColumnRenamed("_lane0", "node"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = join_unique(linked, least, ["root"]).select(F.col("node").alias("_lane0"), "root", "component_id")
    label = classes.join(labels, "_lane0", "left").select("_lane0", F.coalesce("root", "_lane0").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return join_unique(prints, scratch(label, "labels"), ["_lane0"]).select("doc_id", hex_fingerprint(1).alias("fingerprint"), "component_id", "text_key", "root")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``groups``: that with the smallest id, of equal ids that with the smallest digest of its text.

    Rows of different components stay even if they share an id; of rows that agree in id and text one stays.  Rows without an
    id cannot be named and stay.  Only rows that some other row stands for are looked up: by broadcast while they are
    few, else by a join on the row's key; all others pass without a shuffle.
    """
    keyed = scratch(groups.where("doc_id is not null").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("_n")), "keyed")
    best = keyed.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("_best"), F.count("*").alias("_k"), F.max("_n").alias("_m"))
    best = scratch(best.where("_k > 1 or _m > 1").select("root", "_best"), "best")
    marked = join_unique(keyed, best, ["root"]).withColumn("_first", F.struct("doc_id", "text_key") == F.col("_best"))
    marked = scratch(marked.where("not _first or _n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_first"), "marked")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    rows = docs.select(row, F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    rest = rows.join(small(marked.select("_id", "_key")), ["_id", "_key"], "left_anti").select("_row")
    repeated = rows.join(small(marked.where("_first").select("_id", "_key")), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select("_row")
    return rest.unionByName(repeated).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
