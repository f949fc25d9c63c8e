"""Near-duplicates by the Jaccard similarity of word-shingle sets: a byte-position index with count filtering, then whole sets.

The bits of a SimHash only estimate a similarity coarsely, so here a fingerprint's ``POSITIONS`` bytes are min-wise: byte i is
taken from the shingle that is smallest under the i-th hash, so two sets of similarity s share a positional byte with
probability s.  Postings hold ``WIDTH`` bytes with their positions; ``TABLES`` disjoint groups of positions make a pair of
similarity 0.8 share no posting once in 200,000 cases, of 0.85 once in 10^8.  The shared positional bytes of a pair are
tallied; below ``least_bytes`` (four standard deviations under the mean, one pair of 0.8 in 30,000) it goes.  The rest are verified on the whole sets,
so no link is false.

Equal sets are one node.  Nodes are ordered by how many others they meet in postings, as the text that others were
made from meets most.  A posting first hands on the pairs with its first node, then those of its first
node that is not yet linked to that one.  Last, every posting whose nodes are still apart gets their whole sets, compares them in place and hands on
a spanning forest of its true pairs: fewer links than nodes, however many pairs are nearly similar enough.  No link that the index knows is lost.  In a
large posting, pairs that cannot be similar by an exact bound (``likely``) are not even looked at.  Keys have 48 bits beside their table, so postings do not grow with
the corpus; texts are not shuffled, only sets of nodes that share a posting with another are sent to be compared.

Cases: all texts without words have the same empty set; a text with fewer words than a shingle is one shingle; null ids
take no part in the smallest id of their group (all null: null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_rows, drop_scratch, join_unique, partitions, rows_of, scratch, small, text_key
from skein.llm.components import components

SEED = 42
#: Bytes of a posting's key, disjoint groups of positions, bytes of a fingerprint.
WIDTH, TABLES = 6, 40
POSITIONS = WIDTH * TABLES
#: Pairs that are held at once, and shingles that are hashed at once.
PAIRS, CHUNK = 1 << 15, 1 << 12
#: Pairs whose whole sets go to Python at once; a hub's set stands in each of its pairs.
COMPARED = 64
#: Nodes of a posting up to which all its pairs are looked at, and postings' rows with a shingle up to which it is rare there.
FEW, RARE = 64, 8
#: Bytes of sets that a task holds, and that one posting may have; the pairs of a larger one are compared outside of it.
HELD, HEAVY = 8 << 20, 64 << 20
PRIMES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(PRIMES[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(PRIMES[2])
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; words as for SimHash, hashed once each and mixed in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = _mixed(out * np.uint64(PRIMES[0]) + h[j : j + n])
    return np.unique(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets without repeats; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """A number to add and an odd one to multiply by for each position, from a mixing rule."""
    with np.errstate(over="ignore"):
        z = _mixed(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(PRIMES[0]))
    return z[:POSITIONS, None], z[POSITIONS:, None] | np.uint64(1)


ADD, TIMES = _hashes()


def fingerprint(h: np.ndarray) -> bytes:
    """The positional bytes of a set of shingles; zeros for the empty set."""
    least = np.full(POSITIONS, np.uint64(2**64 - 1))
    for at in range(0, len(h), CHUNK):
        with np.errstate(over="ignore"):
            least = np.minimum(least, ((h[None, at : at + CHUNK] ^ ADD) * TIMES).min(axis=1))
    return (least >> np.uint64(8)).astype(np.uint8).tobytes() if len(h) else bytes(POSITIONS)


def least_bytes(similarity: float) -> int:
    """Shared positional bytes that a pair must have: the mean at this similarity less four standard deviations."""
    return int(POSITIONS * similarity - 4 * (POSITIONS * similarity * (1 - similarity)) ** 0.5)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def prints(text: Column, shingle: int) -> Column:
    """Struct of a digest of the text's set and the set's fingerprint."""

    @F.arrow_udf(T.StructType([T.StructField("node", T.BinaryType()), T.StructField("print", T.BinaryType())]))
    def of(batch: pa.Array) -> pa.Array:
        found = [(_digest(h), fingerprint(h)) for h in (shingles(t.as_py(), shingle) for t in batch)]  # one set at a time
        return pa.StructArray.from_arrays([pa.array((f[k] for f in found), pa.binary()) for k in (0, 1)], names=["node", "print"])

    return of(text)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each of ``nodes`` (node, print) and group of positions; the key is the group and its bytes."""

    def of(batches):
        table = np.arange(TABLES, dtype=np.uint64) << np.uint64(8 * WIDTH)
        for batch in batches:
            if batch.num_rows:
                bytes_ = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, TABLES, WIDTH)
                key = np.zeros((batch.num_rows, 8, TABLES), np.uint8)
                key[:, :WIDTH] = bytes_.transpose(0, 2, 1)
                keys = np.ascontiguousarray(key.transpose(0, 2, 1)).view(np.uint64)[:, :, 0] | table
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), TABLES)))], names=["key", "node"])

    return nodes.select("node", "print").mapInArrow(of, "key long, node binary")


def candidates(index: DataFrame, centre: str) -> DataFrame:
    """(u, v), u before v, each once: pairs of a posting whose ``root`` differs, with its first node ("first") or with the first that is apart from that ("second")."""

    def first_of(key, some):
        """For each row the place of its posting's first row of ``some``; the row itself if there is none."""
        at = np.arange(len(key))
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.minimum.reduceat(np.where(some, at, len(key)), head)
        place = np.repeat(place, np.diff(np.append(head, len(key))))
        return np.where(place < len(key), place, at)

    def emit(t: pa.Table):
        node, key = t.column("node").combine_chunks(), np.ascontiguousarray(t.column("key").to_numpy())
        root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)[1]
        first = first_of(key, np.ones(len(key), bool))
        if centre == "second":
            first = first_of(key, root != root[first])
        at = np.arange(len(key))
        i, j = np.minimum(first, at), np.maximum(first, at)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            ok = root[a] != root[b]
            if ok.any():
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a[ok])), node.take(pa.array(b[ok]))], names=["u", "v"])

    def scan(batches):
        kept = None
        for now in batches:
            now = pa.Table.from_batches([now])
            kept = now if kept is None else pa.concat_tables([kept, now])
            key = kept.column("key")
            if kept.num_rows < 1 << 16 or key[0] == key[-1]:
                continue
            done = int(np.searchsorted(key.to_numpy(), key[-1].as_py()))
            yield from emit(kept.slice(0, done))
            kept = kept.slice(done)
        if kept is not None and kept.num_rows:
            yield from emit(kept)

    return _dealt(index).select("key", "node", "root").mapInArrow(scan, "u binary, v binary").distinct()


def _dealt(index: DataFrame) -> DataFrame:
    """Whole postings side by side, their nodes in order."""
    return index.repartition(partitions(index.sparkSession), "key").sortWithinPartitions("key", F.desc("degree"), "node")


def every_pair(n: int):
    """(i, j) in arrays of bounded length: each pair of ``n`` rows once."""
    for i in range(n - 1):
        for at in range(i + 1, n, PAIRS):
            j = np.arange(at, min(n, at + PAIRS))
            yield np.full(len(j), i), j


def likely(sets: list[np.ndarray], similarity: float):
    """(i, j), i before j, in arrays of bounded length, some repeated: all pairs of ``sets`` that may have the similarity.

    Exact: a pair either shares a shingle that at most ``RARE`` of the sets hold, and is found by that, or shares only
    others.  Then it shares at most as many as either set has of those, c, and must have sizes a, b with
    (1 + similarity) c >= similarity (a + b): each set reaches up to a size, and sizes are sorted.
    Copies of one text with edits of their own mostly reach no other, so their number of pairs grows as they do.
    """
    size = np.array([len(h) for h in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, shingle, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = held[shingle]
    rare = np.flatnonzero((held > 1) & (held <= RARE))
    rare = rare[np.argsort(shingle[rare], kind="stable")]
    for at in range(0, len(rare), PAIRS):
        found = []
        for step in range(1, RARE):
            a = rare[at : at + PAIRS]
            b = rare[at + step : at + step + PAIRS]
            a = a[: len(b)]
            same = shingle[a] == shingle[b]
            found.append(row[a[same]] * len(sets) + row[b[same]])  # rows ascend within a shingle
        found = np.unique(np.concatenate(found))
        yield found // len(sets), found % len(sets)
    common = np.bincount(row, held > RARE, len(sets))
    reach = (1 + similarity) / similarity * common - size + 1e-6
    order = np.argsort(size, kind="stable")
    size, reach = size[order], reach[order]
    for at in np.flatnonzero(reach >= size):
        for start in range(at + 1, int(np.searchsorted(size, reach[at], "right")), PAIRS):
            other = np.arange(start, min(start + PAIRS, int(np.searchsorted(size, reach[at], "right"))))
            other = order[other[reach[other] >= size[at]]]
            yield np.minimum(order[at], other), np.maximum(order[at], other)


def forest(key: int, root: np.ndarray, prints: np.ndarray, sets: list[np.ndarray] | None, similarity: float):
    """(i, j): of the rows of one posting links between ``root``s that connect what true pairs connect, fewer than rows.

    A pair counts in the first posting that it shares only.  Without ``sets``: all pairs with shared bytes enough, unverified.
    """
    least, table = least_bytes(similarity), key >> 8 * WIDTH
    root = root.copy()
    few = sets is None or len(root) <= FEW
    looks = iter([np.triu_indices(len(root), 1)]) if len(root) <= FEW else every_pair(len(root)) if few else likely(sets, similarity)
    for i, j in looks:
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        for at in range(0, len(i), CHUNK):
            a, b = i[at : at + CHUNK], j[at : at + CHUNK]
            same = prints[a] == prints[b]
            ok = (same.sum(axis=1, dtype=np.int32) >= least) & (same.reshape(-1, TABLES, WIDTH).all(axis=2).argmax(axis=1) == table)
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                if sets is None:
                    yield x, y
                elif root[x] != root[y] and jaccard(sets[x], sets[y]) >= similarity:
                    root[root == root[y]] = root[x]
                    yield x, y


def apart(index: DataFrame, similarity: float) -> DataFrame:
    """(u, v, sure) from postings with the columns ``print`` and ``set``: their links by ``forest``; not sure (unverified) from those with over ``HEAVY`` bytes of sets."""

    def emit(t: pa.Table):
        t = t.combine_chunks()
        key, node = t.column("key").to_numpy(), t.column("node").combine_chunks()
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        us, vs, sure = [], [], []
        for start, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            some = t.slice(start, end - start)
            root = np.unique(np.array(some.column("root").to_pylist(), object), return_inverse=True)[1]
            prints = np.frombuffer(b"".join(some.column("print").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            light = some.column("set").null_count == 0
            sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in some.column("set")] if light else None
            for i, j in forest(int(key[start]), root, prints, sets, similarity):
                us.append(start + i)
                vs.append(start + j)
                sure.append(light)
                if len(us) == PAIRS:
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(us)), node.take(pa.array(vs)), pa.array(sure)], names=["u", "v", "sure"])
                    us, vs, sure = [], [], []
        if us:
            yield pa.RecordBatch.from_arrays([node.take(pa.array(us)), node.take(pa.array(vs)), pa.array(sure)], names=["u", "v", "sure"])

    def bare(t: pa.Table) -> pa.Table:
        return t.set_column(t.schema.get_field_index("set"), "set", pa.nulls(t.num_rows, pa.binary()))

    def scan(batches):
        parts, held = [], 0
        for now in batches:
            if now.num_rows == 0:
                continue
            parts.append(pa.Table.from_batches([now]))
            held += now.nbytes
            first, last = parts[0].column("key")[0].as_py(), parts[-1].column("key")[-1].as_py()
            if held >= HELD and first != last:
                t = pa.concat_tables(parts)
                done = int(np.searchsorted(t.column("key").to_numpy(), last))
                yield from emit(t.slice(0, done))
                parts = [t.slice(done)]
                held = parts[0].nbytes
            elif held >= HEAVY and first == last:
                parts = [bare(part) for part in parts]
                held = sum(part.nbytes for part in parts)
        if parts:
            yield from emit(pa.concat_tables(parts))

    return _dealt(index).select("key", "node", "root", "print", "set").mapInArrow(scan, "u binary, v binary, sure boolean")


def sets_of(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, set): the whole sets of the written table ``nodes``, one pass over the texts."""

    def of(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in rows_of(batch):
                out = {}
                for text in part.column(0).to_pylist():
                    h = shingles(text, shingle)
                    if (d := _digest(h)) not in seen:
                        seen.add(d)
                        out[d] = h.tobytes()
                if len(seen) > 1 << 18:
                    seen.clear()  # only saves repeats within a task
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], names=["node", "set"])

    every = docs.select(F.col(text_col).alias("text")).mapInArrow(of, "node binary, set binary")
    return scratch(every.join(small(nodes), "node", "left_semi").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, tallied: bool = False) -> DataFrame:
    """The rows of ``pairs`` (u, v) that share enough positional bytes and whose whole sets have the similarity."""
    least = least_bytes(similarity)

    def tally(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, POSITIONS) for c in batch.columns[2:])
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    def check(batches):
        for batch in batches:
            for part in rows_of(batch):
                ok = [jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def both(df: DataFrame, table: DataFrame, what: str, keep) -> DataFrame:
        of = lambda c: table.select(F.col("node").alias(c), F.col(what).alias(f"{c}_{what}"))
        return df.join(of("u"), "u").join(of("v"), "v").select("u", "v", f"u_{what}", f"v_{what}").mapInArrow(keep, "u binary, v binary")

    near = scratch(pairs if tallied else both(pairs, nodes, "print", tally), "tallied")
    with arrow_rows(pairs.sparkSession, COMPARED):
        return scratch(both(near, sets, "set", check), "verified")


def links(docs: DataFrame, nodes: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(u, v): true pairs of the written table ``nodes`` (node, print) that connect all that any true pair connects."""
    counts = scratch(postings(nodes).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = scratch(postings(nodes).join(small(counts), "key"), "met")
    degrees = scratch(met.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    index = scratch(met.join(small(degrees), "node").select("key", "node", "degree"), "postings")
    drop_scratch(met)
    sets = sets_of(docs, degrees.select("node"), text_col, shingle)
    known, rooted = None, index.withColumn("root", F.col("node"))
    for centre in ("first", "second"):
        found = verified(candidates(rooted, centre), nodes, sets, similarity)
        known = found if known is None else known.unionByName(found)
        roots = scratch(components(known), "roots")
        rooted = index.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # only postings that still have nodes apart
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rooted = rooted.join(small(scratch(mixed, "apart")), "key", "left_semi").join(nodes.select("node", "print"), "node").join(sets, "node")
    with arrow_rows(docs.sparkSession, 2 * COMPARED):
        found = scratch(apart(rooted, similarity), "forests")
    known = known.unionByName(found.where("sure").select("u", "v"))
    unsure = found.where("not sure").select("u", "v")
    if not unsure.isEmpty():
        known = known.unionByName(verified(unsure, nodes, sets, similarity, tallied=True))
    drop_scratch(index)
    drop_scratch(sets)
    return known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, component_id, text_key, root and the columns ``keep`` of ``docs``) per row.

    Pairs of at least the ``similarity`` are linked; ``root`` names the component, ``component_id`` is its smallest id
    and ``text_key`` a digest of the row's text.
    """
    printed = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), prints(F.col(text_col), shingle).alias("_p"), *keep)
    named = scratch(printed.select("doc_id", "text_key", "_p.node", "_p.print", *keep), "named")
    nodes = scratch(named.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("print").alias("print")), "nodes")
    found = scratch(components(links(docs, nodes, text_col, shingle, similarity)), "roots")
    linked = scratch(found.join(nodes.select("node", "first_id"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = join_unique(linked, least, ["root"]).select("node", "root", "component_id")
    label = nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return join_unique(named, scratch(label, "labels"), ["node"]).select("doc_id", "component_id", "text_key", "root", *keep)
