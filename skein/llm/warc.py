"""WARC archives with an externally merged capture index.

Writing: each page is one WARC/1.1 record in a gzip member of its own.  Of equal payloads of 100 bytes or
more, the record with the smallest page id is the response, the others revisit it (HTTP headers
only).  A task fills archives of bounded size; each comes with its captures sorted by URL key,
time and id: a local run.  An archive is a row of a table in shared storage (name, bytes, run), since
executors share files only through Spark's writers; its bytes are a valid ``.warc.gz`` file.

Index: the runs are cut into key ranges of about ``RANGE_ROWS`` captures by Spark (a range exchange over the whole
key, so one hot URL spans ranges), which hands each range its pieces run by run, sorted outside of memory.  A loser tree
merges up to ``FAN_IN`` pieces at a time, in as many passes as there are pieces for.  Ranges are written and counted, so
``index_pos`` is the gapless rank of a capture over all archives.

Reading: archives are parsed record by record; a response's payload is hashed anew and checked
against its header.  Rows meet the merged index by archive and offset.

Cases: null html is an empty payload; payloads below 100 bytes are always responses; rows that repeat the
response's page id are responses as well; a row without an id is a revisit if a row with an id has its
payload, else a response, and its capture time is the start of the epoch; a null url has an
empty key; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import partitions, rows_of, scratch, small

LEAST_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
#: Captures of a range of the index, about, and pieces of runs that one merge reads.
RANGE_ROWS, FAN_IN = 100_000, 64
#: Pages carry no capture time: theirs is this moment plus their id in seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
END = b"\r\n"


def url_key(url: str | None) -> str:
    """The URL's sort key: host labels reversed, then path and query; no scheme, user, ``www``, default port or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    at = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{at}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def capture_time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 35))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; ``payload`` is left out of a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {capture_time(page_id)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + END + END + block + END + END


def read_records(archive: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each gzip member."""
    at = 0
    while at < len(archive):
        unzip, out, end = zlib.decompressobj(31), [], at
        while not unzip.eof:
            piece = archive[end : end + step]
            if not piece:
                raise ValueError("an archive is cut short")
            out.append(unzip.decompress(piece))
            end += len(piece)
        end -= len(unzip.unused_data)
        head, _, rest = b"".join(out).partition(END + END)
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != END + END:
            raise ValueError("a record does not end where its header says")
        yield at, end - at, headers, rest[:size]
        at = end


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(runs)
        self.losers = [-1] * max(1, self.k)
        winners = [0] * (2 * self.k)
        for i in range(self.k):
            winners[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return self.heads[a] <= self.heads[b]

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


RUN = "array<struct<url_key:string,capture_time:string,id_order:long,offset:long,length:long>>"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data, run): a table in shared storage with all records of ``pages``."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    large = picked.where(F.col("size") >= LEAST_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    told = picked.join(small(scratch(firsts, "firsts")), "digest", "left")
    refers = F.when((F.col("size") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = told.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers_to"))

    def write(batches):
        run_type = pa.list_(pa.struct([("url_key", pa.string()), ("capture_time", pa.string()), ("id_order", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
        task, count, data, run = TaskContext.get().partitionId(), 0, bytearray(), []

        def finish():
            name = f"part-{task:06d}-{count:05d}.warc.gz"
            run.sort()
            keys = [dict(zip(("url_key", "capture_time", "id_order", "offset", "length"), r, strict=True)) for r in run]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bytes(data)], pa.binary()), pa.array([keys], run_type)], names=["archive", "data", "run"])

        for batch in batches:
            for part in rows_of(batch):
                for page_id, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = record(page_id, url, (html or "").encode(), digest, size, refers_to)
                    zip_ = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = zip_.compress(raw) + zip_.flush()
                    run.append((url_key(url), capture_time(page_id), -1 if page_id is None else page_id, len(data), len(member)))
                    data += member
                    if len(data) >= archive_bytes:
                        yield finish()
                        count, data, run = count + 1, bytearray(), []
        if run:
            yield finish()

    return scratch(rows.mapInArrow(write, f"archive string, data binary, run {RUN}"), "archives")


def merged(runs: list[list], fan_in: int = FAN_IN) -> list:
    """One sorted run of all; passes of merges of at most ``fan_in`` runs each, neighbours together."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    return runs[0] if runs else []


def merge_index(archives: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(index_pos, url_key, capture_time, archive, offset, length): all captures; ``index_pos`` counts them from 0 in the global order."""
    captures = archives.select("archive", F.explode("run").alias("r")).select("r.url_key", "r.capture_time", "r.id_order", "archive", "r.offset", "r.length")
    key = ["url_key", "capture_time", "id_order", "archive", "offset"]

    def merge(batches):
        runs: list[list] = []
        last = None
        for batch in batches:
            for url, time, order, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != last:
                    runs.append([])
                    last = archive
                runs[-1].append((url, time, order, archive, offset, length))
        rows = merged(runs)
        part = TaskContext.get().partitionId()
        for at in range(0, len(rows), 10_000):
            few = rows[at : at + 10_000]
            urls, times, _, archives_, offsets, lengths = zip(*few, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = ([part] * len(few), range(at, at + len(few)), urls, times, archives_, offsets, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["range", "pos", "url_key", "capture_time", "archive", "offset", "length"])

    n = archives.agg(F.sum(F.size("run"))).first()[0] or 0
    ranges = captures.repartitionByRange(max(partitions(archives.sparkSession), -(-n // range_rows)), *key).sortWithinPartitions("archive", *key)
    pieces = scratch(ranges.mapInArrow(merge, "range int, pos long, url_key string, capture_time string, archive string, offset long, length long"), "index")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = pieces.groupBy("range").agg(F.count("*").alias("_n")).select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return pieces.join(F.broadcast(starts), "range").select((F.col("_start") + F.col("pos")).alias("index_pos"), "url_key", "capture_time", "archive", "offset", "length")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, parsed from the archives' bytes."""

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for offset, _, headers, block in read_records(batch.column(1)[i].as_py()):
                    http, _, payload = block.partition(END + END)
                    size = int(http.rpartition(b"Content-Length: ")[2].split(END)[0])
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError("a payload does not match its header")
                    page, refers = _page(headers["WARC-Record-ID"]), _page(headers.get("WARC-Refers-To"))
                    rows.append((page, size, digest, kind, refers, name, offset))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
    return archives.select("archive", "data").mapInArrow(read, schema)


def _page(urn: str | None) -> int | None:
    text = (urn or "none>").rpartition(":")[2].removesuffix(">")
    return None if text == "none" else int(text)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives, merge their index, and read all records back through it."""
    written = write_archives(pages, id_col, url_col, html_col)
    return read_archives(written).join(merge_index(written), ["archive", "offset"])


#: DuckDB SQL for the result of :func:`archive` (URLs with a scheme and a host).
ARCHIVE_SQL = r"""
WITH p AS (
  SELECT page_id, lower(url) AS u, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p),
r AS (
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1), '.')), ',')
    || regexp_replace(regexp_extract(u, '^[a-z]+://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)', 1), '^:(80|443)$', '') || ')'
    || coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/') || regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
FROM f)
SELECT *, row_number() OVER (ORDER BY url_key, capture_time, page_id) - 1 AS index_pos FROM r
"""
