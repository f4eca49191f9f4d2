"""WARC archives with revisit records, and capture histories from an external merge of sorted index runs.

Writers cut their partition into gzip archives of bounded size and emit one locally sorted index run each. The
archives are read back, their entries are dealt by range of (URL key, timestamp, page), and each range merges its
slices of the runs with a loser tree, each slice a stream that lies in a temporary file beyond a few MB, so the ranges
laid end to end are the globally ordered histories.

Defined results: a null html is an empty payload; a null url has the URL key ''; null page ids stay null and are never
referred to (a payload that only has null ids is a response each time); repeated rows with the smallest page id of
their payload are all responses; an empty table gives no record; columns beyond those named are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import tempfile
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load

ARCHIVE_BYTES, READ_BYTES, SPOOL = 16 << 20, 64 << 20, 16 << 20
ENTRY = "run string, url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, pos long, size long"
_PA = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("file", pa.string()), ("pos", pa.int64()), ("size", pa.int64())])


def url_key(url: str | None) -> str:
    """Sortable key: reversed host labels, then path and query, lower case, without scheme, fragment, www. and port."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


def _header_text(x: str) -> str:
    return x.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _plain_text(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"r": "\r", "n": "\n"}.get(m[1], m[1]), x)


def record(page_id, url, ts, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {ts}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse(data: bytes):
    """(pos, size, header dict, payload) for each record of an archive; headers end at the first empty line."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:at + (1 << 20)])
        end = at + (1 << 20)
        while not z.eof:
            raw += z.decompress(data[end:end + (4 << 20)])
            end += 4 << 20
        size = min(end, len(data)) - at - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, size, fields, rest[: int(fields["Content-Length"])]
        at += size


class LoserTree:
    """k-way merge of sorted iterators: inner nodes hold the losers of their matches, so each output replays one path of log k matches."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k  # tree[0] is the winner
        for i in range(len(runs)):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted run loses to all others; ties go to the earlier run."""
        p, q = self.head[a], self.head[b]
        if p is None or q is None:
            return p is not None or (q is None and a < b)
        return p < q or (p == q and a < b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        if not self.runs:
            return
        while (row := self.head[w := self.tree[0]]) is not None:
            yield row
            self.head[w] = next(self.runs[w], None)
            self._replay(w)


def _writer(root: str):
    def write(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        # an attempt's own names: only files of committed attempts are named in the index
        run = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        entries, out, pos, n, name = [], None, 0, 0, None
        for batch in batches:
            for page_id, url, ts, html, digest_hex, first in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
                refers_to = None if first is None or page_id is None or page_id == first else first
                if page_id is None and first is not None:
                    refers_to = first
                data = record(page_id, url, ts, payload, digest, refers_to)
                if out is None or pos + len(data) > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, n, pos = f"{run}-{n:05d}.warc.gz", n + 1, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                entries.append((url_key(url), ts, page_id, name, pos, len(data)))
                pos += len(data)
        if out is not None:
            out.close()
        entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]))
        for i in range(0, len(entries), 4096):
            cols = list(zip(*entries[i:i + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(cols[0])), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=["run", "url_key", "ts", "page_id", "file", "pos", "size"])

    return write


def _reader(root: str):
    def page(x: str | None):
        digits = (x or "")[len("<urn:page:"):-1]
        return int(digits) if digits else None

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                rows = []
                for pos, size, h, body in parse(data):
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"{name}: payload at {pos} doesn't have its digest")
                    url = _plain_text(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None
                    rows.append((name, url_key(url), h["WARC-Date"], page(h["WARC-Record-ID"]), url, kind, page(h.get("WARC-Refers-To")), digest, len(body) if kind == "response" else int(h["X-Payload-Length"]), name, pos, size))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_pylist([dict(zip(_PA.names, r)) for r in rows], schema=_PA)

    return read


def _order(r: tuple):
    """url_key, ts, page_id (null first), then place."""
    return (r[1], r[2], r[3] is not None, r[3] or 0, r[9], r[10])


def _slices(batches):
    """(run, its batches) from rows sorted by run and then in order; over SPOOL bytes a slice lies in a nameless temporary file."""
    run, kept = None, []

    def spooled():
        if sum(b.nbytes for b in kept) < SPOOL:
            return kept
        f = tempfile.TemporaryFile()
        with pa.ipc.new_file(f, _PA) as out:
            for b in kept:
                out.write_batch(b)
        f.seek(0)
        return pa.ipc.open_file(pa.PythonFile(f, "r"))

    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_PA)
        names = batch.column(0).to_pylist()
        at = 0
        while at < len(names):
            end = bisect.bisect_right(names, names[at], at)
            if names[at] != run and kept:
                yield run, spooled()
                kept = []
            run = names[at]
            kept.append(batch.slice(at, end - at))
            at = end
    if kept:
        yield run, spooled()


def _streamed(held):
    """(order, row) of a slice, a thousand rows at a time."""
    for batch in held if isinstance(held, list) else (held.get_batch(k) for k in range(held.num_record_batches)):
        for at in range(0, batch.num_rows, 1024):
            for r in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                yield _order(r), r


def _merger(batches):
    out = []
    for _, r in LoserTree([_streamed(held) for _, held in _slices(batches)]):
        out.append(r)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PA)], schema=_PA)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PA)], schema=_PA)


def archive(spark: SparkSession, pages: DataFrame, scratch: Scratch, *, ts_col: str | None = None) -> DataFrame:
    """Write the archives under scratch/warc; returns the committed index (run, url_key, ts, page_id, file, pos, size).

    ts_col names a capture time column; without one the capture time is the page id in seconds since 1970.
    """
    ts = F.col(ts_col) if ts_col else F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))
    base = pages.select(F.col("page_id").cast("long"), "url", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"))
    firsts = scratch.table(base.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id"), "firsts")
    rows = base.join(firsts, "digest", "left").select("page_id", "url", "ts", "html", "digest", "first_id")
    index = rows.mapInArrow(_writer(scratch.path("warc")), "run string, url_key string, ts string, page_id long, file string, pos long, size long")
    return scratch.table(index, "index")


def histories(spark: SparkSession, scratch: Scratch, index: DataFrame) -> DataFrame:
    """Read the committed archives and merge their runs; one row per record, ordered by (url_key, ts, page_id)."""
    files = index.groupBy("file").agg(F.max(F.col("pos") + F.col("size")).alias("bytes"))
    n, size = files.agg(F.count("*"), F.sum("bytes")).first()
    # as many readers as the session runs tasks, more where archives are over READ_BYTES together; none gets a table of names alone
    readers = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // READ_BYTES))))
    read = files.repartition(readers, "file").select("file").mapInArrow(_reader(scratch.path("warc")), ENTRY)
    runs = scratch.table(read, "runs")
    order = [F.col("url_key"), F.col("ts"), F.col("page_id"), F.col("file"), F.col("pos")]
    return runs.repartitionByRange(*order).sortWithinPartitions("run", *order).mapInArrow(_merger, ENTRY)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    index = archive(spark, load(spark, sf_dir, "pages"), scratch)
    return histories(spark, scratch, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


OP9_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^https?://([^/?#]*)', 1), ':[0-9]*$', ''), '^www[0-9]*[.]', ''), '.')), ',') || ')'
    || coalesce(nullif(regexp_extract(lower(trim(url)), '^https?://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(lower(trim(url)), '^https?://[^/?#]*[^?#]*([?][^#]+)', 1) AS url_key,
  strftime(to_timestamp(page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM b
"""
