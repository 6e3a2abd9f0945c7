"""WARC archives of pages, read back, and their captures in global order by an external index merge.

Archives hold one gzip member per record and about ``archive_bytes`` each; Spark's own writer puts them into any store
it can write to (one row per file: the text writer writes a binary value as it is). Equal payloads are written once: the
record with the largest id is the response, the others are revisits that refer to it. Reading parses an archive per row
and yields a run of captures sorted by URL key, time and id. Runs are stored, cut at common key ranges by one shuffle,
and merged per range by a loser tree; a hot URL key is cut by time and id like any other range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from momentlake.llm.common import durable, shared_folder, slices

ARCHIVE_BYTES = 8 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four characters for each five hexadecimal digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what to write per row. Null html is an empty payload.

    Of rows with equal payloads of at least ``least_bytes`` those with the largest page_id are responses (repeated rows
    all are); the others refer to it. A missing page_id is smaller than any other; where all are missing, or the
    payload is smaller, rows are responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # aggregated before the shuffle; only digests that repeat are joined back
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    out = rows.join(first.select("digest", "first"), "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP headers of its capture, whose length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    when = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:capture:{'none' if page_id is None else page_id}>",
            f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + END + block + END + END


def gz(data: bytes) -> bytes:
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of ``rows`` (see ``captures``) as files in folder ``path``. Of an empty table only the folder is written."""
    def run(batches):
        members, size = [], 0

        def archive():
            # The writer ends each file with the separator, a zero byte: the last of a member under 16 MB, taken off here
            # (an empty member ends so too, and holds no record).
            data = b"".join(members)
            data = data if data[-1:] == b"\0" else data + gz(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["archive"])

        for b in slices(batches, 64):
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page_id, url, payload, digest, refers_to = row
                members.append(gz(record(page_id, url, payload.encode(), digest, refers_to)))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield archive()
                    members, size = [], 0
        if members:
            yield archive()

    packed = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(path)


def members_of(data: bytes):
    """(offset, length, record) of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, out, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(data):
                raise ValueError("archive ends within a record")
            part = view[fed:fed + 65536]
            out.append(unpack.decompress(part))
            fed += len(part)
        end = fed - len(unpack.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and block of a record; checks lengths and, for responses, the payload's digest."""
    head, _, rest = raw.partition(END + END)
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(out["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != END + END:
        raise ValueError("not a record")
    http, _, payload = rest[:size].partition(END + END)
    fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in http.split(END)[1:])}
    out["payload_bytes"], digest = int(fields[b"content-length"]), out["warc-payload-digest"].removeprefix("sha1:")
    if out["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != out["payload_bytes"]):
        raise ValueError("payload and digest differ")
    return out | {"digest": digest, "payload": payload}


def url_key(url: str | None) -> str:
    """Host labels from the right, then port, path and query; '' without a URL."""
    if url is None:
        return ""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{labels}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


RUN = "page_id bigint, url_key string, captured_at timestamp, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint, run bigint"


def id_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:capture:").removesuffix(">")
    return None if number in ("", "none") else int(number)


def order_of(row) -> tuple:
    """URL key, time, id (a missing one first), place."""
    return (row[1], row[2], row[0] is not None, row[0] or 0, row[7], row[8])


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


INDEX = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("captured_at", pa.timestamp("us", "UTC")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.int64())])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive."""
    def run(batches):
        for b in slices(batches, 1):
            name, data = b.column("path").to_pylist()[0], b.column("content").to_pylist()[0]
            name, number, rows = name.rsplit("/", 1)[-1], b.column("run").to_pylist()[0], []
            for at, length, raw in members_of(data):
                if raw:
                    r = parse(raw)
                    when = datetime.fromisoformat(r["warc-date"])
                    rows.append((id_of(r["warc-record-id"]), url_key(r.get("warc-target-uri")), when, r["payload_bytes"], r["digest"], r["warc-type"],
                                 id_of(r.get("warc-refers-to")), name, at, length, number))
            yield batch_of(sorted(rows, key=order_of), INDEX)

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.xxhash64("path").alias("run"))
    return files.mapInArrow(run, RUN)


class LoserTree:
    """k-way merge of sorted lists: each step replays one leaf's matches on the way to the root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _head(self, i):
        """Sorts an exhausted run after all others."""
        done = i >= len(self.runs) or self.at[i] >= len(self.runs[i])
        return (1,) if done else (0, self.key(self.runs[i][self.at[i]]), i)

    def _replay(self, i):
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # first to come here while the tree is built: waits for its opponent
                self.losers[node] = i
                return
            if self.head[other] < self.head[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.head[w := self.losers[0]] != (1,):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self._head(w)
            self._replay(w)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order: ``order_range`` (ranges rise with the keys) and ``order_pos`` (place in the range)."""
    def run(batches):
        by: dict[int, list] = {}
        part = -1
        for b in batches:
            for row in zip(*(b.column(f.name).to_pylist() for f in INDEX), strict=True):
                by.setdefault(row[10], []).append(row)
            if b.num_rows:
                part = b.column("part")[0].as_py()
        for rows in by.values():  # a run's rows arrive in any order of blocks, each block sorted: nearly sorted input
            rows.sort(key=order_of)
        out, pos = [], 0
        schema = INDEX.append(pa.field("order_range", pa.int32())).append(pa.field("order_pos", pa.int64()))
        for row in LoserTree(list(by.values()), order_of):
            out.append((*row, part, pos))
            pos += 1
            if len(out) == 8192:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    n = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(n, "url_key", "captured_at", F.col("page_id").asc_nulls_first(), "archive", "offset")
    return dealt.withColumn("part", F.spark_partition_id()).mapInArrow(run, RUN + ", order_range int, order_pos bigint").drop("run")


def archive_and_read(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, html; null html is empty) and returns their captures as read back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and url_key, captured_at, archive, offset, length,
    order_range, order_pos. Repeated rows are records each; a null page_id stays null; other columns are not read."""
    path = path or shared_folder(pages.sparkSession)
    write_archives(captures(pages), path, archive_bytes)
    spark = pages.sparkSession
    return merge_runs(durable(read_runs(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "offset", "length", "order_range", "order_pos")
