"""Page archives (WARC 1.0, one gzip member a record) as a Spark data source: planned partitions, filters by host, a committing writer.

``spark.read.format("warc").load(folder)`` gives (page_id, url, host, status, content_type, html). Each shard has an index beside it: the host, place and length
of every record. A commit is one small file that lists its shards with their rows, bytes and hosts; only what a commit lists is read, so tasks that failed,
or ran twice, leave nothing visible. Partitions are ranges of records of about ``splitBytes`` compressed bytes; filters on host (=, IN) are
taken over by the source: shards without the hosts are left out when partitions are planned, and of the others only the members of those hosts
are read. Folders without commits are read as other tools write them: every ``.warc.gz`` from start to end, response records only.

The driver holds a line a shard, with at most ``HOSTS`` hosts each; records pass through tasks one by one. Files are reached through pyarrow's
file systems, so a folder may lie in any store that they know.

Defined results: a null url, html or status comes back null; line ends within a url are written percent-encoded; bytes of a page that are not UTF-8
are replaced when read; an empty table makes a commit without shards, which reads as an empty table; overwriting replaces the commits, then deletes what they listed.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom.session import ship

SCHEMA = "page_id long, url string, host string, status int, content_type string, html string"
HOSTS = 1000
SPLIT_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
INDEX = pa.schema([("host", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


# --- records ------------------------------------------------------------------------------------------------


def packed(page_id, url, status, content_type, html) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.0", "WARC-Type: response" if html is not None else "WARC-Type: metadata", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = ["HTTP/1.1" + (f" {status}" if status is not None else "")]
    if content_type is not None:
        http.append("Content-Type: " + " ".join(content_type.split("\n")))
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + (html or "").encode("utf-8", "replace")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n", 6, mtime=0)


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value[1:] if value.startswith(" ") else value)
    return out


def record(f: io.BufferedIOBase) -> dict | None:
    """The next record of an opened stream: its columns, {} for those that are no page; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    lines = []
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line.rstrip(b"\r\n"))
    head = headers(lines)
    block = f.read(int(head.get("content-length") or 0))
    kind = head.get("warc-type")
    if kind != "response" and not (kind == "metadata" and "x-page-id" in head):
        return {}
    top, _, body = block.partition(b"\r\n\r\n")
    first, *rest = top.split(b"\r\n")
    status, http = first.split(b" ")[1:2], headers(rest)
    url, given = head.get("warc-target-uri"), head.get("x-page-id")
    if url is not None:
        url = url.removeprefix("<").removesuffix(">")
    return {
        "page_id": int(given) if given is not None else None if "warc-record-id" not in head else zlib.crc32(head["warc-record-id"].encode()),
        "url": url, "host": host_of(url), "status": int(status[0]) if status and status[0].isdigit() else None, "content_type": http.get("content-type"), "html": body.decode("utf-8", "replace") if kind == "response" else None,
    }


# --- reading ------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """Records of a shard: from start on, stop of them (all where the shard has no index)."""

    path: str
    start: int
    stop: int
    indexed: bool


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split, self.hosts = options["path"], int(options.get("splitbytes", SPLIT_BYTES)), None
        self.fields = pa.schema([(f.name, {"long": pa.int64(), "integer": pa.int32()}.get(f.dataType.typeName(), pa.string())) for f in schema.fields])

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("host",) else set(f.value) if isinstance(f, In) and f.attribute == ("host",) else None
            if wanted is None:
                yield f
            else:
                self.hosts = wanted if self.hosts is None else self.hosts & wanted

    def partitions(self):
        fs, root = opened(self.path)
        files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        commits = sorted(i.path for i in files if re.fullmatch(r"_commit-.*\.json", i.base_name))
        if not commits:
            return [Range(i.path, 0, -1, False) for i in sorted(files, key=lambda i: i.path) if i.base_name.endswith(".warc.gz")] or [Range("", 0, 0, True)]
        out = []
        for c in commits:
            with fs.open_input_stream(c) as f:
                for s in json.loads(f.read())["shards"]:
                    if self.hosts is None or s["hosts"] is None or self.hosts & set(s["hosts"]):
                        step = max(1, round(s["rows"] * min(1.0, self.split / max(1, s["bytes"]))))
                        out += [Range(f"{root}/{s['name']}", k, min(k + step, s["rows"]), True) for k in range(0, s["rows"], step)]
        return out or [Range("", 0, 0, True)]

    def found(self, p: Range) -> Iterator[dict]:
        if not p.path:
            return
        fs, _ = opened(self.path)
        if not p.indexed:
            with fs.open_input_stream(p.path, compression=None) as raw, gzip.open(raw) as f:
                while (r := record(f)) is not None:
                    if r and (self.hosts is None or r["host"] in self.hosts):
                        yield r
            return
        with fs.open_input_file(p.path + ".idx") as f:
            index = pa.ipc.open_file(f).read_all().slice(p.start, p.stop - p.start)
        with fs.open_input_file(p.path) as f:
            for host, offset, length in zip(*(c.to_pylist() for c in index.columns), strict=True):
                if self.hosts is None or host in self.hosts:
                    yield record(io.BytesIO(gzip.decompress(f.read_at(length, offset))))

    def read(self, partition):
        rows, size = [], 0
        for r in self.found(partition):
            rows.append(r)
            size += len(r["html"] or "")
            if size > BATCH_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=self.fields)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.fields)


# --- writing ------------------------------------------------------------------------------------------------


@dataclass
class Shards(WriterCommitMessage):
    shards: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.most = options["path"], overwrite, int(options.get("shardbytes", SHARD_BYTES))

    def write(self, iterator):
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        done: list[dict] = []
        out, name, index, at = None, "", [], 0

        def close():
            nonlocal out
            out.close()
            out = None
            with fs.open_output_stream(f"{root}/{name}.idx") as f, pa.ipc.new_file(f, INDEX) as w:
                w.write_table(pa.Table.from_pylist(index, schema=INDEX))
            hosts = sorted({i["host"] for i in index})
            done.append({"name": name, "rows": len(index), "bytes": at, "hosts": hosts if len(hosts) <= HOSTS else None})

        try:
            for b in iterator:
                names = b.schema.names
                columns = [b.column(c).to_pylist() if c in names else [d] * b.num_rows for c, d in (("page_id", None), ("url", None), ("status", 200), ("content_type", "text/html; charset=utf-8"), ("html", None))]
                for row in zip(*columns, strict=True):
                    if out is None:
                        name, index, at = f"{uuid.uuid4().hex}.warc.gz", [], 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = packed(*row)
                    out.write(member)
                    index.append({"host": host_of(row[1]), "offset": at, "length": len(member)})
                    at += len(member)
                    if at >= self.most:
                        close()
            if out is not None:
                close()
        except BaseException:
            # what this attempt wrote is in no commit; it is deleted where it can be
            if out is not None:
                out.close()
            _delete(fs, root, [name, *(d["name"] for d in done)])
            raise
        return Shards(done)

    def commit(self, messages):
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"_commit-.*\.json", i.base_name)] if self.overwrite else []
        shards = [s for m in messages if m is not None for s in m.shards]
        with fs.open_output_stream(f"{root}/_commit-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"shards": shards}).encode())
        for c in old:
            with fs.open_input_stream(c) as f:
                gone = [s["name"] for s in json.loads(f.read())["shards"]]
            fs.delete_file(c)
            _delete(fs, root, gone)

    def abort(self, messages):
        fs, root = opened(self.path)
        _delete(fs, root, [s["name"] for m in messages if m is not None for s in m.shards])


def _delete(fs: pafs.FileSystem, root: str, names: list[str]) -> None:
    for n in names:
        for path in (f"{root}/{n}", f"{root}/{n}.idx"):
            if n and fs.get_file_info(path).type == pafs.FileType.File:
                fs.delete_file(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema, overwrite):
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters handed to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(pages: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Pages (page_id, url, html[, status, content_type]) as an archive."""
    register(pages.sparkSession)
    pages.write.format("warc").options(**options).mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


# --- request logs -------------------------------------------------------------------------------------------

HAR = """log struct<version: string, pages: array<struct<id: string, title: string>>, entries: array<struct<pageref: string, startedDateTime: string, request: struct<method: string, url: string, headers: array<struct<name: string, value: string>>, postData: struct<mimeType: string, text: string>>,
    response: struct<status: int, content: struct<mimeType: string, text: string>>>>>"""


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, target, seq, method, url, accept, content_type, body, status, answer) of HTTP archives (HAR 1.2), a document a line or a file: requests in their order, with
    what was answered. Native: JSON read by a fixed schema, header names ignoring case, the first of a name."""
    header = lambda name: f"try_element_at(transform(filter(e.request.headers, h -> lower(h.name) = '{name}'), h -> h.value), 1)"
    lines = spark.read.schema(HAR).option("multiLine", "false").json(path).where("log IS NOT NULL")
    pages = "map_from_arrays(transform(log.pages, p -> p.id), transform(log.pages, p -> p.title))"
    rows = lines.selectExpr(f"{pages} AS titles", "posexplode(log.entries) AS (seq, e)")
    return rows.selectExpr(
        "try_cast(e.pageref AS BIGINT) AS page_id", "try_element_at(titles, e.pageref) AS target", "CAST(seq AS BIGINT) AS seq", "e.request.method", "e.request.url", f"{header('accept')} AS accept", f"coalesce({header('content-type')}, e.request.postData.mimeType) AS content_type",
        "e.request.postData.text AS body", "e.response.status", "e.response.content.text AS answer",
    )


def write_har(requests: DataFrame, path: str, part: int = 10_000) -> None:
    """Requests (page_id, target, seq, method, url, accept, content_type, status, answer) as HTTP archives, a document a line; a page of more than ``part`` requests
    gets several, so no page is gathered in one task."""
    header = "filter(array(named_struct('name', 'Accept', 'value', accept), named_struct('name', 'Content-Type', 'value', content_type)), h -> h.value IS NOT NULL)"
    request = f"named_struct('method', method, 'url', url, 'headers', {header})"
    entry = f"named_struct('pageref', CAST(page_id AS STRING), 'request', {request}, 'response', named_struct('status', status, 'content', named_struct('text', answer)))"
    rows = requests.selectExpr("page_id", "target", f"CAST(floor(seq / {part}) AS BIGINT) AS part", f"named_struct('seq', seq, 'e', {entry}) AS x")
    docs = rows.groupBy("page_id", "target", "part").agg({"x": "collect_list"}).withColumnRenamed("collect_list(x)", "xs")
    log = "named_struct('version', '1.2', 'pages', array(named_struct('id', CAST(page_id AS STRING), 'title', target)), 'entries', transform(array_sort(xs), x -> x.e))"
    docs.selectExpr(f"to_json(named_struct('log', {log})) AS value").write.mode("overwrite").text(path)
