"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture that :func:`write_captures` writes is a request, a response (or a revisit of an earlier response with
the same payload) and a metadata record; the latter two name the request in ``WARC-Concurrent-To``. Every attempt
of a task writes its own gzip archives below a shared folder, and a manifest lists those of the attempts that
count, so repeated tasks leave nothing that is read twice. :func:`read_records` streams archives of any origin,
compressed by record, as a whole or not at all; what is damaged or cut off gives a row with its place and the
error, and reading goes on behind it. :func:`assemble` joins the records of each transaction to one nested
row, whichever of them names the others.

Null payloads are empty. Rows that repeat both identifier and payload of the largest identifier are all
responses; rows without an identifier revisit the largest one with their payload, or are all responses if there is
none. A null url leaves out ``WARC-Target-URI`` and comes back null. Payloads may be as long as a string: a task
holds one record at a time. Columns other than the three named ones are ignored, whatever they are called. An empty
table writes no archive and reads back as no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from constella.llm import _store

#: Compressed bytes at which a writer begins another archive, that a reader's task takes on, and that it reads at once.
ARCHIVE_BYTES, TASK_BYTES, CHUNK = 16 << 20, 32 << 20, 1 << 18
#: Bytes that are unpacked at once.
UNPACKED = 1 << 20
#: Bytes of a record's header at most; what goes on beyond is an error.
HEADER_BYTES = 1 << 20
CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, offset long, position long, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, digest string, profile string, fields map<string,string>, payload_bytes long, computed_digest string, payload binary, error string"
RESPONSES = ("response", "revisit", "resource")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head if v is not None) + CRLF).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31, 9 if len(raw) > 4096 else 6)
    return packer.compress(raw) + packer.flush()


def _capture(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str, place: tuple, level: int) -> bytes:
    # A line break in a url would end the header line.
    uri = url and url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    request, response = _urn("request", *place), _urn("response", page_id, digest)
    out = _record("request", request, [*common, ("Content-Type", "application/http;msgtype=request")], f"GET {uri or '/'} HTTP/1.1{CRLF}{CRLF}".encode(), level)
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    linked = [*common, ("WARC-Concurrent-To", request), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None or first == page_id:
        out += _record("response", response, linked, head + payload, level)
    else:
        out += _record("revisit", _urn("revisit", *place), [*linked, ("WARC-Refers-To", _urn("response", first, digest)), ("WARC-Profile", REVISIT)], head, level)
    about = "" if page_id is None else f"page-id: {page_id}{CRLF}"
    return out + _record("metadata", _urn("metadata", *place), [*common, ("WARC-Concurrent-To", request), ("Content-Type", "application/warc-fields")], about.encode(), level)


def write_captures(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 1) -> int:
    """Write one capture per row to archives below ``path``; returns the number of captures.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, those of the largest identifier are responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    rows = rows.join(firsts, "sha", "left").select("id", "url", "payload", "sha", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        # Each attempt has names of its own: rows may come in another order, and be cut elsewhere, when a task is repeated.
        folder = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, size, captures, made = None, 0, 0, []

        def commit() -> None:
            out.close()
            made.append((f"{folder}/{len(made):05d}.warc.gz", size, captures))

        done = 0
        for batch in batches:
            for page_id, url, raw, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    out, size, captures = store.open_output_stream(f"{root}/{folder}/{len(made):05d}.warc.gz", compression=None), 0, 0
                member = _capture(page_id, url, raw, base64.b32encode(sha).decode(), first, date, (path, folder, done), level)
                out.write(member)
                size, captures, done = size + len(member), captures + 1, done + 1
                if size >= ARCHIVE_BYTES:
                    commit()
                    out = None
        if out is not None:
            commit()
        yield pa.record_batch([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "captures"])

    rows.mapInArrow(write, "archive string, bytes long, captures long").write.mode("overwrite").parquet(f"{path}/_manifest")
    return pages.sparkSession.read.parquet(f"{path}/_manifest").agg(F.sum("captures")).first()[0] or 0


class _Records:
    """Cuts a stream of uncompressed bytes into records; what isn't one gives an error, and the search goes on at the next header."""

    def __init__(self, offset: int):
        self.offset, self.position, self.buffer, self.seen, self.head, self.need, self.lost = offset, 0, bytearray(), 0, None, 0, False

    def _error(self, text: str, **more) -> dict:
        return {"offset": self.offset, "position": self.position, "type": "error", "error": text, **more}

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.position, self.seen, self.head = self.position + n, 0, None

    def _skip(self) -> bool:
        """Goes on to what may be the next header; whether there is one so far."""
        at = self.buffer.find(b"WARC/", 1)
        self._drop(at if at >= 0 else max(0, len(self.buffer) - 4))
        return at >= 0

    def feed(self, data: bytes) -> Iterator[dict]:
        self.buffer += data
        while self.buffer:
            if self.head is None:
                if blank := len(self.buffer) - len(self.buffer.lstrip(b"\r\n")):
                    self._drop(blank)
                    continue
                if len(self.buffer) < 5:
                    return
                if not self.buffer.startswith(b"WARC/"):
                    if not self.lost:
                        yield self._error("not a record")
                    self.lost = True
                    if not self._skip():
                        return
                    continue
                end = self.buffer.find(b"\r\n\r\n", max(0, self.seen - 3))
                if end < 0:
                    self.seen = len(self.buffer)
                    if self.seen <= HEADER_BYTES:
                        return
                    yield self._error("a header without end")
                    self.lost = True
                    self._skip()
                    continue
                fields: dict[str, list[str]] = {}
                for line in self.buffer[:end].decode("utf-8", "replace").split(CRLF)[1:]:
                    name, _, value = line.partition(":")
                    fields.setdefault(name.strip().lower(), []).append(value.strip())
                length = fields.get("content-length", [""])[0]
                if not (length.isascii() and length.isdigit()):
                    yield self._error(f"Content-Length {length!r}", record_id=fields.get("warc-record-id", [None])[0])
                    self.lost = True
                    self._skip()
                    continue
                self.head, self.need, self.lost = (fields, end + 4), end + 4 + int(length), False
            if len(self.buffer) < self.need:
                return
            fields, start = self.head
            yield {"offset": self.offset, "position": self.position, "error": None, **_described(fields, bytes(self.buffer[start : self.need]))}
            self._drop(self.need)

    def finish(self) -> Iterator[dict]:
        if self.buffer.strip(b"\r\n") and not self.lost:
            yield self._error("cut off", record_id=self.head[0].get("warc-record-id", [None])[0] if self.head else None)


def _described(fields: dict[str, list[str]], block: bytes) -> dict:
    one = lambda name: fields.get(name, [None])[0]
    kind, content = one("warc-type") or "", one("content-type") or ""
    payload = block.partition(b"\r\n\r\n")[2] if content.startswith("application/http") else block
    about = {}
    if kind in ("metadata", "warcinfo") and content == "application/warc-fields":
        about = {k.strip(): v.strip() for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if s}
    return {
        "type": kind, "record_id": one("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"), "date": one("warc-date"),
        "content_type": content, "digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None, "profile": one("warc-profile"), "fields": list(about.items()),
        "payload_bytes": len(payload), "computed_digest": payload_digest(payload) if kind in ("response", "resource") else None, "payload": payload,
    }


def parse_archive(file) -> Iterator[dict]:
    """The records of one archive, read in chunks from ``file``; errors come as rows of type ``error``.

    ``offset`` is that of the gzip member, 0 in plain archives, and ``position`` that of the record within.
    """
    raw = file.read(CHUNK)
    if raw[:2] != b"\x1f\x8b":
        records = _Records(0)
        while raw:
            yield from records.feed(raw)
            raw = file.read(CHUNK)
        yield from records.finish()
        return
    at = 0  # offset of raw in the file
    while raw:
        unpacker, records, start, fresh = zlib.decompressobj(31), _Records(at), at, True
        try:
            while raw and not unpacker.eof:
                # A little first, as members are mostly small, so that what follows one isn't copied again and again.
                step = 1 << 13 if fresh else CHUNK
                fresh = False
                data = unpacker.decompress(raw[:step], UNPACKED)
                yield from records.feed(data)
                while not unpacker.eof and (unpacker.unconsumed_tail or len(data) == UNPACKED):
                    data = unpacker.decompress(unpacker.unconsumed_tail, UNPACKED)
                    yield from records.feed(data)
                used = min(step, len(raw)) - len(unpacker.unused_data)
                raw, at = raw[used:], at + used
                raw = raw or file.read(CHUNK)
        except zlib.error as e:
            yield {"offset": start, "position": records.position, "type": "error", "error": f"damaged gzip member: {e}"}
            if at == start:
                raw, at = raw[1:], at + 1
            raw, at = _next_member(raw, at, file)
            continue
        if not unpacker.eof:
            yield {"offset": start, "position": records.position, "type": "error", "error": "gzip member cut off"}
            return
        yield from records.finish()
        if raw and len(raw) < 3:
            raw += file.read(CHUNK)
        if raw and not raw.startswith(b"\x1f\x8b"):
            yield {"offset": at, "position": 0, "type": "error", "error": "not a gzip member"}
            raw, at = _next_member(raw, at, file)


def _next_member(raw: bytes, at: int, file) -> tuple[bytes, int]:
    """What follows from the next place on that unpacks to a record's header."""
    while raw:
        k = raw.find(b"\x1f\x8b\x08")
        if k < 0:
            rest = file.read(CHUNK)
            keep = raw[-2:] if rest else b""
            raw, at = keep + rest, at + len(raw) - len(keep)
            continue
        if len(raw) - k < 1 << 10:
            raw += file.read(CHUNK)
        try:
            if zlib.decompressobj(31).decompress(raw[k : k + CHUNK], 64).lstrip(b"\r\n").startswith(b"WARC/"):
                return raw[k:], at + k
        except zlib.error:
            pass
        raw, at = raw[k + 1 :], at + k + 1
    return raw, at


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, bytes) of the archives below ``path``: those of its manifest, or all files named *.warc*."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.read.parquet(f"{path}/_manifest").select(F.concat(F.lit(f"{path.rstrip('/')}/"), "archive").alias("archive"), "bytes")
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record, or error, of the archives below ``path``; without ``payloads`` only their length and digest are kept.

    Archives are streamed by the executors from any store that the Arrow file systems know.
    """
    found = _archives(spark, path)
    number, size = found.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(number, max((size or 0) // TASK_BYTES, 2 * spark.sparkContext.defaultParallelism)))
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = {"offset": pa.int64(), "position": pa.int64(), "concurrent_to": pa.list_(pa.string()), "fields": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def flushed(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as file:
                    for r in parse_archive(file):
                        if not payloads or r["type"] == "revisit":
                            r["payload"] = None
                        held += len(r.get("payload") or b"") + 500
                        rows.append(r | {"archive": name})
                        if held > 8 << 20:
                            yield flushed(rows)
                            rows, held = [], 0
                yield flushed(rows)

    return found.select("archive").repartition(tasks).mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: transaction_id, ``request``, ``response`` (or revisit, or resource) and ``metadata``.

    Two records belong together if either names the other in ``WARC-Concurrent-To``, or if a metadata record and a
    response are both linked with one request. A request that several responses are linked with is part of each of
    their captures. Requests and metadata records without a response make captures of their own, with those linked
    to them. Where several requests or metadata records belong to one capture, the first in the archives stands in its
    row; the others follow in rows of the same transaction_id, so no record is lost and no row grows without bound. Records of other types are left out.
    """
    key = F.concat_ws("|", "archive", *[F.lpad(F.col(c).cast("string"), 13, "0") for c in ("offset", "position")])
    whole = F.struct(*records.columns).alias("r")
    named = records.filter(F.col("type").isin(*RESPONSES, "request", "metadata")).select(key.alias("key"), "type", "record_id", F.coalesce("concurrent_to", F.array().cast("array<string>")).alias("links"), whole)
    captures = named.filter(F.col("type").isin(*RESPONSES))
    own = F.array_compact(F.array_distinct(F.concat("links", F.array("record_id"))))
    names = captures.select(F.col("key").alias("capture"), F.explode(own).alias("name"))

    def linked(kind: str, known: DataFrame) -> DataFrame:
        """The records of a kind with the captures that share a name with them; those without make one of their own."""
        some = named.filter(F.col("type") == kind)
        met = some.select("key", F.explode(own).alias("name")).join(known, "name").select("key", "capture").distinct()
        return some.join(met, "key", "left").withColumn("capture", F.coalesce("capture", "key"))

    # Requests and metadata records are small; what is linked is written once and read by each of the joins.
    requests = _store.materialise(linked("request", names), "requests")
    further = requests.filter("record_id is not null").select("capture", F.col("record_id").alias("name"))
    about = linked("metadata", names.unionByName(further).distinct())
    others = _store.materialise(requests.unionByName(about).select("capture", "type", "key", "r"), "linked")
    _store.drop(requests)
    firsts = others.groupBy("capture", "type").agg(F.min("key").alias("first"))
    slot = F.when(F.col("key") == F.col("first"), F.col("capture")).otherwise(F.concat_ws("|", "capture", "key"))
    placed = others.join(firsts, ["capture", "type"]).select("capture", slot.alias("slot"), "type", "r")
    rows = placed.unionByName(captures.select(F.col("key").alias("capture"), F.col("key").alias("slot"), "type", "r"))
    of = lambda *kinds: F.any_value(F.when(F.col("type").isin(*kinds), F.col("r")), True)
    return rows.groupBy("slot").agg(F.any_value("capture").alias("transaction_id"), of("request").alias("request"), of(*RESPONSES).alias("response"), of("metadata").alias("metadata")).drop("slot")


def resolve_revisits(captures: DataFrame, id_field: str = "page-id") -> DataFrame:
    """Adds ``page_id``, ``record_type``, ``refers_to`` and the full payload's length and digest to captures.

    A revisit takes its payload's length, and the identifier that it refers to, from the response it names. Rows
    without a response are left out.
    """
    page_id = F.col("metadata.fields").getItem(id_field).cast("long")
    captures = captures.filter("response is not null")
    flat = captures.select("*", page_id.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to"))
    known = flat.filter("record_type = 'response'").groupBy(F.col("response.record_id").alias("_to")).agg(F.max("page_id").alias("_page"), F.max("response.payload_bytes").alias("_bytes"))
    joined = flat.join(known, "_to", "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        *captures.columns, "page_id", "record_type",
        F.when(revisit, F.col("_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.digest")).otherwise(F.col("response.computed_digest")).alias("payload_digest"),
        F.when(revisit, F.col("_page")).alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _store.new_path(spark, "warc")
    write_captures(_store.table(spark, sf_dir, "pages"), path)
    records = read_records(spark, path, payloads=False).select("archive", "offset", "position", "type", "record_id", "concurrent_to", "refers_to", "digest", "fields", "payload_bytes", "computed_digest")
    # The narrow records stand for the archives from here on, which are read once only and have served.
    records = _store.materialise(records, "warc-records")
    _store.delete(spark, path)
    return resolve_revisits(assemble(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
SELECT p.page_id, octet_length(encode(coalesce(p.html, ''))) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN p.page_id = d.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> d.first THEN d.first END AS refers_to
FROM pages p JOIN (
  SELECT html, max(page_id) AS first, max(digest) AS digest FROM (
    SELECT coalesce(html, '') AS html, page_id,
      list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(concat('0b', substr(bits, 1 + 5 * i, 5)) AS INTEGER), 1) FOR i IN range(32)], 'string_agg', '') AS digest
    FROM (SELECT page_id, html, list_aggregate([substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (instr('0123456789abcdef', substr(sha1(coalesce(html, '')), k, 1)) - 1), 4) FOR k IN range(1, 41)], 'string_agg', '') AS bits FROM pages)
  ) GROUP BY html
) d ON coalesce(p.html, '') = d.html
"""
