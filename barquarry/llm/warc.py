"""WARC archives: written and read with Spark's text source, captures put together again.

*Writing.*  Each page becomes three records (request, response or revisit, metadata) that
name each other by WARC-Concurrent-To.  A record is one row of text and the row separator
is the CR LF that ends a record, so the part files are plain WARC/1.1 archives, gzipped on
request; any Hadoop store takes them.

*Reading.*  Archives are read as rows separated by CR LF "WARC/1.", streaming, in splits,
one record at a time; plain or gzipped.  A payload that contains the separator is written
with chunked transfer coding, so that no chunk holds it whole.  In foreign archives a row
shorter than its Content-Length is completed with the rows that follow it.

*Transaction assembly.*  Request and metadata records are joined to their response or
revisit through the concurrent-to identifier, and each capture is one nested row.

*Revisits.*  Of records with equal payloads of at least 1000 bytes those with the largest
page id are responses and records with another page id revisit one of them.  The grouping
sees digests only and is combined before its shuffle.

*Round trip.*  Digests and lengths returned are those of the payloads read back; a revisit
has those of the response that it refers to.  A payload that does not match its digest, a
record that breaks off, a capture without its request, metadata or referred response, and
a number of captures other than that of the pages are errors.

Defined results: null html is an empty payload; null ids or urls are written as absent
fields and read as null; rows equal in id, url and payload are numbered, so that each is a
capture; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.storage import Scratch

EOL = "\r\n"
MARK = EOL + "WARC/1."  # before every record but the first of a file
LEAST = 1000  # bytes from which equal payloads are revisits
DATE = "2024-01-01T00:00:00Z"


def _uuid(role: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", F.lit(role), *[F.coalesce(c.cast("string"), F.lit("\x01")) for c in of]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest (hex), n_bytes, record id, and for revisits refers_to (page id) and refers_id."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    page = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    page = page.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n_bytes": F.octet_length("html").cast("long")})
    page = page.withColumn("record", _uuid("response", F.col("page_id"), F.col("url"), F.col("digest")))
    lead = page.where(F.col("n_bytes") >= LEAST).groupBy("digest", "n_bytes").agg(F.max(F.struct("page_id", "record")).alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = lead.where("n > 1").select("digest", "n_bytes", F.col("lead.page_id").alias("refers_to"), F.col("lead.record").alias("refers_id"))
    out = page.join(lead, ["digest", "n_bytes"], "left")
    # dealt by digest already, so that the payloads are not moved again
    number = F.row_number().over(Window.partitionBy("digest", "n_bytes", "page_id", "url").orderBy("record"))
    out = out.withColumn("number", number)
    again = _uuid("response", F.col("page_id"), F.col("url"), F.col("digest"), F.col("number"))
    out = out.withColumn("record", F.when(F.col("number") > 1, again).otherwise(F.col("record"))).drop("number")
    revisit = F.coalesce(F.col("page_id") != F.col("refers_to"), F.lit(False))
    return out.withColumns({c: F.when(revisit, F.col(c)) for c in ("refers_to", "refers_id")})


def _base32(digest: str | None) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the CR LF that ends it."""
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}{EOL}" for k, v in head if v is not None)
    return f"WARC/1.1{EOL}{lines}{EOL}".encode() + block + EOL.encode()


def _chunked(payload: bytes) -> bytes:
    """Chunked transfer coding in which the record mark is cut wherever it occurs."""
    cuts, at = [0], 0
    mark = MARK.encode()
    first = payload.startswith(mark[2:])  # completed by the CR LF before the payload
    if first:
        cuts.append(3)
    while (at := payload.find(mark, at)) >= 0:
        cuts.append(at + 4)
        at += 4
    cuts.append(len(payload))
    parts = [payload[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _clean(text: str | None) -> str | None:
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            payload = r["html"].encode()
            url, page = _clean(r["url"]), None if r["page_id"] is None else str(r["page_id"])
            core = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
            path = url.split("/", 3)[3] if url and url.count("/") > 2 else ""
            host = url.split("/", 3)[2] if url and url.count("/") > 1 else ""
            ask = f"GET /{path} HTTP/1.1{EOL}Host: {host}{EOL}{EOL}".encode()
            head = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}X-Payload-Length: {len(payload)}{EOL}"
            main = [("WARC-Record-ID", r["record"]), *core, ("WARC-Payload-Digest", "sha1:" + _base32(r["digest"]))]
            if r["refers_id"]:
                kind, block = "revisit", (head + EOL).encode()
                main += [("WARC-Refers-To", r["refers_id"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
            else:
                kind = "response"
                marked = MARK.encode() in payload or payload.startswith(MARK.encode()[2:])
                block = f"{head}{'Transfer-Encoding: chunked' if marked else f'Content-Length: {len(payload)}'}{EOL}{EOL}".encode() + (_chunked(payload) if marked else payload)
            main.append(("Content-Type", "application/http; msgtype=response"))
            asked = [("WARC-Record-ID", r["request"]), *core, ("WARC-Concurrent-To", r["record"]), ("Content-Type", "application/http; msgtype=request")]
            meta = [("WARC-Record-ID", r["metadata"]), *core, ("WARC-Concurrent-To", r["record"]), ("Content-Type", "application/warc-fields")]
            note = (f"page-id: {page}{EOL}" if page is not None else "") + f"via: barquarry{EOL}"
            out += [_record("request", asked, ask), _record(kind, main, block), _record("metadata", meta, note.encode())]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])


def write(decided: DataFrame, path: str, gzip: bool = True) -> None:
    """Archives of decide()'s rows under a path. One row of text is one record."""
    rows = decided.select("page_id", "url", "html", "digest", "record", "refers_id", _uuid("request", F.col("record")).alias("request"), _uuid("metadata", F.col("record")).alias("metadata"))
    records = rows.mapInArrow(_write, "value string")
    records.write.option("lineSep", EOL).option("compression", "gzip" if gzip else "none").text(path)


RECORD = "kind string, record string, concurrent_to string, refers_id string, url string, date string, digest string, block_type string, status int, n_bytes long, digest_ok boolean, payload_digest string, payload binary, fields map<string,string>, complete boolean"


def _head(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon:
            out.setdefault(k.decode("utf-8", "replace").strip().lower(), v.decode("utf-8", "replace").strip())
    return out


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        n = int(body[at:end].split(b";")[0] or b"0", 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def _parsed(raw: bytes, with_payload: bool) -> dict | None:
    """A record from 'x CR LF fields CR LF CR LF block': what follows WARC/1. ; None if its block is not all there."""
    head, blank, block = raw.partition(b"\r\n\r\n")
    fields = _head(head)
    size = int(fields.get("content-length", "0"))
    if not blank or len(block) < size:
        return None
    block = block[:size]
    kind = fields.get("warc-type")
    out = {c: None for c in ("status", "n_bytes", "digest_ok", "payload_digest", "payload")}
    out |= {"kind": kind, "record": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_id": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "block_type": fields.get("content-type")}
    digest = fields.get("warc-payload-digest", "")
    out["digest"] = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    out["fields"], out["complete"] = {}, True
    if kind in ("response", "revisit") and (fields.get("content-type") or "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        own = _head(http)
        status = http[:20].split()
        out["status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
        out["fields"] = own
        if kind == "response":
            body = _unchunked(body) if own.get("transfer-encoding", "").lower() == "chunked" else body
            out["n_bytes"] = len(body)
            out["payload_digest"] = hashlib.sha1(body).hexdigest()
            out["digest_ok"] = out["payload_digest"] == out["digest"]
            out["payload"] = body if with_payload else None
        elif (n := own.get("x-payload-length") or own.get("content-length")) is not None:
            out["n_bytes"] = int(n)
    elif kind == "metadata":
        out["fields"] = _head(block)
    elif with_payload:
        out["payload"] = block
    return out


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_raw, open_path = b"", None

        def lost() -> dict:
            return {c: None for c in names} | {"fields": {}, "complete": False}

        for b in batches:
            out = []
            for raw, path in zip(b.column("value").to_pylist(), b.column("path").to_pylist()):
                if open_raw and path == open_path:
                    raw = open_raw + MARK.encode() + raw  # the mark stood in the block
                elif open_raw:
                    out.append(lost())
                raw = raw.removeprefix(b"WARC/1.")
                got = _parsed(raw, with_payload) if raw else None
                open_raw, open_path = (raw, path) if raw and got is None else (b"", None)
                if got:
                    out.append(got)
            if out:
                yield _records(out, names)
        if open_raw:
            yield _records([lost()], names)

    return run


_KINDS = {"status": pa.int32(), "n_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string()), "complete": pa.bool_()}


def _records(out: list[dict], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([list(r[c].items()) if c == "fields" else r[c] for r in out], _KINDS.get(c, pa.string())) for c in names]
    return pa.RecordBatch.from_arrays(columns, names)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under a path. complete is false where an archive breaks off inside a record."""
    storage.small_batches(spark, 1000)
    lines = spark.read.option("lineSep", MARK).text(path)
    rows = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"))
    return rows.mapInArrow(_read(with_payload), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record, url, date, response, request, metadata."""
    main = records.where("kind in ('response', 'revisit')").dropDuplicates(["record"])
    side = records.where("kind in ('request', 'metadata') and concurrent_to is not null")
    side = side.select(F.col("concurrent_to").alias("record"), "kind", F.struct(F.col("record").alias("id"), "block_type", "fields", "payload").alias("part"))
    side = side.groupBy("record").agg(*[F.first(F.when(F.col("kind") == k, F.col("part")), ignorenulls=True).alias(k) for k in ("request", "metadata")])
    response = F.struct("kind", "status", "n_bytes", "digest", "digest_ok", "payload_digest", "refers_id", "fields", "payload")
    return main.select("record", "url", "date", response.alias("response")).join(side, "record", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    storage.small_batches(spark, 1000)
    path = f"{scratch.root}/archives"
    write(decide(pages), path)
    storage.release(spark)
    flat = scratch.write(_whole(read(spark, path, with_payload=False)))
    if (n := flat.count()) != (of := pages.count()):
        raise ValueError(f"{n} captures read back of {of} pages")
    storage.delete(spark, path)
    target = flat.where("record_type = 'response'").select(F.col("record").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("size"))
    out = flat.join(target, "refers_id", "left")
    good = (F.col("record_type") == "response") | ((F.col("digest") == F.col("of")) & (F.col("payload_bytes") == F.col("size")))
    digest = F.when(F.coalesce(good, F.lit(False)), F.coalesce("payload_digest", "of")).otherwise(F.raise_error(F.concat(F.lit("revisit without its response: "), "record")))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def _whole(records: DataFrame) -> DataFrame:
    """One flat row per capture of archives of our own; what is damaged or missing is an error."""
    broken = ~F.col("complete") | (F.coalesce(F.col("kind"), F.lit("")) == "response") & ~F.coalesce(F.col("digest_ok"), F.lit(False))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("damaged record: "), F.coalesce("record", F.lit("breaks off"))))).otherwise(F.col("kind"))
    found = captures(records.withColumn("kind", checked))
    lacks = F.col("request").isNull() | F.col("metadata").isNull()
    record = F.when(lacks, F.raise_error(F.concat(F.lit("capture without its request or metadata: "), "record"))).otherwise(F.col("record"))
    page = F.col("metadata.fields")["page-id"].cast("long").alias("page_id")
    r = F.col("response")
    return found.select(record.alias("record"), page, r["n_bytes"].alias("payload_bytes"), r["digest"].alias("digest"), r["payload_digest"].alias("payload_digest"), r["kind"].alias("record_type"), r["refers_id"].alias("refers_id"))
