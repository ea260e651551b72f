"""Legacy archive converter: ARC records in, WARC records out, written as archives and read back.

Pages are laid out as ARC archives (version 1 or 2) of RECORDS_EACH records; each archive is one binary value. The
converter reads the version block, which becomes a warcinfo record, takes the field names of the header lines from it,
cuts records by their declared lengths and synthesises WARC identifiers, timestamps, types and digests. Equal payloads
are found by digest; the record of smallest page_id becomes the response, the others become revisits that carry the HTTP
head alone and refer to its record by identifier. Archives are written by Spark's text writer with the record terminator
as line separator, so they land in any store by its commit protocol, and are read back as binary files.

Digests alone are grouped. Pages stay where they are unless a bounded filter says that their payload may repeat; those
move once, by page.

Defined cases: a null html is the empty payload, equal to other empty payloads; a null url becomes urn:page:<id>; white
space in urls is percent-encoded; types may hold blanks; rows that repeat a page_id and payload are one response and
revisits of the same id, each with an identifier of its own; a row without page_id is not archived; other columns are
ignored; an empty table gives no rows. In archives read from elsewhere, a header line that does not parse (a length that
is missing or no number) is passed over up to the next line that does; a record shorter than declared is kept and marked
truncated; a page at a filedesc: address is a page unless it opens the archive or holds a version block.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineproof.llm.shared import batch, marked, scratch_path, stored

RECORDS_EACH = 500
ARCHIVE_DATE = "20240101000000"
END = b"\r\n\r\n"
#: Fixed values of the ARC format: field names of a record's header line, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record string"
ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("warc_date", pa.string())])
ROWS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(name: str, version: int, date: str = ARCHIVE_DATE) -> bytes:
    body = f"{version} 0 lineproof\n{' '.join(ARC_FIELDS[version])}\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def arc_record(url: str, block: bytes, version: int, name: str = "-", date: str = ARCHIVE_DATE, mime: str = "text/html", offset: int = 0) -> bytes:
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    middle = "" if version == 1 else f" 200 {sha1_base32(block)} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {mime}{middle} {len(block)}\n".encode() + block + b"\n"


#: What a field of a header line may hold; fields without an entry hold no blank.
FIELD = {"URL": r".*?", "IP-address": r"[0-9A-Fa-f.:]+", "Archive-date": r"\d{4,17}", "Content-type": r".*?", "Archive-length": r"\d+"}
VERSION_BLOCK = re.compile(rb"\d+ \d+ [^\n]*\r?\n[^\n]*Archive-length")


def header_pattern(fields: list[str]) -> re.Pattern:
    return re.compile(" ".join(f"({FIELD.get(f, chr(92) + 'S+')})" for f in fields))


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; a version block comes as a record with the field Version, and its field
    names hold until the next one. Blocks cut short have the field Truncated."""
    at, fields = 0, ARC_FIELDS[1]
    pattern = header_pattern(fields)
    while at < len(data):
        stop = data.find(b"\n", at)
        if stop < 0:
            break
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        opens, at = not at, stop + 1
        found = None
        if line.startswith("filedesc://"):
            length = line.rpartition(" ")[2]
            block = data[at : at + int(length)] if length.isdecimal() else b""
            if VERSION_BLOCK.match(block) or (opens and block[:1].isdigit()):
                at += len(block)
                head = block.decode("utf-8", "replace").split("\n")
                version = head[0].split(" ")[0]
                named = head[1].split() if len(head) > 1 else []
                fields = named or ARC_FIELDS.get(int(version) if version.isdecimal() else 1, ARC_FIELDS[1])
                pattern = header_pattern(fields)
                date = re.search(r" (\d{14}) ", line)
                yield {"URL": line.split(" ")[0], "Version": version, "Archive-date": date[1] if date else ARCHIVE_DATE}, block
                continue
        found = pattern.fullmatch(line)
        if not found:
            continue
        told = dict(zip(fields, found.groups(), strict=True))
        told["URL"] = re.sub(r"\s", "%20", told["URL"])
        length = int(told["Archive-length"])
        block = data[at : at + length]
        at += length
        yield told | ({"Truncated": "length"} if len(block) < length else {}), block


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, sep, body = block.partition(END)
    names = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return head + sep, names, body


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(digest: str, page_id: object, ordinal: int = 1) -> str:
    """The identifier of the ordinal-th record of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {page_id} {ordinal}')}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [WARC_VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def warcinfo(fields: dict[str, str], block: bytes) -> tuple[str, bytes]:
    """Identifier and record of a version block."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, fields['URL'] + hashlib.sha1(block).hexdigest())}>"
    body = f"software: lineproof\r\nformat: {WARC_VERSION}\r\ndescription: converted from an ARC archive of version {fields['Version']}\r\n".encode()
    headers = [("WARC-Record-ID", name), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Filename", fields["URL"].removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")]
    return name, warc_record("warcinfo", headers, body)


def convert(fields: dict[str, str], block: bytes, first: int | None = None, ordinal: int = 1, info: str | None = None) -> bytes:
    """The WARC record of an ARC record; first: the page whose first record holds the same payload, where this is not it."""
    head, http, body = http_parts(block)
    digest, page, url = sha1_base32(body), http.get("X-Page-Id", ""), fields["URL"]
    headers = [
        ("WARC-Record-ID", record_id(digest, page, ordinal)), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Target-URI", url),
        ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        *([("WARC-Warcinfo-ID", info)] if info else []), *([("WARC-Truncated", fields["Truncated"])] if "Truncated" in fields else []),
    ]
    if first is None:
        return warc_record("response", [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")], block)
    # The page number beside the identifier is an extension field, so that a reader needs no join to tell it.
    return warc_record("revisit", [*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(digest, first)), ("Refers-To-Page", str(first))], head)


def read_warc(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, headers, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        headers = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        length = int(headers["Content-Length"])
        yield headers["WARC-Type"], headers, data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + len(END)


def _to_arc(version: int):
    """Archives of RECORDS_EACH pages as single values, with what the converter needs to know of their duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.binary()), ("first", pa.list_(pa.int64())), ("ordinal", pa.list_(pa.int64()))])
        n = 0
        for b in batches:
            for start in range(0, b.num_rows, RECORDS_EACH):
                some, name = b.slice(start, RECORDS_EACH), f"pages-{n:06d}.arc"
                parts, offset = [arc_version_block(name, version)], 0
                for page_id, url, html in zip(some["page_id"].to_pylist(), some["url"].to_pylist(), some["html"].to_pylist(), strict=True):
                    offset += len(parts[-1])
                    body = html or b""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page_id}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    parts.append(arc_record(f"urn:page:{page_id}" if url is None else url, head + body, version, name, offset=offset))
                n += 1
                yield batch(schema, archive=[b"".join(parts)], first=[some["first_page"].to_pylist()], ordinal=[some["ordinal"].to_pylist()])

    return run


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string())])
    for b in batches:
        for archive, first, ordinal in zip(b["archive"], b["first"].to_pylist(), b["ordinal"].to_pylist(), strict=True):
            records, out = read_arc(archive.as_py()), []
            info, head = warcinfo(*next(records))
            out.append(head)
            out += [convert(f, block, page, n, info) for (f, block), page, n in zip(records, first, ordinal, strict=True)]
            yield batch(schema, record=out)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: dict[str, list] = {f.name: [] for f in ROWS}
        for content in b["content"]:
            for kind, headers, block in read_warc(content.as_py()):
                if kind == "warcinfo":
                    continue
                _, http, body = http_parts(block)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and sha1_base32(body) != digest:
                    raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                refers = headers.get("Refers-To-Page")
                row = (int(http["X-Page-Id"]), int(http["Content-Length"]), digest, kind, int(refers) if refers else None, headers["WARC-Target-URI"], headers["WARC-Date"])
                for name, value in zip(cols, row, strict=True):
                    cols[name].append(value)
        yield batch(ROWS, **cols)


def told_apart(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, first_page, ordinal): the page that holds a payload first, null for its own first record."""
    rows = pages.filter("page_id is not null").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("short", F.xxhash64("digest"))
    # One row a digest that repeats: what is unique needs no entry.
    count = rows.groupBy("digest", "short").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    repeated = stored(count.filter("n > 1").drop("n"), "warc-repeated")
    told = marked(rows, "short", repeated.select("short").distinct(), "asked")
    alone = told.filter("not asked").select("page_id", "url", "html", F.lit(None).cast("long").alias("first_page"), F.lit(1).cast("long").alias("ordinal"))
    asked = told.filter("asked")
    # The hot digests meet as narrow rows; a payload moves by its page.
    firsts = asked.select("page_id", "digest").join(repeated.select("digest", "first_page"), "digest", "left").distinct()
    n = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy(F.col("url").asc_nulls_first())).cast("long")
    both = asked.join(firsts, ["page_id", "digest"]).withColumn("ordinal", n)
    own = F.col("first_page").isNull() | ((F.col("first_page") == F.col("page_id")) & (F.col("ordinal") == 1))
    return alone.unionByName(both.select("page_id", "url", "html", F.when(~own, F.col("first_page")).alias("first_page"), "ordinal"))


def write_archives(pages: DataFrame, path: str, version: int = 1) -> None:
    """Convert pages by way of ARC archives into gzipped WARC archives below path."""
    arcs = told_apart(pages).mapInArrow(_to_arc(version), "archive binary, first array<long>, ordinal array<long>")
    records = arcs.mapInArrow(_to_warc, RECORD)
    # An archive of RECORDS_EACH pages and its warcinfo make a file.
    writer = records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_EACH + 1).option("zlib.compress.level", "BEST_SPEED")
    writer.text(path, compression="gzip")


def read_archives(pages: DataFrame, path: str) -> DataFrame:
    spark = pages.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_unzipped, ROWS_DDL)


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    schema = pa.schema([("content", pa.binary())])
    for b in batches:
        for content in b["content"]:
            yield from _read_back([batch(schema, content=[gzip.decompress(content.as_py())])])


def archive_pages(pages: DataFrame, version: int = 1, path: str | None = None) -> DataFrame:
    """Write pages as archives and return what the archives hold, a row per record."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, version)
    return read_archives(pages, path)
