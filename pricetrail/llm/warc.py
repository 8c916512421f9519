"""Web archives (WARC): written by Spark, indexed by record, read back by coalesced byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.session import shared_path

from .common import split, staged, table

VERSION = "WARC/1.1"
END = "\r\n\r\n"  # ends a header, and a record
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 0  # payloads below this are never revisits
BUCKET = 64 << 20  # bytes of an archive that a task reads, about
GAP = 64 << 10  # bytes between two records that are read along rather than skipped
READ = 8 << 20  # bytes of a read, unless a record is longer
BLOCK = 1 << 20  # bytes that the indexer reads at once

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "path string, offset long, length long, type string, record_id string, url string, digest string, refers_to string"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: every five hex digits are four letters."""
    digits = F.sha1(payload)
    four = lambda k: F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[four(k) for k in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def page_of(record: Column) -> Column:
    """The page of a record id; null for a page without one."""
    return F.nullif(F.regexp_extract(record, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")


def record(kind: str, payload: Column, refers_to: Column | None) -> Column:
    """One record without its end: header, then the HTTP response, which a revisit has without its body.

    The HTTP header has the length of the whole payload in both. Line ends in a URL are percent-encoded, as they would end its line.
    """
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, payload) if kind == "response" else http
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("row"))), F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        *([] if refers_to is None else [F.lit(f"WARC-Profile: {SAME}"), F.concat(F.lit("WARC-Refers-To: "), refers_to)]),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of pages (``page_id``, ``url``, ``html``, ``row``: a number of its own for each row) to archives in folder.

    Of the rows with equal payloads of at least ``least_bytes`` bytes that with the largest page_id (of equal ones
    the largest row; a null page_id is below all) is a response, the others are revisits of it; all smaller
    ones are responses. A null html is an empty payload; a null url leaves its line out; an empty table
    gives no record. Records are rows that Spark's own text writer ends with the end of a record, so an archive is
    committed as a whole by the task that wrote it. Payloads that no other row has are written where they are
    read; of those that repeat one copy a task is shuffled, and revisits carry none.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "row", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), payload_digest(html).alias("digest"))
    large = F.col("bytes") >= least_bytes
    groups = rows.where(large).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("first"))
    repeated = staged(groups.where("n > 1").select("digest", "first"))
    some, alone = split(rows.where(large), repeated.select("digest"), "digest")
    best = some.select("digest", "bytes", "html", F.struct("page_id", "row").alias("first"), "url")
    kept = best.groupBy("digest").agg(F.max_by(F.struct("html", "bytes", "url"), "first").alias("page"), F.max("first").alias("first"))
    kept = kept.select("first.page_id", "first.row", "digest", "page.html", "page.bytes", "page.url")
    again = some.drop("html").join(repeated, "digest").where(~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("row") == F.col("first.row"))))
    whole = alone.unionByName(kept, allowMissingColumns=True).unionByName(rows.where(~large))
    out = whole.select(record("response", F.col("html"), None).alias("value"))
    out = out.unionAll(again.select(record("revisit", F.lit(""), record_id(F.col("first.page_id"), F.col("first.row"))).alias("value")))
    out.write.option("lineSep", END).text(folder)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and lengths of the archives in a folder; their content is not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def fields(header: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in header.decode(errors="replace").split("\r\n")[1:])}


def opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    files, place = FileSystem.from_uri(path)
    return files.open_input_file(place)


def records_in(path: str) -> Iterator[tuple]:
    """Offset, length and header fields of each record of an archive. Payloads are skipped, blocks of them never held."""
    with opened(path) as archive:
        size, at, held, start = archive.size(), 0, b"", 0

        def until(end: bytes) -> bytes:
            """From ``at`` up to the mark, read in blocks."""
            nonlocal held, start
            if not start <= at < start + len(held):
                held, start = archive.read_at(min(BLOCK, size - at), at), at
            while (found := held.find(end, at - start)) < 0:
                if start + len(held) >= size:
                    raise ValueError(f"{path}: no end of the header at {at}")
                held, start = held[at - start :], at
                held += archive.read_at(min(BLOCK, size - start - len(held)), start + len(held))
            return held[at - start : found]

        while at < size:
            header = until(END.encode())
            if not header.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {at}")
            own = fields(header)
            length = len(header) + len(END) + int(own["content-length"]) + len(END)
            yield at, length, own
            at += length


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in a folder: its place (path, offset, length), type, id, URL, payload digest and what it refers to.

    Only headers are parsed; a task reads the archives that Spark gives it, a block at a time. A folder without archives gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        made: list[tuple] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for at, length, own in records_in(path):
                    digest = (own.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    made.append((path, at, length, own.get("warc-type"), own.get("warc-record-id"), own.get("warc-target-uri"), digest, own.get("warc-refers-to")))
                    if len(made) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema=SCHEMA)
                        made = []
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema=SCHEMA)

    return archives(spark, folder).mapInArrow(run, INDEX)


SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in INDEX.split(", ")])


def ranges(places: Iterator[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """Places (path, offset, length, ...) in order, coalesced: path, start and end of a read, and the places in it.

    Places are read together while the gap between them is at most ``GAP`` bytes and the read at most ``READ`` bytes.
    """
    own: list[tuple] = []
    start = end = 0
    for place in places:
        path, at, length = place[:3]
        if own and (path != own[0][0] or at - end > GAP or max(end, at + length) - start > READ):
            yield own[0][0], start, end, own
            own = []
        if not own:
            start, end = at, at + length
        own.append(place)
        end = max(end, at + length)
    if own:
        yield own[0][0], start, end, own


def read_records(selected: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """The selected rows of an index with what their records hold: ``payload`` (binary, null for a revisit) and ``payload_bytes``, its length as the HTTP header tells it.

    Places are dealt out by archive and stretch of ``BUCKET`` bytes, sorted, and read in coalesced byte ranges: as
    few reads as the selection allows, and no byte beyond ``GAP`` that was not asked for. Records come out in batches of
    about ``most_bytes``; a longer one is a batch of its own. No selected rows give none; a row selected twice comes twice.
    """
    names = [*SCHEMA.names, "payload", "payload_bytes"]
    kinds = [*SCHEMA.types, pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(n).to_pylist() for n in SCHEMA.names], strict=True)

        made: list[tuple] = []
        held, path, archive = 0, None, None
        for where, start, end, own in ranges(places()):
            if where != path:
                if archive:
                    archive.close()
                path, archive = where, opened(where)
            read = memoryview(archive.read_at(end - start, start))
            for place in own:
                raw = bytes(read[place[1] - start : place[1] - start + place[2]])
                header, _, rest = raw.partition(END.encode())
                http, _, body = rest[: -len(END)].partition(END.encode())
                length = int(fields(http)["content-length"])
                if place[3] == "response" and len(body) != length:
                    raise ValueError(f"{path}: the record at {place[1]} has {len(body)} bytes of {length}")
                made.append((*place, body if place[3] == "response" else None, length))
                held += len(body)
                if held >= most_bytes or len(made) >= 4096:
                    yield batch_of(made)
                    made, held = [], 0
        if archive:
            archive.close()
        if made:
            yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    stretch = F.floor(F.col("offset") / BUCKET)
    dealt = selected.select(*SCHEMA.names, stretch.alias("stretch")).repartition("path", "stretch").sortWithinPartitions("path", "offset")
    return dealt.select(*SCHEMA.names).mapInArrow(run, f"{INDEX}, payload binary, payload_bytes long")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read all of it back by the index."""
    pages = table(spark, sf_dir, "pages")
    row = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    folder = shared_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html", row.alias("row")), folder)
    places = staged(index(spark, folder))
    found = read_records(places)
    digest = F.when(F.col("payload").isNotNull(), payload_digest(F.col("payload"))).otherwise(F.col("digest"))
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "url")
