"""WARC archives, and capture indexes merged from sorted runs.

Archives are written by Spark's own file writer: a record is one line of a text sink whose line
separator is the blank line that ends a WARC record. They are valid WARC files, of a bounded
number of records that shrinks with the pages' sizes, and committed like any Spark output.

Reading an archive back gives a run of its captures, sorted by URL key and time. Runs are cut
into ranges of (URL key, time, record) that hold a bounded number of captures, and each range
merges its pieces of all runs with a loser tree; the ranges in order are one globally ordered
capture history.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import materialize, scratch_path

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of 40 hex digits: five bits at a time, ten digits (eight letters) apiece."""
    part = lambda i: F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("bigint")
    letter = lambda v, k: F.substring(F.lit(BASE32), (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(part(i), k) for i in range(4) for k in range(8)])


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = 2000, file_bytes: int = 64 << 20) -> None:
    """Write one WARC record per row of ``pages`` (``page_id``, ``url``, ``html``) under ``path``.

    The payload is the html in UTF-8, empty for null. Of the rows with equal payloads of at
    least ``min_revisit_bytes``, that with the largest id is a response and the others are
    revisits that refer to it and carry no payload. Rows that repeat the largest id are
    responses too, as are rows with a null id unless a row with an id has the same payload.
    Captures are dated by id, a second each, unless there is a column ``captured_at``. A null
    URL is written as an empty one; blanks and controls in URLs as ``%20``. Very long pages are
    written whole. Other columns are ignored; an empty table gives no records.

    A file holds at most ``records_per_file`` records, and so many fewer as pages are large that
    it has about ``file_bytes`` before compression (a single larger page aside).

    Who is a response is decided on ids and digests alone, so pages meet their decision by
    (id, digest) and a payload that very many pages share is no skewed key of theirs.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    if "captured_at" in pages.columns:
        when = F.coalesce(F.col("captured_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    else:
        when = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)))
    size = F.octet_length(payload).cast("bigint")
    keys = pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha1"), size.alias("bytes"))
    repeated = keys.filter(F.col("bytes") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1").select("sha1", "keeper")
    decided = keys.select("page_id", "sha1").distinct().join(repeated, "sha1").withColumnsRenamed({"page_id": "d_id", "sha1": "d_sha1"})
    mean = max(1.0, keys.agg(F.avg(F.col("bytes") + 400)).first()[0] or 0)
    records_per_file = int(max(1, min(records_per_file, file_bytes / mean)))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select("page_id", url.alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"), size.alias("bytes"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    rows = rows.join(decided, F.col("page_id").eqNullSafe(F.col("d_id")) & (F.col("sha1") == F.col("d_sha1")), "left").withColumn("revisit", F.coalesce(F.col("page_id") < F.col("keeper"), F.col("keeper").isNotNull() & F.col("page_id").isNull()))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(~F.col("revisit"), F.col("html")).otherwise(""))
    refers = F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("keeper")), F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}"))).otherwise("")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{CRLF}WARC-Date: "),
        F.col("date"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        base32_of_hex(F.col("sha1")),
        F.lit(CRLF),
        refers,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(CRLF * 2),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """Sortable: the host's labels reversed and comma-separated, then the rest; lower-cased, without scheme."""
    rest = url.partition("://")[2] if "://" in url else url
    rest = rest.lower()
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def parse_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record, by the stated lengths; one record in memory at a time."""

    def headers() -> list[str]:
        lines = []
        while line := stream.readline():
            if line == b"\r\n":
                return lines
            lines.append(line.decode().removesuffix(CRLF))
        if lines:
            raise ValueError("headers without an end")
        return lines

    while lines := headers():
        first, *lines = lines
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record: {first!r}")
        head = dict(x.split(": ", 1) for x in lines)
        length = int(head["Content-Length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head['WARC-Record-ID']} not closed")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:]), payload


CAPTURE = "run string, url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_runs(spark, path: str) -> DataFrame:
    """The captures of every archive under ``path`` as sorted runs, one archive each.

    Lengths and digests of responses are computed from the payloads read; revisits have those in
    their headers.
    """
    schema = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in _struct(CAPTURE)])
    number = lambda name: int(x) if (x := name[len("<urn:page:") : -1]) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for head, http, payload in parse_archive(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}: {head['WARC-Record-ID']} does not have its digest")
                    size = len(payload) if response else int(http["Content-Length"])
                    rows.append((name.as_py(), url_key(head["WARC-Target-URI"]), head["WARC-Date"], number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], None if response else number(head["WARC-Refers-To"])))
                rows.sort(key=_order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("run"), "content")
    return files.mapInArrow(read, CAPTURE)


def _struct(ddl: str):
    import pyspark.sql.types as T

    return T._parse_datatype_string(ddl)


def _order(row: tuple) -> tuple:
    return (row[1], row[2], row[3] is not None, row[3] or 0)


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, so the next winner costs one path to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [r[0] if r else None for r in runs]
        self.losers = [0] * self.k
        self.winner = self._play(1) if runs else 0

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._before(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_histories(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Captures of all runs in global order of (URL key, time, record): partitions are consecutive ranges of about ``range_rows``.

    The record breaks ties, so the captures of one very frequent URL can fill many ranges. A
    shuffle doesn't keep the order of the rows it brings, so the pieces of the runs are put in
    order again as they arrive.
    """
    ranges = max(-(-runs.count() // range_rows), 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        piece = pa.Table.from_batches(got)
        keys = list(zip(*(piece.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id"))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i][0] != keys[i - 1][0]), len(keys)]
        merged = [i for *_, i in LoserTree([[(_order(keys[i]), i) for i in range(a, b)] for a, b in zip(cuts, cuts[1:])])]
        yield from piece.take(pa.array(merged)).combine_chunks().to_batches()

    return runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", "page_id").mapInArrow(merge, CAPTURE)


def archive_and_index(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back, and return the merged capture history.

    One row per page; columns as in ``CAPTURE``. See ``write_archives`` for odd input.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return merge_histories(materialize(read_runs(spark, path), "capture-runs"))
