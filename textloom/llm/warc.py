"""WARC archives and their external index.

Writing: a page becomes one WARC/1.1 record. Of pages with equal payloads (compared
by SHA-256, of ``min_dedup_bytes`` or more) the smallest page_id is a response and
the others revisit it. Payloads of hot groups are not shuffled for that. Each record is a gzip
member of its own, which can be read alone by the index's offset and length. Files are written
by Spark's text writer, so archives go through its own commit protocol to any file system
it knows; its line separator is an empty gzip member, which readers pass over. A file ends
once it has ``archive_bytes``, so its size is bounded by that and one record.

Reading: archives are parsed member by member and by their Content-Length, never by looking
for a separator. Each file gives one capture run, sorted by (URL key, timestamp, page_id) and written
to the shared folder. The index merge range-partitions the runs by that key, restores
each run's order within a partition, and merges them with a loser tree (one comparison
per level for each capture). The output is globally ordered: a URL's captures follow one
another by time. As page_id is part of the range, a hot URL spreads over partitions.

Pages have no capture time; where no time column is named, page_id gives it, in seconds
after 2024-01-01, modulo a year.

Edge cases: a null html is an empty payload; a null url is written as an empty target; CR
and LF in a URL are percent-encoded; a null page_id is written as "-" and read as null, and
is never a response that others refer to unless all of its group are null; rows that
repeat a page_id and payload are all responses if their id is the smallest; an empty
table gives no archive and an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, join_groups, map_arrow, shuffle_partitions

CRLF = "\r\n"
ARCHIVE_BYTES = 64 << 20
#: A gzip member of no bytes, which parts records.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = 1_704_067_200
_YEAR = 31_536_000
_CAPTURE = "urlkey string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"
_KEY = ("urlkey", "timestamp", "page_id")


def _base32_sha1(payload: Column) -> Column:
    """Base 32 of SHA-1, 20 bits at a time: conv() writes base 32 with 0-9A-V."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, min_dedup_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per page into gzip-compressed archives under path."""
    scratch = Scratch(pages.sparkSession, "payloads")
    time = F.col(time_col) if time_col else F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(_YEAR)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.date_format(F.coalesce(time, F.timestamp_seconds(F.lit(_EPOCH))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    ).withColumn("content", F.unhex(F.sha2("payload", 256)))
    long_enough = F.octet_length("payload") >= min_dedup_bytes
    firsts = rows.groupBy("content").agg(F.min(F.when(long_enough, F.col("id"))).alias("first"), F.count(F.lit(1)).alias("pages"))
    firsts = scratch.keep(firsts, "firsts")
    roles = join_groups(rows, firsts, ["content"], "pages").withColumn("revisit", long_enough & ~F.col("id").eqNullSafe(F.col("first")))
    digest = _base32_sha1(F.col("payload"))
    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    rows = roles.withColumn("digest", digest).withColumn("body", body)

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    shown = F.coalesce(F.col("id").cast("string"), F.lit("-"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("id"), F.col("digest")), F.lit(">"))),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Page-ID", shown),
        F.when(
            F.col("revisit"),
            F.concat(
                field("WARC-Profile", F.lit(PROFILE)),
                field("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("first"), F.col("digest")), F.lit(">"))),
                field("WARC-Refers-To-Page-ID", F.coalesce(F.col("first").cast("string"), F.lit("-"))),
            ),
        ).otherwise(""),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length("body").cast("string")),
        F.lit(CRLF),
        F.col("body"),
    )
    members = map_arrow(rows.select(record.alias("record")), _members(archive_bytes), "value binary, part int")
    # The writer passes a string's bytes on as they are, and knows the separator's bytes by its encoding.
    writer = members.select(F.col("value").cast("string"), "part").write.mode("overwrite").partitionBy("part")
    writer.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)
    scratch.drop("firsts")


def _members(archive_bytes: int):
    """Each record as a gzip member, and the number of its task's file that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = 0, 0
        for batch in batches:
            members, parts = [], []
            for record in batch.column(0):
                member = gzip.compress(record.as_py().encode() + b"\r\n\r\n", mtime=0)
                if filled >= archive_bytes:
                    part, filled = part + 1, 0
                filled += len(member) + len(EMPTY_MEMBER)
                members.append(member)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(parts, pa.int32())], names=["value", "part"])

    return run


def url_key(url: str) -> str:
    """Sort-friendly URI: the host's labels from the last to the first, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    own = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + own + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, block, offset, length) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        fields = {k.decode().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}
        body = end + 4
        stop = body + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} does not end where its length says")
        yield fields, data[body:stop], at, stop + 4 - at
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :]


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members_of(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(content, offset, length) of each member of a gzip file that is not empty."""
    at = 0
    while at < len(data):
        member, begin, out = zlib.decompressobj(31), at, []
        while not member.eof:
            chunk = data[at : at + 65_536]
            if not chunk:
                raise ValueError(f"the member at offset {begin} has no end")
            out.append(member.decompress(chunk))
            at += len(chunk)
        at -= len(member.unused_data)
        if any(out):
            yield b"".join(out), begin, at - begin


def _number(text: str | None) -> int | None:
    return None if text in (None, "-") else int(text)


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name = "/".join(path.as_py().rsplit("/", 2)[1:])
            rows = []
            for content_, offset, length in members_of(content.as_py()):
                ((fields, block, _, _),) = parse_records(content_)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                payload = payload_of(block)
                if fields["warc-type"] == "response":
                    if _digest(payload) != digest:
                        raise ValueError(f"{name}, offset {offset}: the payload does not have its digest")
                    size = len(payload)
                else:
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block)[1])
                stamp = re.sub(r"\D", "", fields["warc-date"])
                rows.append((url_key(fields["warc-target-uri"]), stamp, _number(fields["warc-page-id"]), fields["warc-type"], digest, size, _number(fields.get("warc-refers-to-page-id")), name, offset, length))
            rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(range(len(rows)), pa.int64())], names=[*names, "seq"])


class LoserTree:
    """K-way merge. Inner nodes hold the losers of their matches and the root the winner, so that
    after each output only the matches on the winner's path are played again."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.heads = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Run a's head goes first; finished runs lose, and ties go to the smaller run."""
        if self.heads[a] >= len(self.runs[a]):
            return False
        if self.heads[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.heads[a]], self.runs[b][self.heads[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of every item in order."""
        if not self.runs:
            return
        while self.heads[self.winner] < len(self.runs[self.winner]):
            yield self.winner, self.heads[self.winner]
            self.heads[self.winner] += 1
            now, node = self.winner, (self.winner + self.k) // 2
            while node:
                if self._before(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs in a range partition, whose rows come run by run."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found).combine_chunks()
    archives = rows.column("archive").to_pylist()
    keys = [(u, t, p is not None, p or 0) for u, t, p in zip(*(rows.column(c).to_pylist() for c in _KEY), strict=True)]
    starts = [i for i in range(len(keys)) if not i or archives[i] != archives[i - 1]]
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    order = pa.array([starts[run] + place for run, place in LoserTree(runs)], pa.int64())
    yield from rows.drop_columns(["seq"]).take(order).combine_chunks().to_batches()


def read_index(spark: SparkSession, path: str, captures_per_task: int = 100_000) -> DataFrame:
    """The captures of all archives under path, globally ordered by URL key, timestamp and page_id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    runs = Scratch(spark, "captures").keep(map_arrow(files, _read_runs, f"{_CAPTURE}, seq long"), "runs")
    tasks = max(shuffle_partitions(spark), -(-runs.count() // captures_per_task))
    ranged = runs.repartitionByRange(tasks, *_KEY).sortWithinPartitions("archive", "seq")
    return map_arrow(ranged, _merge, _CAPTURE)


def archive_round_trip(pages: DataFrame, min_dedup_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns the merged index read from them."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path, min_dedup_bytes=min_dedup_bytes, **columns)
    return read_index(spark, path)
