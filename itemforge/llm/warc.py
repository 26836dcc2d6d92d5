"""Web archives and their capture index.

``write_archives`` writes one WARC/1.0 record per page through Spark's text writer (record text, CR LF CR LF after
it, gzip): the HTTP response with the html as payload, or, for a payload that a later page repeats, a revisit record
that carries the headers only and names the response. ``read_captures`` reads the files back, checks lengths and
digests and gives each task's captures sorted by URL key and time: a run. ``merge_runs`` deals the runs into ranges of
(URL key, time, page_id) and merges the runs of each range with a loser tree, so the ranges, one after the other, are
the globally ordered capture history.

Scale: the pages are shuffled once, by digest; only digests seen twice are looked up, and equal payloads are spread
over salts before they meet their response, so one payload with a third of all pages is no hot task. A range is cut by
time and page as well as by URL, so a hot URL has many ranges. A reading task holds one file, of at most
``records_per_file`` records, and a merging task one range.

Pages hold no capture time; the record's date is page_id seconds after 1970 unless a ``captured`` column is named.

Cases: null html is an empty payload, which takes part like any other; payloads below ``least_bytes`` are always
responses; of equal payloads the largest page_id is the response; repeated rows of it are all responses; a null page_id
revisits where there is another page; a null URL has an empty key; line breaks in a URL are percent-encoded; payloads
that contain record-like text are safe, since lengths decide; an empty table writes no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.shared import fresh_dir, table

END, SALTS = "\r\n\r\n", 64
CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, place long"


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in upper-case base32: five hex digits are four base32 digits."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_response(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest and refers_to, the response's page_id where the page is a revisit."""
    known = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), "captured", F.coalesce(pages["html"], F.lit("")).alias("payload"))
    known = known.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    known = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    same = ["payload_digest", "payload_bytes"]
    salted = known.filter(F.col("payload_bytes") >= least_bytes).groupBy(*same, "salt").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    repeated = (salted.groupBy(*same).agg(F.max("largest").alias("response"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
                .filter("n > 1").select(*same, "response", F.explode("salts").alias("salt")))
    joined = known.join(repeated, [*same, "salt"], "left")
    return joined.withColumn("refers_to", F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")))


def record_text(page: DataFrame) -> DataFrame:
    """The record of every page, without the line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: "), F.col("captured"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                                 F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return page.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, captured: str | None = None, least_bytes: int = 0, records_per_file: int = 2_000) -> None:
    time = F.col(captured) if captured else F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(4_102_444_800)))
    dated = pages.select("page_id", "url", "html", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"))
    (record_text(with_response(dated, least_bytes)).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def url_key(url: str) -> str:
    """Host labels from the top domain down, then path and query; scheme, user, default port, ``www`` and fragment go."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    keep = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(labels))}{keep}){parts.path or '/'}{query}".lower()


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has another length")
        yield at, headers, content[start:stop]
        at = stop + 4


def capture(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} fails its digest")
    number = lambda name: int(x) if (x := headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    stamp = "".join(c for c in headers["WARC-Date"] if c.isdigit())
    return url_key(headers.get("WARC-Target-URI", "")), stamp, number("WARC-Record-ID"), size, digest, headers["WARC-Type"], number("WARC-Refers-To")


def order_key(row: tuple) -> tuple:
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], [f.name for f in fields])


FIELDS = [pa.field(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in CAPTURE.split(", "))]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under a folder; each file's rows are one run: sorted by URL key, time and page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [(*capture(headers, block), name.as_py(), at) for at, headers, block in records(gzip.decompress(content.as_py()))]
                yield _batch(sorted(rows, key=order_key), FIELDS)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted runs: inner nodes remember the loser of their match, so each output replays one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.keys = [order_key(r[0]) if r else None for r in runs]
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._replay(run)

    def _after(self, a: int, b: int) -> bool:
        """True if run a's head comes after run b's; an empty run comes last, equal heads go by run."""
        x, y = self.keys[a], self.keys[b]
        return x is None if x is None or y is None else (x, a) > (y, b)

    def _replay(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # a place still free while the tree is filled
                self.losers[node] = run
                return
            if self._after(run, self.losers[node]):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.winner = run

    def merged(self) -> Iterator[tuple]:
        while self.k and self.keys[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.keys[run] = order_key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            self._replay(run)


def merge_runs(captures: DataFrame) -> DataFrame:
    """The captures in global order: by range, and inside each range by merging its runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[7], []).append(row)
        for rows in runs.values():
            rows.sort(key=order_key)  # runs arrive in order; this only guards against a shuffle that mixed one
        held: list[tuple] = []
        for row in LoserTree(list(runs.values())).merged():
            held.append(row)
            if len(held) == 4_096:
                yield _batch(held, FIELDS)
                held = []
        yield _batch(held, FIELDS)
    return captures.repartitionByRange("url_key", "captured", "page_id").mapInArrow(run, CAPTURE)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return merge_runs(read_captures(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to FROM d
"""
