"""WARC archives and their capture index.

Pages are written as WARC records into archives of bounded size (rows of a table: archive, WARC bytes), equal
payloads as revisits of one response. Reading an archive back gives a run of captures, sorted by URL key and
timestamp. The external merge deals the runs' pieces out by key range and merges each range's runs with a
loser tree: the partitions, in order, are the globally ordered capture history.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha1
from itertools import pairwise
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, save, slices

ARCHIVE_BYTES = 4 << 20
#: Captures that one task merges, about.
RANGE_ROWS = 100_000
MIN_REVISIT_BYTES = 1000
EPOCH = "2024-01-01T00:00:00Z"
CAPTURES = "url_key string, stamp string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, position long"


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query (``com,example)/a?b``). Odd URLs key as themselves."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return url
    if not host:
        return url
    port = f":{parts.netloc.rsplit(':', 1)[1]}" if ":" in parts.netloc.rsplit("@", 1)[-1].rstrip("]") and not parts.netloc.endswith("]") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id: int, url: str, stamp: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds headers only."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {stamp}",
        # a target that holds line breaks would break the header: percent-encoded there
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and position of each record of an archive; raises on a record that is cut off or malformed."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[end + 4 : stop], at
        at = stop + 4


class LoserTree:
    """Merges sorted iterables: inner nodes hold the losers, so that each step replays one path of log2(k) matches."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = max(1, len(self.runs))
        self.k, self.losers = k, [-1] * k
        for run in range(len(self.runs)):
            self._replay(run)

    def _less(self, a: int, b: int) -> bool:
        """Does run a stand before run b? An exhausted run stands last; ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _replay(self, run: int) -> None:
        node = (run + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0:  # while the tree is built: the first to come waits here
                self.losers[node] = run
                return
            if self._less(other, run):
                self.losers[node], run = run, other
            node >>= 1
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while (best := self.heads[run := self.losers[0]]) is not None:
            yield best
            self.heads[run] = next(self.runs[run], None)
            self._replay(run)


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds payload (UTF-8 of html, null: empty), payload_digest (SHA-1), and refers_to for copies of a later page.

    The largest page_id of each digest comes from a partial aggregate and meets the copies' ids in rows without
    payloads. A digest that a third of all pages share is one key of that join, which adaptive execution splits (the
    other side has one row for it); payloads are then met by page_id, which has no hot key.
    """
    page = pages.select("page_id", "url", "stamp", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    key = page.select("page_id", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    best = key.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    again = key.join(best, "payload_digest").filter("page_id <> refers_to").groupBy("page_id").agg(F.max("refers_to").alias("refers_to"))
    return page.join(again, "page_id", "left")


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows (archive, data) of WARC files of about ``archive_bytes``, from page_id, url, stamp, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, data = TaskContext.get().partitionId(), 0, bytearray()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([bytes(data)], pa.binary())], ["archive", "data"])

        for batch in batches:
            for piece in slices(batch, 3):
                for page, url, stamp, payload, refers in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    data += record(page, url or "", stamp, payload, sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers)
                    if len(data) >= archive_bytes:
                        yield full()
                        n, data = n + 1, bytearray()
        if data:
            yield full()

    return with_revisits(pages, min_bytes).select("page_id", "url", "stamp", "payload", "refers_to").mapInArrow(run, "archive string, data binary")


def capture_runs(archives: DataFrame) -> DataFrame:
    """Captures read back from archives; the captures of an archive are a run, sorted by URL key, timestamp and page."""
    names = [x.split()[0] for x in CAPTURES.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def page_of(urn: str) -> int | None:
        number = urn[len("<urn:page:") : -1]
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for h, block, at in read_records(data.as_py()):
                    kind, digest, size = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if kind == "response" and (sha1(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"{archive}, byte {at}: the payload does not match its digest")
                    url = h["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((url_key(url), h["WARC-Date"], page_of(h["WARC-Record-ID"]), url, kind, digest, size, page_of(h["WARC-Refers-To"]) if kind == "revisit" else None, archive, at))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("archive", "data").mapInArrow(run, CAPTURES)


def merge_runs(captures: DataFrame) -> DataFrame:
    """The capture history: all runs merged by URL key, timestamp and page; ``place`` numbers a partition's captures in order.

    The runs are those that ``capture_runs`` sorted: ranges deal out their pieces, and each piece is merged as it is.

    Ranges also cut by timestamp and page, so one URL with a third of all captures spreads over tasks. Their number
    grows with the captures, so that a task merges about ``RANGE_ROWS`` of them, which carry no payloads.
    """
    names = [f.name for f in captures.schema]
    order = ["url_key", "stamp", "page_id"]
    ranges = max(partitions(captures.sparkSession), -(-captures.count() // RANGE_ROWS))
    dealt = captures.repartitionByRange(ranges, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        cols = [table.column(n).to_pylist() for n in (*order, "archive")]
        runs: dict[str, list[tuple]] = {}
        for k, (key, stamp, page, archive) in enumerate(zip(*cols, strict=True)):
            runs.setdefault(archive, []).append((key, stamp, page is not None, page, k))
        for run_ in runs.values():  # pieces of a run come in its order, unless the shuffle has mixed them
            if any(b < a for a, b in pairwise(run_)):
                run_.sort()
        at = [row[-1] for row in LoserTree(runs.values())]
        base = TaskContext.get().partitionId() << 40
        merged = table.take(at).append_column("place", pa.array(range(base, base + len(at)), pa.int64()))
        yield from merged.combine_chunks().to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema)
    return dealt.select(*names).mapInArrow(run, schema + ", place long")


def archive_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stamp: str = EPOCH, stamp_col: str | None = None) -> DataFrame:
    """Write pages as WARC, read the archives back, and return their merged capture history, one row per page.

    ``stamp_col`` names a column of capture times (``2024-01-01T00:00:00Z``, which sort as text); without it, and where
    it is null, all captures have the time ``stamp``. Captures of one URL follow each other by time, then by page.
    Null html is an empty payload, a null url an empty target. Payloads under 1,000 bytes are always responses. Page
    ids are expected to be unique; repeated rows give repeated captures, and a page without an id is a response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), (F.coalesce(F.col(stamp_col).cast("string"), F.lit(stamp)) if stamp_col else F.lit(stamp)).alias("stamp"))
    archives = save(write_archives(rows), "archives")
    return merge_runs(save(capture_runs(archives), "runs"))
