"""Web archives of pages, read back, and their capture index merged from sorted runs.

An archive is a sequence of WARC/1.1 records, each its own gzip member: a ``response`` holds the payload, a ``revisit``
says that the payload is the one of another page. The index lists the captures of an archive part in the order of URL key and
time. These sorted runs are cut at the bounds of key ranges, and each range merges its slices of all runs with a tree of losers,
so the ranges one after the other are the capture histories in global order.
"""

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import Published, file_system, mapped, shared_files, stored

#: Compressed bytes after which a task begins the next archive.
ARCHIVE_BYTES = 16 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
VERSION = b"WARC/1.1"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from the top, then path and query, all in lower case: ``com,example)/a?b``."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){path}".lower()


def capture_time(page_id: int | None) -> str:
    """The given pages have no time; they count as captured a second apart, in the order of their ids, those without an id at the begin."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int, url: str, digest: str, copy: int) -> str:
    """A name of its own for every record of a page: by payload, URL and the number among equal rows."""
    return f"<urn:page:{page_id}:{digest}:{zlib.crc32(url.encode('utf-8', 'surrogatepass')):08x}:{copy}>"


def record(name: str, page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record, uncompressed. ``refers_to`` names the response of a revisit, which has no payload itself. Line ends in a URL would break the header and become blanks."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", capture_time(page_id)),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", refers_to),
            ("X-Payload-Length", str(size)),
        ]
        payload = b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    lines = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + payload + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def records_of(archive: Iterator[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, size, headers, block)`` of each gzip member of an archive that comes in blocks."""
    offset, member, rest, raw = 0, zlib.decompressobj(31), b"", []
    used = 0
    for block in archive:
        rest = block
        while rest:
            raw.append(member.decompress(rest))
            if member.eof:
                used += len(rest) - len(member.unused_data)
                rest = member.unused_data
                yield (offset, used, *parsed(b"".join(raw)))
                offset, used, member, raw = offset + used, 0, zlib.decompressobj(31), []
            else:
                used += len(rest)
                rest = b""
    if raw:
        raise ValueError("the archive ends inside a record")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("no WARC record")
    headers = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if body[size:] != b"\r\n\r\n":
        raise ValueError("a record has another length than its header says")
    return headers, body[:size]


_KEY = ["id", "url", "digest", "n"]
_CAPTURE = ["page_id", "url", "html", "digest", "n", "copy", "refers_to", "refers_url"]


def plan_captures(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, digest, n, copy, refers_to, refers_url)``: one response per payload, that of the smallest id, and revisits without html.

    Equal rows are counted first, with map-side merging. Of rows of the smallest id with one payload, that with the smallest URL is the
    response, and of equal ones the first; all others are revisits and are made from the narrow counts, so html moves once and only to drop the
    rows that revisit. Rows with a null id refer to the smallest id with their payload; without one each is a response. Null URLs are empty.
    """
    page, url = F.col("page_id").cast("bigint"), F.coalesce(F.col("url").cast("string"), F.lit(""))
    own = pages.select(F.coalesce(page.cast("string"), F.lit("")).alias("id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.select("id", "url", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("bigint").alias("n"), "html")
    page_id = F.col("id").try_cast("bigint")
    rows = stored(own.groupBy(*_KEY).agg(F.count("*").alias("copies")).withColumn("page_id", page_id), "digests")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    owners = rows.groupBy("digest", "n").agg(first.alias("owner"), F.sum("copies").alias("all")).filter("all > 1 AND owner IS NOT NULL")
    is_owner = F.col("page_id").eqNullSafe(F.col("owner.page_id")) & (F.col("url") == F.col("owner.url"))
    again = rows.join(owners, ["digest", "n"]).withColumn("mine", is_owner).filter("NOT mine OR copies > 1")
    again = stored(again.select(*_KEY, "page_id", "copies", "mine", F.col("owner.page_id").alias("refers_to"), F.col("owner.url").alias("refers_url")), "revisits")

    nothing = [F.lit(0).cast("bigint").alias("copy"), F.lit(None).cast("bigint").alias("refers_to"), F.lit(None).cast("string").alias("refers_url")]
    once = own.join(again.select(*_KEY), _KEY, "left_anti").select(page_id.alias("page_id"), "url", "html", "digest", "n", *nothing)
    twice = again.filter("mine").select(*_KEY)
    several = own.join(twice, _KEY).groupBy(*_KEY).agg(F.first("html").alias("html")).select(page_id.alias("page_id"), "url", "html", "digest", "n", *nothing)
    copy = F.explode(F.sequence(F.when(F.col("mine"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), F.col("copies") - 1)).alias("copy")
    revisits = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "n", copy, "refers_to", "refers_url").select(*_CAPTURE)
    # the scan for responses of repeated rows is left out where there are none
    responses = once if twice.isEmpty() else once.unionAll(several)
    return responses.unionAll(revisits)


ENTRY = "url_key string, ts string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, file string, offset bigint, size bigint"
_FIELDS = ["url_key", "ts", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "size"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def write_archives(captures: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``plan_captures`` and return the list of archives ``(file, records, bytes)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, out, count, unnamed = TaskContext.get().partitionId(), 0, None, 0, 0
        done: list[tuple[str, int, int]] = []

        def close():
            out.commit()
            done.append((f"{folder}/pages-{task:06d}-{serial:04d}.warc.gz", count, out.size))

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for page_id, url, html, digest, n, copy, refers_to, refers_url in zip(*[c.to_pylist() for c in batch.slice(at, 200).columns]):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    told = payload_digest(payload) if refers_to is None else base64.b32encode(bytes.fromhex(digest)).decode()
                    if out is None:
                        out, count = Published(folder, f"pages-{task:06d}-{serial:04d}.warc.gz"), 0
                    unnamed += page_id is None
                    name = f"<urn:unnamed:{task}-{unnamed}>" if page_id is None else record_id(page_id, url, told, copy)
                    source = None if refers_to is None else record_id(refers_to, refers_url, told, 0)
                    out.write(packed(record(name, page_id, url, payload, told, n, source)))
                    count += 1
                    if out.size >= archive_bytes:
                        close()
                        out, serial = None, serial + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), *[pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)]],
            names=["file", "records", "bytes"],
        )

    # the list is stored, so that the archives are written once
    return stored(mapped(captures.select(*_CAPTURE), write, "file string, records bigint, bytes bigint"), "archives")


def index_archives(archives: DataFrame) -> DataFrame:
    """Read archives record by record and return their captures; digests and lengths come from the payloads, those of revisits from headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = file_system(file)
                with system.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for offset, size, headers, block in records_of(iter(lambda s=stream: s.read(1 << 20), b"")):
                        refers_to = headers.get("WARC-Refers-To")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if refers_to is None and payload_digest(block) != digest:
                            raise ValueError(f"{file} at {offset}: the payload has another digest than its header says")
                        url = headers["WARC-Target-URI"]
                        rows.append(
                            (
                                url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, headers["WARC-Type"],
                                int(headers["X-Payload-Length"]) if refers_to else len(block), digest,
                                _page(refers_to) if refers_to else None, file, offset, size,
                            )
                        )
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000]), _TYPES)], names=_FIELDS)

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mapped(archives.select("file").repartition(parts, "file"), read, ENTRY)


def _page(urn: str) -> int | None:
    return None if urn.startswith("<urn:unnamed:") else int(urn.split(":")[2])


def _key(entry: tuple) -> tuple:
    """URL key, time, page (none last), file and offset of an entry: no two records are equal in all of them."""
    return (entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[8], entry[9])


class LoserTree:
    """Merge of k sorted runs: a node holds the loser of the match below it, the winner passes on to the top."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [self._next(k) for k in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        for k in range(len(runs)):
            self._play(k)

    def _next(self, k: int):
        return next(self.runs[k], None)

    def _less(self, a: int, b: int) -> bool:
        """Ended runs lose; equal heads go by the number of the run."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, k: int) -> None:
        """Carry run ``k`` to the top; while the tree fills, an empty node (-1) takes the first to come."""
        winner, node = k, (k + len(self.runs)) // 2
        while node > 0:
            if self.losers[node] == -1 and self._filling:
                self.losers[node], winner = winner, -1
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    _filling = True

    def __iter__(self) -> Iterator:
        self._filling = False
        while self.runs:
            k = self.losers[0]
            if self.heads[k] is None:
                return
            yield self.heads[k]
            self.heads[k] = self._next(k)
            self._play(k)


#: Entries that are sorted into one run, and that a range is made for.
RUN_ROWS, RANGE_ROWS = 20_000, 100_000
SLICES = "bucket int, task int, run bigint, entries binary"


def capture_histories(archives: DataFrame, ranges: int | None = None, fan_in: int = 256, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures of all archives in the order of URL key, time and page, nulls last: ``(range_no, place, …)``, ``place`` counting inside a range.

    Each index task sorts what it read, ``run_rows`` at a time, into runs and cuts these at the bounds of the ranges, which come from a sample
    of some rows per range. There are as many ranges as it takes for about ``range_rows`` captures each, so that a merge holds no more at any size of the
    table. Slices of a range are merged ``fan_in`` at a time. The bounds have URL key, time, page, file and offset, so
    that also a single URL or page with very many captures is spread.
    """
    spark = archives.sparkSession
    entries = stored(index_archives(archives), "entries")
    total = max(1, entries.count())
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows))
    chosen = F.pmod(F.xxhash64("page_id", "offset"), F.lit(max(1, total // (40 * ranges)))) == 0
    sample = sorted(_key(r) for r in entries.filter(chosen).select(*_FIELDS).limit(80 * ranges).collect())
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if len(sample) >= ranges else sample

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for run, batch in enumerate(_gathered(batches, run_rows)):
            keys = [_key(e) for e in zip(*[c.to_pylist() for c in batch.columns])]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            buckets = [bisect.bisect_right(bounds, keys[k]) for k in order]
            rows, at = [], 0
            while at < len(order):
                stop = bisect.bisect_right(buckets, buckets[at])
                part = batch.take(pa.array(order[at:stop]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    for first in range(0, part.num_rows, 200):  # a merge decodes a block of each slice at a time
                        out.write_batch(part.slice(first, 200))
                rows.append((buckets[at], task, run, sink.getvalue().to_pybytes()))
                at = stop
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "task", "run", "entries"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs = None, []
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if b != bucket and runs:
                    yield from _merged(bucket, runs, fan_in)
                    runs = []
                bucket = b
                runs.append(raw)
        if runs:
            yield from _merged(bucket, runs, fan_in)

    slices = mapped(entries, cut, SLICES)
    dealt = slices.repartition(ranges, "bucket").sortWithinPartitions("bucket", "task", "run")
    return mapped(dealt, merge, f"range_no int, place bigint, {ENTRY}")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if count:
        yield pa.concat_batches(held)


def _rows(raw: bytes) -> Iterator[tuple]:
    for batch in pa.ipc.open_stream(raw):
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _merged(bucket: int, runs: list[bytes], fan_in: int) -> Iterator[pa.RecordBatch]:
    streams = [_rows(r) for r in runs]
    while len(streams) > fan_in:  # more slices than a tree shall have: trees of trees
        streams = [iter(LoserTree([map(_Entry, s) for s in streams[k : k + fan_in]])) for k in range(0, len(streams), fan_in)]
        streams = [map(tuple, s) for s in streams]
    held, place = [], 0
    for row in LoserTree([map(_Entry, s) for s in streams]):
        held.append((bucket, place, *row))
        place += 1
        if len(held) >= 5000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), *_TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range_no", "place", *_FIELDS])


class _Entry(tuple):
    """An entry that compares by ``_key``."""

    __slots__ = ()

    def __lt__(self, other) -> bool:
        return _key(self) < _key(other)


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, unnamed: bool = False) -> DataFrame:
    """Write all pages and read the archives back as capture histories.

    Null html is an empty payload, null URLs are empty. With ``unnamed``, pages with a null id get a record under a name of their own, otherwise they are
    left out; rows with equal ids, and equal rows, each give a record with a name of its own. Of equal payloads one record, of the smallest id, is the response. An empty table gives no
    archive and no rows.
    """
    folder = shared_files(pages.sparkSession, "warc")
    pages = pages if unnamed else pages.filter(F.col("page_id").cast("bigint").isNotNull())
    return capture_histories(write_archives(plan_captures(pages), folder, archive_bytes))
