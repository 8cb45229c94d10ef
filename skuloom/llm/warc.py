"""WARC archives of captures with a globally ordered index, built by external merging.

Writing: captures are dealt to tasks; each task sorts its share by URL key and timestamp, writes it as
one gzip-per-record WARC file, and writes the index of that file as a sorted run with a sparse
position table.  Of captures with one payload the first is a ``response``, the others are ``revisit``
records of the identical-payload profile.

Merging: URL keys are cut into ranges at sampled keys.  A task per range opens all runs at the range's
start and merges them by a loser tree on (URL key, timestamp), which puts whole capture histories in
order; it holds one line per run.  More than ``fan_in`` runs are merged in rounds first.

Reading: every archive is read from front to back, one record at a time, payload digests are checked, and the
records are joined with the merged index by (archive, offset).

Files live in the shared folder; a task that is repeated writes new files, and only those named in the
stored tables are read.  Defined results: null html is an empty payload, a null url an empty one; null page ids are
written and read as null and refer last; of equal rows the first is the response; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.llm.common import shared_dir, stored
from skuloom.llm.shingles import raw_texts, small_batches
from skuloom.llm.url_reputation import host_of, path_of

SPARSE = 256  # records between two entries of a run's position table
CHUNK = 1 << 20


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels in reverse, then the rest in lower case; one line, no tab."""
    url = F.coalesce(url, F.lit(""))
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    key = F.when(F.contains(url, F.lit("://")), F.concat(host, F.lit(")"), F.lower(path_of(url)), F.lower(query))).otherwise(F.lower(url))
    return F.regexp_replace(key, r"[\x00-\x20]", "%20")


def decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Every capture with payload, digest, ``kind`` and ``refers_to``.

    Captures are known by ``capture``, a hash of page_id, url and digest (nulls apart), so that payloads are shuffled
    once, by it, and stay there for the join and the numbering of equal rows.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    page, url = F.col("page_id"), F.col("url").cast("string")
    rows = pages.select(
        page, url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes")
    ).withColumn(
        "capture",
        F.sha2(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), "digest", F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-"))), 256),
    )
    distinct = rows.groupBy("capture", "page_id", "url", "digest", "bytes").agg(F.count("*").alias("times"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url", "capture")
    first = (
        distinct.filter(F.col("bytes") >= least_bytes).groupBy("digest")
        .agg(F.min(order).alias("first"), F.sum("times").alias("times")).filter("times > 1").select("digest", "first")
    )
    choice = distinct.join(first, "digest").select(
        "capture", F.col("first.page_id").alias("to"), (F.col("capture") == F.col("first.capture")).alias("is_first")
    )
    met = rows.join(choice, "capture", "left")
    again = F.row_number().over(Window.partitionBy("capture").orderBy(F.lit(1))) > 1
    revisit = F.coalesce(~F.col("is_first") | F.col("again"), F.lit(False))
    return met.withColumn("again", again).select(
        "page_id", "url", "payload", "digest", "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("to")).alias("refers_to"),
    )


def _line(text) -> str:
    return "" if text is None else str(text).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, stamp: str, kind: str, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_line(page_id)}>", f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {stamp}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_line(refers_to)}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str):
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class _Run:
    """Writes a sorted index run and its position table."""

    def __init__(self, files, path: str):
        self.files, self.path, self.out = files, path, files.open_output_stream(path)
        self.table, self.at, self.n = [], 0, 0

    def add(self, line: bytes):
        if self.n % SPARSE == 0:
            self.table.append((line.split(b"\t", 1)[0], self.at))
        self.out.write(line)
        self.at += len(line)
        self.n += 1

    def close(self) -> list[str]:
        self.out.close()
        with self.files.open_output_stream(self.path + ".table") as out:
            out.write(b"".join(k + b"\t" + str(a).encode() + b"\n" for k, a in self.table))
        return [k.decode() for k, _ in self.table]


def _writer(folder: str):
    """Archives and index runs of a task's sorted captures."""

    def run(batches: Iterator[pa.RecordBatch]):
        files, base = _open(folder)
        name, archive, index = uuid.uuid4().hex, None, None
        at = count = 0
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("page_id", "url", "key", "stamp", "digest", "kind", "refers_to")]
            for page_id, url, key, stamp, digest, kind, to, payload in zip(*cols, raw_texts(batch["payload"]), strict=True):
                if archive is None:
                    archive, index = files.open_output_stream(f"{base}/{name}.warc.gz"), _Run(files, f"{base}/{name}.run")
                data = gzip.compress(record(page_id, url, stamp, kind, digest, payload, to), 4, mtime=0)
                archive.write(data)
                index.add(f"{key}\t{stamp}\t{name}\t{at}\n".encode())
                at += len(data)
                count += 1
        if archive is not None:
            archive.close()
            keys = index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([count], pa.int64()), pa.array([keys], pa.list_(pa.string()))], ["run", "n", "sampled"]
            )

    return run


class LoserTree:
    """Smallest of k sorted streams; one comparison per level for every item taken.

    Node 0 holds the winner, every other node the loser of its match.
    """

    def __init__(self, streams: list):
        self.streams = streams
        self.k = max(1, len(streams))
        self.heads = [next(s, None) for s in streams] or [None]
        self.tree = [-1] * self.k
        for s in range(self.k):
            self._play(s)

    def _before(self, a: int, b: int) -> bool:
        """Whether stream ``a`` comes first; ended streams come last, ties go by stream number."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, s: int):
        node = (s + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                # The first to arrive waits for its opponent.
                self.tree[node] = s
                return
            if self._before(self.tree[node], s):
                self.tree[node], s = s, self.tree[node]
            node //= 2
        self.tree[0] = s

    def __iter__(self):
        while True:
            s = self.tree[0]
            if s < 0 or self.heads[s] is None:
                return
            yield self.heads[s]
            self.heads[s] = next(self.streams[s], None)
            node = (s + self.k) // 2
            while node > 0:
                if self._before(self.tree[node], s):
                    self.tree[node], s = s, self.tree[node]
                node //= 2
            self.tree[0] = s


def _lines(files, path: str, low: bytes, high: bytes | None):
    """(key, stamp, rest) of a run from ``low`` up to before ``high``."""
    with files.open_input_stream(path + ".table") as f:
        table = [x.split(b"\t") for x in f.read().splitlines()]
    start = max(0, bisect_left([x[0] for x in table], low) - 1)
    with files.open_input_file(path) as f:
        f.seek(int(table[start][1]))
        rest = b""
        while True:
            data = f.read(1 << 16)
            rest += data
            lines = rest.split(b"\n")
            rest = lines.pop()
            for line in lines:
                key, stamp, where = line.split(b"\t", 2)
                if high is not None and key >= high:
                    return
                if key >= low:
                    yield key, stamp, where
            if not data:
                return


def _merger(folder: str, runs: list[str]):
    """Captures of each range in global order, numbered within their history."""

    def run(batches: Iterator[pa.RecordBatch]):
        files, base = _open(folder)
        for batch in batches:
            for number, low, high in zip(*(batch[c].to_pylist() for c in ("number", "low", "high")), strict=True):
                streams = [_lines(files, f"{base}/{r}.run", low.encode(), None if high is None else high.encode()) for r in runs]
                out, at, last, capture = [], 0, None, 0
                for key, stamp, where in LoserTree(streams):
                    capture = capture + 1 if key == last else 1
                    last = key
                    archive, offset = where.split(b"\t")
                    out.append((number, at, key.decode(), stamp.decode(), capture, archive.decode(), int(offset)))
                    at += 1
                    if len(out) == 10_000:
                        yield _index_batch(out)
                        out = []
                if out:
                    yield _index_batch(out)

    return run


INDEX = "range int, place bigint, url_key string, stamp string, capture bigint, archive string, offset bigint"


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["range", "place", "url_key", "stamp", "capture", "archive", "offset"],
    )


def _group_merger(folder: str):
    """Several runs merged into a longer one."""

    def run(batches: Iterator[pa.RecordBatch]):
        files, base = _open(folder)
        for batch in batches:
            for runs in batch["runs"].to_pylist():
                name = uuid.uuid4().hex
                out = _Run(files, f"{base}/{name}.run")
                for item in LoserTree([_lines(files, f"{base}/{r}.run", b"", None) for r in runs]):
                    out.add(b"\t".join(item) + b"\n")
                keys = out.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([keys], pa.list_(pa.string()))], ["run", "sampled"])

    return run


def records_in(files, path: str):
    """(offset, record bytes) of an archive, one record in memory at a time."""
    with files.open_input_stream(path) as f:
        data, at = f.read(CHUNK), 0
        while data:
            member, parts, used = zlib.decompressobj(31), [], 0
            while not member.eof:
                if not data:
                    data = f.read(CHUNK)
                    if not data:
                        raise ValueError(f"{path} ends inside a record")
                parts.append(member.decompress(data))
                used += len(data) - len(member.unused_data)
                data = member.unused_data
            yield at, b"".join(parts)
            at += used
            data = data or f.read(CHUNK)


def parsed(data: bytes) -> tuple:
    """(page_id, payload_bytes, digest, kind, refers_to) of a record; checks the payload's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")

    def page(name):
        value = fields.get(name, "<urn:page:>").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return page("WARC-Record-ID"), size, digest, kind, page("WARC-Refers-To")


RECORD = "archive string, offset bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        files, base = _open(folder)
        for batch in batches:
            for name in batch["run"].to_pylist():
                out = []
                for offset, data in records_in(files, f"{base}/{name}.warc.gz"):
                    out.append((name, offset, *parsed(data)))
                    if len(out) == 5000:
                        yield _record_batch(out)
                        out = []
                if out:
                    yield _record_batch(out)

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Writes all captures below ``folder``; one row per archive: run (its name), n, sampled keys.

    ``pages``: page_id, url, html.  The page_id, counted in seconds, is the time of the capture.
    """
    small_batches(pages.sparkSession)
    stamp = F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) % (1 << 31)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = decided(pages, least_bytes).withColumn("key", url_key(F.col("url"))).withColumn("stamp", stamp)
    ordered = rows.sortWithinPartitions("key", "stamp", "page_id")
    runs = ordered.select("page_id", "url", "key", "stamp", "digest", "kind", "refers_to", "payload").mapInArrow(
        _writer(folder), "run string, n bigint, sampled array<string>"
    )
    return stored(runs, "warc-archives")


def merged_index(runs: DataFrame, folder: str, per_range: int = 50_000, fan_in: int = 512) -> DataFrame:
    """The index of all archives in one order: ``range`` and ``place`` number it, ``capture`` numbers a history."""
    spark = runs.sparkSession
    total = runs.agg(F.sum("n")).first()[0] or 0
    names = [r["run"] for r in runs.select("run").collect()]
    while len(names) > fan_in:
        groups = [(names[i : i + fan_in],) for i in range(0, len(names), fan_in)]
        longer = spark.createDataFrame(groups, "runs array<string>").repartition(len(groups)).mapInArrow(
            _group_merger(folder), "run string, sampled array<string>"
        )
        runs = stored(longer, "warc-longer-runs")
        names = [r["run"] for r in runs.select("run").collect()]
    ranges = max(1, total // per_range)
    keys = runs.select(F.explode("sampled").alias("key"))
    # At most about 100 keys per range are looked at, chosen by hash; they only place the borders.
    thin = max(1, total // SPARSE // (100 * ranges))
    keys = sorted(r["key"].encode() for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(thin)) == 0).select("key").collect())
    borders = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    lows = [b""] + [b for b in borders if b]
    cut = [(i, low.decode(), lows[i + 1].decode() if i + 1 < len(lows) else None) for i, low in enumerate(lows)]
    table = spark.createDataFrame(cut, "number int, low string, high string").repartition(len(cut), "number")
    return table.mapInArrow(_merger(folder, names), INDEX)


def archive_round_trip(pages: DataFrame, least_bytes: int = 100, per_range: int = 50_000, fan_in: int = 512) -> DataFrame:
    """Writes every capture, merges the indexes, reads the archives back: one row per capture, with its place in the index."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, base = _open(folder)
    files.create_dir(base, recursive=True)
    archives = write_archives(pages, folder, least_bytes)
    index = merged_index(archives, folder, per_range, fan_in)
    # As many tasks as archives, however few bytes their names have.
    found = archives.select("run").repartition(max(1, archives.count()), "run").mapInArrow(_reader(folder), RECORD)
    return found.join(index, ["archive", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "capture", "range", "place"
    )
