"""WARC archives of pages: written, read back, and merged into one ordered index.

An archive is a file in the shared folder that holds gzip members, one for each record, so that a record can be read
by its offset alone. A new archive begins when the last has ``ARCHIVE_BYTES`` or ``ARCHIVE_ROWS``. Each task writes its
own archives aside and renames them; what it returns is a list of them, and only listed archives are read, record by
record, so that an attempt that was lost leaves nothing in the index.

Index: every archive gives a run of captures, sorted by url key and timestamp. Splitters cut each run in ranges;
all pieces of one range meet in one task, which merges them with a loser tree. Ranges are in order, and so are
the captures of each.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import shared_path, written

#: Payloads of at least so many bytes are stored once.
DEDUP_BYTES = 1000
#: Compressed bytes and records after which an archive ends (a larger record is an archive of its own).
ARCHIVE_BYTES, ARCHIVE_ROWS = 64 << 20, 10_000
#: Captures of a range, about, and how many captures of the sample stand for a range.
RANGE_ROWS, SAMPLED = 50_000, 4
#: Bytes that are read at a time.
CHUNK = 1 << 15

ENTRY = "urlkey string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, record_length long"


def url_key(url: Column) -> Column:
    """The host's labels in reverse, comma-joined, then ``)`` and the path with its query: ``com,example)/a?b``. Null: empty."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, ts: Column) -> DataFrame:
    """page_id and record: the text of one WARC record for each page. Only payloads that occur again are joined."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"), F.col(html_col).alias("html"), ts.alias("ts"))
    rows = rows.withColumns({"n": F.octet_length(payload).cast("long"), "digest": F.sha1(payload.cast("binary"))})
    same = rows.where((F.col("n") >= DEDUP_BYTES) & F.col("page_id").isNotNull()).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("least < keeper").drop("least")
    rows = rows.join(same, ["digest", "n"], "left")
    revisit = F.col("page_id") < F.col("keeper")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Date: "), F.col("ts"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("n"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nX-Url-Key: "), url_key(F.col("url")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n")), F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, "").otherwise(payload)
    return rows.select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: Column | None = None, archive_rows: int = ARCHIVE_ROWS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record for each page in archives below ``path``; returns their list (archive, records, bytes). Without ``ts`` all captures have one time.

    Of records with equal payloads of at least 1000 bytes that with the largest page_id is the response (all of
    them, if rows repeat that id) and the others revisit it. A null payload is empty; a page with a null id is
    always a response.
    """
    ts = F.lit("2000-01-01T00:00:00Z") if ts is None else ts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path)
        store.create_dir(where, recursive=True)
        out, name, records, size = None, "", 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            store.move(f"{where}/_{name}", f"{where}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], names=["archive", "records", "bytes"])

        for batch in batches:
            for record in batch.column("record"):
                if out is not None and (records >= archive_rows or size >= archive_bytes):
                    yield ended()
                    out = None
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{where}/_{name}", compression=None)
                pack = zlib.compressobj(wbits=31)
                member = pack.compress(record.as_py()) + pack.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            yield ended()

    return written(records(pages, id_col, url_col, html_col, ts).select("record").mapInArrow(run, "archive string, records long, bytes long"), "archives")


def members(stream) -> Iterator[tuple[bytes, int, int]]:
    """Each gzip member of a stream, decompressed, with its offset and length; one is in memory at a time."""
    rest, at = stream.read(CHUNK), 0
    while rest:
        d, parts, size = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not rest:
                raise ValueError(f"broken archive at {at}")
            parts.append(d.decompress(rest))
            size += len(rest) - len(d.unused_data)
            rest = d.unused_data or stream.read(CHUNK)
        yield b"".join(parts), at, size
        at += size


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body, size = end + 4, int(head["Content-Length"])
    if not lines[0].startswith("WARC/") or data[body + size :] != b"\r\n\r\n":
        raise ValueError("broken record")
    return head, data[body : body + size]


def read_record(path: str, archive: str, offset: int, record_length: int) -> tuple[dict, bytes]:
    """Headers and block of one record, by its place in the index."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{where}/{archive}") as f:
        return parse(zlib.decompress(f.read_at(record_length, offset), 31))


def read_index(archives: DataFrame, path: str) -> DataFrame:
    """The captures of the listed archives below ``path``, one run for each archive in order of url key, timestamp and page; payloads are checked against their digests."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    tasks = max(1, archives.count())  # an archive is a task's work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        schema = pa.schema([(n, pa.string() if "string" in c else pa.int64()) for n, c in zip(names, ENTRY.split(", "), strict=True)])
        number = lambda x: int(x[10:-1]) if x and x != "<urn:page:null>" else None
        store, where = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                out = []
                with store.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for data, at, size in members(stream):
                        head, block = parse(data)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError(f"digest of record at {at} in {name}")
                        out.append((head["X-Url-Key"], head["WARC-Date"], number(head["WARC-Record-ID"]), head["WARC-Type"], int(head["WARC-Payload-Length"]), digest, number(head.get("WARC-Refers-To")), name, at, size))
                out.sort(key=capture_order)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return archives.select("archive").repartition(tasks).mapInArrow(run, ENTRY)


def capture_order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that a step replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.front = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for r in range(self.k):
            self._replay(r)

    def _beats(self, x: int, y: int) -> bool:
        if y < 0:  # an empty place wins while the tree is filled
            return False
        if x < 0:
            return True
        if self.front[x] is None or self.front[y] is None:
            return self.front[y] is None and (self.front[x] is not None or x < y)
        return (self.front[x], x) < (self.front[y], y)

    def _replay(self, r: int) -> None:
        node = (r + self.k) // 2
        while node > 0:
            if self._beats(self.tree[node], r):
                self.tree[node], r = r, self.tree[node]
            node //= 2
        self.tree[0] = r

    def __iter__(self):
        if not self.k:
            return
        while self.front[w := self.tree[0]] is not None:
            run = self.runs[w]
            yield run[self.at[w]]
            self.at[w] += 1
            self.front[w] = self.key(run[self.at[w]]) if self.at[w] < len(run) else None
            self._replay(w)


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures with ``part`` and ``position``: ordered by both they are in order of url key, timestamp and page.

    Runs are the archives. Splitters come from a sample of about ``SAMPLED`` captures a range, chosen by a hash; they only
    balance the ranges (one of three times the size is rare). The driver sorts them: one key for 12,500 captures, so
    160,000 keys for the two billion captures of 100 TB. They are captures, not url keys, so that a url with very
    many captures spans several ranges.
    """
    total = index.count()
    parts = max(1, -(-total // range_rows))
    names = index.columns
    splitters: list[tuple] = []
    if parts > 1:
        share = min(1.0, SAMPLED * parts / total)
        sample = index.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        keys = sorted(capture_order(tuple(r)) for r in sample.collect())
        splitters = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            runs: dict[str, list] = {}
            for r in rows:
                runs.setdefault(r[7], []).append(r)
            out = []
            for name, run in runs.items():
                order = [capture_order(r) for r in run]
                if any(x > y for x, y in zip(order, order[1:])):  # noqa: B905  an archive's rows may come in several batches
                    run, order = [r for _, r in sorted(zip(order, run, strict=True))], sorted(order)
                ends = [0, *(bisect.bisect_left(order, s) for s in splitters), len(run)]
                out += [(k, name, [dict(zip(names, r, strict=True)) for r in run[a:b]]) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]  # noqa: B905
            kind = pa.list_(pa.struct([(n, t) for n, t in zip(names, batch.schema.types, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], kind)], names=["part", "run", "entries"])

    def merge(table: pa.Table) -> pa.Table:
        runs = [[tuple(e[n] for n in names) for e in entries] for entries in table.column("entries").to_pylist()]
        merged = list(LoserTree(runs, capture_order))
        types = table.schema.field("entries").type.value_type
        columns = [pa.array(list(x), types.field(n).type) for n, x in zip(names, zip(*merged, strict=True), strict=True)]
        part = table.column("part")[0].as_py()
        return pa.table([pa.array([part] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()), *columns], names=["part", "position", *names])

    pieces = index.mapInArrow(cut, f"part int, run string, entries array<struct<{', '.join(c.replace(' ', ': ') for c in ENTRY.split(', '))}>>")
    return pieces.groupBy("part").applyInArrow(merge, f"part int, position long, {ENTRY}")


def capture_histories(pages: DataFrame, ts: Column | None = None, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages' archives, reads them back and returns the merged index: one row for each page.

    ``place`` is the number of a capture in the order of all (from 0). An empty table gives no archives and an empty
    index. Repeated rows are records of their own. Other columns are ignored; ids are any long numbers.
    """
    path = path or shared_path(pages.sparkSession, "warc")
    archives = write_archives(pages, path, ts=ts, **columns)
    merged = written(merge_index(written(read_index(archives, path), "index")), "merged")
    # A row for each range; the window over them is one task's work.
    starts = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    return merged.join(starts, "part").select((F.col("begin") + F.col("position")).alias("place"), *merged.columns)
