"""WARC archives as a PySpark data source, reader and writer.

Writer: tasks write records, each gzip member by itself, and note where records begin. The
driver's commit publishes one manifest with the files of the successful tasks, their sizes
and those places; nothing is renamed. A file that no manifest names is one of a lost,
retried or speculative attempt and is never read, whole or truncated.
Reader: where there are manifests, exactly their files are read; in a folder of foreign
archives all ``*.warc`` and ``*.warc.gz`` whose names begin with neither ``_`` nor ``.``.
Files are dealt out as partitions of about equal bytes; a large one is split where records
begin, foreign ones once ``indexed`` has written a manifest for them. Equality and ``IN``
filters on ``record_type`` and header columns are pushed down; of a record the header is
parsed first, and the block of a record that a predicate rejects is passed over undecoded.
With option ``payload=false`` no payload is decoded at all.

``record_type`` is response or revisit. A revisit has the HTTP header of its response
but no payload; its ``Content-Length`` there still tells the payload's length.

Rows learn the first id of their payload by digest and salt, so that a payload of very
many rows (empty pages) is spread over tasks; what is grouped has ids and digests only.

Defined results: a null payload is an empty one; null URLs are left out of the header;
records of equal payloads revisit that with the smallest id; rows that repeat that very
id are responses too; a null id is written without number and revisits a numbered one; very
long payloads are written and read whole, one at a time; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stepforge.llm.common import dropped, facts_of, salts, scratch, ship, table, written

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Header fields of the columns that can be told from a record's header alone.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Fixed value: the profile of revisits by equal payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 32 << 20
ROLL_BYTES = 64 << 20
#: Bytes between the places of a file that a partition may begin at.
MARK_BYTES = 4 << 20
READ_BYTES = 1 << 18
#: Rows of a payload that one task gets.
SALT_ROWS = 1_000_000
MANIFEST = "_manifest-"
#: The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, payload: bytes, length: int, digest: str, uri: str | None, refers_to: str | None, date: str) -> bytes:
    """One record; ``payload`` is empty and ``length`` that of the response for revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    if uri is not None:
        fields.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return b"".join((head.encode(), http, payload, b"\r\n\r\n"))


class Stream:
    """Bytes of a file from a place on, gzip members joined, of which parts can be skipped."""

    def __init__(self, path: str, start: int = 0):
        fs, name = opened(path)
        self.file, self.at = fs.open_input_file(name), start
        if start:
            self.file.seek(start)
        self.buffer, self.zipped, self.inflate, self.rest = bytearray(), name.endswith(".gz"), None, b""

    def pulled(self) -> bytes:
        data = self.file.read(READ_BYTES)
        self.at += len(data)
        return data

    def more(self) -> bool:
        if not self.zipped:
            data = self.pulled()
            self.buffer += data
            return bool(data)
        data, self.rest = self.rest or self.pulled(), b""
        if not data:
            if self.inflate is not None:
                raise EOFError("a gzip member is cut off")
            return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(data)
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, None
        return True

    def place(self) -> int | None:
        """Where in the file reading could begin anew; none inside of a gzip member."""
        if not self.zipped:
            return self.at - len(self.buffer)
        while not self.buffer and self.inflate is not None and self.more():
            pass
        return None if self.buffer or self.inflate is not None else self.at - len(self.rest)

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise EOFError("a record ends before its length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, n: int) -> None:
        while n:
            k = min(n, len(self.buffer))
            del self.buffer[:k]
            n -= k
            if n and not self.more():
                raise EOFError("a record ends before its length")


def records(path: str, wanted, payload: bool = True, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """Rows of one file, or of its records that begin from ``start`` to ``end``, of which
    ``wanted(header columns)`` holds."""
    stream = Stream(path, start)
    while end is None or (at := stream.place()) is None or at < end:
        if (head := stream.until(b"\r\n\r\n")) is None:
            return
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        row = {c: fields.get(f.lower()) for c, f in FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        length = int(fields["content-length"])
        if not wanted(row):
            stream.skip(length + 4)
            continue
        row |= {"payload_length": None, "payload": None}
        if not payload or row["record_type"] not in ("response", "revisit"):
            stream.skip(length + 4)
        else:
            http, _, body = stream.take(length).partition(b"\r\n\r\n")
            stream.skip(4)
            said = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            row["payload_length"] = len(body) if row["record_type"] == "response" else int(said[0]) if said else None
            if row["record_type"] == "response":
                row["payload"] = body
                if row["payload_digest"] not in (None, f"sha1:{sha1_base32(body)}"):
                    raise ValueError(f"{row['record_id']}: the payload does not have its digest")
        yield row


def marks(path: str) -> tuple[int, list[int]]:
    """Size of a file and the places, ``MARK_BYTES`` apart or more, where reading can begin."""
    stream, found = Stream(path), [0]
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
        stream.skip(int(fields["content-length"]) + 4)
        if (at := stream.place()) is not None and at - found[-1] >= MARK_BYTES:
            found.append(at)
    return stream.at, [m for m in found if m < stream.at] or [0]


def published(path: str, files: list[tuple[str, int, list[int]]]) -> None:
    """Write a manifest: its name stands only once all of it is there."""
    system, name = opened(path)
    system.create_dir(name, recursive=True)
    end = f"{uuid.uuid4().hex}.json"
    with system.open_output_stream(f"{name}/_temporary-{end}") as out:
        for f in files:
            out.write((json.dumps(f) + "\n").encode())
    system.move(f"{name}/_temporary-{end}", f"{name}/{MANIFEST}{end}")


def listed(path: str) -> list[tuple[str, int, list[int]]]:
    """(name, size, places to begin at) of the archives of a folder, or of one file."""
    from pyarrow import fs

    system, name = opened(path)
    top = system.get_file_info(name)
    if top.type == fs.FileType.File:
        return [(name, top.size, [0])]
    found = [f for f in system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True)) if f.is_file]
    manifests = [f for f in found if f.base_name.startswith(MANIFEST)]
    out = []
    for f in manifests:
        with system.open_input_stream(f.path) as lines:
            for line in lines.read().decode().splitlines():
                own, size, at = json.loads(line)
                out.append((f"{f.path.rpartition('/')[0]}/{own}", size, at))
    if not manifests:
        out = [(f.path, f.size, [0]) for f in found if f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))]
    return sorted(out)


class Files(InputPartition):
    """Pieces of files: (path, start, end)."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        super().__init__(0)
        self.pieces = pieces


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.payload, self.names = options["path"], options.get("payload", "true").lower() != "false", schema.names
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.equal.append((f.attribute[0], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        scheme = f"{self.path.partition('://')[0]}://" if "://" in self.path else "file://" if self.path.startswith("file:") else ""
        out, held = [], 0
        for name, size, at in listed(self.path):
            name = scheme + (name if scheme in ("", "file://") else name.lstrip("/"))
            start = 0
            while start < size or not start:
                # The last place within what the partition still has room for; the next
                # one where there is none.
                room = self.split - held if out else self.split
                ends = [m for m in at if start < m]
                end = next((m for m in reversed(ends) if m - start <= room), ends[0] if ends else size) if size - start > room else size
                if not out or held and held + end - start > self.split:
                    out.append(Files([]))
                    held = 0
                out[-1].pieces.append((name, start, end if end < size else None))
                held += end - start
                if end >= size:
                    break
                start = end
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted = lambda row: all(row[c] in values for c, values in self.equal)
        types = {n: pa.string() for n in FIELDS} | {"payload_length": pa.int64(), "payload": pa.binary()}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in self.names], names=self.names)

        rows, held = [], 0
        for path, start, end in partition.pieces:
            for row in records(path, wanted, self.payload, start, end):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) == 1000 or held > 16 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, list[int]]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Columns record_id, record_type, target_uri, payload_digest, refers_to,
    payload_length and payload; written as gzip members unless ``compress=false``."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.zipped = options.get("compress", "true").lower() != "false"
        self.roll = int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, name = opened(self.path)
        system.create_dir(name, recursive=True)
        files: list[list] = []
        out = None
        try:
            for b in iterator:
                # Row by row, so that one long payload at a time is copied.
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    if out is None or files[-1][1] > self.roll:
                        if out:
                            out.close()
                        files.append([f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped, 0, [0]])
                        out = system.open_output_stream(f"{name}/{files[-1][0]}", compression=None)
                    now = files[-1]
                    if now[1] - now[2][-1] >= MARK_BYTES:
                        now[2].append(now[1])
                    data = record(r["record_type"], r["record_id"], r["payload"] or b"", r["payload_length"], r["payload_digest"], r["target_uri"], r["refers_to"], self.date)
                    if self.zipped:
                        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = pack.compress(data) + pack.flush()
                    out.write(data)
                    now[1] += len(data)
            if out:
                out.close()
        except BaseException:
            # What a killed process leaves behind no manifest names.
            if out:
                out.close()
            self.removed(system, name, files)
            raise
        return Written([tuple(f) for f in files])

    def removed(self, system, name: str, files) -> None:
        for f in files:
            try:
                system.delete_file(f"{name}/{f[0]}")
            except FileNotFoundError:
                continue

    def commit(self, messages: list[Written | None]) -> None:
        published(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages: list[Written | None]) -> None:
        system, name = opened(self.path)
        for m in messages:
            self.removed(system, name, m.files if m else [])


class WarcDataSource(DataSource):
    """Format ``warc``: options path, payload, split_bytes; date, compress, roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def base32_of_hex(column):
    """Upper-case base32 of a hex SHA-1: each five hex digits are four of base32."""
    digit = lambda i, s: F.substr(F.lit(BASE32), (F.shiftright(F.conv(F.substr(column, F.lit(5 * i + 1), F.lit(5)), 16, 10).cast("int"), s).bitwiseAND(31) + 1), F.lit(1))
    return F.concat(*(digit(i, s) for i in range(8) for s in (15, 10, 5, 0)))


def archived(df: DataFrame, folder: str, key: str = "page_id", uri: str | None = "url", payload: str = "html", least: int = 0, prefix: str = "urn:stepforge:page:") -> None:
    """Write a record for each row; equal payloads of ``least`` bytes or more revisit the
    one with the smallest key."""
    spark = df.sparkSession
    register(spark)
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("long").alias("k"), (F.col(uri).cast("string") if uri else F.lit(None).cast("string")).alias("target_uri"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body")).withColumn("salt", F.pmod(F.xxhash64("k", "target_uri"), F.lit(salts(df, SALT_ROWS))))
    first = facts_of(rows.where(F.octet_length("body") >= least), ["sha1"], first="min(k)")
    joined = rows.join(first, ["sha1", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("k"))
    name = lambda c: F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("")))
    out = joined.select(
        name(F.col("k")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("string").alias("warc_date"),
        base32_of_hex(F.col("sha1")).alias("payload_digest"),
        F.when(again, name(F.col("first"))).alias("refers_to"),
        F.octet_length("body").cast("long").alias("payload_length"),
        F.when(~again, F.col("body")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("path", folder).save()


def archive(spark, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=folder, **options).load()


def indexed(spark, folder: str, least: int = SPLIT_BYTES) -> None:
    """Write a manifest for a folder of foreign archives, so that large ones are split where
    their records begin. Each file of more than ``least`` bytes is passed over once, as a
    task of its own."""
    register(spark)
    files = listed(folder)
    top = opened(folder)[1].rstrip("/")
    prefix = folder[: len(folder.rstrip("/")) - len(top)] if folder.rstrip("/").endswith(top) else ""
    large = [f[0] for f in files if f[1] > least]
    found = {name: [name, size, [0]] for name, size, _ in files}

    def run(batches):
        for b in batches:
            rows = [(n, *marks(prefix + n)) for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["name", "size", "at"])

    if large:
        rows = spark.createDataFrame([(n,) for n in large], "name string").repartition(len(large)).mapInArrow(run, "name string, size long, at array<long>")
        found |= {r.name: list(r) for r in rows.toLocalIterator()}
    published(folder, [(name[len(top) :].lstrip("/"), size, list(at)) for name, size, at in found.values()])


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back; they go once they are read."""
    folder = scratch(spark, "warc")
    archived(table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    back = archive(spark, folder).select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
    found, _ = written(back, "warc-rows")
    dropped(spark, folder)
    return found


_DIGITS = " || ".join(f"substr('{BASE32}', 1 + (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT) >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
