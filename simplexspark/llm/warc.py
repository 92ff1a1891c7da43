"""WARC archives as a PySpark data source, and revisit records for equal payloads.

``spark.read.format("warc")`` plans whole files to partitions of about ``maxPartitionBytes``. Filters on the record type and
on headers are pushed down: a task parses the headers of a record first, and passes over the block of a record that is not
wanted without decoding it (by a seek where the archive is not compressed). ``option("payload", "false")`` passes over all
blocks. Records of other software are read too; what is not HTTP is given whole.

Tasks write into a folder of the job, one or more files each; the driver moves them into place when all have succeeded, so
failed and repeated attempts leave nothing behind.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, date string, target_uri string, payload_digest string, refers_to string, "
          "payload_length long, payload binary")
#: The header that holds each column, and the profile of a revisit.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARROW = pa.schema([*[(c, pa.string()) for c in HEADERS], ("payload_length", pa.int64()), ("payload", pa.binary())])
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], schema.names, self.options.get("compression", "gzip"))


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("maxPartitionBytes", 64 << 20))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of one header column with values; leaves the others to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        store, root = open_store(self.path)
        found = store.get_file_info(root)
        files = [found] if found.is_file else [x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.base_name[0] not in "._"]
        parts: list[Files] = []
        size = self.most
        for x in sorted((x for x in files if x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
            if size + x.size > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(x.path)
            size += x.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            for row in self.records(store, path):
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def records(self, store: fs.FileSystem, path: str) -> Iterator[dict]:
        with store.open_input_file(path) as raw:
            packed = path.endswith(".gz")
            source = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if packed else io.BufferedReader(raw, 1 << 20)
            while line := source.readline():
                if not line.strip():
                    continue  # the two line ends after a record
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record begins with {line[:40]!r}")
                headers = header_fields(source)
                length = int(headers["content-length"])
                row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                if not all(fits(f, row[f.attribute[0]]) for f in self.wanted) or not self.with_payload:
                    if all(fits(f, row[f.attribute[0]]) for f in self.wanted):
                        yield row | {"payload_length": None, "payload": None}
                    pass_over(source, length, packed)
                    continue
                block = source.read(length)
                if len(block) < length:
                    raise ValueError(f"{path}: record {row['record_id']} is cut off")
                payload, declared = block, length
                if headers.get("content-type", "").startswith("application/http"):
                    top, _, payload = block.partition(b"\r\n\r\n")
                    http = header_fields(io.BytesIO(top.partition(b"\r\n")[2]))
                    declared = int(http.get("content-length", len(payload)))
                yield row | {"payload_length": declared, "payload": None if row["record_type"] == "revisit" else payload}


def header_fields(source) -> dict[str, str]:
    fields = {}
    while (line := source.readline()).strip(b"\r\n"):
        name, _, value = line.rstrip(b"\r\n").partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.removeprefix(b" ").decode("utf-8", "replace")
    return fields


def pass_over(source, n: int, packed: bool) -> None:
    if not packed:
        source.seek(n, io.SEEK_CUR)
        return
    while n > 0:
        got = len(source.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("the last record is cut off")
        n -= got


def fits(f: Filter, value: str | None) -> bool:
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else True


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], compression: str) -> None:
        self.path, self.names = path, names
        self.ending = "warc.gz" if compression == "gzip" else "warc"
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        folder = posixpath.join(root, self.job)
        store.create_dir(folder, recursive=True)
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in pa.RecordBatch.from_arrays(batch.columns, names=self.names).to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    paths.append(posixpath.join(folder, f"part-{uuid.uuid4().hex}.{self.ending}"))
                    out, size = store.open_output_stream(paths[-1], compression=None), 0
                record = record_bytes(row)
                if self.ending.endswith("gz"):
                    record = gzip.compress(record, compresslevel=4, mtime=0)  # a member for each record
                out.write(record)
                size += len(record)
        if out:
            out.close()
        return Written(paths)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            for p in m.paths if m else []:
                store.move(p, posixpath.join(root, posixpath.basename(p)))
        self.drop(store, root)

    def abort(self, messages) -> None:
        self.drop(*open_store(self.path))

    def drop(self, store: fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, self.job)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def one_line(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def record_bytes(row: dict) -> bytes:
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    declared = len(payload) if row.get("payload_length") is None else row["payload_length"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % declared + (b"" if revisit else payload)
    head = [b"WARC/1.1"] + [h.encode() + b": " + one_line(row[c]) for c, h in HEADERS.items() if row[c] is not None]
    if revisit:
        head.append(b"WARC-Profile: " + SAME_PAYLOAD.encode())
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def web_records(df: DataFrame, id_col: str, url_col: str, payload: Column, urn: str, least: int = 100,
                date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One record per row. Of rows with equal payloads of at least ``least`` bytes, those with the smallest id are
    responses and the others revisit them; shorter payloads are always responses. Null payloads are empty; null ids come
    after all others, and where a payload has no other row they are responses. Rows repeated in id and payload are one
    page seen twice: both are responses, or both revisit the same one.

    Only payloads that do repeat enter the joined table, one row each, counted before the shuffle.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(firsts.select(F.col("digest").alias("of"), "first"), F.col("digest") == F.col("of"), "left")
    again = F.coalesce((F.col("payload_length") >= least) & (F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())), F.lit(False))
    name = lambda c: F.concat(F.lit(f"<urn:{urn}:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(name("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit(date).alias("date"),
                         "target_uri", F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(again, name("first")).alias("refers_to"),
                         "payload_length", F.when(~again, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records (columns of ``SCHEMA``) as archives under ``path``; rows keep no order across files."""
    records.sparkSession.dataSource.register(WarcSource)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    records.select(*names).write.format("warc").mode("append").option("compression", compression).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``; a folder without archives gives none. A filter on header columns reaches the tasks if
    ``spark.sql.python.filterPushdown.enabled`` is true when the DataFrame is planned, which this call sees to."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
