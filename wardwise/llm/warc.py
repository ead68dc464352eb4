"""WARC archives: a Spark text sink, and a Python data source that reads headers first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from wardwise.llm.common import Steps

#: The base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Columns that hold a header's value, which predicates can be pushed to.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def base32_sha1(payload):
    """Bare upper-case base32 SHA-1 of a string column, from its hexadecimal form: five digits give four letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Which pages are archived in full and which revisit an equal payload.

    Returns page_id, url, html (NULL: empty), payload_bytes, payload_digest, record_type and refers_to. Of pages with
    equal payloads of at least ``min_bytes`` bytes the one of smallest page_id is a response; rows that repeat its page_id are
    responses too. A page without page_id is always a response and is never referred to.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html"))})
    groups = pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(html).alias("payload_digest")).groupBy("payload_digest")
    first = groups.agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("payload_digest", "first")
    # Stored, so that the planner knows how many payloads repeat: pages are shuffled only where that is much.
    first = Steps(pages.sparkSession, "payloads").write(first, "first")
    joined = rows.join(first, "payload_digest", "left")
    revisit = (F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= min_bytes)
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _one_line(value):
    """A header's value: line ends would end the header."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes one WARC record for each planned row, into as many files as there are tasks.

    A record is one line of Spark's text sink with the record's own end as line separator, so files are committed as any
    other table and any file system of Spark's can hold them. A revisit has no block; its own headers tell the length of the payload.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    id_of = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", id_of(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), F.coalesce(line("WARC-Target-URI", _one_line(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", id_of(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    )
    body = F.when(revisit, "").otherwise(F.col("html"))
    records.select(F.concat(header, F.lit("\r\n"), body)).write.option("lineSep", END).text(path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.wanted: dict[str, set[str]] = {}
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.target = int(options.get("partitionbytes", 64 << 20))

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if column in HEADERS and all(isinstance(v, str) for v in values):
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def _filesystem(self):
        import pyarrow.fs as fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        """Whole files, small ones together up to about the wanted size."""
        import pyarrow.fs as fs

        store, root = self._filesystem()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.size)
        groups, room = [], 0
        for name, size in files:
            if not groups or size > room:
                groups.append([])
                room = self.target
            groups[-1].append((name, size))
            room -= size
        return [_Files(g) for g in groups]

    def read(self, partition):
        store, _ = self._filesystem()
        for name, _ in partition.files if partition else ():  # no files: Spark plans one empty partition
            with store.open_input_file(name) as raw:
                yield from self._records(raw)

    def _records(self, raw):
        """Reads a record's headers, then either its block or, if it is not wanted, just past it."""
        size = raw.size()
        at, buffer, base = 0, b"", 0  # buffer holds the file's bytes from base on
        while at < size:
            head = -1
            while head < 0:
                head = buffer.find(b"\r\n\r\n", at - base) if base <= at < base + len(buffer) else -1
                if head < 0:
                    if base <= at:
                        buffer = buffer[at - base :] if at - base < len(buffer) else b""
                    base = at
                    raw.seek(base + len(buffer))
                    more = raw.read(1 << 16)
                    if not more:
                        raise ValueError(f"a WARC record at byte {at} has no end of headers")
                    buffer += more
            lines = buffer[at - base : head].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start, length = head + 4 + base, int(fields["content-length"])
            at = start + length + 4
            values = {c: fields.get(h) for c, h in HEADERS.items()}
            if values["payload_digest"]:
                values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
            if any(values[c] not in ok for c, ok in self.wanted.items()):
                continue
            payload = None
            if self.payload:
                have = buffer[start - base : start - base + length]
                if len(have) < length:
                    raw.seek(start + len(have))
                    have += raw.read(length - len(have))
                payload = have
            total = fields.get("warc-payload-length")
            yield (*(values[c] for c in HEADERS), int(total) if total else length, payload)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option payload=false leaves blocks unread."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records of all archives below ``path``; equality and IN predicates on header columns are pushed into the source."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitionBytes", str(partition_bytes)).load(path)


def page_of(record_id):
    """The page_id in a record's id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
