"""Dictionary-compressed WARC archives.

Each task turns its pages into WARC/1.1 records and writes them to archives of bounded size in the shared folder: a
leading skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the archive's own records, then
one Zstandard frame a record. The dictionary is trained on pieces of whole records, spread evenly over the archive; where the
trainer finds too little to count (a few records, or hardly any bytes), the pieces themselves are the dictionary, so that
every archive has one. Payloads of at least REVISIT bytes that occur more than once are stored once, with the smallest
page_id; the others become revisit records that name it. A response's block is an HTTP message, as
the format says: a status line and headers of its own, then the page.

Reading back uses Spark's binaryFile source; sizes and digests of payloads are those of the stored payloads, checked
against the headers, and a revisit is held against the stored record that it names: none, or one of another digest, fails the
read.

Defined results: a null html is the empty payload; shorter payloads are all responses; rows with equal page_id and equal
payload beyond the first are revisits of themselves; rows with a null page_id come last in the order and their id reads
back as null, and a payload that only such rows have is stored with each; no rows give no archives and no rows; other
columns, whatever their names, are left out. Each record has an id of its own, also among equal rows. Archives are written
under temporary names and renamed, so a repeated task leaves whole files only; the table of archives names those that count.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, only, trim, written

REVISIT = 100
#: Raw bytes of records in one archive, about; of what a dictionary is trained on; of one piece of that; of a dictionary.
ARCHIVE, TRAIN, PIECE, DICTIONARY = 16 << 20, 4 << 20, 16 << 10, 64 << 10
LEVEL = 3
SKIPPABLE = 0x184D2A5D
EOL = b"\r\n"
#: A fixed date keeps reruns equal; callers that know when pages were fetched pass their own.
DATE = datetime(2000, 1, 1, tzinfo=UTC)


#: Fixed: the head of the HTTP message around a page.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, digest: str, turn: int | str = 0) -> str:
    """turn: tells records of equal page_id and digest apart; the one that revisits name has 0."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{turn}')}>"


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, turn: int | str = 0, date: datetime = DATE) -> bytes:
    """One WARC record: headers, blank line, block, two line ends. A revisit's block is the HTTP head alone."""
    head = HTTP % len(payload)
    block = head + payload if kind == "response" else head
    heads = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, turn)), ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        heads.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        heads.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        heads.append(("WARC-Refers-To", record_id(refers, digest)))
        heads.append(("X-Refers-To-Page-ID", str(refers)))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in heads) + EOL + block + EOL + EOL


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(EOL + EOL)
    lines = head.split(EOL)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    heads = dict(x.decode("utf-8", "replace").split(": ", 1) if b": " in x else (x.decode("utf-8", "replace").rstrip(":"), "") for x in lines[1:])
    return heads, rest[: int(heads["Content-Length"])]


def parse_http(block: bytes) -> tuple[int, bytes]:
    """The length that an HTTP message's head states, and its body."""
    head, _, body = block.partition(EOL + EOL)
    return int(next(x.split(b":")[1] for x in head.split(EOL) if x.lower().startswith(b"content-length:"))), body


def build_dictionary(records: list[bytes]) -> bytes:
    """From records of any number and size: trained, or else the pieces as they are (a dictionary of raw content)."""
    step = max(1, -(-sum(map(len, records)) // TRAIN))
    # of long archives every step-th piece, so that each record of some length has its part
    pieces = [r[at : at + PIECE] for r in records for at in range(0, len(r), PIECE)][::step]
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1 << 10, total // 16)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


class Archive:
    """Collects the records of one archive, builds its dictionary from them, and compresses each on its own."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.raw = 0

    def add(self, record: bytes) -> None:
        self.raw += len(record)
        self.waiting.append(record)

    def close(self) -> bytes:
        dictionary = build_dictionary(self.waiting)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        out = io.BytesIO()
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        for r in self.waiting:
            out.write(compressor.compress(r))
        return out.getvalue()


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = reader.decompressobj()
        raw = one.decompress(rest)
        yield parse_record(raw)
        rest = rest[len(rest) - len(one.unused_data) :]


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to: null for a response, else the page_id of the response that the record repeats.

    Payloads meet as digests only, counted before they move. The table of digests that occur twice or more is written to
    the shared folder, so that Spark knows its size: small, it is broadcast and no page moves; large, it is joined by
    digest and Spark splits the rows of a payload that very many pages share.
    """
    own = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    raw = F.encode("html", "utf-8")
    marked = own.withColumn("digest", F.when(F.octet_length("html") >= REVISIT, F.sha2(raw, 256)))
    by_page = marked.where("digest is not null").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    by_digest = by_page.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("n", "page_id").alias("n_first"), F.sum("n").alias("n"))
    groups = written(by_digest.where("n > 1 and first is not null").select("digest", "first", "n_first"), "warc-digests")
    joined = marked.join(groups, "digest", "left")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    if not groups.where("n_first > 1").take(1):
        return joined.select("page_id", "url", "html", again.alias("refers_to"))
    # the same page came more than once: one of its rows is the response
    several = F.coalesce((F.col("page_id") == F.col("first")) & (F.col("n_first") > 1), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
    same = joined.where(several).withColumn("k", turn).select("page_id", "url", "html", F.when(F.col("k") > 1, F.col("first")).alias("refers_to"))
    return joined.where(~several).select("page_id", "url", "html", again.alias("refers_to")).unionByName(same)


def write_archives(planned: DataFrame, folder: str, date: datetime = DATE) -> DataFrame:
    """Writes the archives; a row (path, records) for each that counts. Computed once: the table is written too.

    Archives are written by pyarrow's filesystem of the folder's URI, which all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        names, counts, task = [], [], TaskContext.get().partitionId()

        def put(a: Archive) -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = a.close()
            with fs.open_output_stream(f"{base}/.{name}.part", compression=None) as f:
                f.write(data)
            fs.move(f"{base}/.{name}.part", f"{base}/{name}")
            names.append(f"{folder}/{name}")
            counts.append(len(a.waiting))

        archive, n = Archive(), 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(j)[k].as_py() for j in range(4))
                payload = html.encode("utf-8", "replace")
                digest = hashlib.sha256(payload).hexdigest()
                kind = "response" if refers is None else "revisit"
                n += 1
                # only a stored payload that others may name has a turn that they know
                turn = 0 if kind == "response" and len(payload) >= REVISIT and page_id is not None else f"{task}.{n}"
                archive.add(record_bytes(kind, page_id, url, payload, digest, refers, turn, date))
                if archive.raw >= ARCHIVE:
                    put(archive)
                    archive = Archive()
        if archive.waiting:
            put(archive)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(planned.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "warc-archives")


def read_archives(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, refers_id, payload of every record.

    Sizes and digests of responses are those of the stored payloads, revisits state theirs; a damaged record fails the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if listed is not None:
        # one short name for each archive: Spark's own size check says whether they are broadcast
        files = files.join(listed.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_semi")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_id string, payload string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int64()
        kinds = pa.schema([("page_id", number), ("url", text), ("record_type", text), ("payload_bytes", number), ("payload_digest", text), ("refers_to", number), ("record_id", text), ("refers_id", text), ("payload", text)])

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for heads, block in read_archive(content.as_py()):
                    kind, digest = heads["WARC-Type"], heads["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, payload = parse_http(block)
                    if kind == "response":
                        size, stored = len(payload), (size, digest)
                        digest = hashlib.sha256(payload).hexdigest()
                        if stored != (size, digest):
                            raise ValueError(f"{heads['WARC-Record-ID']}: the payload does not fit its length or digest")
                    whole = lambda k: int(heads[k]) if k in heads else None  # noqa: B023, E731
                    rows.append((whole("X-Page-ID"), heads["WARC-Target-URI"], kind, size, digest, whole("X-Refers-To-Page-ID"), heads["WARC-Record-ID"], heads.get("WARC-Refers-To"), payload.decode("utf-8") if kind == "response" else None))
                    held += len(payload)
                    if held >= 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)
        trim()

    return files.select("content").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """records (of read_archives, without payload), each revisit's size and digest taken from the response that it names; one
    that names none, or one of another digest, fails the job."""
    slim = written(records.drop("payload"), "warc-index")
    named = written(slim.where("refers_id is not null").select(F.col("refers_id").alias("n_id")).distinct(), "warc-named")
    stored = slim.where("record_type = 'response'").join(named, F.col("record_id") == F.col("n_id"), "left_semi")
    stored = written(stored.select(F.col("record_id").alias("s_id"), F.col("payload_bytes").alias("s_bytes"), F.col("payload_digest").alias("s_digest")), "warc-stored")
    revisits = slim.where("refers_id is not null").join(stored, F.col("refers_id") == F.col("s_id"), "left")
    fits = F.col("s_digest").eqNullSafe(F.col("payload_digest")) & F.col("s_bytes").eqNullSafe(F.col("payload_bytes"))
    digest = F.when(fits, F.col("s_digest")).otherwise(F.raise_error(F.concat(F.lit("no such response: "), F.col("refers_id"))))
    checked = revisits.withColumn("payload_digest", digest).withColumn("payload_bytes", F.col("s_bytes")).select(*slim.columns)
    return slim.where("refers_id is null").unionByName(checked)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: one row a page."""
    spark = pages.sparkSession
    folder = fresh(spark, "warc")
    archives = write_archives(plan(pages), folder)
    if not archives.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolved(read_archives(spark, folder, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
