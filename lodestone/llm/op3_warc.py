"""WARC with a monolithic gzip normaliser.

Pages become WARC/1.1 records in archives of one gzip stream each; the normaliser inflates such a file once,
from front to back, writes every record anew as a gzip member of its own and lists the members' offsets in
a sidecar file; the reader fetches each record by its offset. Files are written through Arrow's file systems
into the shared folder under names of one task attempt, and a table of the finished files decides which
count, so a task that is run again after a lost executor leaves no double.

Of records with equal payloads of at least min_revisit bytes the one with the smallest id is a response and
the rest are revisits of it. Payloads are streamed: memory holds a page when it is written or read, and a
chunk or two when archives are normalised, of records of any size.

Defined results: a null page is an empty payload; a null URL is left out of its record; rows that repeat an id
and a payload are one record's copies and all of the first one's type; a null id is a revisit if any other
row has its payload; extra columns are not read; an empty table gives no archives and no rows.
"""

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stored, give_back, read_table, shared_dir, stored

NAME = "op3_warc_normalise"
CHUNK = 1 << 20
#: Bytes of records after which a task begins another archive.
ROLL = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "path string, records bigint"
_PAGES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _fs(uri):
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id, url, payload: bytes, refers_to=None, revisit=False) -> bytes:
    """One record: a response with its payload, or a revisit with only the response's HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if id is None else id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Type, id, payload digest, payload size and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None
    return {
        "type": fields["WARC-Type"],
        "id": number(fields["WARC-Record-ID"]),
        "refers_to": number(fields.get("WARC-Refers-To", "")),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "size": size,
        "payload": payload,
    }


def _write(folder, level):
    """Archives of one gzip stream each."""

    def run(batches):
        fs, root = _fs(folder)
        out = press = path = None
        size = records = 0
        done = []

        def close():
            out.write(press.flush())
            out.close()
            done.append((path, records))

        for batch in batches:
            for id, url, html, refers_to, revisit in zip(*(c for c in batch.columns)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, press, size, records = fs.open_output_stream(path, compression=None), zlib.compressobj(level, wbits=31), 0, 0
                data = record(id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), revisit.as_py())
                out.write(press.compress(data))
                size, records = size + len(data), records + 1
                if size >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return run


def _inflated(stream):
    """The bytes of a gzip file of any number of members, CHUNK at a time however well they were packed."""
    press, data = zlib.decompressobj(wbits=31), b""
    while data or (data := stream.read(CHUNK >> 4)):
        if press.eof:
            press = zlib.decompressobj(wbits=31)
        if out := press.decompress(data, CHUNK):
            yield out
        data = press.unused_data if press.eof else press.unconsumed_tail
    while not press.eof and (out := press.decompress(b"", CHUNK)):
        yield out


class _Bytes:
    """A stream of chunks, read up to a mark or by size without copying what follows."""

    def __init__(self, parts):
        self.parts, self.held, self.at = parts, b"", 0

    def more(self) -> bool:
        """Whether another chunk came; what is left of the last one, less than a record's head, is put before it."""
        part = next(self.parts, None)
        if part is not None:
            self.held, self.at = self.held[self.at :] + part, 0
        return part is not None

    def head(self):
        """Bytes up to and with the next empty line; None at the end."""
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                return self.held[self.at :] or None
        out, self.at = self.held[self.at : end + 4], end + 4
        return out

    def body(self, size: int):
        """The next size bytes, in pieces."""
        while size:
            if self.at == len(self.held) and not self.more():
                raise ValueError("the archive ends within a record")
            piece = memoryview(self.held)[self.at : self.at + size]
            self.at, size = self.at + len(piece), size - len(piece)
            yield piece


def _normalise(folder, level):
    """Each archive anew, a member for each record, with a sidecar of offsets."""

    def run(batches):
        fs, root = _fs(folder)
        for batch in batches:
            for source, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                at, index = 0, []
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(path, compression=None) as out:
                    data = _Bytes(_inflated(stream))
                    while (head := data.head()) is not None:
                        left = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0]) + 4
                        press, size = zlib.compressobj(level, wbits=31), 0
                        for x in (press.compress(head), *map(press.compress, data.body(left)), press.flush()):
                            out.write(x)
                            size += len(x)
                        index.append(f"{at}\t{size}\n")
                        at += size
                if len(index) != records:
                    raise ValueError(f"{source} holds {len(index)} records, not {records}")
                with fs.open_output_stream(f"{path}.idx", compression=None) as out:
                    out.write("".join(index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([records], pa.int64())], ["path", "records"])
        give_back()

    return run


def _deleted(folder):
    """Deletes the named files themselves, nothing beside them; one that is gone already is no error."""

    def run(batches):
        fs, _ = _fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
                    fs.delete_file(path)
            yield batch

    return run


def _read(folder, payloads):
    def run(batches):
        fs, _ = _fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = [tuple(map(int, x.split(b"\t"))) for x in f.read().splitlines()]
                with fs.open_input_file(path) as f:
                    for k in range(0, len(index), 64):
                        rows = []
                        for at, size in index[k : k + 64]:
                            r = parse(zlib.decompress(f.read_at(size, at), wbits=31))
                            if r["type"] == "response" and (digest32(r["payload"]), len(r["payload"])) != (r["digest"], r["size"]):
                                raise ValueError(f"{path}: the record at {at} is damaged")
                            rows.append((r["id"], r["size"], r["digest"], r["type"], r["refers_to"], r["payload"] if payloads else None))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _PAGES.split(", ")])

    return run


def _each(files: DataFrame) -> DataFrame:
    """A task for each file, or for a few."""
    n = files.count()
    return files.repartition(max(1, min(n, 10_000)), "path")


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0, level: int = 6) -> DataFrame:
    """Files (path, records) of pages' records, one gzip stream each, revisits told from responses by their payloads."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    fs, root = _fs(folder)
    fs.create_dir(root)
    rows = pages.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    long = F.octet_length("html") >= min_revisit
    keys = rows.where(long).select(F.col("id").alias("k"), F.sha1("html").alias("d"))
    first = stored(keys.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("d", "first"), "op3-first")
    again = stored(keys.join(first, "d").where("NOT k <=> first").distinct(), "op3-revisits")
    same = F.col("id").eqNullSafe(F.col("k")) & (F.sha1("html") == F.col("d")) & long
    rows = rows.join(again, same, "left").select("id", "url", "html", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))
    out = stored(rows.mapInArrow(_write(folder, level), _FILES), "op3-archives")
    drop_stored(first, again)
    return out


def normalise(files: DataFrame, level: int = 6, keep: bool = True) -> DataFrame:
    """Files (path, records) with a member for each record and a sidecar; unless keep, the given files are deleted once all are written anew."""
    folder = f"{shared_dir(files.sparkSession)}/warc-{uuid.uuid4().hex}"
    fs, root = _fs(folder)
    fs.create_dir(root)
    out = stored(_each(files).mapInArrow(_normalise(folder, level), _FILES), "op3-members")
    if not keep:
        files.select("path").mapInArrow(_deleted(folder), "path string").count()
    return out


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised files, each fetched by its offset and checked against its digest."""
    out = _each(files).mapInArrow(_read(shared_dir(files.sparkSession), payloads), _PAGES)
    return out if payloads else out.drop("payload")


def query(spark, sf_dir):
    files = write_archives(read_table(spark, sf_dir, "pages"))
    return read_archives(normalise(files, keep=False), payloads=False)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d),
a AS (SELECT i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i::INT + 1, 1) AS c FROM range(32) r(i)),
b AS (SELECT d, list_transform(range(32), lambda k: list_reduce(list_transform(range(5), lambda j: ((('0x' || substr(d, ((5 * k + j) // 4)::INT + 1, 1))::INT >> (3 - (5 * k + j) % 4)::INT) & 1)::INT), lambda x, y: 2 * x + y)) AS g FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1), '' ORDER BY o) FROM unnest(b.g) WITH ORDINALITY u(x, o)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (d) JOIN b USING (d)
"""
