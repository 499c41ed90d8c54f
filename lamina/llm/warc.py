"""WARC archives with a two-level capture index.

Captures are sorted by a key of the reversed host and the path, and stored as lines in compressed blocks. A sparse
directory has the first and last key of each block with the block's place. A lookup searches the directory by halves, reads
the block by its range, searches it by halves, and reads the record by its range; :func:`find` does so for a table of keys.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import file_system, fresh_dir, read_range, saved, table

#: Payloads of fewer bytes are always stored.
LEAST = 1000
#: Lines of an index block, and bytes after which a task begins another archive file.
LINES, FILE_BYTES = 3000, 1 << 30
LEVEL = 6
#: Bytes of archives that a task reads.
TASK_BYTES = 64 << 20
END = b"\r\n"
CAPTURE = "key string, page_id long, type string, file string, offset long, length long"
DIRECTORY = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: Keys that are looked up with one read of their part of the directory.
ASKED = 8192
SAFE = "/%?=&,):;@+$!*'(~-._[]|#"
#: Fixed value: the profile that the standard names for a record that has the payload of another.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sort_key(url: str | None) -> str:
    """``com,example,blog)/path?query``: the host's labels reversed, without scheme, port and fragment."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return ")" + " ".join((url or "").split())
    query = f"?{parts.query}" if parts.query else ""
    return quote(",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query, safe=SAFE)


def uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe=SAFE) if url else f"urn:page:{page_id}"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP head of its payload and not the payload.

    ``name`` is unique among all records, and its record id is made of it; page_ids, which may repeat, have fields of their own.
    """
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", uri(refers_url, refers_to)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + END + block + END + END
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """A record's fields: ``id``, ``page_id``, ``type``, ``refers_to``, ``digest`` and ``payload`` (None for a revisit)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(END + END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != END + END:
        raise ValueError("a record of another length than it states")
    payload = rest[:size].partition(END + END)[2]
    number = lambda name: int(x) if (x := fields.get(name)) else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload of another digest than its record states")
    return {"id": fields["warc-record-id"], "page_id": number("page-id"), "type": kind, "refers_to": number("refers-to-page-id"), "digest": digest, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``page_id``, ``url``, ``html`` below ``path`` and the index of them; returns the captures.

    Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id is a response and
    the others revisit it; rows that repeat that page_id are responses too. A null html is an empty payload; a
    null page_id revisits a known one, and among null ids alone all are responses; a null url has an empty key.
    Groups are found by digest, in a table of only those with several rows: a large group is a large aggregate,
    not a task. Every task writes a file of its own under a new name, and only the files of the tasks that
    finished are in the captures, so a task can be run again; what others left is deleted at the end. An empty table
    gives an archive without captures; other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("target"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1 and target.page_id is not null").select("digest", "target.page_id", "target.url"), "groups").toDF("digest", "target", "target_url")
    other = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    decided = rows.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(other, F.col("target")).alias("refers_to"), F.when(other, F.col("target_url")).alias("refers_url"))

    def put(batches):
        files, root = file_system(path)
        files.create_dir(root, recursive=True)
        out, name, offset, made = None, "", 0, []
        try:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    captures = []
                    for page_id, url, data, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                        if out is None or offset > FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{root}/{name}", compression=None)
                            made.append(name)
                        member = record(f"{name}:{offset}", page_id, url, data, refers_to, refers_url, date)
                        out.write(member)
                        captures.append((sort_key(url), page_id, "response" if refers_to is None else "revisit", name, offset, len(member)))
                        offset += len(member)
                    yield _batch(captures)
        except BaseException:  # the task failed or was stopped: nothing will name its files
            for name in made:
                with contextlib.suppress(OSError):
                    files.delete_file(f"{root}/{name}")
            raise
        finally:
            if out is not None:
                out.close()

    captures = saved(decided.mapInArrow(put, CAPTURE), "captures")
    sweep(captures, path)
    write_index(captures, path)
    return captures


def sweep(captures: DataFrame, path: str) -> list[str]:
    """Delete archive files that no capture names, which lost executors leave; there is a name per ``FILE_BYTES`` or task."""
    files, root = file_system(path)
    named = {r["file"] for r in captures.select("file").distinct().collect()}
    found = [x.base_name for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    gone = [x for x in found if x.startswith("pages-") and x not in named]
    for x in gone:
        files.delete_file(f"{root}/{x}")
    return gone


def _batch(captures: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["key", "page_id", "type", "file", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*captures) if captures else [()] * 6, kinds)], names=names)


def _line(capture: tuple) -> str:
    key, page_id, kind, file, offset, length = capture
    return f"{key} {'' if page_id is None else page_id} {kind} {file} {offset} {length}"


def _parsed(line: str) -> tuple:
    key, page_id, kind, file, offset, length = line.split(" ")
    return key, int(page_id) if page_id else None, kind, file, int(offset), int(length)


def write_index(captures: DataFrame, path: str, lines: int = LINES) -> DataFrame:
    """Sort captures by key into compressed blocks, and write the directory of blocks as a table beside them."""

    def put(batches):
        files, root = file_system(path)
        name, offset, held = f"index-{uuid.uuid4().hex}.gz", 0, []
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:

            def block(some):
                nonlocal offset
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress("\n".join(map(_line, some)).encode()) + packer.flush()
                out.write(data)
                offset += len(data)
                return pa.RecordBatch.from_pylist([{"first": some[0][0], "last": some[-1][0], "file": name, "offset": offset - len(data), "length": len(data)}])

            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns))
                while len(held) >= lines:
                    yield block(held[:lines])
                    held = held[lines:]
            if held:
                yield block(held)

    # page_id and place also order, so that one key with very many captures is cut as well
    ranged = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    directory = ranged.mapInArrow(put, "first string, last string, file string, offset long, length long")
    directory.write.parquet(f"{path}/directory")
    return captures.sparkSession.read.parquet(f"{path}/directory")


def _lines(files: fs.FileSystem, name: str, offset: int, length: int) -> tuple[list[str], list[str]]:
    """The keys and the lines of an index block."""
    lines = zlib.decompress(read_range(files, name, offset, length), 31).decode().split("\n")
    return [x.split(" ", 1)[0] for x in lines], lines


class Directory:
    """The part of the directory with the keys ``low`` to ``high``; blocks are disjoint runs of the sorted captures, so both ends rise."""

    def __init__(self, files: fs.FileSystem, root: str, low: str, high: str):
        rows = ds.dataset(f"{root}/directory", DIRECTORY, "parquet", files).to_table(filter=(ds.field("last") >= low) & (ds.field("first") <= high))
        self.blocks = sorted(zip(*(rows[c].to_pylist() for c in ("first", "last", "file", "offset", "length"))))
        self.first, self.last = [b[0] for b in self.blocks], [b[1] for b in self.blocks]

    def of(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may have a key, by bisection."""
        return [b[2:] for b in self.blocks[bisect_left(self.last, key) : bisect_right(self.first, key)]]


class Lookup:
    """Finds single captures; it reads the part of the directory that a key needs."""

    def __init__(self, path: str):
        self.files, self.root = file_system(path)

    def captures(self, url: str | None) -> list[tuple]:
        """All captures of a URL, of which one may be in several blocks."""
        key, out = sort_key(url), []
        for file, offset, length in Directory(self.files, self.root, key, key).of(key):
            keys, lines = _lines(self.files, f"{self.root}/{file}", offset, length)
            out += [_parsed(x) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
        return out

    def read(self, capture: tuple) -> dict:
        _, _, _, file, offset, length = capture
        return parse(read_range(self.files, f"{self.root}/{file}", offset, length))


def keys_of(urls: DataFrame) -> DataFrame:
    """The different sort keys (``key``) of a table's ``url`` column."""

    def make(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sort_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col("url").cast("string")).mapInArrow(make, "key string").distinct()


def find(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """All captures of the keys (``key``, each once): bisect the directory, then the blocks that it names.

    Keys are range-partitioned, so a task reads the parts of the directory that its keys are in and never all of it. A key
    with very many captures is in many blocks, each of which is a row; blocks are dealt out and read once each.
    """

    def places(batches):
        files, root = file_system(path)
        for batch in batches:
            for at in range(0, len(batch), ASKED):
                keys = batch.column(0).slice(at, ASKED).to_pylist()
                directory = Directory(files, root, min(keys), max(keys))
                rows = [(key, *block) for key in keys for block in directory.of(key)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "file", "offset", "length"])

    def search(batches):
        files, root = file_system(path)
        held, keys, lines = None, [], []
        for batch in batches:
            out = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, offset) != held:
                    held, (keys, lines) = (file, offset), _lines(files, f"{root}/{file}", offset, length)
                out += [_parsed(x) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
                if len(out) >= 8192:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    asked = keys.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(places, "key string, file string, offset long, length long")
    return asked.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(search, CAPTURE)


def read(spark: SparkSession, captures: DataFrame, path: str) -> DataFrame:
    """Read the records of captures by their ranges: ``page_id``, ``type``, ``refers_to``, ``digest`` and ``payload``.

    Captures are dealt out by file and read in order of their place. A payload that doesn't have its record's digest
    or length is an error. A revisit's payload is null; its response has it.
    """

    def get(batches):
        files, root = file_system(path)
        name, f = None, None
        try:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if f is not None:
                            f.close()
                        name, f = row["file"], files.open_input_file(f"{root}/{row['file']}")
                    out.append(parse(f.read_at(row["length"], row["offset"])))
                    if len(out) == 256:
                        yield _records(out)
                        out = []
                yield _records(out)
        finally:
            if f is not None:
                f.close()

    # 8 MB of a file stay together, and the tasks follow from the bytes to read, as the rows dealt are small
    dealt = saved(captures.select("file", "offset", "length"), "places").withColumn("stretch", F.shiftright("offset", 23))
    tasks = (dealt.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(get, "page_id long, type string, refers_to long, digest string, payload binary")


def _records(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "type": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def digests(records: DataFrame) -> DataFrame:
    """What each record read back stands for: a revisit has the size of the payload that its response has.

    ``records`` is read once. A response that many revisit is one row, and Spark splits what it is joined with.
    """
    rows = saved(records.select("page_id", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("size")), "records")
    wanted = rows.where("type = 'response' and size is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("size").alias("of_response"))
    revisits = rows.where("type = 'revisit'").drop("size").join(wanted, ["refers_to", "digest"], "left").withColumnRenamed("of_response", "size")
    return rows.where("type = 'response'").unionByName(revisits).select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages, then look every page's URL up in the index and read what it has."""
    path, pages = fresh_dir(spark, "warc"), table(spark, sf_dir, "pages")
    write(pages, path)
    return digests(read(spark, find(spark, keys_of(pages), path), path))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
t AS (SELECT html, max(page_id) AS target FROM p WHERE n >= {LEAST} GROUP BY html)
SELECT p.page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN t.target IS NOT NULL AND p.page_id IS DISTINCT FROM t.target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM t.target THEN t.target END AS refers_to
FROM p LEFT JOIN t ON p.html = t.html
"""
