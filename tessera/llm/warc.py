"""WARC archives with revisits, and a two-level capture index over them.

Records are written as gzip members into archives of bounded size; an archive is one row of a
written table (its whole .warc.gz stream), so every store that Spark can write holds them. The
index sorts captures by reversed-host key into compressed blocks and keeps the first key of each
block in a sparse directory. A lookup goes by key range to the part of the index that holds it,
binary-searches the directory, opens one block, and the record is read as a range of its archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, partitions, table, written

ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 300
#: Lines of a part of the index, about: a lookup opens a part in one task.
PART_LINES = 1 << 20
#: Shared digests that are broadcast at most, and tasks that each is dealt to beyond that.
BROADCAST_ROWS, SALTS = 200_000, 16
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def reversed_host_key(url: str) -> Column:
    """com,example,www)/path?query: the host's labels reversed, lower-cased, then the rest of the url."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.when(u.contains("://"), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1)).otherwise(u)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, "[.]"))), F.lit(")"), rest)


def record_bytes(kind: str, url: str, page: str, digest: str, payload: bytes, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the digest and drops the payload."""
    body = b"" if kind == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.encode("unicode_escape").decode(), f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record, checked against its lengths."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length")
    return headers, block.partition(b"\r\n\r\n")[2]


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a .warc.gz stream, one gzip member each."""
    while archive:
        member = zlib.decompressobj(31)
        yield parse_record(member.decompress(archive))
        archive = member.unused_data


def with_types(
    pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", html: str = "html", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to): who holds each payload and who revisits it.

    Digests and ids are grouped, never payloads. Only digests that several pages have are joined
    back: up to broadcast_rows of them (about 100 bytes each) are broadcast and no payload moves;
    more are joined by digest, each dealt to SALTS tasks, so a payload that many pages share is
    no single task's.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sha = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    small = p.select("page_id", sha.alias("sha"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= min_bytes)
    holder = small.groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    shared = written(holder.where("n > 1").select(F.col("sha").alias("s"), "holder"), "shared-payloads")
    keyed = p.withColumn("sha", sha)
    if shared.count() <= broadcast_rows:
        joined = keyed.join(F.broadcast(shared), F.col("sha") == F.col("s"), "left")
    else:
        salted = shared.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = keyed.withColumn("salt", salt).join(salted, (F.col("sha") == F.col("s")) & (F.col("salt") == F.col("s_salt")), "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select(
        "page_id", "url", "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("holder")).alias("refers_to"),
    )


def write_archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(archive, data) and (archive, offset, length, key, page_id): the archives, and where each record lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        data, index, at = [], [], 0

        def emit() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string()), ("page_id", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n]), pa.array([b"".join(data)], pa.binary()), pa.array([index], kind)], ["archive", "data", "records"]
            )

        for b in batches:
            for page, url, html, kind, refers, key in zip(*(c.to_pylist() for c in b.columns)):
                payload = html.encode()
                member = gzip.compress(record_bytes(kind, url or "", str(page), digest_of(payload), payload, str(refers)), 4, mtime=0)
                index.append({"offset": at, "length": len(member), "key": key, "page_id": page})
                data.append(member)
                at += len(member)
                if at >= archive_bytes:
                    yield emit()
                    data, index, at, n = [], [], 0, n + 1
        if data:
            yield emit()

    keyed = typed.select("page_id", "url", "html", "record_type", "refers_to", reversed_host_key("url").alias("key"))
    both = bucketed(
        keyed.mapInArrow(run, "archive long, data binary, records array<struct<offset:long,length:long,key:string,page_id:long>>"), "archive", "archives",
    )
    return both.select("archive", "data"), both.select("archive", F.inline("records"))


def build_index(places: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(part, lo, directory, blocks): for each key range, compressed blocks of sorted lines and their first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["part", "block", "first_key", "first_page", "lines"]

        def emit(block: int, rows: list[tuple]) -> pa.RecordBatch:
            text = "".join("\t".join((*(_escape(str(x)) for x in r), "\n")) for r in rows)
            cols = [[part], [block], [rows[0][0]], [rows[0][1]], [zlib.compress(text.encode(), 6)]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        held, n = [], 0
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= block_lines:
                yield emit(n, held[:block_lines])
                held, n = held[block_lines:], n + 1
        if held:
            yield emit(n, held)

    order = ["key", "page_id", "archive", "offset"]  # records of one key may fill several parts
    parts = max(partitions(places.sparkSession), -(-places.count() // PART_LINES))
    ranged = places.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(
        ranged.select("key", "page_id", "archive", "offset", "length").mapInArrow(
            run, "part int, block int, first_key string, first_page long, lines binary"
        ),
        "capture-index",
    )


def _escape(x: str) -> str:
    return x.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def find(directory: list[tuple], opened, key: tuple) -> list[tuple[int, int, int]]:
    """The places of all records of a key: binary search in the directory, then in the lines of each block that may hold it."""
    found = []
    for k in range(max(0, bisect.bisect_left(directory, key) - 1), bisect.bisect_right(directory, key)):
        keys, places = opened(k)
        found += places[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
    return found


def _order(key: str, page: int | None) -> tuple:
    return key.encode(), page is not None, page or 0


def look_up(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(key, page_id, archive, offset, length) of every record of each distinct (key, page_id) of wanted, through the index.

    The range of each part comes from its own first key; a key goes to all parts that may hold it.
    Parts hold about PART_LINES lines or less, so their first keys are a short list.
    """
    parts = index.where("block = 0").select("part", "first_key", "first_page").orderBy("part").collect()
    firsts = [(_order(r["first_key"], r["first_page"]), r["part"]) for r in parts]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = [k for k, _ in firsts]
        for b in batches:
            rows: list[tuple] = []
            for k, p in zip(*(c.to_pylist() for c in b.columns)):
                key = _order(k, p)
                lo, hi = max(0, bisect.bisect_left(begins, key) - 1), bisect.bisect_right(begins, key)
                rows += [(k, p, part) for _, part in firsts[lo:hi]]
            cols = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "page_id", "part"])

    def run(keys: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        pages = [None if pd.isna(p) else int(p) for p in blocks["first_page"]]
        directory = [_order(k, p) for k, p in zip(blocks["first_key"], pages)]
        packed = blocks["lines"].tolist()
        open_: dict[int, tuple] = {}

        def opened(k: int) -> tuple:
            if k not in open_:
                open_.clear()  # one block at a time: the keys come in order
                lines = [x.split("\t") for x in zlib.decompress(packed[k]).decode().split("\n")[:-1]]
                keys_ = [_order(_unescape(x[0]), None if x[1] == "None" else int(x[1])) for x in lines]
                open_[k] = keys_, [tuple(map(int, x[2:5])) for x in lines]
            return open_[k]

        rows = [(k, None if pd.isna(p) else int(p)) for k, p in zip(keys["key"], keys["page_id"])]
        rows.sort(key=lambda r: _order(*r))
        found = [(k, p, *place) for k, p in rows for place in find(directory, opened, _order(k, p))]
        return pd.DataFrame(found, columns=["key", "page_id", "archive", "offset", "length"]).astype(
            {"key": object, "page_id": "Int64", "archive": "Int64", "offset": "Int64", "length": "Int64"}
        )

    keyed = wanted.select("key", "page_id").distinct().mapInArrow(dealt, "key string, page_id long, part int")
    return keyed.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(run, "key string, page_id long, archive long, offset long, length long")


def _unescape(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n", "r": "\r"}.get(m[1], m[1]), x) if "\\" in x else x


def read_ranges(places: DataFrame, archives: DataFrame) -> DataFrame:
    """What each record says of itself, read as a range of its archive: a row per place.

    Response payloads are hashed anew and must have the digest in their header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for b in batches:
            for r in b.to_pylist():
                out = []
                for place in r["places"]:
                    head, payload = parse_record(zlib.decompress(r["data"][place["offset"] : place["offset"] + place["length"]], 31))
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError("payload and digest differ")
                    page = head["WARC-Record-ID"][len("<urn:page:") : -1]
                    refers = head.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    out.append(
                        (None if page == "None" else int(page), int(head["X-Payload-Length"]), digest, kind,
                         int(refers) if refers and refers != "None" else None, head["WARC-Target-URI"])
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    by_archive = places.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places"))  # an archive is bounded
    return archives.join(by_archive.hint("shuffle_hash"), "archive").select("data", "places").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    )


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write pages to archives, index them, look every page up and read its record back.

    Of equal payloads of min_bytes or more the largest page id is the response and the others
    revisit it. Null markup is an empty payload, a null url an empty one; null ids count as less
    than all others (where all are null, all are responses); rows with one url and id are a record
    each, and a lookup finds all records of its key, so they come back whatever their markup;
    repeated rows with the largest id are responses alike; an empty table gives no rows; further
    columns are ignored.
    """
    typed = with_types(pages, min_bytes, id_col, html)
    archives, places = write_archives(typed, archive_bytes)
    index = build_index(places, block_lines)
    wanted = pages.select(reversed_host_key("url").alias("key"), F.col(id_col).cast("long").alias("page_id"))
    return read_ranges(look_up(wanted, index), archives)


def op8(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
