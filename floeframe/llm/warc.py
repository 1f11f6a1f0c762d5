"""WARC archives of web pages and a two-level capture index over them.

Writing. Each row becomes a WARC/1.1 record, compressed as a gzip member of its own, in archive files of the shared folder.
Of rows with the same payload of at least ``min_bytes`` bytes the one with the largest page_id is a ``response``; the others
are ``revisit`` records, which keep the HTTP head and the payload's digest and name that response. A task writes its own
files; only files named by the captures that it returned count, so that an attempt which was lost leaves nothing visible.

Index. Captures are sorted by key (the URL with its host reversed, ``com,example,www)/path``), then by file and offset, and
written in compressed blocks of ``BLOCK_LINES`` lines. An index part ends in a sparse directory: the first key, place and
size of each block. Above the directories stand the parts' first and last keys, one row for each part.

Reading. A lookup finds the parts, then binary-searches their directories, range-reads the blocks that may hold the key,
binary-searches the lines, and range-reads the records. Key and block are the unit of work: a key with any share of the
captures fills many blocks, and those are opened by different tasks. Payloads are checked against their digests.

Edge cases: a null html is an empty payload; a null or empty url has the key ``-``; control characters and blanks in a url are
percent-encoded; a null page_id counts as the smallest and is written as ``-``; rows that repeat the largest page_id of a payload
are all responses; an empty table gives no files and an empty index; columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_LINES = 3000
FILE_BYTES = 1 << 30                 # an archive file is closed once it is that long
FLUSH_ROWS, FLUSH_BYTES = 2000, 16 << 20
DATE = "2024-01-01T00:00:00Z"        # pages carry no date of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID("5a1d3c6e-6f0b-4c0e-9d5c-0d1b7a4c2f10")
LEAST_HOT, MOST_HOT = 256, 100_000   # a payload is hot above this many rows, raised so that hot payloads stay below 100,000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it, for a path as Spark writes it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def encoded(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str | None) -> str:
    """The sort key of a url: host reversed, no scheme, user, default port or fragment."""
    told = encoded(url).split("#", 1)[0]
    if not told:
        return "-"
    scheme, mark, rest = told.partition("://")
    if not mark:
        scheme, rest = "", told
    at = re.search(r"[/?]", rest)
    host, path = (rest[:at.start()], rest[at.start():]) if at else (rest, "/")
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    port = "" if (scheme.lower(), port) in (("http", "80"), ("https", "443"), ("", "")) else port
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page_id}:{digest}')}>"


def record(page_id: str, url: str, payload: bytes, refers_to: str | None, refers_url: str, own: str) -> tuple[bytes, str]:
    """One compressed record, and the payload's digest. ``own`` tells a revisit from others of its page."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id if refers_to is None else own, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id)]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", DATE),
                 ("WARC-Refers-To-Target-URI", refers_url), ("X-Refers-To-Page-ID", refers_to)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    told = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v) + "\r\n"
    return gzip.compress(told.encode() + block + b"\r\n\r\n", 6, mtime=0), digest


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both by lower-cased name) and payload of a record; its digests are checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = [line.split(": ", 1) for line in head.decode().split("\r\n")[1:]]
    warc = {k.lower(): v for k, v in names}
    block = rest[:int(warc["content-length"])]
    if f"sha1:{digest_of(block)}" != warc["warc-block-digest"]:
        raise ValueError(f"damaged record {warc['warc-record-id']}")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])}
    if warc["warc-type"] == "response" and f"sha1:{digest_of(payload)}" != warc["warc-payload-digest"]:
        raise ValueError(f"payload and digest differ in {warc['warc-record-id']}")
    return warc, http, payload


# --- writing -----------------------------------------------------------------------------------------------

CAPTURES = "key string, page_id string, file string, offset long, length long, digest string"


class _Archive:
    """The archive files of one task attempt."""

    def __init__(self, root: str):
        context = TaskContext.get()
        self.root, self.prefix = root, f"pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.count, self.out, self.name, self.at = 0, None, "", 0

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.count = f"{self.prefix}-{self.count:03d}.warc.gz", self.count + 1
            fs, path = opened(f"{self.root}/{self.name}")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at = fs.open_output_stream(path, compression=None), 0
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(self.name, '')}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Length: 0\r\n\r\n"
            first = gzip.compress(info.encode() + b"\r\n\r\n", 6, mtime=0)
            self.out.write(first)
            self.at = len(first)
        begin = self.at
        self.out.write(member)
        self.at += len(member)
        return self.name, begin

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _write(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = _Archive(root)
        for f in frames:
            rows = []
            for i, (page_id, url, html, refers_to, refers_url) in enumerate(zip(f["page_id"], f["url"], f["html"], f["refers_to"], f["refers_url"])):
                own = f"{archive.prefix}:{archive.count}:{archive.at}:{i}"
                member, digest = record(page_id, encoded(url), html.encode("utf-8", "surrogatepass"), refers_to, encoded(refers_url), own)
                rows.append((url_key(url), page_id, *archive.add(member), len(member), digest))
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length", "digest"])
        archive.close()
    return run


def decided(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, refers_url: what each row is to be; ids as text, ``refers_to`` null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_hash", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "url")).alias("_best"),
                                       F.first(F.octet_length("html")).alias("_bytes"))
    groups = scratch.store(groups, "payloads")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot_from = max(LEAST_HOT, total // MOST_HOT)
    shared = groups.where((F.col("_n") > 1) & (F.col("_bytes") >= min_bytes)).select("_hash", "_n", "_best")
    # at most MOST_HOT rows
    hot = F.broadcast(shared.where(F.col("_n") > hot_from).select("_hash", F.col("_best").alias("_hot")))
    rest = shared.where(F.col("_n") <= hot_from).select(F.col("_hash").alias("_key"), F.col("_best").alias("_cold"))
    # rows of a hot payload are dealt out by keys that nothing else has
    spread = F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id().cast("string")).otherwise(F.col("_hash"))
    joined = rows.join(hot, "_hash", "left").withColumn("_key", spread).join(rest, "_key", "left")
    best = F.coalesce("_hot", "_cold")
    stays = best.isNull() | best["page_id"].eqNullSafe(F.col("page_id"))
    return joined.select(F.coalesce(F.col("page_id").cast("string"), F.lit("-")).alias("page_id"), "url", "html",
                         F.when(~stays, best["page_id"].cast("string")).alias("refers_to"), F.when(~stays, best["url"]).alias("refers_url"))


def write_archives(pages: DataFrame, root: str, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Archive files under ``root``; the captures in them: key, page_id (text), file, offset, length, digest."""
    return scratch.store(decided(pages, scratch, min_bytes).mapInPandas(_write(root), CAPTURES), "captures")


# --- index -------------------------------------------------------------------------------------------------

PARTS = "part string, first string, last string, blocks long, captures long"


def _write_part(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, directory, lines, last, total = None, 0, [], [], "", 0
        name = f"index-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.cdx"

        def flush() -> None:
            nonlocal at, lines
            body = zlib.compress("\n".join(lines).encode(), 6)
            directory.append((lines[0].split("\t", 1)[0], at, len(body)))
            out.write(body)
            at, lines = at + len(body), []

        for f in frames:
            for row in zip(f["key"], f["page_id"], f["file"], f["offset"], f["length"], f["digest"]):
                if out is None:
                    fs, path = opened(f"{root}/{name}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                lines.append("\t".join(map(str, row)))
                last, total = row[0], total + 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            yield pd.DataFrame([(name, directory[0][0], last, len(directory), total)], columns=["part", "first", "last", "blocks", "captures"])
    return run


def write_index(captures: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """Index parts under ``root``; one row for each: part, first and last key, blocks, captures."""
    order = ["key", "file", "offset"]                # file and offset tell captures apart, so a hot key is cut anywhere
    return scratch.store(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_write_part(root), PARTS), "parts")


class Directory:
    """Places of blocks by key. ``parts``: (part, first key, last key), as many as the index has files."""

    def __init__(self, root: str, parts: list[tuple[str, str, str]]):
        self.root = root
        self.parts = sorted((first.encode(), last.encode(), part) for part, first, last in parts)
        self.firsts, self.open = [p[0] for p in self.parts], {}

    def of(self, part: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        if part not in self.open:
            if len(self.open) > 8:
                self.open.clear()
            fs, path = opened(f"{self.root}/{part}")
            with fs.open_input_file(path) as file:
                end = file.size()
                size = int.from_bytes(file.read_at(8, end - 8), "big")
                entries = json.loads(zlib.decompress(file.read_at(size, end - 8 - size)))
            self.open[part] = [e[0].encode() for e in entries], [(e[1], e[2]) for e in entries]
        return self.open[part]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(part, offset, length) of every block that may hold ``key``."""
        told = key.encode()
        p = bisect.bisect_right(self.firsts, told) - 1
        while p >= 0 and self.parts[p][1] >= told:
            firsts, places = self.of(self.parts[p][2])
            low, high = max(0, bisect.bisect_left(firsts, told) - 1), bisect.bisect_right(firsts, told)
            for offset, length in places[low:high]:
                yield self.parts[p][2], offset, length
            if self.parts[p][0] < told:
                break
            p -= 1


def _locate(root: str, parts: list[tuple[str, str, str]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directory = Directory(root, parts)
        for f in frames:
            rows = []
            for key in f["key"]:
                for place in directory.blocks(key):
                    rows.append((key, *place))
                    if len(rows) == FLUSH_ROWS:
                        yield pd.DataFrame(rows, columns=["key", "part", "at", "size"])
                        rows = []
            yield pd.DataFrame(rows, columns=["key", "part", "at", "size"])
    return run


def _search(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, lines, keys = None, [], []
        for f in frames:
            rows = []
            for key, part, at, size in zip(f["key"], f["part"], f["at"], f["size"]):
                if (part, at) != held:
                    fs, path = opened(f"{root}/{part}")
                    with fs.open_input_file(path) as file:
                        lines = zlib.decompress(file.read_at(size, at)).decode().split("\n")
                    held, keys = (part, at), [line.split("\t", 1)[0].encode() for line in lines]
                told = key.encode()
                for line in lines[bisect.bisect_left(keys, told):bisect.bisect_right(keys, told)]:
                    key_, page_id, file_, offset, length, digest = line.split("\t")
                    rows.append((key_, page_id, file_, int(offset), int(length), digest))
                if len(rows) >= FLUSH_ROWS:
                    yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length", "digest"])
                    rows = []
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length", "digest"])
    return run


def keys(pages: DataFrame) -> DataFrame:
    """Distinct keys of the urls of ``pages``."""
    @F.pandas_udf("string")
    def of(url: pd.Series) -> pd.Series:
        return url.map(url_key)
    return pages.select(of(F.col("url")).alias("key")).distinct()


def lookup(requests: DataFrame, parts: DataFrame, root: str) -> DataFrame:
    """Captures of the requested keys (each asked for once), through the directories and blocks of the index."""
    listed = [tuple(r) for r in parts.select("part", "first", "last").collect()]      # one row for each file of the index
    # sorted requests, so that a task opens few directories; then block by block
    located = requests.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInPandas(_locate(root, listed), "key string, part string, at long, size long")
    return located.repartition("part", "at").sortWithinPartitions("part", "at", "key").mapInPandas(_search(root), CAPTURES)


RECORDS = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _fetch(root: str, payloads: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        name, file = None, None
        for f in frames:
            rows, held = [], 0
            for file_, offset, length in zip(f["file"], f["offset"], f["length"]):
                if file_ != name:
                    if file is not None:
                        file.close()
                    fs, path = opened(f"{root}/{file_}")
                    name, file = file_, fs.open_input_file(path)
                warc, http, payload = parsed(file.read_at(length, offset))
                whole = warc["warc-type"] == "response"
                rows.append((warc["x-page-id"], warc.get("warc-target-uri"), warc["warc-type"], warc.get("x-refers-to-page-id"),
                             len(payload) if whole else int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"),
                             payload if payloads and whole else None))
                held += len(payload) if payloads else 0
                if len(rows) >= FLUSH_ROWS or held >= FLUSH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)
        if file is not None:
            file.close()
    return run


def fetch(captures: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of captures, by range reads in the order of the archives. A revisit has no payload of its own."""
    order = ["file", "offset"]
    return captures.select("file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_fetch(root, payloads), RECORDS)
