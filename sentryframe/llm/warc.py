"""WARC archives with a two-level capture index.

Pages are range-partitioned and sorted by URL key (the host's parts reversed, then the path), and each partition writes
.warc.gz files of about `archive_bytes`, in which every record is a gzip member of its own. Of records with equal payloads
(by SHA-256 and size, as SHA-1 can be forged) the one with the smallest id is a response and the others are revisits that name
it. The index lines come out in key order: each archive's are packed into gzip blocks of `block_lines`, and the directory has
one row per block: its first and last key, file, offset and length. A lookup finds its shelf (a run of archives) and then its
blocks by binary search in the directory, unpacks them, finds its lines by binary search there, and reads the records'
ranges. Keys may recur over several blocks and archives; a lookup reads all of them. Revisits carry the SHA-256 and size of
the response they name; `checked` compares them.

Cases: null html is an empty payload; null or malformed URLs get the key `-)/` and are archived like others; a null id is
written as an empty one and never serves as the original if the group has an id; rows with equal ids are records apart;
an empty table gives no files and no rows; payloads under `min_revisit_bytes` are always responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mark_maybe, table
from .files import read_range, write_whole

DATE = "2024-01-01T00:00:00Z"
DIRECTORY = "part int, first_key string, last_key string, n_lines int, index_file string, offset long, length long, warc_file string, warc_start long, warc_stop long"


def url_key(url: str | None) -> str:
    """com,example)/path?query of a URL: host parts reversed, lower case, without port 80 or 443, www. kept."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return "-)/"
    if not host:
        return "-)/"
    key = ",".join(reversed(host.split(".")))
    if port not in (None, 80, 443):
        key += f":{port}"
    return (key + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")).replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09")


def url_key_of(urls: str) -> Column:
    return F.pandas_udf(lambda s: s.map(url_key), "string")(F.col(urls))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, full: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload but carries the digests (SHA-1 and SHA-256) and size of the full one."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    kind = "revisit" if refers_to is not None else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-SHA256: {full}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}\r\n\r\n")
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; a response's digest and size are computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.partition(": ")[::2] for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: int(x) if (x := v[len("<urn:page:") : -1]) else None
    size = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest, full = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["X-Payload-SHA256"]
    if h["WARC-Type"] == "response":
        if (len(payload), payload_digest(payload), hashlib.sha256(payload).hexdigest()) != (size, digest, full):
            raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return {"page_id": page(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "payload_sha256": full, "record_type": h["WARC-Type"], "refers_to": page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None}


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    """Pages with digest, size and the id each refers to (null: it is a response; revisits carry no payload on).

    Payloads are equal if their SHA-256 and sizes are. Digests are grouped among narrow rows. Only pages whose digest may recur
    are joined with their group; Spark splits a hot digest's partition. Other payloads go straight to the writers."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("full", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    groups = rows.groupBy("full", "size").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes))
    groups = table(groups.drop("n"), "warc-groups")
    marked = mark_maybe(rows, groups, "full", groups.count())
    again = marked.filter("maybe").drop("maybe").join(groups, ["full", "size"], "left")
    alone = marked.filter("not maybe").drop("maybe").withColumn("original", F.lit(None).cast("long"))
    refers = F.when(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    planned = again.unionByName(alone).withColumn("refers_to", refers)
    return planned.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "full", "size", "refers_to")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, block_lines: int = 300, archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archives and index blocks under folder; returns the directory, in key order by first_key.

    A partition goes on with a new archive and index when one has archive_bytes, so a task holds the lines of one block and
    the packed index of one archive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), (r for b in batches for r in b.to_pylist())
        no, r = 0, next(rows, None)
        while r is not None:
            name, index = f"pages-{part:06d}-{no:06d}.warc.gz", f"{folder}/index-{part:06d}-{no:06d}.gz"
            directory, blocks, lines, left = [], [], [], [r]

            def pack():
                raw = gzip.compress("\n".join(f"{k} {DATE} {p or '-'} {o} {n} {name}" for k, p, o, n in lines).encode(), 6, mtime=0)
                directory.append((part, lines[0][0], lines[-1][0], len(lines), index, sum(map(len, blocks)), len(raw), f"{folder}/{name}", lines[0][2], lines[-1][2] + lines[-1][3]))
                blocks.append(raw)
                lines.clear()

            def records():
                at = 0
                while left[0] is not None and at < archive_bytes:
                    r = left[0]
                    raw = record_bytes(r["page_id"], r["url"], r["payload"] or b"", base64.b32encode(bytes.fromhex(r["digest"])).decode(), r["full"], r["size"], r["refers_to"])
                    lines.append((r["key"], "" if r["page_id"] is None else str(r["page_id"]), at, len(raw)))
                    at += len(raw)
                    if len(lines) == block_lines:
                        pack()
                    left[0] = next(rows, None)
                    yield raw

            write_whole(f"{folder}/{name}", records())
            if lines:
                pack()
            write_whole(index, blocks)
            frame = pd.DataFrame(directory, columns=[c.split()[0] for c in DIRECTORY.split(", ")])
            yield pa.RecordBatch.from_pandas(frame.astype({"part": "int32", "n_lines": "int32"}), preserve_index=False)
            no, r = no + 1, left[0]

    rows = plan_records(pages, id_col, url_col, html_col, min_revisit_bytes).withColumn("key", url_key_of("url"))
    ordered = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return table(ordered.mapInArrow(work, DIRECTORY), "warc-directory")


def index_lines(r) -> list[list[str]]:
    """The lines of a directory row's block, each split: key, date, page id, offset, length, file."""
    return [x.rsplit(" ", 5) for x in gzip.decompress(read_range(r.index_file, r.offset, r.length)).decode().split("\n")]


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, payload_sha256 string, record_type string, refers_to long"


def with_shelves(directory: DataFrame, shelves: int = 1_000) -> DataFrame:
    """The directory with shelf: a number for runs of neighbouring partitions, at most `shelves` of them."""
    parts = (directory.agg(F.max("part")).first()[0] or 0) + 1
    return directory.withColumn("shelf", F.expr(f"part div {-(-parts // shelves)}").cast("int"))


def find_shelves(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """asked (a key) and shelf of the shelves that may hold each key, by binary search among their first and last keys: a bounded number, which all tasks get."""
    rows = directory.groupBy("shelf").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()
    rows.sort(key=lambda r: (r["first"], r["last"], r.shelf))
    sent = directory.sparkSession.sparkContext.broadcast(([r["first"] for r in rows], [r["last"] for r in rows], [r.shelf for r in rows]))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, shelves = sent.value
        for f in frames:
            found = [(k, x) for k in f["key"] for x in shelves[bisect_left(last, k) : bisect_right(first, k)]]
            yield pd.DataFrame(found, columns=["asked", "shelf"]).astype({"shelf": "int32"})

    return keys.select("key").mapInPandas(search, "asked string, shelf int")


def find_blocks(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """The directory rows of the blocks that may hold some of the keys (distinct, in a column key), with these in asked.

    Keys meet their shelf of the directory in one task, which finds each key's blocks by binary search. A key that fills many
    blocks, or archives, is found in each of them. directory is what one call of write_archives returned."""
    directory = with_shelves(directory)
    columns = [c.split()[0] for c in DIRECTORY.split(", ")]
    both = directory.withColumn("asked", F.lit(None).cast("string")).unionByName(find_shelves(directory, keys), allowMissingColumns=True)
    n = max(1, directory.select("shelf").distinct().count())
    dealt = both.repartition(n, "shelf").sortWithinPartitions("shelf", F.col("asked").asc_nulls_first(), "first_key", "last_key", "part", "index_file", "offset")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, first, last = None, [], [], []
        for f in frames:
            for file, g in f.groupby("shelf", sort=False):
                if file != now:
                    now, rows, first, last = file, [], [], []
                fresh = g["asked"].isna()
                for r in g.loc[fresh, columns].itertuples(index=False):
                    rows.append(tuple(r))
                    first.append(r.first_key)
                    last.append(r.last_key)
                asked: dict[int, list[str]] = {}
                for k in g.loc[~fresh, "asked"]:
                    for j in range(bisect_left(last, k), bisect_right(first, k)):
                        asked.setdefault(j, []).append(k)
                if asked:
                    out = pd.DataFrame([rows[j] for j in asked], columns=columns).astype({c: "int64" for c in ("part", "n_lines", "offset", "length", "warc_start", "warc_stop")})
                    yield out.assign(asked=list(asked.values()))

    return dealt.mapInPandas(search, DIRECTORY + ", asked array<string>")


def _runs(lines: list[list[str]], take: list[int], most: int) -> Iterator[list[int]]:
    """Lines whose records lie side by side, as long as they have `most` bytes or fewer together."""
    run: list[int] = []
    for i in take:
        if run and (i != run[-1] + 1 or int(lines[i][3]) + int(lines[i][4]) - int(lines[run[0]][3]) > most):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def captures(directory: DataFrame, keys: DataFrame, payload: bool = False, most: int = 8 << 20) -> DataFrame:
    """key, the columns of RECORD, and html (null unless payload, and for revisits) of each capture of the keys.

    Archives and blocks are found by binary search in the directory, lines by binary search in the unpacked block; records
    that lie side by side are one range read."""
    schema = f"key string, {RECORD}, html binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                lines = index_lines(r)
                of = [x[0] for x in lines]
                take = sorted({i for k in r.asked for i in range(bisect_left(of, k), bisect_right(of, k))})
                for run in _runs(lines, take, most):
                    begin = int(lines[run[0]][3])
                    raw = read_range(r.warc_file, begin, int(lines[run[-1]][3]) + int(lines[run[-1]][4]) - begin)
                    out = []
                    for i in run:
                        at = int(lines[i][3]) - begin
                        rec = parse_record(zlib.decompress(raw[at : at + int(lines[i][4])], 31))
                        out.append(rec | {"key": of[i], "html": rec["payload"] if payload and rec["record_type"] == "response" else None})
                    yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(1, min(directory.count(), 4 * directory.sparkSession.sparkContext.defaultParallelism, 10_000))
    return find_blocks(directory, keys).repartition(n, "index_file", "offset").mapInPandas(work, schema)


def lookup(directory: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each asked URL, with their payloads."""
    asked = urls.select(F.col(url_col).cast("string").alias("asked"), url_key_of(url_col).alias("key")).distinct()
    return captures(directory, asked.select("key").distinct(), payload=True).join(asked, "key").drop("key")


def checked(records: DataFrame) -> DataFrame:
    """The records; fails if a revisit's SHA-256 and size are not those of the response it names."""
    records = table(records, "warc-records")
    known = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_sha256", "payload_bytes", F.lit(True).alias("found")).distinct()
    again = records.filter("record_type = 'revisit'").join(known, ["refers_to", "payload_sha256", "payload_bytes"], "left")
    sure = F.when(F.col("found"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("no such response for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string"))
    return records.filter("record_type = 'response'").unionByName(again.withColumn("record_type", sure).select(records.columns))
