"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

A record's text is built by built-in functions and ends, as the format asks, with an empty line; the sink's line
separator writes it. Readers take what stands between two magic strings after empty lines as a line of the text source,
so uncompressed archives are read in splits, compressed ones as a stream, and no task holds more than some records. Each
such candidate emits the offset of its successor as its Content-Length tells. Chains are followed inside a block at once,
and between blocks by pointer jumping from the start of the file; what is not reached that way is magic inside a payload
and is dropped, and the place where a chain breaks is a row of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import new_path, text_of, written

#: What stands before the digit of the version; lines of the reader are parted by an empty line and it.
MAGIC = b"WARC/1."
END = "\r\n\r\n"
#: The type of the row that tells where a chain breaks.
BROKEN = "broken"
#: A record of this scheme names a page of the table.
URN = "urn:page:"
LEAST = 1000
BLOCK = 1 << 20
FIELDS = "type string, id string, target string, refers_to string, payload_bytes long, payload_digest string, body_ok boolean"


def _header_safe(c: Column) -> Column:
    """Control characters and spaces would end or split a header: percent-encoded."""
    for code in (*range(0x21), 0x7F):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return c


def records(pages: DataFrame, least: int = LEAST, max_broadcast_rows: int = 200_000) -> DataFrame:
    """One column `record`: a response, or a revisit of the page with the largest id among those of equal payload.

    Payload: html in UTF-8, null as empty; payloads under `least` bytes are all responses. Equal ids with equal
    payloads are responses alike; null ids come before all others. Copies are found on digests, aggregated before the
    shuffle, so a payload that a third of the pages share is one row of the table of copies. That table is broadcast
    while it has at most max_broadcast_rows rows (of under 100 bytes each); beyond it the join shuffles.
    """
    p = pages.select("page_id", "url", text_of("html").alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = p.where(F.col("bytes") >= least).select("page_id", "digest")
    copies = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL")
    copies = written(copies.select(F.col("digest").alias("d"), "keeper"), "warc-copies")
    if copies.count() <= max_broadcast_rows:
        copies = F.broadcast(copies)
    p = p.join(copies, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    named = lambda c: F.concat(F.lit("<" + URN), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), named(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named(F.col("keeper")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return p.select(F.concat(lines, F.lit(END), block).alias("record"))


def write(records: DataFrame, path: str, per_file: int = 2000) -> None:
    """Archives of at most per_file records each, gzip-compressed, in the folder path."""
    (records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))


def _parsed(line: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Offsets of a record's block and its end in a line, which starts after MAGIC, and the headers; None if malformed."""
    version = re.match(rb"\d\r\n", line)
    if not version:
        return None
    head_end = line.find(b"\r\n\r\n")
    head_end = head_end if head_end >= 0 else len(line)  # the block itself starts with magic
    headers: dict[str, str] = {}
    last = None
    for row in line[version.end() : head_end].split(b"\r\n"):
        if row[:1] in (b" ", b"\t") and last is not None:  # a folded header goes on
            headers[last] += " " + row.strip().decode("utf-8", "replace")
            continue
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        last = name.strip().lower().decode("latin-1")
        headers[last] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return None
    start = head_end + 4
    return start, start + int(headers["content-length"]), headers


def _same_digest(claimed: str, digest: bytes) -> bool:
    name, colon, value = claimed.rpartition(":")
    return not colon or name.lower() != "sha1" or value.lower() == digest.hex() or value.upper() == base64.b32encode(digest).decode()


def _described(body: bytes, headers: dict[str, str]) -> tuple:
    """Type, id, target, refers_to, payload_bytes, payload_digest and body_ok of a record with its whole block."""
    is_http = headers.get("content-type", "application/http").lower().startswith("application/http")
    http, _, payload = body.partition(b"\r\n\r\n") if is_http else (b"", b"", body)
    claimed, kind = headers.get("warc-payload-digest", ""), headers.get("warc-type", "")
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        size, digest, ok = int(length[1]) if length else None, claimed.rpartition(":")[2], length is not None
    else:
        sha = hashlib.sha1(payload)
        size, digest, ok = len(payload), sha.hexdigest(), _same_digest(claimed, sha.digest())
    return kind, headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), headers.get("warc-refers-to", "").strip("<>") or None, size, digest, ok


_NAMES = ["file", "split", "at", "next", "complete", "type", "id", "target", "refers_to", "payload_bytes", "payload_digest", "body_ok"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_()]
_BETWEEN = len(END) + len(MAGIC)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, split, at, line) of each line, at: its first byte after MAGIC counted from the split's first line; after each split's lines, (file, split, bytes, None)."""
    now, at = None, 0
    for batch in batches:
        for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value"), strict=True):
            if (file, split) != now:
                if now:
                    yield *now, at, None
                now, at = (file, split), 0
            line = value.as_py()
            first = split == 0 and at == 0
            if not first or line.startswith(MAGIC):
                skipped = len(MAGIC) if first else 0
                yield file, split, at + skipped, line[skipped:]
            at += len(line) + _BETWEEN
    if now:
        yield *now, at, None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each candidate, its offsets counted from the split's first line; and one for each split, whose `next` is its bytes and whose `at` is null."""
    rows: list[tuple] = []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
    for file, split, at, line in _positions(batches):
        if line is None:
            rows.append((file, split, None, at, *[None] * 8))
        elif found := _parsed(line):
            start, end, headers = found
            # a record that ends with its line is complete; one that holds magic goes on in further lines
            complete = end <= len(line) and not line[end:].strip(b"\r\n")
            following = at + (len(line) if complete else end) + len(END)
            told = _described(line[start:end], headers) if complete else (headers.get("warc-type", ""), *[None] * 6)
            rows.append((file, split, at - len(MAGIC), following, complete, *told))
        if len(rows) >= 5_000:
            yield batch_of()
            rows.clear()
    if rows:
        yield batch_of()


def _block_exits(group: pa.Table) -> pa.Table:
    """For each candidate of a block, where its chain leaves the block: an offset beyond, -1 at the end of file, -2 if broken."""
    offsets, nexts = group["offset"].to_pylist(), group["next"].to_pylist()
    block = group["block"][0].as_py()
    exits: dict[int, int] = {}
    for at, following in sorted(zip(offsets, nexts, strict=True), reverse=True):
        outside = following < 0 or following // BLOCK != block
        exits[at] = following if outside else exits.get(following, -2)
    return pa.table({"file": group["file"], "offset": group["offset"], "exit": pa.array([exits[x] for x in offsets], pa.int64())})


def _walked(entries: pa.Table, group: pa.Table) -> pa.Table:
    """The candidates of a block on the chain from its entry."""
    follows = dict(zip(group["offset"].to_pylist(), group["next"].to_pylist(), strict=True))
    reached = set()
    for at in entries["entry"].to_pylist():
        while at in follows and at not in reached:
            reached.add(at)
            at = follows[at]
    return group.filter(pa.array([x in reached for x in group["offset"].to_pylist()], pa.bool_()))


def _lines(spark, path: str) -> DataFrame:
    """(file, split, value): what stands between magic strings, in the order of the file inside each split."""
    text = spark.read.option("lineSep", END + MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def read(spark, path: str, ranges_at_once: int = 500_000) -> DataFrame:
    """The records of the archives in a folder, as (file, offset, type, id, target, refers_to, payload_bytes, payload_digest, body_ok).

    One row for each record that the chain from offset 0 of its file reaches; versions 1.0 and 1.1, headers may be folded.
    body_ok: the payload's SHA-1, in hexadecimal or base 32, is the one in the header, or none is there. Where bytes are
    not a record, or the last record is cut off, the chain ends, and a row of type BROKEN with the offset tells it; damage
    inside a compressed stream is an error of the read. Empty files and folders give no rows.
    Uncompressed archives of any size are read in splits; a compressed one is a stream of one task. A task holds a batch of
    records; blocks hold at most BLOCK bytes of record starts, which bounds what one grouped task call holds. Records with
    magic in them, which are found in a second pass, are put together one by one.
    """
    schema = f"file string, split bigint, at bigint, next bigint, complete boolean, {FIELDS}"
    raw = written(_lines(spark, path).mapInArrow(_candidates, schema), "warc-lines")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    ends = raw.where("at IS NULL").select("file", "split", F.coalesce(F.sum("next").over(before), F.lit(0)).alias("base"), F.col("next").alias("bytes"))
    ends = written(ends, "warc-splits")
    sizes = ends.groupBy("file").agg((F.max(F.col("base") + F.col("bytes")) - _BETWEEN).alias("size"))
    found = raw.where("at IS NOT NULL").join(ends.drop("bytes"), ["file", "split"]).join(sizes, "file")
    found = found.withColumn("offset", F.col("base") + F.col("at")).withColumn("next", F.col("base") + F.col("next"))
    # the last record may lack its empty line; one that is cut off is none
    found = found.where(F.col("complete") | (F.col("next") - len(END) <= F.col("size")))
    found = found.withColumn("next", F.when(F.col("next") < F.col("size"), F.col("next")).otherwise(F.lit(-1)))
    fields = ["type", "id", "target", "refers_to", "payload_bytes", "payload_digest", "body_ok"]
    found = written(found.select("file", F.floor(F.col("offset") / BLOCK).alias("block"), "offset", "next", "complete", *fields), "warc-candidates")
    schema = f"file string, block long, offset long, next long, complete boolean, {FIELDS}"
    exits = written(found.select("file", "block", "offset", "next").groupBy("file", "block").applyInArrow(_block_exits, "file string, offset long, exit long"), "warc-exits")
    # pointer jumping over blocks: entries known so far, and pointers that double their reach each round
    entries = found.where("offset = 0").select("file", F.col("offset").alias("entry"))
    jumps, n = exits, -1
    while True:
        step = entries.join(jumps, (F.col("entry") == F.col("offset")) & (entries["file"] == jumps["file"])).where("exit >= 0").select(entries["file"], F.col("exit").alias("entry"))
        entries = written(entries.union(step).distinct(), "warc-entries")
        was, n = n, entries.count()
        if n == was:
            break
        far = jumps.select(F.col("file").alias("f"), F.col("offset").alias("o"), F.col("exit").alias("x"))
        joined = jumps.join(far, (jumps["file"] == F.col("f")) & (F.col("exit") == F.col("o")), "left")
        # a pointer to an offset that is no candidate is broken; one past the end of file stays
        jumps = written(joined.select("file", "offset", F.when(F.col("exit") < 0, F.col("exit")).otherwise(F.coalesce("x", F.lit(-2))).alias("exit")), "warc-jumps")
    at = entries.withColumn("block", F.floor(F.col("entry") / BLOCK))
    kept = written(at.groupBy("file", "block").cogroup(found.groupBy("file", "block")).applyInArrow(_walked, schema), "warc-kept")
    reached = kept.groupBy("file").agg(F.max("offset").alias("last"), F.max_by("next", "offset").alias("to"))
    broken = sizes.where("size > 0").join(reached, "file", "left").where(F.coalesce("to", F.lit(0)) >= 0)
    broken = broken.select("file", F.coalesce("to", F.lit(0)).cast("bigint").alias("offset"), F.lit(BROKEN).alias("type"), *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in FIELDS.split(", ")[1:])))
    whole = kept.where("complete").select("file", "offset", *fields).unionByName(broken)
    if n_parts := kept.where("NOT complete").count():
        parts = kept.where("NOT complete").join(sizes, "file").select("file", "offset", F.when(F.col("next") >= 0, F.col("next") - len(END)).otherwise(F.col("size")).alias("stop"))
        chunks = -(-n_parts // ranges_at_once)
        for c in range(chunks):
            wanted = parts.where(F.pmod(F.xxhash64("file", "offset"), F.lit(chunks)) == c).collect()
            whole = whole.unionByName(_put_together(spark, path, ends, sorted(map(tuple, wanted))))
    return whole


def _put_together(spark, path: str, ends: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """The records from offset to stop of each range (file, offset, stop), whose lines are more than one."""
    of: dict[str, tuple[list[int], list[int]]] = {}
    for file, offset, stop in ranges:  # records of a chain do not overlap
        starts, stops = of.setdefault(file, ([], []))
        starts.append(offset)
        stops.append(stop)
    sent = spark.sparkContext.broadcast(of)
    lines = _lines(spark, path).join(F.broadcast(ends.where(F.col("file").isin(list(of)) if len(of) <= 1000 else F.lit(True)).select("file", "split", "base")), ["file", "split"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        bases: dict[tuple[str, int], int] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, split, base in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "base")), strict=True):
                    bases[file, split] = base
                yield batch

        for file, split, at, line in _positions(noted()):
            starts, stops = of.get(file, ([], []))
            if line is None or not starts:
                continue
            # the line with the magic before it, and the empty line before that
            begin = bases[file, split] + at - len(MAGIC)
            text = MAGIC + line + END.encode()
            for k in range(max(0, bisect_right(starts, begin) - 1), len(starts)):
                if starts[k] >= begin + len(text):
                    break
                lo, hi = max(starts[k], begin), min(stops[k], begin + len(text))
                if lo < hi:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([starts[k]], pa.int64()), pa.array([lo], pa.int64()), pa.array([text[lo - begin : hi - begin]], pa.binary())], names=["file", "offset", "lo", "bytes"])

    def joined(group: pa.Table) -> pa.Table:
        parts = sorted(zip(group["lo"].to_pylist(), group["bytes"].to_pylist(), strict=True))
        line = b"".join(x for _, x in parts)[len(MAGIC) :]
        found = _parsed(line)
        told = _described(line[found[0] : found[1]], found[2])
        return pa.table([group["file"][:1], group["offset"][:1], *(pa.array([x], t) for x, t in zip(told, _KINDS[5:], strict=True))], names=["file", "offset", *_NAMES[5:]])

    cut = lines.mapInArrow(pieces, "file string, offset bigint, lo bigint, bytes binary")
    return cut.groupBy("file", "offset").applyInArrow(joined, f"file string, offset bigint, {FIELDS}")


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) written as archives and read back: records with page ids instead of names.

    A broken chain, or a payload that is not what its header says, is an error. See records() for what odd rows give.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(records(pages, least), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS BIGINT)")
    place = F.concat_ws(" ", F.col("type"), F.lit("record in"), F.col("file"), F.lit("at"), F.col("offset").cast("string"))
    sound = F.when((F.col("type") != BROKEN) & F.col("body_ok"), F.col("type")).otherwise(F.raise_error(place))
    return read(spark, path).withColumn("type", sound).withColumn("page_id", page("id")).withColumn("refers_to", page("refers_to"))
