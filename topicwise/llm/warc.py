"""WARC archives: written as text files of records, read back by boundary chains.

A record ends where its length says, not where the next magic stands, since payloads may hold a magic too. Tasks read any
byte range of a file, cut at every magic, and emit for each candidate record its offset and that of its successor. Pointer
jumping from each file's start keeps the candidates that a chain of true records reaches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.llm.common import small, stage
from topicwise.session import scratch_dir

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
    salts: int = 16,
) -> str:
    """Write one record per row and return the folder of archive files.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the largest id are responses; the others are
    revisits that name it and carry no payload. Null payloads are empty; null urls leave out the header; a null id is below
    every other and makes a record without an id of its own. Repeated rows make a record each. An empty table gives an empty
    folder. Only the digests that repeat are joined to the rows: broadcast below a counted bound, else salted.
    """
    path = path or scratch_dir(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload")
    )
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    repeated = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    repeated = stage(repeated.filter("n > 1").select(F.col("digest").alias("d"), "first"), "warc-repeated")
    if small(repeated):
        rows = rows.join(F.broadcast(repeated), F.col("digest") == F.col("d"), "left")
    else:
        salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(salts))
        copies = repeated.withColumn("s", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
        rows = rows.withColumn("salt", salt).join(copies, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    revisit = F.coalesce(F.col("bytes") >= least_bytes, F.lit(False)) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    rows.select(_record(revisit, date).alias("value")).write.option("lineSep", END).text(path)
    return path


def _record(revisit: Column, date: str) -> Column:
    """Everything of a record but the two line ends that close it."""
    one_line = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">\r\n"))
    header = lambda text, value: F.coalesce(F.concat(F.lit(text), value), F.lit(""))
    return F.concat(
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        header("WARC-Record-ID: ", name("id")),
        header("WARC-Target-URI: ", F.concat(one_line, F.lit("\r\n"))),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, F.concat(header("WARC-Refers-To: ", name("first")), F.lit(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        ))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )


CANDIDATE = (
    "file string, offset bigint, successor bigint, size bigint, whole boolean, id string, url string, type string, refers_to string, "
    "http_bytes bigint, payload_bytes bigint, payload_digest string"
)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per true record: id, url, type, refers_to, payload_bytes, payload_digest (hex SHA-1), file, offset.

    Bytes and digest are of the payload as read; for a revisit, of the payload its headers state. Works on files of any size,
    which need not fit into a task.
    """
    found = stage(_candidates(spark, path), "warc-candidates")
    true = stage(reachable(found.select("file", "offset", "successor")), "warc-chain")
    records = found.join(true, ["file", "offset"])
    # A payload that holds a magic was cut there: put those few records together from a second look at their byte ranges.
    cut = records.filter("NOT whole")
    if cut.limit(1).count():
        records = records.filter("whole").unionByName(_mended(spark, path, stage(cut, "warc-cut")))
    return records.select("id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "file", "offset")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, with its place: (file, block, before, size, value); ``before`` counts bytes since the block's
    first piece. A reader's pieces are whole, whatever byte ranges the files are dealt in."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))


def _placed(pieces: DataFrame, function, schema: str) -> DataFrame:
    """Apply ``function`` to (value, size, first piece of the file?) of each piece; add file, block, before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != place:
                    place, before = (file, block), 0
                rows.append((file, block, before, *function(value)))
                before += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=types)

    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return pieces.mapInArrow(run, schema)


def _offsets(placed: DataFrame) -> DataFrame:
    """Replace block and before by the offset in the file: blocks of a file follow each other, one small row per block."""
    blocks = placed.groupBy("file", "block").agg(F.max(F.col("before") + F.col("size")).alias("bytes"))
    blocks = blocks.select(
        F.col("file").alias("f"), F.col("block").alias("b"), F.expr("sum(bytes) OVER (PARTITION BY file ORDER BY block) - bytes").alias("base")
    )
    joined = placed.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    # A piece follows its magic; what stands before the first magic of a file has none.
    joined = joined.withColumn("offset", F.col("base") + F.col("before") - len(MAGIC))
    return joined.filter("offset >= 0").drop("base", "before", "block")


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    fields = "size bigint, length bigint, whole boolean, id string, url string, type string, refers_to string, http_bytes bigint, payload_bytes bigint, payload_digest string"
    placed = _placed(_pieces(spark, path), _parsed, f"file string, block bigint, before bigint, {fields}")
    # Staged, as both the block totals and the rows are read from it, and the files should be read once.
    rows = _offsets(stage(placed, "warc-pieces"))
    return rows.withColumn("successor", F.col("offset") + F.col("length")).selectExpr(*[f.split()[0] for f in CANDIDATE.split(", ")])


def _header(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n"))
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _parsed(value: bytes) -> tuple:
    """(size, length, whole, fields ...) of a candidate; length is that of the whole record, null if there is no header."""
    size, head = len(value) + len(MAGIC), value.find(b"\r\n\r\n")
    header = _header(value[:head]) if head >= 0 else {}
    stated = header.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", stated):
        return size, None, False, None, None, None, None, None, None, None
    length = len(MAGIC) + head + 4 + int(stated) + len(END)
    block = value[head + 4 : head + 4 + int(stated)]
    whole = len(MAGIC) + len(value) >= length
    inner = block.find(b"\r\n\r\n")
    http = _header(block[:inner]) if inner >= 0 else {}
    payload = block[inner + 4 :] if inner >= 0 else block
    stated = http.get("content-length", "")
    bytes_, digest = len(payload), hashlib.sha1(payload).hexdigest()
    kind = header.get("warc-type")
    if kind == "revisit":
        bytes_ = int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None
        digest = header.get("warc-payload-digest", "").removeprefix("sha1:")
    name = lambda key: header[key].removeprefix("<urn:page:").removesuffix(">") if key in header else None
    return size, length, whole, name("warc-record-id"), header.get("warc-target-uri"), kind, name("warc-refers-to"), None, bytes_, digest


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from each file's start, from (file, offset, successor).

    Each round doubles the jump: what is reached jumps by it once, and every jump is followed by itself. The rounds are the
    binary logarithm of the longest chain; each is written, so a lost executor costs one round.
    """
    links = links.select("file", "offset", F.col("successor").alias("jump"))
    known = links.select("file", "offset")
    jumps = stage(links.join(known.withColumnRenamed("offset", "jump"), ["file", "jump"]).select("file", "offset", "jump"), "warc-jumps")
    reached = stage(known.filter("offset = 0"), "warc-reached")
    while True:
        further = reached.join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        reached = stage(reached.unionByName(further), "warc-reached")
        then = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("next"))
        jumps = stage(jumps.join(then, ["file", "jump"]).select("file", "offset", F.col("next").alias("jump")), "warc-jumps")
        if not jumps.limit(1).count():
            return reached


def _mended(spark: SparkSession, path: str, cut: DataFrame) -> DataFrame:
    """Records whose payload holds a magic. Each is cut into pieces; a piece belongs to the record whose range it is in."""
    schema = "file string, block bigint, before bigint, size bigint, value binary"
    pieces = _offsets(stage(_placed(_pieces(spark, path), lambda v: (len(v) + len(MAGIC), v), schema), "warc-second"))
    ends = cut.select("file", F.col("offset").alias("start"), "successor")
    inside = pieces.join(ends, "file").filter("offset >= start AND offset < successor")
    whole = inside.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, start, parts = (c.to_pylist() for c in batch.columns)
            done = [_parsed(MAGIC.encode().join(p["value"] for p in ps)) for ps in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array([d[8] for d in done], pa.int64()), pa.array([d[9] for d in done], pa.string())],
                ["file", "offset", "payload_bytes", "payload_digest"],
            )

    fields = whole.mapInArrow(run, "file string, offset bigint, payload_bytes bigint, payload_digest string")
    return cut.drop("payload_bytes", "payload_digest").join(fields, ["file", "offset"])
