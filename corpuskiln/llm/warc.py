"""WARC archives: written by Spark's text writer, read back in parallel by boundary-chain verification.

A reader task sees its stretch of a file cut at every occurrence of the magic line, inside payloads too. Each cut is a
candidate record, with the offset at which its successor must begin if it is one. Pointer jumping from the start of each file
keeps only the candidates that the chain of successors reaches; the others are parts of a payload and are put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.llm.storage import durable, new_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Digests, or stretches that are not records, up to this number are broadcast; more are joined.
FEW = 200_000
#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 1000


def percent_encoded(url: Column) -> Column:
    """A url whose characters other than visible ASCII ones are percent-encoded as UTF-8."""

    def encoded(c: Column) -> Column:
        return F.when(c.rlike("^[\\x21-\\x7e]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))

    return F.when(url.rlike("[^\\x21-\\x7e]"), F.array_join(F.transform(F.split(url, ""), encoded), "")).otherwise(url)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record, as a string, for each row of `pages`.

    The payload is the html in UTF-8; null is empty. Of the rows with equal payloads of LEAST_REVISIT bytes or more, that with
    the largest page_id is a response and the others are revisits of it; rows that repeat that page_id are responses too, and
    so is every smaller payload. A null page_id is smaller than any other and is written as an empty id. Control characters,
    spaces and non-ASCII characters of a url are percent-encoded as UTF-8, so that a header never holds a line break.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        percent_encoded(F.coalesce(F.col(url), F.lit(""))).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= LEAST_REVISIT
    copied = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copied = durable(copied, "copied")
    rows = rows.join(F.broadcast(copied) if copied.count() <= FEW else copied, "digest", "left")
    revisit = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def record_id(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id("first_id"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes the pages' records to WARC files under `path`, one for each task."""
    records(pages, **columns).write.option("lineSep", END).text(path)


def stretches(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the task's part of the file), n and text of every stretch that follows a magic line, in the order of n.

    How files are split among tasks, and so n, may change from one scan to the next; so the stretches are written once.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    return durable(rows, "stretches", "zstd")


def _head() -> Column:
    return F.substring_index("text", END, 1)


def _length() -> Column:
    """The length of the block that the header states; null without a whole header."""
    stated = F.regexp_extract(_head(), "(?i)\\r\\nContent-Length: *([0-9]{1,18})(\\r\\n|$)", 1)
    return F.when(F.octet_length(_head()) < F.octet_length("text"), stated.try_cast("long"))


def candidates(raw: DataFrame) -> DataFrame:
    """file, n, at and succ of every stretch, without its text.

    at is the offset of the magic; succ the offset at which the next record must begin, null where the header has no length.
    Offsets are running sums within a task's part of a file, set off by the sums of the parts before it in the file.
    """
    width = len(MAGIC)
    sizes = raw.select("file", "start", "n", (F.octet_length("text") + width).alias("bytes"), (F.octet_length(_head()) + len(END) + _length()).alias("headed"))
    sizes = durable(sizes, "sizes")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("file", "start").agg(F.sum("bytes").alias("bytes")).select("file", "start", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("file", "start").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("within", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(parts, ["file", "start"])
    at = F.col("within") + F.col("before") - width
    return placed.select("file", "n", at.alias("at"), (at + width + F.col("headed") + len(END)).alias("succ"))


def reachable(links: DataFrame) -> DataFrame:
    """file and at of the candidates (file, at, succ) that the chain from offset 0 reaches, by pointer jumping.

    In round k the reached set is joined with pointers of 2**k steps, and the pointers with themselves; it ends when no pointer
    out of the reached set leads to a candidate that is not reached yet.
    """
    pointers = durable(links.filter("succ > at").select("file", "at", "succ").join(links.select("file", F.col("at").alias("succ")), ["file", "succ"]).select("file", "at", "succ"), "pointers")
    reached = durable(links.filter("at = 0").select("file", "at"), "reached")
    n = reached.count()
    while True:
        stepped = reached.join(pointers, ["file", "at"]).select("file", F.col("succ").alias("at"))
        reached = durable(reached.unionByName(stepped).distinct(), "reached")
        n, was = reached.count(), n
        if n == was:
            return reached
        twice = pointers.select("file", F.col("at").alias("first"), F.col("succ").alias("at")).join(pointers, ["file", "at"])
        pointers = durable(twice.select("file", F.col("first").alias("at"), "succ"), "pointers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, refers_to, uri, digest, http_length, payload of every true record under `path`.

    The payload is what follows the HTTP header of the block. Bytes after the last record that the chain reaches in a file are
    not records. An empty folder gives no rows.
    """
    raw = stretches(spark, path)
    found = durable(candidates(raw), "candidates")
    true = reachable(found.select("file", "at", "succ"))
    marked = found.select("file", "n", "at").join(true.withColumn("is_record", F.lit(True)), ["file", "at"], "left")
    # Stretches that are not records belong to the last record before them; those before the first to none.
    back = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    owned = marked.withColumn("owner", F.last(F.when(F.col("is_record"), F.col("n")), True).over(back))
    parts = durable(owned.filter("is_record is null").select("n", "owner"), "parts")
    cut = parts.filter("owner is not null").select(F.col("owner").alias("n"), "owner").distinct()
    apart = durable(parts.unionByName(cut).withColumn("apart", F.lit(True)), "apart")
    # Only records that the magic has cut, and their parts, are shuffled; all others are read as they stand.
    texts = raw.select("n", "text").join(F.broadcast(apart) if apart.count() <= FEW else apart, "n", "left")
    pieces = texts.filter("apart and owner is not null").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("pieces"))
    joined = pieces.select(F.array_join(F.transform("pieces", lambda p: p["text"]), MAGIC).alias("text"))
    whole = texts.filter("apart is null").select("text").unionByName(joined)
    whole = whole.withColumns({"head": _head(), "length": _length()})
    whole = whole.withColumn("block", F.expr(f"substring(cast(text AS binary), octet_length(head) + {len(END) + 1}, cast(length AS int))"))
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    whole = whole.withColumn("http", http)

    def header(c: str, name: str) -> Column:
        return F.regexp_extract(c, f"(?i)(?:^|\\r\\n){name}: *([^\\r\\n]*)", 1)

    return whole.select(
        header("head", "WARC-Type").alias("record_type"),
        header("head", "WARC-Record-ID").alias("record_id"),
        header("head", "WARC-Refers-To").alias("refers_to"),
        header("head", "WARC-Target-URI").alias("uri"),
        F.regexp_replace(header("head", "WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        header("http", "Content-Length").try_cast("long").alias("http_length"),
        F.expr(f"substring(block, octet_length(http) + {len(END) + 1})").alias("payload"),
    )


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row, read back from a written archive.

    A response's digest and size are taken from its payload as read; a revisit's digest is its header's, and its size the
    length that its HTTP header states for the full payload.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **columns)
    response = F.col("record_type") == "response"

    def page(c: str) -> Column:
        return F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1).try_cast("long")

    return read(spark, path).select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(~response, page("refers_to")).alias("refers_to"),
    )
