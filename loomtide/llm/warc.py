"""WARC archives written and read back, records found by boundary chains.

A reader that starts anywhere can't trust the magic string: a payload may hold
it. So every place that has it is only a candidate, and its header says where
the record after it would begin. Pointer jumping from the start of each file
doubles the distance it covers in every round and keeps the candidates that
are reached; magic inside payloads never is.

Files are split wherever Spark splits them: the text source cuts at the magic
string, so a segment is what follows a candidate up to the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtide.llm.common import materialize, release, sieve

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 1000
#: What a revisit says of its kind.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Characters that end a line somewhere or could be taken for the space around a value.
_SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x85\xa0\u2028\u2029"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _uri(url: Column) -> Column:
    """The url with its white space percent-encoded, so that it stays within its line."""
    for c in _SPACES:
        url = F.replace(url, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    return url


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, min_revisit: int = REVISIT_BYTES, date: str | None = None) -> None:
    """A record for each page, in archives under path.

    Of pages with equal payloads of min_revisit bytes or more, the one with
    the largest page_id (repeated rows with it too, null the least) holds the
    payload; the others are revisits of it. A null html is empty, a null url
    has no header line, a null page_id an empty number in its record's; white
    space in a url is percent-encoded. Repeated rows are records each, an empty
    table gives archives without records, other columns are not read. date is
    the time of all records (ISO 8601), now if it isn't given.

    Payloads that surely don't repeat aren't moved: digests that do are told
    apart from most others by a bounded set of bits, and only rows with such
    a digest meet their keeper.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).select("*", F.octet_length("html").cast("long").alias("size"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    large = rows.where(F.col("size") >= min_revisit)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    kept = materialize(kept, "keepers", slim=True)
    may_repeat = (F.col("size") >= min_revisit) & sieve(kept, "digest")("digest")
    some = rows.where(may_repeat).join(kept, "digest", "left")
    known = rows.where(~may_repeat).withColumn("keeper", F.lit(None).cast("long")).unionByName(some)
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("keeper")))),
        _field("WARC-Original-Length", F.when(revisit, F.col("size").cast("string"))),
        F.lit("Content-Type: text/html"), F.lit("\r\n"),
        F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(BREAK),
    )
    known.select(F.concat(head, payload).alias("value")).write.option("lineSep", BREAK).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, n, raw): what follows each magic string; part and n give the order."""
    return (
        spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("raw"))
    )


def _placed(segments: DataFrame) -> DataFrame:
    """Adds x, the byte of the magic string before a segment of that size."""
    before = Window.partitionBy("file").orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("x", F.sum(F.col("size") + len(MAGIC)).over(before) - len(MAGIC)).where(F.col("x").isNotNull()).drop("part", "n")


def _header(raw: Column) -> Column:
    """The header as text, null if it doesn't end in this segment."""
    return F.when(F.locate(BREAK, raw.cast("string")) > 0, F.substring_index(raw.cast("string"), BREAK, 1))


def _get(header: Column, name: str) -> Column:
    # (?d): of all characters that can end a line, only \n does.
    found = F.regexp_extract(header, rf"(?imd)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def reachable(links: DataFrame) -> DataFrame:
    """(file, x, to) candidates -> (file, x) of those on the chain from byte 0."""
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    state = materialize(links.select("file", "x", "to", (F.col("x") == 0).alias("seen")), "chain", slim=True)
    stride = 1
    while stride < most:
        far = state.select("file", F.col("x").alias("to"), F.col("to").alias("next"))
        hit = state.where("seen and to is not null").select("file", F.col("to").alias("x"), F.lit(True).alias("hit")).distinct()
        after = materialize(
            state.join(far, ["file", "to"], "left").join(hit, ["file", "x"], "left")
            .select("file", "x", F.col("next").alias("to"), F.coalesce(F.col("seen") | F.col("hit"), F.col("seen")).alias("seen")),
            "chain", slim=True,
        )
        release(state)
        state, stride = after, stride * 2
    return state.where("seen").select("file", "x")


def _parsed(rows: DataFrame) -> DataFrame:
    """Adds header, begin (of the payload in raw) and length to rows with raw."""
    return (
        rows.withColumn("header", _header(F.col("raw")))
        .withColumn("begin", F.octet_length("header").cast("long") + len(BREAK))
        .withColumn("length", _get(F.col("header"), "Content-Length").try_cast("long"))
    )


def _payload() -> Column:
    return F.substring("raw", (F.col("begin") + 1).cast("int"), F.col("length").cast("int"))


def read(spark: SparkSession, path: str, of_payload: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Archives under path -> a row for each record.

    page_id, record_type, refers_to, url, digest and original_length are from
    its header, null where it has no such line. of_payload names the columns
    that are worked out from the binary payload where it is read, so that it
    isn't moved; the default is the payload itself. What no chain from the
    start of a file reaches is no record; archives without records, and empty
    files, give no rows. A very long payload is read whole.
    """
    of_payload = of_payload or {"payload": lambda c: c}
    values = [f(_payload()).alias(name) for name, f in of_payload.items()]
    own = F.octet_length("raw").cast("long")
    whole = own >= F.col("begin") + F.col("length")
    scanned = _parsed(_segments(spark, path)).select(
        "file", "part", "n", own.alias("size"), "header", "begin", "length", F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(whole, F.struct(*values)).alias("values"),
    )
    to = F.col("x") + len(MAGIC) + F.col("begin") + F.col("length") + len(BREAK)
    found = materialize(_placed(scanned).withColumn("to", to), "segments")
    true = materialize(reachable(found.select("file", "x", "to")), "records", slim=True)
    records = found.join(true, ["file", "x"])
    every = records.where("whole").select("header", "values.*")
    if (longer := records.where("not whole")).limit(1).count():
        every = every.unionByName(_continued(spark, path, longer.select("file").distinct(), true).select("header", *values))

    def page(name: str) -> Column:
        return F.regexp_extract(F.coalesce(_get(F.col("header"), name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)

    return every.select(
        page("WARC-Record-ID").try_cast("long").alias("page_id"), _get(F.col("header"), "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").try_cast("long").alias("refers_to"), _get(F.col("header"), "WARC-Target-URI").alias("url"),
        F.substring_index(_get(F.col("header"), "WARC-Payload-Digest"), "sha1:", -1).alias("digest"),
        _get(F.col("header"), "WARC-Original-Length").try_cast("long").alias("original_length"), *of_payload,
    )


def _continued(spark: SparkSession, path: str, files: DataFrame, true: DataFrame) -> DataFrame:
    """(header, begin, length, raw) of the records whose payload holds the magic
    string and goes on in later segments; only files with such records are read."""
    again = _placed(_segments(spark, path).join(files, "file", "left_semi").withColumn("size", F.octet_length("raw").cast("long")))
    owner = F.max(F.when(F.col("true"), F.col("x"))).over(Window.partitionBy("file").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    parts = (
        again.join(true.withColumn("true", F.lit(True)), ["file", "x"], "left").withColumn("own", owner).where("own is not null")
        .groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("x", "raw"))).alias("parts")).where(F.size("parts") > 1)
    )
    first, rest = F.element_at("parts", 1)["raw"], F.slice("parts", 2, F.size("parts"))
    return _parsed(parts.select(F.aggregate(rest, first, lambda a, p: F.concat(a, F.lit(MAGIC.encode()), p["raw"])).alias("raw")))


#: What digests() needs of a payload.
DIGESTS = {"payload_bytes": lambda c: F.octet_length(c).cast("long"), "payload_digest": F.sha1}


def digests(records: DataFrame) -> DataFrame:
    """read(..., DIGESTS) -> page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and SHA-1 are those of the payload that was read; a
    revisit's are from its header.
    """
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id", F.when(revisit, F.col("original_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
