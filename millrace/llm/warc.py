"""A content-addressed WARC archive.

``payloads``: each distinct payload once, under its SHA-256.  ``headers``: the exact header block
of every record and the digest of its payload.  Original records come back through joins, and what
is read back is parsed from their bytes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import dropped, saved, scratch
from millrace.operators.layout import drop_stored
from millrace.sources.scratch import hold, settings

CRLF = "\r\n"
URN = "urn:millrace:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that share a payload meet it in groups of about so many.
SHARE = 1 << 16
#: Payload bytes of a bucket.
BUCKET_BYTES = 64 << 20


@dataclass
class Archive:
    """Files under ``path``; ``table`` names the payloads in buckets by digest, for sessions that know it."""

    spark: SparkSession
    path: str
    table: str | None = None

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        """Stored payloads; one that doesn't match its digest fails the query."""
        stored = self.spark.table(self.table) if self.table else self.spark.read.parquet(f"{self.path}/payloads")
        broken = F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))
        return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(broken))


def write_archive(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = 1000,
    id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", share: int = SHARE,
) -> Archive:
    """Archive one record for each row of ``pages``.

    Of records with equal payloads of ``least`` bytes or more, the one with the largest id (of
    repeated ids, any one) is a response and the others revisit it; smaller ones are all responses.
    Record ids hold the page's id and the row's number, so they differ even where page ids repeat.
    A null payload is empty, a null url is left out of the header, a null id is lower than any other
    and is written as ``null``.  An empty table gives an empty archive; other columns are ignored.
    Equal payloads are counted before they meet, and the records of one with many are dealt into
    groups of about ``share``, so that it is no hot key when records come back.
    """
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), payload.alias("payload"))
    narrow = rows.select(
        "id", "url", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("sha256"), F.monotonically_increasing_id().alias("row"),
    )
    narrow = saved(narrow, "warc-rows")
    kinds = narrow.groupBy("sha256").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("records"), F.first("bytes").alias("stored"))
    kinds = saved(kinds.withColumn("groups", F.ceil(F.col("records") / share).cast("int")), "warc-payloads")
    typed = narrow.join(kinds, "sha256")
    response = (F.col("bytes") < least) | (F.col("best.row") == F.col("row"))
    urn = lambda page, row: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    header = F.concat(
        F.concat_ws(
            CRLF,
            F.lit("WARC/1.1"),
            line("WARC-Type", F.when(response, "response").otherwise("revisit")),
            line("WARC-Record-ID", urn("id", "row")),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
            F.when(~response, line("WARC-Refers-To", urn("best.id", "best.row"))),
            F.when(~response, line("WARC-Profile", F.lit(PROFILE))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(response, F.col("bytes")).otherwise(0).cast("string")),
        ),
        F.lit(CRLF + CRLF),
    )
    group = F.pmod(F.xxhash64("row"), F.col("groups")).cast("int")
    typed.select(header.alias("header"), "sha256", "groups", group.alias("group")).write.parquet(f"{path}/headers")
    spark, table = pages.sparkSession, f"millrace_payloads_{uuid.uuid4().hex}"
    total = kinds.agg(F.sum("stored")).first()[0] or 0
    buckets = int(min(100_000, 1 + total // BUCKET_BYTES))
    hold(table, lambda: drop_stored(spark, table))
    # payloads are shuffled once: the tasks that tell equal ones apart each write a bucket
    with settings(spark, spark_sql_shuffle_partitions=str(buckets), spark_sql_adaptive_coalescePartitions_enabled="false"):
        distinct = rows.select(F.sha2("payload", 256).alias("sha256"), "payload").dropDuplicates(["sha256"])
        distinct.write.bucketBy(buckets, "sha256").option("path", f"{path}/payloads").format("parquet").saveAsTable(table)
    dropped(narrow, kinds)
    return Archive(spark, path, table)


def records(archive: Archive) -> DataFrame:
    """Rows (record, payload_bytes, payload_digest): the original records, byte for byte, and the payload that each has or revisits.

    A revisit has no payload of its own.  Size and SHA-1 are worked out once for a stored payload.
    """
    stored = archive.payloads.select(
        "sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    # headers go to where the payloads lie, but payloads of several groups, one of ``share`` records at
    # most, go to their groups
    several = archive.headers.where("groups > 1")
    numbers = several.select("sha256", "groups").distinct()
    spread = stored.join(numbers, "sha256").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    alone = archive.headers.where("groups = 1").drop("group").join(stored.hint("merge"), "sha256")
    joined = alone.drop("groups").unionByName(several.drop("groups").join(spread, ["sha256", "group"]).drop("group"))
    end = F.lit(CRLF + CRLF).cast("binary")
    own = F.when(header_field("WARC-Type", F.col("header")) == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(F.concat(F.col("header").cast("binary"), own, end).alias("record"), "payload_bytes", "payload_digest")


def header_field(name: str, header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def page_of(name: str, header: Column) -> Column:
    return F.nullif(F.regexp_extract(header_field(name, header), rf"<{URN}(.*):\d+>", 1), F.lit("null")).cast("long")


def read_index(archive: Archive) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from the records' bytes.

    A response's size and digest are those of the bytes that follow its header, a revisit's those of
    the payload it shares; either must agree with what the header says, and a record must end where
    its length says.
    """
    whole = F.col("record").cast("string")
    header = F.concat(F.substring_index(whole, CRLF + CRLF, 1), F.lit(CRLF + CRLF))
    found = records(archive).select("record", header.alias("header"), F.col("payload_bytes").alias("shared_bytes"), F.col("payload_digest").alias("shared_digest"))
    length = header_field("Content-Length", F.col("header")).cast("int")
    parsed = found.select(
        "header", "shared_bytes", "shared_digest", length.alias("length"), header_field("WARC-Type", F.col("header")).alias("record_type"),
        F.substring("record", F.octet_length("header") + 1, length).alias("body"),
        (F.octet_length("record") - F.octet_length("header") - 4 == length).alias("ends"),
    )
    response = F.col("record_type") == "response"
    parsed = parsed.select(
        "header", "length", "ends", "record_type",
        F.when(response, F.octet_length("body").cast("long")).otherwise(F.col("shared_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("body")).otherwise(F.col("shared_digest")).alias("payload_digest"),
    )
    told = F.regexp_replace(header_field("WARC-Payload-Digest", F.col("header")), "^sha1:", "")
    broken = F.raise_error(F.concat(F.lit("header and payload differ: "), "header"))
    return parsed.select(
        page_of("WARC-Record-ID", F.col("header")).alias("page_id"),
        "payload_bytes",
        F.when((told == F.col("payload_digest")) & F.col("ends"), told).otherwise(broken).alias("payload_digest"),
        "record_type",
        page_of("WARC-Refers-To", F.col("header")).alias("refers_to"),
    )


def export_warc(archive: Archive, path: str, records_per_file: int = 2000) -> None:
    """Write the records as plain WARC files of at most ``records_per_file`` records (UTF-8 payloads)."""
    whole = records(archive).select(F.decode(F.substring("record", F.lit(1), F.octet_length("record") - 4), "utf-8").alias("value"))
    whole.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (header, payload) of WARC files, walked by Content-Length; one file is one row's memory."""

    def walk(batches):
        for batch in batches:
            for content in batch.column(0):
                data, at, heads, bodies = content.as_py(), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end].decode()
                    size = next(int(x[15:]) for x in head.split(CRLF) if x.startswith("Content-Length:"))
                    heads.append(head)
                    bodies.append(data[end : end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], ["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(walk, "header string, payload binary")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Archive ``pages`` in the shared scratch folder and return the index read back from it."""
    return read_index(write_archive(pages, scratch(pages.sparkSession, "warc"), **names))
