"""Content-addressed WARC archive.

Every page becomes a WARC/1.1 record.  The archive keeps two tables in the
shared folder: ``headers``, the exact header bytes of every record, and
``payloads``, each distinct payload once under its SHA-256.  That a digest stands
for one payload is checked by a second hash and the length while writing, and by
hashing the stored bytes again while reading.  Records are put together again by
a join on the digest.

Of the records with one payload of at least ``MIN_REVISIT`` bytes, that of the
least page id is the response and the others revisit it; smaller payloads are
always responses.  Copies of a payload collapse inside each task before the
shuffle; the join's record side is narrow, so AQE can split a hot digest.

Edge cases: null html is an empty payload; a null page id gives a response that
nothing revisits; repeated rows of the least page id are all responses; a null
url leaves out the target line, and CR, LF and % in a url are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.session import scratch_path

MIN_REVISIT = 100
CRLF = "\r\n"
_DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str) -> str:
    """Write the archive of ``pages`` (page_id, url, html) under ``path``."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("second"))
    per = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.min("second").alias("lo"), F.max("second").alias("hi"),
                                       F.min("size").alias("least"), F.max("size").alias("most"))
    clash = (F.col("lo") != F.col("hi")) | (F.col("least") != F.col("most"))
    per = per.select("digest", F.when(clash, F.raise_error(F.concat(F.lit("two payloads share the digest "), "digest")))
                     .otherwise(F.col("first")).alias("first"))
    again = (F.col("size") >= MIN_REVISIT) & F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    h = narrow.join(per, "digest").withColumn("again", again)
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Target-URI", url), _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(F.col("again"), _record_id(F.col("first")))),
        _line("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("again"), F.lit(0)).otherwise(F.col("size")).cast("string")), F.lit(CRLF))
    h.select("digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, stored, record): each original record put together from the two tables; ``stored`` is the
    payload's digest, computed once for each payload, however many records share it."""
    h = spark.read.parquet(f"{path}/headers")
    p = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload does not match its digest "), "digest")))
    j = h.join(p.select("digest", "payload", sound.alias("stored")), "digest").select("header", "payload", "stored")
    end = F.lit(CRLF * 2).cast("binary")
    own = F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    return j.withColumn("record", F.when(own, F.concat("header", end)).otherwise(F.concat("header", "payload", end)))


def _field(head: Column, name: str, value: str = "[^\r\n]*") -> Column:
    return F.regexp_extract(head, f"\n{name}: ({value})\r", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """Read page_id, record_type, refers_to and the payload's size and digest back from the records' bytes."""
    text = F.col("record").cast("string")
    r = records.withColumn("head", F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF)))
    r = r.withColumn("kind", _field(F.col("head"), "WARC-Type"))
    size = F.octet_length("head") + 2
    own = F.expr("substring(record, octet_length(head) + 3, cast(regexp_extract(head, '\\nContent-Length: ([0-9]+)', 1) as int))")
    r = r.withColumn("body", F.when(F.col("kind") == "revisit", F.col("payload")).otherwise(own))
    # a revisit has no bytes of its own: its payload was hashed where it is stored
    r = r.withColumn("digest", F.when(F.col("kind") == "revisit", F.col("stored")).otherwise(F.sha2("body", 256)))
    declared = _field(F.col("head"), "WARC-Payload-Digest", "sha256:[0-9a-f]{64}")
    page = lambda name: F.nullif(_field(F.col("head"), name, "<urn:page:-?[0-9]*>"), F.lit("<urn:page:>"))
    number = lambda name: F.regexp_extract(F.nullif(page(name), F.lit("")), "-?[0-9]+", 0).cast("long")
    whole = F.octet_length("record") == size + F.when(F.col("kind") == "revisit", 0).otherwise(F.octet_length("body")) + 4
    ok = (declared == F.concat(F.lit("sha256:"), "digest")) & whole
    return r.select(number("WARC-Record-ID").alias("page_id"), F.octet_length("body").cast("long").alias("payload_bytes"),
                    F.when(ok, F.col("digest")).otherwise(F.raise_error(F.lit("damaged record"))).alias("payload_digest"),
                    F.col("kind").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))


def report(pages: DataFrame) -> DataFrame:
    """Write the archive of all pages, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    return parse_records(read_records(spark, write_archive(pages, scratch_path(spark, "warc"))))
