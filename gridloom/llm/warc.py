"""A content-addressed WARC archive.

``store`` holds each payload's bytes once, under its SHA-256; ``headers`` holds every record's exact
header block, with its number and the address of its payload.  A join rebuilds the records byte for
byte (``records``), ``save`` writes them as WARC files, and all that is read back (``index``,
``pages``) is parsed from rebuilt records: the header from the bytes before the empty line, the
payload from as many bytes as Content-Length says.  A revisit has no payload, so it is looked up in
the response that its WARC-Refers-To names.

Of records with equal payloads the one with the largest page_id is the response, and the others
are revisits of it.  Repeated rows with the largest page_id are responses each, as are all rows
without a page_id where no equal payload has one; payloads are stored once all the same.

Null html counts as an empty payload and is marked in the header.  A url that a header line cannot
hold as it is (null, empty, with control characters or outer white space) is percent-encoded in
WARC-Target-URI and given exactly in X-Source-URI, so pages come back as they were.  Record ids are
unique also for repeated rows.  No pages make an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import Scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four runs of 40 bits, eight symbols each."""
    digest = F.sha1(payload)
    return F.transform(F.array(digest), lambda d: F.concat(*[_run(F.substring(d, 1 + 10 * k, 10)) for k in range(4)]))[0]


def _run(hex10: Column) -> Column:
    value = F.conv(hex10, 16, 10).cast("long")
    return F.concat(*[F.substr(F.lit(BASE32), (F.shiftright(value, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)])


def _field(name: str) -> Column:
    """A field of ``head``; null if it has none."""
    return F.get(F.regexp_extract_all("head", F.lit(rf"(?:^|\n){name}: ([^\r\n]*)"), F.lit(1)), F.lit(0))


def _number(name: str) -> Column:
    return F.regexp_extract(_field(name), r"^<urn:gridloom:record:(\d+)>$", 1).try_cast("long")


@dataclass
class Archive:
    headers: DataFrame
    store: DataFrame

    def records(self) -> DataFrame:
        """(record): all records as they stand in a WARC file. Only responses meet the store."""
        full = self.headers.where("response").join(self.store, "addr").select(F.concat("header", "payload", F.lit(END)).alias("record"))
        return full.unionByName(self.headers.where("not response").select(F.concat("header", F.lit(END)).alias("record")))

    def save(self, path: str) -> None:
        """Write WARC files below ``path``; their ends of records are the ends of Spark's text lines."""
        bare = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - len(END))
        self.records().select(bare.cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)

    def parsed(self) -> DataFrame:
        """A row per record, from its bytes alone."""
        # The bytes before the first empty line; casting binary to string leaves them as they are.
        head = self.records().select("record", F.substring_index(F.col("record").cast("string"), END.decode(), 1).alias("head"))
        length = _field("Content-Length").try_cast("int")
        split = head.select("record", "head", (F.octet_length("head") + len(END)).alias("at"), length.alias("length"))
        body = F.substring(F.col("record"), F.col("at") + 1, F.col("length"))
        whole = (F.octet_length("record") == F.col("at") + F.col("length") + len(END)) & (F.substring(F.col("record"), F.col("at") + F.col("length") + 1, F.lit(len(END))) == F.lit(END))
        return split.select(
            _number("WARC-Record-ID").alias("number"),
            _field("X-Page-ID").try_cast("long").alias("page_id"),
            _field("WARC-Type").alias("record_type"),
            _number("WARC-Refers-To").alias("refers"),
            F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
            F.coalesce(_field("X-Source-URI"), F.lit("")).alias("exact"),
            _field("WARC-Target-URI").alias("uri"),
            (F.coalesce(_field("X-Null-Payload"), F.lit("")) == "true").alias("missing"),
            F.coalesce(whole, F.lit(False)).alias("whole"),
            body.alias("body"),
        )

    def index(self) -> DataFrame:
        """A row per record: digests are those of the bytes read, revisits take length and page from the response they name."""
        row = self.parsed().withColumn("digest", F.when(F.col("record_type") == "response", base32_sha1(F.col("body")))).withColumn("n", F.octet_length("body").cast("long")).drop("body")
        full = row.where("record_type = 'response'")
        same = F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(False))
        responses = full.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), (F.col("whole") & same).alias("verified"))
        named = full.select(F.col("number").alias("refers"), F.col("page_id").alias("refers_to"), F.col("n").alias("payload_bytes"), F.col("digest").alias("held"))
        again = row.where("record_type <> 'response'").join(named, "refers", "left")
        good = F.col("whole") & (F.col("n") == 0) & F.coalesce(F.col("held") == F.col("payload_digest"), F.lit(False))
        return responses.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", good.alias("verified")))

    def pages(self) -> DataFrame:
        """(page_id, url, html) as they were written."""
        row = self.parsed()
        exact = F.decode(F.unbase64("exact"), "UTF-8")
        row = row.withColumn("url", F.when(F.col("exact") == "", F.col("uri")).when(F.col("exact") == "-", None).when(F.col("exact") == "=", "").otherwise(exact))
        full = row.where("record_type = 'response'")
        again = row.where("record_type <> 'response'").drop("body").join(full.select(F.col("number").alias("refers"), "body"), "refers")
        html = F.when(~F.col("missing"), F.decode("body", "UTF-8")).alias("html")
        return full.select("page_id", "url", html).unionByName(again.select("page_id", "url", html))


def write(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, date: str | None = None) -> Archive:
    """Archive ``pages`` (page_id, url, html); payloads of fewer than ``least_bytes`` are never revisits.

    ``date`` is the WARC-Date of all records, by default now.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = pages.select("page_id", "url", F.col("html").isNull().alias("missing"), payload.alias("payload")).withColumn("addr", F.sha2("payload", 256))
    store = page.groupBy("addr").agg(F.any_value("payload").alias("payload"))
    store = scratch.table(store, "store", wide=True)
    meta = page.select("page_id", "url", "missing", "addr", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest"))
    meta = scratch.table(meta.withColumn("number", F.monotonically_increasing_id()), "meta")  # numbers hold once they are written
    last = F.max(F.struct("page_id", "number")).alias("last")
    first = meta.groupBy("addr").agg(last, F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    # Equal addresses must mean equal bytes: a second digest has to agree.
    sound = F.assert_true(F.col("d0") == F.col("d1"), F.lit("two payloads share a digest")).isNull().alias("sound")
    first = scratch.table(first.select("addr", F.col("last.page_id").alias("response"), F.col("last.number").alias("refers"), sound), "responses")
    both = meta.join(first, "addr").where("sound")
    same = F.coalesce(F.col("page_id") == F.col("response"), F.col("response").isNull())
    both = both.withColumn("revisit", ~same & (F.col("n") >= least_bytes))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:gridloom:record:"), F.col(c).cast("string"), F.lit(">"))
    plain = F.coalesce(F.col("url").rlike(r"^[^\x00-\x20\x7f](?:[^\x00-\x1f\x7f]*[^\x00-\x20\x7f])?$"), F.lit(False))
    exact = F.when(F.col("url").isNull(), "-").when(F.col("url") == "", "=").otherwise(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("number")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.when(plain, F.col("url")).otherwise(F.url_encode(F.coalesce("url", F.lit(""))))),
        F.when(plain, "").otherwise(line("X-Source-URI", exact)),
        F.when(F.col("page_id").isNull(), "").otherwise(line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn("refers")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.when(F.col("missing"), "X-Null-Payload: true\r\n").otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    headers = scratch.table(both.select("number", "addr", (~F.col("revisit")).alias("response"), F.encode(head, "UTF-8").alias("header")), "headers")
    scratch.drop("meta", "responses")
    return Archive(headers, store)


def open_archive(spark: SparkSession, root: str) -> Archive:
    return Archive(spark.read.parquet(f"{root}/headers"), spark.read.parquet(f"{root}/store"))
