"""WARC: converter for legacy ARC archives, writer and reader.

Archives are read and written through Spark's text source, so any file system
Spark knows will do: ARC as lines, WARC as pieces between ``CRLF CRLF`` (which
ends every record and every header). Files are gzip-compressed and so never
split; a parser glues the pieces of one file together again and follows the
declared lengths, so payloads may hold line ends, blank lines or any bytes.
A task holds one record at a time.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut_lineage

CRLF2 = "\r\n\r\n"
#: Payloads below this many bytes are always stored.
REVISIT_BYTES = 100
#: Fields of the record line by ARC version; the version block names them.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "file", "length"),
}
_BATCH_BYTES = 4 << 20
_RECORD = "file_key long, url string, ip string, date string, mime string, http string, payload binary, " \
          "payload_bytes long, payload_digest string"
_NAMES = [f.split()[0] for f in _RECORD.split(", ")]


def split_http(block: bytes) -> tuple[str | None, bytes]:
    """Head and payload of an HTTP response (no head: all is payload)."""
    if block.startswith(b"HTTP/"):
        head, found, payload = block.partition(b"\r\n\r\n")
        if found:
            return head.decode("utf-8", "replace"), payload
    return None, block


class _Pieces:
    """The pieces of one file as one stream, each followed by the separator."""

    def __init__(self, pieces, sep: bytes):
        self.pieces, self.sep, self.pending = iter(pieces), sep, []

    def next(self) -> bytes | None:
        return self.pending.pop() if self.pending else next(self.pieces, None)

    def take(self, length: int) -> bytes | None:
        """The next ``length`` bytes; what follows of the separator is left
        out. None if the file ends before."""
        parts, size = [], 0
        while size < length + (0 if length else 1):
            piece = self.next()
            if piece is None:
                return None
            parts += (piece, self.sep)
            size += len(piece) + len(self.sep)
        blob = b"".join(parts)
        rest = blob[length:]
        while len(rest) < len(self.sep):  # the block's end looks like the separator's start
            piece = self.next()
            if piece is None:
                return blob[:length]
            rest += piece + self.sep
        rest = rest[len(self.sep):] if rest.startswith(self.sep) else rest
        if rest:
            self.pending.append(rest[:-len(self.sep)])
        return blob[:length]


def arc_records(lines):
    """``(fields, block)`` of the records of one ARC file, given its lines.

    The version block says by its first number which fields record lines
    have; URLs may hold blanks. A line that is no record line where one is
    due is skipped, and so is a last record shorter than declared."""
    stream, fields = _Pieces(lines, b"\n"), ARC_FIELDS[1]
    while (line := stream.next()) is not None:
        text = line.rstrip(b"\r")
        if not text:
            continue
        head = text.decode("utf-8", "replace")
        is_version = head.startswith("filedesc://")
        values = head.rsplit(" ", 4 if is_version and len(head.split(" ")) == 5 else len(fields) - 1)
        names = ARC_FIELDS[1] if len(values) == 5 else fields
        if len(values) != len(names) or not values[-1].isdigit():
            continue
        block = stream.take(int(values[-1]))
        if block is None:
            return
        record = dict(zip(names, values))
        if is_version:
            number = block.split(b" ", 1)[0]
            fields = ARC_FIELDS[2] if number == b"2" else ARC_FIELDS[1]
        yield record, block


def warc_records(pieces):
    """``(header fields, block)`` of the records of one WARC file, given its
    pieces between blank lines. Pieces that are no header where one is due
    are skipped, and so is a last record shorter than declared."""
    stream = _Pieces(pieces, b"\r\n\r\n")
    while (piece := stream.next()) is not None:
        at = piece.find(b"WARC/1.")
        if at < 0 or piece[:at].strip():
            continue
        fields = {}
        for line in piece[at:].decode("utf-8", "replace").split("\r\n")[1:]:
            name, found, value = line.partition(":")
            if found:
                fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not length.isdigit():
            continue
        block = stream.take(int(length))
        if block is None:
            return
        yield fields, block


def _by_file(batches):
    """``(file key, iterator of its pieces)`` for consecutive rows."""
    rows = ((k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield key, (v or b"" for _, v in group)


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return (spark.read.option("lineSep", sep).text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file_key"), F.col("value").cast("binary").alias("value")))


def _in_batches(rows, names, types):
    """Record batches of about ``_BATCH_BYTES`` from ``(size, row)``."""
    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 200
        if size >= _BATCH_BYTES:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC archives of either version, version blocks too."""
    def run(batches):
        def rows():
            for key, lines in _by_file(batches):
                for r, block in arc_records(lines):
                    http, payload = split_http(block)
                    yield len(block), (key, r["url"], r["ip"], r["date"], r["mime"], http, payload, len(payload),
                                       hashlib.sha256(payload).hexdigest())

        text = pa.string()
        yield from _in_batches(rows(), _NAMES, [pa.int64(), text, text, text, text, text, pa.binary(), pa.int64(), text])

    return _pieces(spark, path, "\n").mapInArrow(run, _RECORD)


def _uuid(name: Column) -> Column:
    h = F.sha1(name.cast("binary"))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), part[0], F.lit("-"), part[1], F.lit("-5"), part[2], F.lit("-a"), part[3],
                    F.lit("-"), part[4], F.lit(">"))


def _timestamp(date: Column) -> Column:
    """ISO time of a 14-digit date (anything else: the epoch)."""
    full = F.when(date.rlike("^[0-9]{14}$"), date).otherwise(F.lit("19700101000000"))
    cut = [F.substring(full, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.concat(cut[0], F.lit("-"), cut[1], F.lit("-"), cut[2], F.lit("T"), cut[3], F.lit(":"), cut[4], F.lit(":"),
                    cut[5], F.lit("Z"))


def convert(records: DataFrame, path: str, *, order: Column, min_bytes: int = REVISIT_BYTES) -> None:
    """Write ARC ``records`` (``read_arc``) as WARC archives to ``path``.

    Identifiers come from URL, date, order and payload digest; times from the
    14-digit dates (others: the epoch); types from URL and block: version
    blocks are ``warcinfo``, HTTP blocks ``response``, others ``resource``.
    Of responses with equal payloads of at least ``min_bytes`` the one of the
    smallest ``order`` (a long) is stored, later ones are ``revisit`` records
    that refer to it; a response with a null order is always stored. What
    decides that is a table of identifiers and digests; payloads never meet."""
    version = F.col("url").startswith("filedesc://")
    kind = F.when(version, "warcinfo").when(F.col("http").isNotNull(), "response").otherwise("resource")
    rows = records.withColumn("kind", kind).withColumn("order", order).withColumn(
        "id", _uuid(F.concat_ws("|", "url", "date", F.col("order").cast("string"), "payload_digest")))
    meta = cut_lineage(rows.where((F.col("kind") == "response") & F.col("order").isNotNull()
                                  & (F.col("payload_bytes") >= min_bytes)).select("id", "order", "payload_digest"), "records")
    first = (meta.groupBy("payload_digest")
             .agg(F.min(F.struct("order", "id")).alias("first"), F.max("order").alias("last"), F.count("*").alias("w"))
             .where(F.col("last") > F.col("first.order")))
    later = (lookup(meta, cut_lineage(first.drop("last"), "digests"), "payload_digest", "w")
             .where(F.col("order") > F.col("first.order")).select("id", F.col("first.id").alias("refers_to")).distinct())
    full = rows.join(later, "id", "left")
    is_revisit = F.col("refers_to").isNotNull()
    body = F.when(F.col("http").isNull(), F.col("payload").cast("string")).when(
        is_revisit, F.concat("http", F.lit(CRLF2))).otherwise(
        F.concat("http", F.lit(CRLF2), F.col("payload").cast("string")))
    line = [F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise(F.col("kind"))),
            F.concat(F.lit("WARC-Record-ID: "), "id"),
            F.concat(F.lit("WARC-Date: "), _timestamp(F.col("date"))),
            F.when(~version, F.concat(F.lit("WARC-Target-URI: "), "url")),
            F.when(~version, F.concat(F.lit("WARC-IP-Address: "), "ip")),
            F.when(~version, F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest")),
            F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), "refers_to")),
            F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.concat(F.lit("Content-Type: "), F.when(version, "application/warc-fields").when(
                F.col("http").isNotNull(), "application/http; msgtype=response").otherwise(F.col("mime"))),
            F.concat(F.lit("Content-Length: "), F.octet_length("body").cast("string"))]
    (full.withColumn("body", body).select(F.concat(F.concat_ws("\r\n", *line), F.lit(CRLF2), "body").alias("value"))
     .write.option("lineSep", CRLF2).option("compression", "gzip").text(path))


_WARC = "file_key long, warc_type string, id string, date string, url string, refers_to string, declared_digest string, " \
        "http string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of WARC archives: header fields, HTTP head, and payload
    with its own size and digest (of what the record holds)."""
    names = [f.split()[0] for f in _WARC.split(", ")]

    def run(batches):
        def rows():
            for key, pieces in _by_file(batches):
                for f, block in warc_records(pieces):
                    http, payload = split_http(block)
                    yield len(block) if with_payload else 0, (
                        key, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-date"), f.get("warc-target-uri"),
                        f.get("warc-refers-to"), (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                        http, len(payload), hashlib.sha256(payload).hexdigest(), payload if with_payload else None)

        text = pa.string()
        yield from _in_batches(rows(), names, [pa.int64(), *[text] * 7, pa.int64(), text, pa.binary()])

    return _pieces(spark, path, CRLF2).mapInArrow(run, _WARC)


def resolve(records: DataFrame) -> DataFrame:
    """Responses as they are; revisits with ``target`` (a struct of the HTTP
    head, size and digest of the response they refer to)."""
    stored = records.where("warc_type = 'response'").select(
        F.col("id").alias("refers_to"), F.struct("http", "payload_bytes", "payload_digest").alias("target"))
    revisits = records.where("warc_type = 'revisit'")
    weight = revisits.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("w"))
    table = cut_lineage(stored.join(weight, "refers_to").dropDuplicates(["refers_to"]), "targets")
    kind = table.schema["target"].dataType
    return (lookup(revisits, table, "refers_to", "w")
            .unionByName(records.where("warc_type = 'response'").withColumn("target", F.lit(None).cast(kind))))
