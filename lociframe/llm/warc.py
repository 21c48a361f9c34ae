r"""WARC archives written and read as chunk rows.

A record never exists as one value. Writing turns it into rows (record
identifier, chunk number, bytes, digest of the payload so far): row 0 holds the
WARC and HTTP headers, each later row one piece of the payload as a chunk of
the HTTP chunked transfer coding, the last row the end of the record. Every
row's bytes end with a line feed, so Spark's text sink, which ends each row
with one, writes the rows as WARC files, gzipped. The content length is known
beforehand from the payload's length and the size of a piece.

Reading streams the files as lines (gzip files are not split, so a task has
whole files in order). A small state machine follows headers and pieces, feeds
the payload to a running SHA-1 line by line, and compares the digest with the
header's. A piece bounds the length of a line, so a payload of any size is read
in bounded memory.

Payloads that occur several times are written once: the record of the largest
page id is the response, the others are revisits that name it. Equal payloads
are pre-aggregated before they are shuffled, and only light rows are joined.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lociframe.llm.common import SLICE_BYTES, map_columns, table
from lociframe.session import shared_dir, written

NAME = "op11_warc"
PIECE_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, target_uri string, n_pieces long, digest_ok boolean"
)
CHUNK_SCHEMA = "record_id string, chunk_no long, data binary, payload_sha1 string"


def _base32_sql() -> str:
    """SQL: a hex SHA-1 as base32, five hex digits to four characters."""
    group = "('0x' || substr(h, {at}, 5))::INTEGER"
    signs = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({group} >> {shift}) & 31), 1)"
    return " || ".join(signs.format(group=group.format(at=5 * k + 1), shift=s) for k in range(8) for s in (15, 10, 5, 0))


ORACLE_SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
tops AS (SELECT h, max(page_id) AS top FROM hashed GROUP BY h)
SELECT page_id, payload_bytes, {_base32_sql()} AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> top THEN top END AS refers_to
FROM hashed JOIN tops USING (h)"""


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def pieces(payload: bytes, size: int) -> Iterator[memoryview]:
    view = memoryview(payload)
    for at in range(0, len(payload), size):
        yield view[at : at + size]


def payload_sha1(payload: bytes, size: int = PIECE_BYTES):
    running = hashlib.sha1()
    for piece in pieces(payload, size):
        running.update(piece)
    return running


def coded_length(n_bytes: int, size: int = PIECE_BYTES) -> int:
    """Length of a payload in the chunked transfer coding, without coding it."""
    full, rest = divmod(n_bytes, size)
    return full * (len(f"{size:x}") + 4 + size) + (len(f"{rest:x}") + 4 + rest if rest else 0) + len("0\r\n\r\n")


def _header(fields: Iterable[tuple[str, object]], first: str) -> bytes:
    lines = [first, *(f"{name}: {_one_line(value)}" for name, value in fields if value is not None)]
    return "".join(f"{line}\r\n" for line in [*lines, ""]).encode("utf-8", "surrogatepass")


def _one_line(value: object) -> str:
    """Line breaks and per cent signs of a header value as %XX, so that no value can end its line."""
    text = str(value).replace("%", "%25")
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _from_one_line(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record_id(page_id: int | None, at: int) -> str:
    """A record's URN: its page, and a number that tells rows of one page apart."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{at}>"


def _page_of(urn: str) -> int | None:
    number = urn.strip("<>").split(":")[2]
    return int(number) if number else None


def response_chunks(
    page_id: int | None, at: int, url: str | None, digest: str, payload: bytes, size: int = PIECE_BYTES
) -> Iterator[tuple[str, int, bytes, str]]:
    """The rows of a response record: headers, pieces, end. Raises if the payload isn't the digest's."""
    urn, running = record_id(page_id, at), hashlib.sha1()
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", "chunked")], "HTTP/1.1 200 OK")
    head = _header(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", urn),
            ("WARC-Date", "1970-01-01T00:00:00Z"),  # the table has no date; equal input gives equal files
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(http) + coded_length(len(payload), size)),
        ],
        "WARC/1.1",
    )
    yield urn, 0, head + http, base32(running.digest())
    number = 0
    for number, piece in enumerate(pieces(payload, size), 1):
        running.update(piece)
        yield urn, number, b"%x\r\n%b\r\n" % (len(piece), piece), base32(running.digest())
    if base32(running.digest()) != digest:
        raise ValueError(f"{urn}: the payload's digest is {base32(running.digest())}, expected {digest}")
    yield urn, number + 1, b"0\r\n\r\n\r\n\r\n", base32(running.digest())


def revisit_chunk(
    page_id: int | None, at: int, url: str | None, digest: str, n_bytes: int, refers_to: str
) -> tuple[str, int, bytes, str]:
    """The one row of a revisit record, which repeats the headers and leaves the payload out."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n_bytes)], "HTTP/1.1 200 OK")
    head = _header(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", record_id(page_id, at)),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", url),
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", refers_to),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(http)),
        ],
        "WARC/1.1",
    )
    return record_id(page_id, at), 0, head + http + b"\r\n\r\n", digest


class RecordReader:
    """Follows the bytes of WARC files line by line and yields a row at the end of each record.

    Records may have any content length; the state is a few counters, the
    headers of the record and the running digest.
    """

    def __init__(self) -> None:
        self.state = "between"
        self.finished_pieces: list[dict] = []

    def feed(self, line: bytes) -> dict | None:
        """``line`` without its line feed; the finished record's row, if it ends here."""
        line += b"\n"
        if self.state == "between":
            if line.strip():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"a record begins with {line[:40]!r}")
                self.state, self.warc, self.http = "warc", {}, {}
                self.sha1, self.n_bytes, self.n_pieces = hashlib.sha1(), 0, 0
            return None
        if self.state == "warc":
            if not line.strip():
                self.left, self.state = int(self.warc["content-length"]), "status"
                return self._finished() if self.left == 0 else None
            self._field(self.warc, line)
            return None
        self.left -= len(line)
        if self.left < 0:
            raise ValueError(f"{self.warc.get('warc-record-id')}: block beyond its content length")
        self._block_line(line)
        return self._finished() if self.left == 0 else None

    def _block_line(self, line: bytes) -> None:
        if self.state == "status":
            self.state = "http"
        elif self.state == "http":
            if line.strip():
                self._field(self.http, line)
            else:
                self.state = "size" if self.http.get("transfer-encoding") == "chunked" else "body"
        elif self.state == "size":
            self.piece, self.bytes = int(line, 16), bytearray()
            self.n_pieces += self.piece > 0
            self.state = "piece" if self.piece else "end"
        elif self.state == "piece":
            taken = line[: self.piece]
            self.sha1.update(taken)
            self.bytes += taken
            self.n_bytes += len(taken)
            self.piece -= len(taken)
            if self.piece == 0:
                self.finished_pieces.append(self._piece())
            if len(taken) < len(line):
                if line[len(taken) :] != b"\r\n":
                    raise ValueError(f"{self.warc.get('warc-record-id')}: a piece does not end where its size says")
                self.state = "size"
            elif self.piece == 0:
                self.state = "after"  # the piece's last byte was a line feed
        elif self.state == "after":
            self.state = "size"
        elif self.state == "body":
            self.sha1.update(line)
            self.n_bytes += len(line)

    def _piece(self) -> dict:
        return {
            "record_id": self.warc["warc-record-id"],
            "chunk_no": self.n_pieces,
            "data": bytes(self.bytes),
            "payload_sha1": base32(self.sha1.digest()),
        }

    def taken_pieces(self) -> list[dict]:
        """The pieces that have ended since the last call."""
        taken, self.finished_pieces = self.finished_pieces, []
        return taken

    def _field(self, fields: dict, line: bytes) -> None:
        name, _, value = line.rstrip(b"\r\n").decode("utf-8", "surrogatepass").partition(": ")
        fields[name.lower()] = _from_one_line(value)

    def _finished(self) -> dict:
        self.state = "between"
        kind, digest = self.warc["warc-type"], self.warc["warc-payload-digest"].removeprefix("sha1:")
        revisit, urn = kind == "revisit", self.warc["warc-record-id"]
        return {
            "page_id": _page_of(urn),
            "payload_bytes": int(self.http["content-length"]) if revisit else self.n_bytes,
            "payload_digest": digest if revisit else base32(self.sha1.digest()),
            "record_type": kind,
            "refers_to": _page_of(self.warc["warc-refers-to"]) if revisit else None,
            "record_id": urn,
            "target_uri": self.warc.get("warc-target-uri"),
            "n_pieces": self.n_pieces,
            "digest_ok": revisit or base32(self.sha1.digest()) == digest,
        }

    def close(self) -> None:
        if self.state != "between":
            raise ValueError(f"the file ends inside the record {self.warc.get('warc-record-id')}")


def _columns(chunks: Iterable[tuple[str, int, bytes, str]], limit: int = SLICE_BYTES) -> Iterator[dict]:
    """Chunk rows as columns, a few megabytes at a time."""
    names = ("record_id", "chunk_no", "data", "payload_sha1")
    held, weight = [], 0
    for row in chunks:
        held.append(row)
        weight += len(row[2])
        if weight >= limit:
            yield dict(zip(names, map(list, zip(*held))))
            held, weight = [], 0
    if held:
        yield dict(zip(names, map(list, zip(*held))))


def chunk_rows(pages: DataFrame, min_bytes: int = 0, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All records of ``pages`` (``page_id``, ``url``, ``html``) as chunk rows, those of a record one after the other.

    A record per page: null html is an empty payload. Among records of equal
    payloads of at least ``min_bytes`` bytes that of the largest page id is the
    response (of repeated ids one of them), the others revisit it; smaller ones
    are all responses. A null page id is below all others and is read back as
    null; so is a reference to it. A null url leaves the header out. Other
    columns are not read, and an empty table has no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def measure(texts):
        raw = (b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts)
        found = [(len(r), payload_sha1(r, piece_bytes).hexdigest()) for r in raw]
        yield {"payload_bytes": [n for n, _ in found], "sha1": [d for _, d in found]}

    # the number is fixed by being written, and tells repeated rows apart
    light = written(
        map_columns(
            pages.withColumn("at", F.monotonically_increasing_id()),
            ["html"],
            "payload_bytes long, sha1 string",
            measure,
            keep=["at", "page_id", "url"],
        ),
        "warc-pages",
    )
    joint, single = light.filter(F.col("payload_bytes") >= min_bytes), light.filter(F.col("payload_bytes") < min_bytes)
    heads = (
        joint.groupBy("sha1")
        .agg(F.max(F.struct("page_id", (-F.col("at")).alias("order"), "url", "payload_bytes")).alias("head"))
        .select((-F.col("head.order")).alias("at"), "head.page_id", "head.url", "head.payload_bytes", "sha1")
    )
    # pages of one payload become one row before they are shuffled
    text = F.coalesce("html", F.lit("")).alias("html")
    bodies = pages.select(text).select(F.sha1(F.col("html").cast("binary")).alias("sha1"), "html")
    bodies = bodies.groupBy("sha1").agg(F.first("html").alias("html"))
    responses = bodies.join(heads.unionByName(single), "sha1")
    named = heads.select("sha1", F.col("page_id").alias("head_page"), F.col("at").alias("head_at"))
    revisits = joint.join(named, "sha1").filter("at <> head_at")

    def respond(page_ids, numbers, urls, digests, texts):
        rows = zip(page_ids, numbers, urls, digests, texts)
        yield from _columns(
            chunk
            for page, at, url, digest, html in rows
            for chunk in response_chunks(
                page, at, url, base32(bytes.fromhex(digest)), html.encode("utf-8", "surrogatepass"), piece_bytes
            )
        )

    def revisit(page_ids, numbers, urls, digests, sizes, head_pages, head_numbers):
        rows = zip(page_ids, numbers, urls, digests, sizes, head_pages, head_numbers)
        yield from _columns(
            revisit_chunk(page, at, url, base32(bytes.fromhex(digest)), n, record_id(head, head_at))
            for page, at, url, digest, n, head, head_at in rows
        )

    key = ["page_id", "at", "url", "sha1"]
    whole = map_columns(responses.select(*key, "html"), [*key, "html"], CHUNK_SCHEMA, respond)
    named_only = ["payload_bytes", "head_page", "head_at"]
    return whole.unionByName(
        map_columns(revisits.select(*key, *named_only), [*key, *named_only], CHUNK_SCHEMA, revisit)
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, piece_bytes: int = PIECE_BYTES) -> None:
    """The records of ``pages`` as gzipped WARC files below ``path``, one file per task."""
    rows = chunk_rows(pages, min_bytes, piece_bytes)
    # the sink ends each row with the line feed that the row's bytes end with
    lines = rows.select(F.expr("substring(data, 1, length(data) - 1)").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))


def _streamed(lines: DataFrame, schema: str, pick) -> DataFrame:
    """Rows that ``pick(reader, finished record)`` gives after each line, a few megabytes of lines at a time."""
    target = _parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, reader = to_arrow_schema(target), RecordReader()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                found = []
                for line in batch.column(0).slice(at, rows).to_pylist():
                    found.extend(pick(reader, reader.feed(line)))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=shape)
        reader.close()

    return lines.mapInArrow(run, target)


def _record(reader: RecordReader, record: dict | None) -> list[dict]:
    reader.taken_pieces()
    return [record] if record else []


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the WARC files below ``path``; ``digest_ok``: the payload has the header's digest.

    A revisit has the full payload's size and digest from its headers.
    """
    return _streamed(_lines(spark, path), SCHEMA, _record)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The payloads of the WARC files below ``path`` as rows of one piece; ``payload_sha1``: the digest up to there."""
    return _streamed(_lines(spark, path), CHUNK_SCHEMA, lambda reader, record: reader.taken_pieces())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
