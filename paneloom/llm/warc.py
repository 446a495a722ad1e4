"""WARC records: responses, and the metadata and plain-text records derived from them.

A response becomes two linked records: a metadata record with the response's HTTP status,
its HTTP and WARC headers, digests, title and links, and a conversion record with the page as
plain text. Both name the response in WARC-Refers-To and repeat its target and date, and its
payload digest as WARC-Source-Payload-Digest, since their own payload is another.
Record ids are name-based UUIDs, so a retried task writes the same records. Everything is
done row by row; files are written and read by Spark's text source, one record per "line",
which keeps them splittable and commits whole files only.

Defined cases. Null html is an empty payload; a null url leaves WARC-Target-URI out. A
block without an HTTP head is all payload with an empty status. Repeated pages give equal
records. An empty table gives no rows. Other columns are ignored. A record whose length
does not fit its Content-Length is read with `complete` false.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
END = "\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of names that are URLs
DATE = "2024-01-01T00:00:00Z"

HIDES = {"script", "style", "template", "noscript", "title"}
CLOSES = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in HIDES}
#: Of these, `/>` is an end: they also stand in inline SVG and XHTML.
SELF_CLOSED = {"style", "title"}
BREAKS = set(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3"
    " h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead tr"
    " ul".split()
)
OPENS = re.compile(r"<(?=[/!?a-zA-Z])")
# A quoted value after `=` may hold `>`; a quote that is never closed is any character.
TAG = re.compile(r"<[/!?a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NUMBER = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,}));?")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def unescape(text: str) -> str:
    """Character references resolved; numbers beyond all characters are U+FFFD, however long."""
    return html.unescape(NUMBER.sub("\ufffd", text))


def parsed(page: str) -> tuple[str, str, list[str]]:
    """(text, title, link targets) of a page, read once from front to back.

    The text has a line per block element, white space collapsed, references resolved. Comments
    and hidden elements are a space; one that is never closed hides the rest. A tag ends at
    the first `>` outside a quoted value; from where that fails, at the first `>`, and a `<`
    with no `>` behind it is text.
    """
    out, title, links = [], None, {}
    at, quoted = 0, True
    while found := OPENS.search(page, at):
        first = found.start()
        if page.startswith("<!--", first):
            end = page.find("-->", first + 4)
            out += [page[at:first], " "]
            at = len(page) if end < 0 else end + 3
            continue
        tag = TAG.match(page, first) if quoted else None
        if tag is None:
            quoted = False
            end = page.find(">", first) + 1
            if not end:
                break
        else:
            end = tag.end()
        out.append(page[at:first])
        at = end
        named = NAME.match(page, first)
        name = named.group(1).lower() if named else ""
        opens = page[first + 1] != "/"
        if opens and name in HIDES:
            out.append(" ")
            if name in SELF_CLOSED and page[end - 2] == "/":
                continue
            close = CLOSES[name].search(page, end)
            if name == "title" and title is None and close:
                title = page[end : close.start()]
            at = close.end() if close else len(page)
        elif name in BREAKS:
            out.append("\n")
        elif opens and name == "a":
            link = HREF.search(page, named.end(), end)
            if link:
                links[unescape("".join(link.groups("")))] = None
    out.append(page[at:])
    lines = (" ".join(unescape(line).split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), unescape(title or ""), list(links)


def plain_text(page: str) -> str:
    return parsed(page)[0]


def _one_line(text: str) -> str:
    return " ".join(text.split())


RECORD = (
    "record_id string, type string, refers_to string, target_uri string, date string, "
    "content_type string, payload_digest string, block_digest string, headers string, "
    "block string"
)
NAMES = [field.split()[0] for field in RECORD.split(", ")]


def _record(kind: str, own_id: str, fields: dict, block: str, payload_digest: str) -> tuple:
    """One record as a row of RECORD. `fields` are further headers, those without a value
    are left out."""
    raw = block.encode()
    headers = {
        "WARC-Type": kind, "WARC-Record-ID": own_id, **fields,
        f"WARC-{'' if kind == 'response' else 'Source-'}Payload-Digest": payload_digest,
        "WARC-Block-Digest": digest(raw), "Content-Length": str(len(raw)),
    }
    lines = [f"{k}: {_one_line(v)}" for k, v in headers.items() if v is not None]
    return (
        own_id, kind, fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI"),
        fields.get("WARC-Date"), fields.get("Content-Type"), payload_digest,
        headers["WARC-Block-Digest"], "\r\n".join(lines), block,
    )


def _to_batch(extra: list[list], rows: list[tuple], names: list[str], types) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [
        pa.array([], pa.string()) for _ in NAMES
    ]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(e, t) for e, t in zip(extra, types)), *columns], [*names, *NAMES]
    )


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = DATE,
) -> DataFrame:
    """A response record per page, with its id in the column `page`."""
    kind = pages.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, text in zip(*(batch[c].to_pylist() for c in ("page", "url", "html"))):
                payload = (text or "").encode()
                head = (
                    "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                    f"Content-Length: {len(payload)}"
                )
                fields = {
                    "WARC-Target-URI": url, "WARC-Date": date,
                    "Content-Type": "application/http; msgtype=response",
                }
                own = digest(payload)
                name = record_id("response", str(page), url or "", own)
                rows.append(_record("response", name, fields, head + END + (text or ""), own))
            yield _to_batch([batch["page"]], rows, ["page"], [batch["page"].type])

    chosen = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return chosen.mapInArrow(build, f"page {kind}, {RECORD}")


SOURCE = ("record_id", "target_uri", "date", "payload_digest", "headers", "block")


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response among `records`; the columns
    of `records` other than RECORD are carried."""
    carried = [f for f in records.schema.fields if f.name not in NAMES]
    names = [f.name for f in carried]
    chosen = records.filter(F.col("type") == "response").select(
        *names, *SOURCE
    )

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in zip(*(batch[c].to_pylist() for c in SOURCE)):
                rows += _derived(*own)
            twice = [i // 2 for i in range(2 * batch.num_rows)]
            extra = [batch[n].take(pa.array(twice, pa.int64())) for n in names]
            yield _to_batch(extra, rows, names, [e.type for e in extra])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), RECORD])
    return chosen.mapInArrow(derive, schema)


def _derived(source, uri, date, payload_digest, headers, block) -> list[tuple]:
    source = source or ""
    head, found, payload = (block or "").partition(END)
    if not found or not head.startswith("HTTP/"):
        head, payload = "", block or ""
    status, *http = head.split("\r\n")
    shared = {"WARC-Refers-To": source, "WARC-Target-URI": uri, "WARC-Date": date}
    metadata_id = record_id("metadata", source)
    conversion_id = record_id("conversion", source)
    text, title, links = parsed(payload)
    fields = [
        ("status", status), *(("http-header", h) for h in http),
        *(("warc-header", h) for h in (headers or "").split("\r\n") if h),
        ("payload-digest", payload_digest or ""), ("payload-length", str(len(payload.encode()))),
        ("conversion", conversion_id), ("conversion-digest", digest(text.encode())),
        ("title", title),
        *(("outlink", link) for link in links),
    ]
    described = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)
    return [
        _record("metadata", metadata_id, {**shared, "Content-Type": "application/warc-fields"},
                described, payload_digest),
        _record("conversion", conversion_id,
                {**shared, "WARC-Concurrent-To": metadata_id, "Content-Type": "text/plain"},
                text, payload_digest),
    ]


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records as WARC files; "gzip" compresses whole files."""
    lines = records.select(F.concat(F.lit(f"{VERSION}\r\n"), "headers", F.lit(END), "block"))
    lines.write.option("lineSep", END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """RECORD and `complete` of every record of the files, all of one version ("WARC/1.0" or
    "WARC/1.1"): the text between records may hold the other one's name."""
    start = f"{version}\r\n"
    pieces = spark.read.option("lineSep", END + start).text(path)
    piece = F.regexp_replace("value", r"\A" + re.escape(start), "")
    rest = F.expr(f"substring(piece, char_length(head) + {len(END) + 1})")

    def header(name: str):
        value = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(value != "", value)

    length = header("Content-Length").cast("long")
    trimmed = F.regexp_replace("rest", r"\r\n\r\n\z", "")
    return (
        pieces.select(piece.alias("piece"))
        .filter(F.col("piece") != "")
        .withColumn("head", F.substring_index("piece", END, 1))
        .withColumn("rest", rest)
        .withColumn("trimmed", trimmed)
        .withColumn(
            "block",  # the last record of a file still has its end
            F.when(F.octet_length("rest") == length, F.col("rest")).otherwise(F.col("trimmed")),
        )
        .select(
            header("WARC-Record-ID").alias("record_id"), header("WARC-Type").alias("type"),
            header("WARC-Refers-To").alias("refers_to"),
            header("WARC-Target-URI").alias("target_uri"), header("WARC-Date").alias("date"),
            header("Content-Type").alias("content_type"),
            F.coalesce(header("WARC-Payload-Digest"), header("WARC-Source-Payload-Digest"))
            .alias("payload_digest"),
            header("WARC-Block-Digest").alias("block_digest"),
            F.col("head").alias("headers"), "block",
            F.coalesce(F.octet_length("block") == length, F.lit(False)).alias("complete"),
        )
    )
