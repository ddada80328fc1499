"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each derivative refers to its response by WARC-Refers-To, keeps its target
URI, date and digests, and has digests of its own. A conversion has all text
that a reader of the page sees, navigation, forms and comments too; other text
is taken as it is, and what is no text (images, say) gives metadata only. The
transfer codings chunked, gzip and deflate are undone; of others (br, zstd) the
metadata names the one that was not, and there is no conversion.

Records are read from and written to the WARC 1.1 format; digests are SHA-1 in
base 32 as usual there. Files are read as streams, a record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import blocks_of

CRLF = b"\r\n"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, headers map<string,string>, block binary"
_SCHEMA = pa.schema([*((c, pa.string()) for c in "record_type record_id refers_to target_uri date content_type block_digest payload_digest".split()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_NAMES = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest"}
_LINK = re.compile(r"<(a|img|link|script|iframe)\b[^<>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n\Z")
_BLANK = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """The same URN for the same parts, run after run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(list(map(str, parts))))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and payload of an HTTP response; no headers if the block isn't one."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    end = _BLANK.search(block)  # some servers end lines with LF alone
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    lines = head.decode("iso-8859-1").replace("\r\n", "\n").split("\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()], payload


def unchunked(payload: bytes) -> bytes:
    """A chunked payload put together; as it is if it isn't chunked, and up to the first broken chunk."""
    out, at = [], 0
    while (end := payload.find(CRLF, at)) >= 0:
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]{1,8})\s*(?:;.*)?", payload[at:end], re.S)
        if not size:
            break
        n = int(size[1], 16)
        out.append(payload[end + 2 : end + 2 + n])
        if n == 0:
            return b"".join(out)
        at = end + 2 + n + 2
    return b"".join(out) if out else payload


def plain_payload(payload: bytes, headers: list[tuple[str, str]]) -> tuple[bytes, str | None]:
    """The payload with its codings undone, the last first, and the first coding that can't be."""
    values = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in values.get("transfer-encoding", ""):
        payload = unchunked(payload)
    codings = [x.strip() for x in values.get("content-encoding", "").split(",") if x.strip() not in ("", "identity")]
    for coding in reversed(codings):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif coding == "deflate":
                try:
                    payload = zlib.decompress(payload)
                except zlib.error:
                    payload = zlib.decompress(payload, -zlib.MAX_WBITS)
            else:
                return payload, coding
        except (OSError, EOFError, zlib.error):
            if not payload[:2] == b"\x1f\x8b":  # stored after decoding, under the old header
                return payload, None
            return payload, coding
    return payload, None


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """A payload as text, in the charset of the header or of the page; in UTF-8 where that is unknown."""
    values = {k.lower(): v for k, v in headers}
    named = _CHARSET.search(values.get("content-type", "")) or _CHARSET.search(payload[:2048].decode("ascii", "replace"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError):  # unknown, or none for text
        return payload.decode("utf-8", "replace")


def form_of(headers: list[tuple[str, str]], payload: bytes) -> str:
    """html, text or other, by the content type, or by the first bytes without one."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").split(";")[0].strip().lower()
    if kind in ("text/html", "application/xhtml+xml") or (not kind and payload.lstrip()[:1] in (b"<", b"")):
        return "html"
    return "text" if kind.startswith("text/") or kind.endswith(("json", "xml", "javascript")) else "other"


def plain_text(page: str) -> str:
    """The text of all blocks that a reader sees, a line each."""
    return "\n".join(b.text for b in blocks_of(page, everything=True))


def _metadata(row: dict, status: str, headers: list[tuple[str, str]], page: str, payload: bytes, undecoded: str | None) -> bytes:
    title = _TITLE.search(page)
    links = [{"tag": t.lower(), "url": a or b or c} for t, a, b, c in _LINK.findall(page)]
    source = {k: row[v] for k, v in _NAMES.items() if row[v] is not None} | dict(row["headers"] or {})
    body = {
        "warc": source,
        "http": {"status": status, "headers": headers, "payload_length": len(payload), "payload_digest": digest(payload)} | ({"undecoded": undecoded} if undecoded else {}),
        "html": {"title": " ".join(title[1].split()) if title else None, "links": links},
    }
    return json.dumps(body, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")


def derive_one(row: dict) -> list[dict]:
    """The metadata and, of text, the conversion record of a response; none for a record of another type."""
    if row["record_type"] != "response":
        return []
    block = row["block"] or b""
    status, headers, payload = split_http(block)
    body, undecoded = plain_payload(payload, headers)
    form = "other" if undecoded else form_of(headers, body)
    text = decoded(body, headers) if form != "other" else ""
    own = {"refers_to": row["record_id"], "target_uri": row["target_uri"], "date": row["date"]}
    kept = dict(row["headers"] or {}) | {"WARC-Source-Block-Digest": row["block_digest"] or digest(block), "WARC-Source-Payload-Digest": row["payload_digest"] or digest(payload)}
    made = [("metadata", "application/json", _metadata(row, status, headers, text if form == "html" else "", payload, undecoded))]
    if form != "other":
        made.append(("conversion", "text/plain; charset=utf-8", (plain_text(text) if form == "html" else text).encode("utf-8", "replace")))
    out = []
    for kind, content_type, data in made:
        out.append(own | {"record_type": kind, "record_id": record_id(row["record_id"], kind), "content_type": content_type, "block_digest": (d := digest(data)), "payload_digest": d, "headers": list(kept.items()), "block": data})
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = {n: batch.column(n).to_pylist() for n in _SCHEMA.names}
    for i in range(batch.num_rows):
        yield {n: v[i] for n, v in columns.items()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and, of text, a conversion record for each response record (columns of RECORD); others give none.

    Null blocks count as empty. Repeated records give repeated derivatives with
    the same ids, since these follow from the response's. Other columns are left
    out; long blocks are taken in whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _batch([x for row in _rows(batch.slice(at, 256)) for x in derive_one(row)])

    return responses.select(*_SCHEMA.names).mapInArrow(run, RECORD)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each row of pages (page_id, url, html), as a crawler would have stored it."""

    def one(page_id: object, url: str | None, page: str | None) -> dict:
        payload = (page or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        return {"record_type": "response", "record_id": record_id(page_id, url, d := digest(block)), "refers_to": None, "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "block_digest": d, "payload_digest": digest(payload), "headers": [("WARC-Page-ID", str(page_id))], "block": block}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _batch([one(*x) for x in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))])

    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD)


def format_record(row: dict) -> bytes:
    """A record in WARC 1.1, headers and block."""
    block = row["block"] or b""
    named = [(k, row[v]) for k, v in _NAMES.items() if row[v] is not None]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*named, *(row["headers"] or []), ("Content-Length", len(block))])]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


#: Bytes of a line, of a record's headers and of its block, at most: a value of a row has to hold the block.
_LINE, _HEAD, LONGEST = 1 << 16, 1 << 20, 1 << 30
_PIECE = 1 << 20
#: Stands on a line of its own, with the place in the file, where a gzip member broke; 255 is in no header.
_BROKEN = b"\xffbroken gzip member at "
_BROKEN_LINE = re.compile(re.escape(_BROKEN) + rb"([0-9]{1,19})\r\n")
_BEGINS = re.compile(rb"WARC/|" + _BROKEN_LINE.pattern + rb"\Z")


class _Tape:
    """A stream that can take back what was read; at: the place of the next byte."""

    def __init__(self, stream: io.BufferedIOBase) -> None:
        self.stream, self.held, self.at = stream, b"", 0

    def line(self) -> bytes:
        """Up to a line's end, _LINE bytes at most."""
        end = self.held.find(b"\n", 0, _LINE) + 1
        if not end and len(self.held) < _LINE:
            self.held += self.stream.readline(_LINE - len(self.held))
            end = self.held.find(b"\n", 0, _LINE) + 1
        return self._take(end or min(len(self.held), _LINE))

    def _take(self, n: int) -> bytes:
        data, self.held = self.held[:n], self.held[n:]
        self.at += len(data)
        return data

    def read(self, n: int) -> bytes:
        """n bytes, or as many as there are, read piece by piece."""
        parts = [self._take(min(n, len(self.held)))]
        n -= len(parts[0])
        while n and (piece := self.stream.read(min(n, _PIECE))):
            parts.append(piece)
            self.at += len(piece)
            n -= len(piece)
        return b"".join(parts)

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held, self.at - len(data)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a WARC stream, uncompressed, one at a time.

    A record is one if its headers end, give a length, and the block of that
    length is followed by an empty line or the stream's end. Whatever else
    stands in the stream gives records of type `unreadable`, one for each span,
    with its place and the reason; behind its first line reading goes on at the
    next line that begins a record, or ends as such a line does, within what a
    wrong length takes in too.
    Blocks beyond LONGEST are unreadable.
    """
    tape, lost, told = _Tape(stream), None, False

    def unreadable(place: int, reason: str) -> dict:
        return dict.fromkeys(_NAMES.values()) | {"record_type": "unreadable", "headers": [("Offset", str(place)), ("Reason", reason)], "block": b""}

    while line := tape.line():
        begin = tape.at - len(line)
        if not line.startswith(b"WARC/"):
            if broken := _BROKEN_LINE.fullmatch(line):
                yield unreadable(int(broken[1]), "a broken gzip member, by the place in the file")
                lost, told = None, True
            elif line.strip() and lost is None and not told:
                lost = begin
            if not (inner := _VERSION.search(line)):  # a record whose line what was lost runs into
                continue
            begin, line = tape.at - len(inner[0]), inner[0]
        if lost is not None:
            yield unreadable(lost, "no record begins here")
        lost, told = None, False
        pairs: list[tuple[str, str]] = []
        head = b""
        while (line := tape.line()).strip() and not (line.startswith((b"WARC/", _BROKEN)) and _BEGINS.match(line)) and len(head) < _HEAD:
            head += line
            k, _, v = line.decode("utf-8", "replace").partition(":")
            pairs.append((k.strip(), v.strip()))
        values = {k.lower(): v for k, v in pairs}
        length = values.get("content-length", "")
        if line.strip() or not line:
            tape.back(line)
            yield unreadable(begin, "the headers end early")
            continue
        if not re.fullmatch("[0-9]{1,18}", length) or int(length) > LONGEST:
            yield unreadable(begin, "no length" if not length.isdigit() else f"{length} bytes are too many")
            told = length.isdigit()
            continue
        block = tape.read(int(length))
        end = tape.read(4)
        if len(block) < int(length) or end not in (b"", CRLF + CRLF) and not re.fullmatch(rb"(\r?\n){1,2}", end) and not re.match(rb"\n\n", end):
            tape.back(block + end)
            yield unreadable(begin, f"{len(block)} of {length} bytes" if len(block) < int(length) else f"what follows the {length} bytes is no end")
            told = True
            continue
        if end[:2] == b"\n\n":
            tape.back(end[2:])
        row = {v: values.get(k.lower()) for k, v in _NAMES.items()}
        known = {k.lower() for k in _NAMES} | {"content-length"}
        yield row | {"headers": [x for x in pairs if x[0].lower() not in known], "block": block}
    if lost is not None:
        yield unreadable(lost, "no record begins here")


class _Members(io.RawIOBase):
    """The bytes of a gzip stream, member after member. What can't be unpacked is a line of _BROKEN; reading goes on at the next member that can."""

    def __init__(self, raw: io.BufferedIOBase) -> None:
        self.raw, self.held, self.at, self.out = raw, b"", 0, b""
        self.member, self.began, self.told, self.gave = None, 0, False, False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out and self._more():
            pass
        n = min(len(into), len(self.out))
        into[:n] = self.out[:n]
        self.out = self.out[n:]
        return n

    def _fill(self) -> bool:
        data = self.raw.read(_PIECE)
        self.held += data
        return bool(data)

    def _break(self) -> None:
        """The member is given up; the next is looked for behind its beginning."""
        if not self.told:
            self.out += CRLF + _BROKEN + str(self.began).encode() + CRLF
        self.told, self.member = True, None

    def _more(self) -> bool:
        """One step; False at the end."""
        if self.member is None:
            if not self.held and not self._fill():
                return False
            start = self.held.find(b"\x1f\x8b\x08")
            skipped = self.held if start < 0 else self.held[:start]
            if start < 0 and self._fill():  # the sign may be cut in two
                return True
            if skipped.strip(b"\0") and not self.told:
                self.began = self.at
                self._break()
            self.at, self.held = self.at + len(skipped), self.held[len(skipped) :]
            if start >= 0:
                self.member, self.began, self.gave = zlib.decompressobj(31), self.at, False
                self.at, self.head, self.held = self.at + 3, self.held[:3], self.held[3:]
            return True
        head, self.head = self.head, b""
        if not self.held and not head and not self._fill():
            self._break()  # the file ends within the member
            return True
        given = self.held
        try:
            self.out += self.member.decompress(head + given, _PIECE)
        except zlib.error:
            self._break()
            return True
        self.gave |= bool(self.out)
        if self.member.eof:
            rest = self.member.unused_data
            self.member, self.told = None, False
        else:
            rest = self.member.unconsumed_tail
            self.told &= not self.gave
        self.at, self.held = self.at + len(given) - len(rest), rest
        if self.member is not None and not rest and not self.out and not self._fill():
            self._break()
        return True


def records_in(raw: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a WARC file, compressed by record, as a whole, or not at all."""
    first = raw.peek(2)[:2]
    return parse(io.BufferedReader(_Members(raw), 1 << 20) if first == b"\x1f\x8b" else raw)


def formatted(records: DataFrame, compress: bool = True) -> DataFrame:
    """(record_id, warc binary): each record as a WARC record, by default a gzip member of its own, so that files can be joined end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = list(_rows(whole.slice(at, 256)))
                made = [gzip.compress(x, mtime=0) if compress else x for x in map(format_record, rows)]
                yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array(made, pa.binary())], ["record_id", "warc"])

    return records.select(*_SCHEMA.names).mapInArrow(run, "record_id string, warc binary")


def _batches(raw: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0
    for row in records_in(raw):
        rows.append(row)
        size += len(row["block"])
        if len(rows) >= 256 or size >= 16 << 20:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def parsed(files: DataFrame) -> DataFrame:
    """The records (columns of RECORD) in files (content binary), such as spark.read.format("binaryFile") gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                yield from _batches(io.BufferedReader(io.BytesIO(data.as_py() or b"")))

    return files.select("content").mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path, a file a task, each read as a stream.

    Where the store is one that only Spark opens, files come whole.
    """
    files = spark.read.format("binaryFile").load(path)
    dealt = max(files.select("path").count(), 1)  # a number of its own, as names are too small to be dealt by their bytes
    try:
        fs.FileSystem.from_uri(re.sub("^file:/*", "/", path.split("*")[0]))
    except (pa.ArrowInvalid, OSError):
        return parsed(files.repartition(dealt, "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub("^file:/*", "/", name))
                with system.open_input_file(at) as opened:
                    yield from _batches(io.BufferedReader(opened, 1 << 20))

    return files.select("path").repartition(dealt, "path").mapInArrow(run, RECORD)


def write(records: DataFrame, path: str, level: int = 1) -> int:
    """The records as WARC files in the folder path, a gzip member each, a file for each partition; returns how many.

    A task that runs again writes the same file again. The folder is one that
    all executors reach by the library of files (a mounted one, or a store).
    """
    system, root = fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))
    system.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to = fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))
        part, n = TaskContext.get().partitionId(), 0
        hidden = f"{to}/.{uuid.uuid4().hex}"
        with own.open_output_stream(hidden) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for row in _rows(batch.slice(at, 256)):
                        out.write(gzip.compress(format_record(row), level, mtime=0))
                        n += 1
        own.move(hidden, f"{to}/part-{part:06d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return records.select(*_SCHEMA.names).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
