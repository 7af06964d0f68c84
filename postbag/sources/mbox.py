"""Mailbox files to message and attachment rows.

Most mail is plain: short ASCII headers of one line each, known content types, parts with
marks at both ends.  Such messages are cut by `Plain`; whatever it does not know (folded or
encoded headers, carriage returns, other encodings and parameters, messages in messages) it
refuses, and the standard library's parser takes the message.  Both give the same rows.
"""

from __future__ import annotations

import base64
import binascii
import email
import email.header
import email.policy
import email.utils
import hashlib
import re
import urllib.parse
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDRESS = "array<struct<name:string,email:string>>"
ATTACHMENTS = "array<struct<filename:string,content_type:string,charset:string,size:bigint,sha1:string,text:string,content:binary>>"
SCHEMA = (
    f"folder string, message_id string, date timestamp, hacky_date boolean, subject string, `from` {ADDRESS}, `to` {ADDRESS}, cc {ADDRESS}, bcc {ADDRESS}, list_post string, "
    f"body string, has_plain boolean, text_html string, headers string, attachments {ATTACHMENTS}"
)
_ADDRESS = pa.list_(pa.struct([("name", pa.string()), ("email", pa.string())]))
_FILES = pa.list_(pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("charset", pa.string()), ("size", pa.int64()), ("sha1", pa.string()), ("text", pa.string()), ("content", pa.binary())]))
_ARROW = pa.schema([
    ("folder", pa.string()), ("message_id", pa.string()), ("date", pa.timestamp("us")), ("hacky_date", pa.bool_()), ("subject", pa.string()), ("from", _ADDRESS), ("to", _ADDRESS), ("cc", _ADDRESS), ("bcc", _ADDRESS), ("list_post", pa.string()),
    ("body", pa.string()), ("has_plain", pa.bool_()), ("text_html", pa.string()), ("headers", pa.string()), ("attachments", _FILES),
])
#: Stand-in for a date that is missing or out of range.
INVALID = datetime(1960, 1, 1)
#: Messages of this size together, or 500, go on at once: attachments are rows' content.
BATCH_BYTES = 16_000_000


class _Odd(Exception):
    """A message that `Plain` does not know."""


_HEAD = re.compile(r"([A-Za-z][A-Za-z0-9-]*):[ \t]*([^\n]*)\n")
_MARK = re.compile(r"^--([^\n]*)(?:\n|\Z)", re.M)
_KIND = re.compile(r'([a-z]+/[a-z0-9.+-]+)(?:; (?:charset="?([A-Za-z0-9-]+)"?|boundary="([A-Za-z0-9=_.-]+)"))?')
_FILE = re.compile(r"attachment; filename\*=utf-8''([A-Za-z0-9%._-]+)|attachment; filename=\"([A-Za-z0-9._-]+)\"")
_BASE64 = re.compile(r"[A-Za-z0-9+/\n]*={0,2}\n*")
_ATOMS = r"[A-Za-z0-9#_+-]+(?:\.[A-Za-z0-9#_+-]+)*"
_PERSON = re.compile(rf'(?:"([A-Za-z0-9#_](?:[A-Za-z0-9#_ ]*[A-Za-z0-9#_])?)" <({_ATOMS}@{_ATOMS})>|({_ATOMS}@{_ATOMS}))(?:, (?=.)|\Z)')


class Plain:
    """A plain message, or a part of one, as far as rows need it, under the names that `email.message.Message` has."""

    def __init__(self, text: str):
        at, self.heads = 0, []
        while m := _HEAD.match(text, at):
            self.heads.append((m[1], m[2]))
            at = m.end()
        self.by = {k.lower(): v for k, v in self.heads}
        if not text.startswith("\n", at) or len(self.by) < len(self.heads):
            raise _Odd
        if not text[:at].isascii() or "=?" in text[:at]:
            raise _Odd
        self.payload, self.parts = text[at + 1 :], None
        kind = _KIND.fullmatch(self.by.get("content-type", "text/plain"))
        how = self.by.get("content-disposition")
        file = how and _FILE.fullmatch(how)
        self.coding = self.by.get("content-transfer-encoding", "8bit")
        if not kind or (how and not file) or how == "" or self.coding not in ("7bit", "8bit", "base64") or kind[1].startswith("message/"):
            raise _Odd
        self.kind, self.charset, self.file = kind[1], kind[2] and kind[2].lower(), None
        if file:
            try:
                self.file = (urllib.parse.unquote(file[1], errors="strict") if file[1] else file[2]).strip()
            except UnicodeDecodeError:
                raise _Odd from None
        if self.kind.startswith("multipart/"):
            self._cut(kind[3])

    def _cut(self, mark: str | None) -> None:
        if not mark or self.kind not in ("multipart/mixed", "multipart/alternative") or self.coding == "base64" or self.file:
            raise _Odd
        lines = [(m, m[1].rstrip(" \t")) for m in _MARK.finditer(self.payload)]
        marks = [(m, end) for m, end in lines if end in (mark, mark + "--")]
        # only the last mark closes all, and between two marks stands a part
        if len(marks) < 2 or marks[-1][1] == mark or any(end != mark for _, end in marks[:-1]):
            raise _Odd
        self.parts = []
        for (one, _), (two, _) in zip(marks, marks[1:], strict=False):
            if two.start() - one.end() < 2:
                raise _Odd
            self.parts.append(Plain(self.payload[one.end() : two.start() - 1]))

    def get(self, name: str, other=None):
        return self.by.get(name.lower(), other)

    def get_all(self, name: str, other):
        return [self.by[name.lower()]] if name.lower() in self.by else other

    def items(self) -> list[tuple[str, str]]:
        return self.heads

    raw_items = items

    def is_multipart(self) -> bool:
        return self.parts is not None

    def get_content_type(self) -> str:
        return self.kind

    def get_content_charset(self) -> str | None:
        return self.charset

    def get_filename(self) -> str | None:
        return self.file

    def get_content_disposition(self) -> str | None:
        return "attachment" if self.file is not None else None

    def get_payload(self, decode: bool = False):
        if not decode:
            return self.parts
        if self.coding != "base64":
            return self.payload.encode("ascii", "surrogateescape")
        if not _BASE64.fullmatch(self.payload):
            raise _Odd
        try:
            return binascii.a2b_base64(self.payload.replace("\n", ""), strict_mode=True)
        except binascii.Error:
            raise _Odd from None


def _addresses(msg, name: str) -> list[dict]:
    lines = [str(x) for x in msg.get_all(name, [])]
    if len(lines) == 1:
        out, at = [], 0
        while m := _PERSON.match(lines[0], at):
            out.append({"name": m[1], "email": (m[2] or m[3]).lower()})
            at = m.end()
        if out and at == len(lines[0]):
            return out
    return [{"name": n or None, "email": a.strip().lower()} for n, a in email.utils.getaddresses(lines) if a]


def _decoded(msg, name: str) -> str:
    """A header's text; bytes that are not encoded count as UTF-8."""
    raw = next((v for k, v in msg.raw_items() if k.lower() == name), "")
    plain = str(raw).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return str(email.header.make_header(email.header.decode_header(plain))) if "=?" in plain else plain


@lru_cache(4096)
def _moment(value: str) -> datetime | None:
    try:
        return email.utils.parsedate_to_datetime(value)
    except (ValueError, TypeError):
        return None


def _date(msg) -> tuple[datetime, bool]:
    for value in (msg.get("Date"), (msg.get("Received") or "").rpartition(";")[2] or None):
        d = _moment(str(value)) if value else None
        if d is not None:
            d = d.astimezone(UTC).replace(tzinfo=None) if d.tzinfo else d
            return d, not 1960 <= d.year <= datetime.now().year
    return INVALID, True


def _payload(part) -> str:
    raw = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset(), "utf-8", "latin-1"):
        try:
            return raw.decode(charset or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def parse_message(raw: bytes, folder: str) -> dict:
    """One message as a row: header fields, plain and HTML text, attachments."""
    if b"\r" not in raw:
        try:
            return _row(Plain(raw.decode("ascii", "surrogateescape")), folder)
        except _Odd:
            pass
    return _row(email.message_from_bytes(raw, policy=email.policy.compat32), folder)


def _row(msg, folder: str) -> dict:
    plain, html, files = [], [], []

    def walk(part) -> None:
        kind = part.get_content_type()
        name = part.get_filename()
        if kind == "message/rfc822":
            inner = part.get_payload(0).as_bytes() if part.is_multipart() else part.get_payload(decode=True) or b""
            if part.is_multipart() and str(part.get("Content-Transfer-Encoding") or "").strip().lower() == "base64":
                inner = base64.b64decode(inner)
            keep(part, name or "message.eml", kind, inner, inner.decode("utf-8", "replace"))
        elif part.is_multipart():
            for p in part.get_payload():
                walk(p)
        elif name or part.get_content_disposition() == "attachment" or not kind.startswith("text/"):
            data = part.get_payload(decode=True) or b""
            keep(part, name or "attachment" + {"image/jpeg": ".jpg", "image/png": ".png", "application/pdf": ".pdf", "text/plain": ".txt"}.get(kind, ""), kind, data, _payload(part) if kind.startswith("text/") else None)
        elif kind == "text/html":
            html.append(_payload(part))
        elif kind.startswith("text/"):
            plain.append(_payload(part))

    def keep(part, name: str, kind: str, data: bytes, text: str | None) -> None:
        files.append({"filename": name, "content_type": kind, "charset": part.get_content_charset(), "size": len(data), "sha1": hashlib.sha1(data).hexdigest(), "text": text, "content": data})

    walk(msg)
    when, hacky = _date(msg)
    page = "\n".join(html)
    body = "\n".join(plain) or re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]*>", " ", page)).strip()
    return {
        "folder": folder, "message_id": (str(msg.get("Message-ID") or "")).strip() or None, "date": when, "hacky_date": hacky,
        "subject": _decoded(msg, "subject"),
        "from": _addresses(msg, "From"), "to": _addresses(msg, "To"), "cc": _addresses(msg, "Cc"), "bcc": _addresses(msg, "Bcc"),
        "list_post": msg.get("List-Post"), "body": body, "has_plain": any(plain), "text_html": page or None,
        "headers": "\n".join(f"{k}: {v}" for k, v in msg.items()), "attachments": files,
    }


#: What separates two messages of a mailbox: a line that begins so.
SEPARATOR = "\nFrom "


def message_of(record: bytes) -> bytes:
    """The message of a record between two separators; `>From ` lines are unquoted.

    A record begins with the rest of its separator line, a file's first one with the whole
    line.  What stands before a file's first separator is a message if it begins with a
    header.  Blank lines at the end belong to the separator.
    """
    line, _, rest = record.partition(b"\n")
    whole = record if re.match(rb"[A-Za-z][A-Za-z0-9-]*:", line) and not line.startswith(b"From ") else rest
    if not whole.strip():
        return b""
    whole = whole.rstrip(b"\n") + b"\n"
    return re.sub(rb"(?m)^>(>*From )", rb"\1", whole) if b">From " in whole else whole


def records(spark: SparkSession, path: str) -> DataFrame:
    """(folder, record) of all mailbox files under `path`.

    Files are cut at byte ranges, and a record goes to the range that it begins in, so one
    mailbox is the work of many tasks and no row holds a file.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", SEPARATOR).text(path)
    return lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("folder"), F.col("value").cast("binary").alias("record"))


def _nested(lists: list[list[dict]], kind: pa.ListType) -> pa.ListArray:
    flat, ends = [x for row in lists for x in row], [0]
    for row in lists:
        ends.append(ends[-1] + len(row))
    of = kind.value_type
    inner = pa.StructArray.from_arrays([pa.array([x[f.name] for x in flat], f.type) for f in of], fields=list(of))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [[r[f.name] for r in rows] for f in _ARROW]
    return pa.RecordBatch.from_arrays([_nested(c, f.type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all mailbox files under `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for folder, record in zip(b.column("folder"), b.column("record"), strict=True):
                raw = message_of(record.as_py())
                if not raw:
                    continue
                rows.append(parse_message(raw, urllib.parse.unquote(folder.as_py())))
                held += len(raw)
                if len(rows) == 500 or held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    # times of day are the session's, as they stand
    got = records(spark, path).mapInArrow(run, SCHEMA.replace("date timestamp,", "date timestamp_ntz,")).withColumn("date", F.col("date").cast("timestamp"))
    names = lambda c: F.array_join(F.transform(c, lambda a: a["email"]), ",")
    uid = F.sha2(F.concat_ws("\x01", F.date_format("date", "yyyy-MM-dd HH:mm"), names("from"), names("to"), names("cc"), names("bcc"), F.coalesce("message_id", F.lit("")), F.coalesce("subject", F.lit("")), F.when(F.col("message_id").isNull() & F.col("hacky_date"), F.concat(F.substring("body", 1, 500), F.expr("right(body, 500)"), F.length("body").cast("string"))).otherwise("")), 256)
    return got.withColumn("doc_id", uid)


def last_seen(messages: DataFrame, keys: list[str], uid: str) -> DataFrame:
    """Where an incremental fetch goes on: the largest id per account and folder."""
    return messages.groupBy(*keys).agg(F.max(uid).alias("last_uid"))


def unseen(messages: DataFrame, seen: DataFrame, keys: list[str], uid: str) -> DataFrame:
    """Messages beyond what `last_seen` has of their account and folder; all of those that it does not have.

    Messages without an id cannot be told from known ones and are taken again.
    """
    mark = seen.select(*[F.col(k).alias(f"_{k}") for k in keys], "last_uid")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return messages.join(mark, same, "left").where(F.col("last_uid").isNull() | F.col(uid).isNull() | (F.col(uid) > F.col("last_uid"))).select(*messages.columns)
