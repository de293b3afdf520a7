"""Secret scan: pattern candidates, and encoded candidates confirmed by their structure.

Candidates in base64, base64url or hex are reported only if they decode and parse: DER private keys by their nested
lengths, PEM blocks by their decoded body (encrypted ones by their headers and whole cipher blocks), OpenSSH private keys by their length-prefixed fields, and signed tokens by a
JSON header that names an algorithm. A run of letters of an encoding is decoded once for each place that its groups can
begin at, so a key is found wherever it begins in the run, and its lengths tell where it ends; runs of base64 in
successive lines are joined. Plain assignments, access ids and long hex runs are reported by pattern.

Rows: one output row per input row; null text gives no spans, like the empty text. Positions count code points, ends are
exclusive. Spans are sorted by start, then kind in the order of KINDS, then end. Keys inside a PEM block count as the
block. Very long texts are scanned whole, in time that grows with their length. Repeated rows give repeated results; an
empty table gives an empty one. Columns of the input named like the output are replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, extend, texts_of

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "der", "openssh", "signed")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are greedy, so shorter ones hold no other match
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----([^-]+(?:-(?!----)[^-]*)*)-----END \1-----")
#: Headers of an encrypted block: that it is, the cipher and its first block in hex.
ENCRYPTED = re.compile(r"\s*Proc-Type:[ \t]*4,[ \t]*ENCRYPTED\s+DEK-Info:[ \t]*[A-Z0-9-]{3,40},[ \t]*((?:[0-9A-Fa-f]{2}){8,32})\s")
DOTTED = re.compile(r"[A-Za-z0-9_.-]{20,}")
HEADER, JSON = re.compile(r'\{\s*"[^"\\]*"\s*:'), json.JSONDecoder(strict=False)
RUN64, MORE64, GAP = re.compile(r"[A-Za-z0-9+/_-]{40,}"), re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[ \t]{0,16}\r?\n[ \t]{0,16}")
RUN16 = re.compile(r"[0-9A-Fa-f]{80,}")
_LENGTH = rb"(?:[\x00-\x7f]|\x81.|\x82..|\x83...)"
#: A sequence of any length that begins with a version number, or with an algorithm of password-based encryption (PKCS 5, PKCS 12).
DER_HEAD = re.compile(rb"\x30" + _LENGTH + rb"(?:\x02\x01[\x00-\x03]|\x30" + _LENGTH + rb"\x06[\x09\x0a]\x2a\x86\x48\x86\xf7\x0d\x01(?:\x05|\x0c\x01))", re.S)
MAGIC = b"openssh-key-v1\0"
SPACE, PADDING = re.compile(r"\s+"), re.compile("={0,2}")
URLSAFE = str.maketrans("-_", "+/")


def decode64(text: str) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[at:end] exactly, each constructed one filled exactly in turn; else None."""
    out = []
    while at < end:
        if at + 2 > end or depth > 8:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > end or tag & 0x20 and der_items(data, at, at + size, depth + 1) is None:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def der_end(data: bytes, at: int) -> int | None:
    """The end of a private key that begins at a place: a sequence of a small version number, then key numbers (PKCS 1), an algorithm and key (PKCS 8) or an EC key; or a sequence of a cipher's algorithm and whole blocks of bytes (PKCS 8, encrypted)."""
    size, body = data[at + 1], at + 2
    if size >= 0x80:
        size, body = int.from_bytes(data[body : body + (size & 0x7F)], "big"), body + (size & 0x7F)
    inner = der_items(data, body, body + size) if body + size <= len(data) else None
    if inner and [x[0] for x in inner] == [0x30, 0x04]:
        return body + size if (inner[1][2] - inner[1][1]) % 8 == 0 and inner[1][2] > inner[1][1] else None
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return None
    tags = [x[0] for x in inner[1:]]
    return body + size if len(tags) >= 8 and set(tags[:8]) == {0x02} or tags[:2] == [0x30, 0x04] or tags[0] == 0x04 else None


def openssh_end(data: bytes, at: int) -> int | None:
    """The end of a private key that begins at a place: the magic string, then cipher, kdf and its options, key count, that many public keys and the private part, fields with lengths that stay inside the data."""

    def field(at: int, plain: bool = False) -> int | None:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if at + 4 <= len(data) and end <= len(data) and (not plain or data[at + 4 : end].isascii()) else None

    at += len(MAGIC)
    for k in range(3):
        if (at := field(at, k < 2)) is None:
            return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):
        if (at := field(at)) is None:
            return None
    return at


def keys_in(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the private keys in decoded bytes; none inside another."""
    found, end = [], 0
    starts = sorted([(m.start(), "der", der_end) for m in DER_HEAD.finditer(data)] + [(m.start(), "openssh", openssh_end) for m in re.finditer(MAGIC, data)], key=lambda x: x[0])
    for at, kind, ends in starts:
        if at >= end and (to := ends(data, at)) is not None and to - at >= 30:
            found.append((kind, at, to))
            end = to
    return found


def lines64(text: str) -> list[list[tuple[int, int]]]:
    """The places of base64 runs; those that go on in the next line are joined."""
    out: list[list[tuple[int, int]]] = []
    for m in RUN64.finditer(text):
        if out and m.start() < out[-1][-1][1]:
            continue  # the last, short line of a run before
        parts = [m.span()]
        while (gap := GAP.match(text, parts[-1][1])) and (more := MORE64.match(text, gap.end())):
            parts.append(more.span())
            if more.end() - more.start() < 40:
                break
        out.append(parts)
    return out


def encoded_keys(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of private keys in base64 and hex runs."""
    found = set()
    for parts in lines64(text):
        run = "".join(text[a:b] for a, b in parts).translate(URLSAFE)
        ends = list(accumulate(b - a for a, b in parts))
        place = lambda k: parts[i := bisect_right(ends, k)][1] - (ends[i] - k)
        for phase in range(min(4, len(run))):
            data = decode64(run[phase : len(run) - ((len(run) - phase) % 4 == 1)]) or b""  # a single last letter holds no byte
            for kind, at, to in keys_in(data):
                if at % 3 == 0:  # others begin inside a letter, and are found in another phase
                    last = place(phase + (to * 4 + 2) // 3 - 1) + 1
                    found.add((kind, place(phase + at // 3 * 4), last + len(PADDING.match(text, last)[0])))
    for m in RUN16.finditer(text):
        for phase in range(2):
            run = m[0][phase:]
            found |= {(kind, m.start() + phase + 2 * a, m.start() + phase + 2 * b) for kind, a, b in keys_in(bytes.fromhex(run[: len(run) // 2 * 2]))}
    return sorted(found)


def signed_tokens(text: str) -> list[tuple[str, int, int]]:
    """Three base64url parts joined by dots: the first ends in a JSON object that names its algorithm, the second is a JSON object."""
    found, end = [], 0
    for m in DOTTED.finditer(text) if "eyJ" in text else ():
        parts, at = m[0].split("."), m.start()
        for head, body, sign in zip(parts, parts[1:], parts[2:]):
            if at >= end and len(body) >= 4 and (signature := re.match("[A-Za-z0-9_-]{16,}", sign)) and "eyJ" in head and is_object(decode64(body)):
                if (start := header_start(head)) is not None:
                    end = at + len(head) + len(body) + 2 + signature.end()
                    found.append(("signed", at + start, end))
            at += len(head) + 1
    return found


def is_object(data: bytes | None) -> bool:
    try:
        return isinstance(json.loads(data or b""), dict)
    except (ValueError, RecursionError):
        return False


def header_start(head: str) -> int | None:
    """Where in a token's first part its header begins: JSON from there to the end, with an algorithm's name."""
    starts = []
    for phase in range(min(4, len(head))):
        data = (decode64(head[phase:]) or b"").decode("latin-1")
        for m in HEADER.finditer(data):
            if m.start() % 3 == 0:
                try:
                    header, end = JSON.raw_decode(data, m.start())
                except (ValueError, RecursionError):
                    continue
                if not data[end:].strip() and isinstance(header.get("alg"), str):
                    starts.append(phase + m.start() // 3 * 4)
                    break
    return min(starts, default=None)


def is_key_body(text: str) -> bool:
    if sealed := ENCRYPTED.match(text):
        data = decode64(SPACE.sub("", text[sealed.end() :])) or b""
        return len(data) >= 32 and len(data) % (len(sealed[1]) // 2) == 0
    data = decode64(SPACE.sub("", text)) or b""
    return bool(DER_HEAD.match(data)) and der_end(data, 0) == len(data) or data.startswith(MAGIC) and openssh_end(data, 0) is not None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of one text."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    blocks = [m.span() for m in PEM.finditer(text) if is_key_body(m[2])] if "-----BEGIN " in text else []
    found += [("pem", *x) for x in blocks]
    found += [x for x in encoded_keys(text) if not any(a <= x[1] < b for a, b in blocks)]
    found += signed_tokens(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with all spans of each whole text."""

    def start():
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        names = ("kind", "start", "end")

        def batch(texts: pa.Array) -> pa.Array:
            return pa.array([[dict(zip(names, x)) for x in find_spans((t or b"").decode("utf-8", "replace"))] for t in texts_of(texts)], pa.list_(kind))

        return batch

    return extend(docs, **{spans: arrow_column(start, SPANS)(F.col(text))})


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by mask; overlapping spans become one. Null text stays null."""

    def start():
        def clean(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            t = raw.decode("utf-8", "replace")
            out, at = [], 0
            for _, a, b in find_spans(t):
                if b > at:
                    out += [t[at:a], mask] if a >= at else []
                    at = b
            return "".join([*out, t[at:]])

        return lambda texts: pa.array([clean(x) for x in texts_of(texts)], pa.string())

    return extend(docs, **{text: arrow_column(start, "string")(F.col(text))})


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*BASE)) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
