"""Secret scan: base patterns find spans, structural parsing confirms further ones.

Base spans (assignments, access keys, hex runs) are reported as the patterns say.
Beyond them, base64 and hex candidates are decoded and reported only if they parse:
a signed token needs a JSON header naming an algorithm and a JSON payload, a key
needs the nested lengths of its encoding to add up to the decoded bytes exactly.

Escaped line ends count as line ends. Encrypted keys need their algorithm or headers.

Defined cases. A null text is an empty one and has no spans. A repeated row is
scanned like any other. A signed token starts where no token character precedes it. Offsets count code points, the end is exclusive. Candidates
that cannot be decoded or whose lengths do not add up are not reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and the least length of each kind.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")

# no pattern may start again inside a run it has read: a scan is linear in the text
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
ARMOUR = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*+((?:[A-Za-z0-9-]++:(?:(?!-----)[^\n\r])*+\s++)*+)([A-Za-z0-9+/=_\s]*+)-----END \1-----"
)
ENCODED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}")
URL_SAFE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?=\s)")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{40}")
NEXT_LINE = re.compile(r"[^\S\n]*\n\s*([A-Za-z0-9+/_-]+={0,2})")
ESCAPED = re.compile(r"(?<!\\)\\++[nrt]")
CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})\s")
# password-based encryption: PKCS #5 and PKCS #12
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
HEX_PAIRS = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
SSH_MAGIC = b"openssh-key-v1\0"
SSH_KIND = re.compile(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+")


def _unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _json_object(text: str) -> dict | None:
    data = _unbase64(text)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(text: str) -> bool:
    """A header object naming its algorithm, an object as payload, a decodable signature."""
    header, payload, signature = text.split(".", 2)
    return (
        isinstance((_json_object(header) or {}).get("alg"), str)
        and _json_object(payload) is not None
        and _unbase64(signature) is not None
    )


def der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the elements that fill `data[start:end]` exactly, else None."""
    fields, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            length, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + length > end:
            return None
        fields.append((tag, at, at + length))
        at += length
    return fields


def der_key(data: bytes) -> bool:
    """A sequence that starts with a version number and goes on with well-formed key fields."""
    outer = der_fields(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    tag, start, end = inner[0]
    version = tag == 0x02 and end - start == 1 and data[start] <= 3
    nested = all(der_fields(data, a, b) is not None for t, a, b in inner if t in (0x30, 0x31))
    return version and nested and inner[1][0] in (0x02, 0x04, 0x30)


def ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first of them naming the key's kind."""
    at, names = 0, []
    if data.startswith(SSH_MAGIC):
        at = len(SSH_MAGIC)
        for _ in range(3):
            length = int.from_bytes(data[at:at + 4], "big")
            if at + 4 + length > len(data):
                return False
            at += 4 + length
        return at + 4 <= len(data) and int.from_bytes(data[at:at + 4], "big") >= 1
    while at < len(data):
        length = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + length > len(data):
            return False
        names.append(data[at + 4:at + 4 + length])
        at += 4 + length
    return len(names) >= 2 and SSH_KIND.fullmatch(names[0]) is not None


def encrypted_key(data: bytes) -> bool:
    """A sequence of a password-based encryption's algorithm and a byte string."""
    outer = der_fields(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(data, outer[0][1], outer[0][2])
    if not inner or [t for t, _, _ in inner] != [0x30, 0x04] or inner[1][1] == inner[1][2]:
        return False
    algorithm = der_fields(data, inner[0][1], inner[0][2])
    if not algorithm or [t for t, _, _ in algorithm] != [0x06, 0x30]:
        return False
    (_, a, b), (_, start, end) = algorithm
    return data[a:b].startswith(ENCRYPTION) and der_fields(data, start, end) is not None


def is_key(data: bytes | None) -> bool:
    return bool(data) and (der_key(data) or encrypted_key(data) or ssh_key(data))


def encrypted_body(headers: str, data: bytes | None) -> bool:
    """Whole blocks of the cipher that the armour's headers name, by its initial vector."""
    named = CIPHER.search(headers) if "ENCRYPTED" in headers else None
    return bool(named and data) and len(data) % (len(named[1]) // 2) == 0


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys over several lines of one width, of which the last may be shorter."""
    done = 0
    for m in WRAPPED.finditer(text):
        if m.start() < done:
            continue
        stops = [m.end()]
        while line := NEXT_LINE.match(text, stops[-1]):
            if len(line[1]) > len(m[0]):
                break
            stops.append(line.end())
            if len(line[1]) < len(m[0]):
                break
        done = stops[-1]
        for stop in stops[1:][:-3:-1]:  # the line after a full last one may be another text
            if is_key(_unbase64(text[m.start():stop])):
                yield "key", m.start(), stop
                break


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    # escaped line ends become blank ones of the same length
    plain = ESCAPED.sub(lambda m: "\n" * len(m[0]), text) if "\\" in text else text
    if "eyJ" in text:
        for m in TOKEN.finditer(plain):
            if signed_token(m[0]):
                yield "jwt", m.start(), m.end()
    if "PRIVATE KEY-----" in plain:
        for m in ARMOUR.finditer(plain):
            data = _unbase64(m[3])
            if is_key(data) or encrypted_body(m[2], data):
                yield "pem", m.start(), m.end()
    if not LONG_RUN.search(text):
        return  # neither form of a key has a line so long
    for source in (text, plain) if plain != text else (text,):
        for m in ENCODED.finditer(source):
            if is_key(bytes.fromhex(m[0]) if HEX_PAIRS.fullmatch(m[0]) else _unbase64(m[0])):
                yield "key", m.start(), m.end()
        for m in URL_SAFE.finditer(source):
            if is_key(_unbase64(m[0])):
                yield "key", m.start(), m.end()
    yield from _wrapped(plain)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed in `KINDS`."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans += _confirmed(text)
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


@F.pandas_udf(SPANS)
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda text: [
            {"kind": k, "start": a, "end": b} for k, a, b in find_spans(text or "")
        ])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, spans`: an array of (kind, start, end) for every document."""
    return docs.select(F.col(id_col).alias("doc_id"), _spans(F.col(text_col)).alias("spans"))
