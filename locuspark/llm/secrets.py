"""Secret scans: patterns, and candidates confirmed by their inner structure.

The base kinds ``assign``, ``access`` and ``hex`` are patterns alone.  Further
kinds are reported only where a candidate decodes and its structure holds:
``jwt`` (a signed token whose header and claims are JSON objects), ``pem`` (an
armoured private key, plain or encrypted), ``der`` (a bare base64 private key),
``ssh`` (an OpenSSH private key without armour) and ``hexder`` (a key in
hexadecimal digits, adjacent or separated).

Bare keys are looked for at every position, in lines that go on and within
longer runs: the outer length of an encoding says how many characters it has,
and these must decode to a key whose nested lengths agree.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh", "hexder")

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run of 18 (16) characters or more is the run that the open pattern finds, as both end where the class does.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----((?:\s*[A-Za-z][A-Za-z0-9-]*:[^\r\n]*\r?\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_DEK = re.compile(r"DEK-Info:\s*([A-Z0-9-]+)\s*,\s*([0-9A-Fa-f]+)\s*$", re.MULTILINE)
# In base64 a sequence starts with M; C to H are lengths of one byte, I longer ones.
_DER_START = re.compile(r"(?=(M[C-I][A-Za-z0-9+/]{10}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{9}))")
_DER_RUN = re.compile(r"[A-Za-z0-9+/]+")
_LINE = re.compile(r"[ \t]*\r?\n[ \t]*")
_HEX_START = re.compile(r"(?=(30(?:[0-7]|8[1-4]))(?:[0-9A-Fa-f]{14}))")
_HEX_PAIRS = re.compile(r"(?<![0-9A-Fa-f])30(?:(?::|-|[ \t]|:?[ \t]*\r?\n[ \t]*)[0-9A-Fa-f]{2}){15,}")
_NOT_HEX = re.compile(r"[^0-9A-Fa-f]+")

_HEX_ONLY = re.compile(r"[0-9A-Fa-f]*")

_SEQUENCE, _INTEGER, _OCTETS, _OID = 0x30, 0x02, 0x04, 0x06
#: The object identifiers of PKCS 5 and of PKCS 12 schemes, by which keys are encrypted.
_PASSWORD_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the elements that fill data[start:end] exactly; None where they don't."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length = data[start], data[start + 1]
        start += 2
        if length == 0x80 or length > 0x84:
            return None
        if length > 0x80:
            n = length - 0x80
            if start + n > end:
                return None
            length = int.from_bytes(data[start : start + n], "big")
            start += n
            if length < 0x80 or length < 1 << 8 * (n - 1):  # lengths must be as short as they can
                return None
        if start + length > end:
            return None
        found.append((tag, start, start + length))
        start += length
    return found


def private_key_encoding(data: bytes) -> str | None:
    """``der`` or ``ssh`` where the bytes are the encoding of a private key, nested lengths included."""
    if data.startswith(b"openssh-key-v1\0"):
        return "ssh" if _ssh_strings(data) else None
    top = _children(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return None
    parts = _children(data, *top[0][1:])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    if tags == [_SEQUENCE, _OCTETS]:
        return "der" if _encrypted(data, parts) else None
    if tags[0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return None
    version = data[parts[0][1]]
    if version in (0, 1) and len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:  # any algorithm, wrapped
        inner = _children(data, *parts[1][1:])
        return "der" if inner and inner[0][0] == _OID else None
    if version == 0 and len(tags) in (6, 9) and set(tags) == {_INTEGER}:  # DSA or RSA
        return "der"
    if version == 1 and len(tags) >= 2 and tags[1] == _OCTETS and set(tags[2:]) <= {0xA0, 0xA1}:  # elliptic curve
        return "der"
    return None


def _encrypted(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """An encrypted key: an algorithm for encryption by password, with its parameters, and whole bytes that it made."""
    algorithm = _children(data, *parts[0][1:])
    if not algorithm or [a[0] for a in algorithm] != [_OID, _SEQUENCE] or parts[1][2] - parts[1][1] < 8:
        return False
    by_password = data[algorithm[0][1] : algorithm[0][2]].startswith(_PASSWORD_OIDS)
    return by_password and _children(data, *algorithm[1][1:]) is not None


def _encoded_size(data: bytes) -> int | None:
    """Bytes of the encoding that starts with ``data``, where its first bytes are those of a key."""
    if len(data) < 9 or data[0] != _SEQUENCE:
        return None
    n = data[1] - 0x80 if data[1] > 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return None
    size = int.from_bytes(data[2 : 2 + n], "big") if n else data[1]
    start = 2 + n
    version = data[start] == _INTEGER and data[start + 1] == 1 and data[start + 2] in (0, 1)
    return start + size if version or data[start] == _SEQUENCE else None


def _ssh_size(data: bytes) -> int | None:
    """Bytes of an OpenSSH key at the start of ``data``, or None where its strings reach beyond it."""
    at = len(b"openssh-key-v1\0")
    for k in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(min(keys, 64) + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def _run(text: str, start: int, wanted: int | None) -> tuple[str, list[int]]:
    """Base64 characters from ``start``, over line breaks, as many as ``wanted`` if there are; and where each line starts and ends."""
    parts, ends, at, n = [], [], start, 0
    while (m := _DER_RUN.match(text, at)) and (wanted is None or n < wanted):
        stop = m.end() if wanted is None else min(m.end(), at + wanted - n)
        parts.append(text[at:stop])
        ends += [at, stop]
        n += stop - at
        gap = _LINE.match(text, m.end())
        if gap is None or stop < m.end():
            break
        at = gap.end()
    return "".join(parts), ends


def _end_of(ends: list[int], n: int) -> int:
    """The text position after the first ``n`` characters of a run."""
    for a, b in zip(ends[::2], ends[1::2]):
        if n <= b - a:
            return a + n
        n -= b - a
    return ends[-1]


def _bare_keys(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Keys in base64 at any position outside the spans ``taken``; they don't overlap."""
    free, skip = 0, sorted(taken)
    for m in _DER_START.finditer(text):
        start = m.start()
        while skip and skip[0][1] <= start:
            skip.pop(0)
        if start < free or skip and skip[0][0] <= start:
            continue
        if m[1][0] == "M":
            size = _encoded_size(base64.b64decode(m[1]))
            if size is None or size > len(text) - start:
                continue
            chars, ends = _run(text, start, -(-size * 4 // 3))
            if len(chars) * 3 // 4 < size:
                continue
            data = _decoded(chars)
        else:
            chars, ends = _run(text, start, None)
            data = _decoded(chars[: len(chars) // 4 * 4]) if len(chars) % 4 == 1 else _decoded(chars)
            size = _ssh_size(data) if data else None
            if size is None:
                continue
            data = data[:size]
        kind = private_key_encoding(data[:size]) if data else None
        if kind:
            free = _end_of(ends, -(-size * 4 // 3))
            pad = -size % 3
            if text.startswith("=" * pad, free):
                free += pad
            yield start, free, kind


def _hex_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in hexadecimal digits, adjacent ones at any position, or pairs separated by colons, hyphens, blanks or lines."""
    free = 0
    for m in _HEX_START.finditer(text):
        start = m.start()
        if start < free:
            continue
        size = _encoded_size(bytes.fromhex(text[start : start + 16]) + bytes(2))
        if size is None or start + 2 * size > len(text) or not _HEX_ONLY.fullmatch(text, start, start + 2 * size):
            continue
        if private_key_encoding(bytes.fromhex(text[start : start + 2 * size])):
            free = start + 2 * size
            yield start, free, "hexder"
    for m in _HEX_PAIRS.finditer(text):
        data = bytes.fromhex(_NOT_HEX.sub("", m[0]))
        size = _encoded_size(data)
        if size is not None and size <= len(data) and private_key_encoding(data[:size]):
            pairs = re.finditer(r"[0-9A-Fa-f]{2}", m[0])
            last = next(p for i, p in enumerate(pairs) if i == size - 1)
            yield m.start(), m.start() + last.end(), "hexder"


def _armoured(headers: str, body: str) -> bool:
    """A key between armour lines: an encoding, or one that its headers say is encrypted, in whole blocks of the named cipher."""
    data = _decoded("".join(body.split()))
    if not data:
        return False
    if not headers.strip():
        return private_key_encoding(data) is not None
    if "Proc-Type: 4,ENCRYPTED" not in headers:
        return private_key_encoding(data) is not None
    dek = _DEK.search(headers)
    block = len(dek[2]) // 2 if dek else 0
    return block in (8, 16) and len(dek[2]) % 2 == 0 and len(data) >= 2 * block and len(data) % block == 0


def _ssh_strings(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, the public keys, the private part."""
    at = len(b"openssh-key-v1\0")

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if string() is None or string() is None or string() is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(string() is not None for _ in range(keys + 1)) and at == len(data)


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(text: str) -> dict | None:
    data = _decoded(text, url=True)
    try:
        value = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _signed_token(header: str, claims: str, signature: str) -> bool:
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(claims) is None:
        return False
    return bool(signature) and _decoded(signature, url=True) is not None if head["alg"].lower() != "none" else True


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and kind of every span, in code points, by start and then kind as listed."""
    if not text:
        return []
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in _ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "eyJ" in text:
        spans += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if _signed_token(*m.groups())]
    armoured = [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if _armoured(m[2], m[3])] if "PRIVATE KEY-----" in text else []
    spans += armoured
    spans += _bare_keys(text, armoured)
    spans += _hex_keys(text)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (start, end, kind), for every row.

    Null and empty texts have no spans; null ids and repeated rows stay; other
    columns are left out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return source.mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redacted(text: str | None, mark: str = "[{kind}]") -> str | None:
    """The text with each stretch covered by spans replaced by a mark that names its first kind."""
    if not text:
        return text
    out, at = [], 0
    stretches: list[list] = []
    for start, end, kind in find_secrets(text):
        if stretches and start < stretches[-1][1]:
            stretches[-1][1] = max(end, stretches[-1][1])
        else:
            stretches.append([start, end, kind])
    for start, end, kind in stretches:
        out += [text[at:start], mark.format(kind=kind.upper())]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the secrets in its texts replaced by marks; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    """What ``span_digest`` gives as base_sha256, for tests."""
    return hashlib.sha256(_joined([s for s in spans if s[2] in KINDS[:3]]).encode()).hexdigest()
