"""Secret scans with structural confirmation.

Three patterns give the base spans: assignments to secret-like names, access
key ids and long lower-case hex.  Beyond them, base64 or hex digits are
decoded, and reported only if the bytes have the structure of a secret:

- ``der``: an ASN.1 sequence whose nested lengths fill it exactly and that
  holds a private key (PKCS#1, PKCS#8 or SEC1 shape, the algorithm a known one)
- ``openssh``: the OpenSSH magic, then length-prefixed fields within the bytes
- ``pem``: armour lines around one of the kinds above, or around a body that
  its header says is encrypted, of whole cipher blocks
- ``pgp``: armour lines around an OpenPGP secret-key packet that fits
- ``jwt``: three base64url parts, the first a JSON object with an ``alg``, the
  second a JSON object

Base64 may be wrapped over lines, also by escaped line ends as in JSON strings:
the length in a key's first bytes says how many digits belong to it.  Hex of an
odd number of digits is no bytes.

Defined results: spans are code point offsets, the end exclusive.  A null text
counts as empty; a null id is kept.  Each row is scanned by itself, so repeated
rows repeat; texts of any length are scanned whole, in time linear in it but
for what keys claim (64 KB each at most).  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY(?: BLOCK)?)-----", re.A)
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:;,.()\\_@<>-]*", re.A)
LINE_END = r"(?:\\r)?\\n|\\r|\r?\n"
HEADER = re.compile(r"^[A-Za-z-]+:.*$", re.M)
DEK = re.compile(r"^DEK-Info: *[A-Z0-9-]+,([0-9A-Fa-f]{16,32}) *$", re.M)
JWT_START = re.compile(r"(?<![A-Za-z0-9_-])(?=[eICD][A-Za-z0-9_-]{7,}\.)")  # "{" or white space begins with these digits
JWT = re.compile(r"([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
KEY_START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?=M[A-I][A-Za-z0-9+/_-]{6}|b3BlbnNzaC1rZXktdjEA)")
KEY_LINE = re.compile(rf"([A-Za-z0-9+/_-]+)(={{0,2}})((?:{LINE_END})[ \t]*(?=[A-Za-z0-9+/_-]))?")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")

#: The order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "openssh", "pgp")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: DER bodies of the object ids of private-key algorithms (RSA, RSA-PSS, DH, DSA, EC, X25519, X448, Ed25519, Ed448).
KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a", "2a864886f70d010301", "2a8648ce380401", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571")}
#: The arcs of password-based encryption (PKCS#5, PKCS#12).
PBE_ARCS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: The most bytes that a key may claim.
LONGEST_KEY = 1 << 16


def _tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER value at ``at``, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER values that fill ``[at, end)`` exactly."""
    out = []
    while at < end:
        x = _tlv(b, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def der_key(b: bytes) -> bool:
    """Whether the bytes are a private key in DER, with every nested length right."""
    top = _tlv(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    parts = _children(b, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, *_ in parts]
    if tags[0] == 0x30 and tags == [0x30, 0x04]:  # an encrypted key
        inner = _children(b, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and b[inner[0][1] : inner[0][2]].startswith(PBE_ARCS)
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1 or len(parts) < 3 and tags[1:2] != [0x04]:
        return False
    if len(parts) >= 6 and all(t == 0x02 for t in tags[:6]):  # PKCS#1, DSA
        return True
    if tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
        inner = _children(b, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and b[inner[0][1] : inner[0][2]] in KEY_OIDS
    return tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC1


def openssh_key(b: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key whose length-prefixed fields fit."""
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return False
    at, fields = len(magic), []
    for i in range(5):
        if i == 3:  # the number of keys
            if at + 4 > len(b) or int.from_bytes(b[at : at + 4], "big") < 1:
                return False
            at += 4
        if at + 4 > len(b):
            return False
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + n > len(b):
            return False
        fields.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    return bool(fields[0]) and bool(fields[3])


def unbase64(s: str) -> bytes | None:
    s = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    b = unbase64(part)
    try:
        x = json.loads(b) if b else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def key_kind(b: bytes | None) -> str | None:
    if not b:
        return None
    return "der" if der_key(b) else "openssh" if openssh_key(b) else None


def pgp_key(body: str) -> bool:
    """Whether an armoured body begins with an OpenPGP secret-key packet that fits in it."""
    digits = [x for x in body.replace("\r", "").split("\n\n", 1)[-1].split() if not x.startswith("=")]  # without headers and checksum
    b = unbase64("".join(digits))
    if not b or len(b) < 8 or not b[0] & 0x80:
        return False
    if b[0] & 0x40:  # the newer form of lengths
        tag, n = b[0] & 0x3F, b[1]
        at, n = (2, n) if n < 192 else (3, ((n - 192) << 8) + b[2] + 192) if n < 224 else (6, int.from_bytes(b[2:6], "big"))
    else:
        tag, k = (b[0] >> 2) & 0x0F, (1, 2, 4, 0)[b[0] & 3]
        at, n = 1 + k, int.from_bytes(b[1 : 1 + k], "big") if k else len(b) - 1
    return tag in (5, 7) and at + n <= len(b) and n > 6 and b[at] in (3, 4, 5, 6)


def pem_kind(label: str, body: str) -> str | None:
    """What the lines between two armour lines hold."""
    if not PEM_BODY.fullmatch(body):
        return None
    body = re.sub(LINE_END, "\n", body).strip()
    if label.endswith("BLOCK"):
        return "pgp" if pgp_key(body) else None
    b = unbase64(HEADER.sub("", body))
    if key_kind(b):
        return "pem"
    dek = DEK.search(body)  # a body of whole blocks, with the vector that its cipher needs
    return "pem" if b and dek and "ENCRYPTED" in body and len(b) >= 32 and len(b) % (len(dek[1]) // 2) == 0 else None


def key_at(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of the base64 key that begins at ``at``, as long as its own first bytes say."""
    need = LONGEST_KEY * 4 // 3
    if text[at] == "M":
        head = unbase64(text[at : at + 8])
        n = head[1] if head else 0
        k = n & 0x7F if n & 0x80 else 0
        if not head or k > 4:
            return None
        total = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else n)
        if not 32 <= total <= LONGEST_KEY:
            return None
        need = (total * 4 + 2) // 3
    digits, have, end = [], 0, at
    while have < need and (m := KEY_LINE.match(text, end)):
        digits.append(m[1])
        have += len(m[1])
        end = m.end(2)
        if m[2] or not m[3]:
            break
        if have < need:
            end = m.end()
    if text[at] == "M" and have != need:
        return None
    kind = key_kind(unbase64("".join(digits)))
    return (kind, end) if kind else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded bytes have the structure of a secret."""
    out = []
    if "-----BEGIN" in text:
        begin = None  # each armour line is looked at once
        for m in ARMOUR.finditer(text):
            if m[1] == "END" and begin and begin[2] == m[2] and (kind := pem_kind(m[2], text[begin.end() : m.start()])):
                out.append((kind, begin.start(), m.end()))
            begin = m if m[1] == "BEGIN" else None
    end = 0
    for m in JWT_START.finditer(text):
        if m.start() >= end and (t := JWT.match(text, m.start())):
            head = _object(t[1])
            if head and isinstance(head.get("alg"), str) and _object(t[2]) is not None:
                out.append(("jwt", t.start(), t.end()))
                end = t.end()
    armoured = [(s, e) for k, s, e in out if k in ("pem", "pgp")]
    end = 0
    for m in KEY_START.finditer(text):
        s = m.start()
        if s >= end and not any(a <= s < b for a, b in armoured) and (found := key_at(text, s)):
            out.append((found[0], s, found[1]))
            end = found[1]
    for m in ANY_HEX.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and (kind := key_kind(bytes.fromhex(m[0]))):
            out.append((kind, m.start(), m.end()))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span replaced; overlapping spans become one mark."""
    if not text:
        return text
    spans = in_order(base_spans(text) + confirmed_spans(text))
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, s, e in spans:
        if s >= end:
            out += [text[at:s], mark]
        at = end = max(e, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``secrets``: the spans (kind, start, end) of each row, by start, then kind."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<kind string, start bigint, end bigint>>")
    def spans(col: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in in_order(base_spans(t) + confirmed_spans(t))] for t in (t or "" for t in col.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return docs.select(quoted(id_col).alias("doc_id"), spans(quoted(text_col)).alias("secrets"))


def digest(secrets: Column) -> dict[str, Column]:
    """Counts, digest and joined spans of a column of ``scan_secrets``."""
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(secrets, lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter(secrets, lambda s: s["kind"] == k)).cast("long")
    return {"n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": F.sha2(join(base).cast("binary"), 256), "spans": join(secrets)}


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and ``size_col``, if there is one, set to the new number of characters where the text changed."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(col: pa.Array) -> pa.Array:
        return pa.array([redact(t, mark) for t in col.to_pylist()], pa.string())

    name = "__clean"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, clean(quoted(text_col)))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(name).alias(c))
        elif c == size_col:
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col(name).eqNullSafe(quoted(text_col)), quoted(c)).otherwise(F.length(name).cast(kind)).alias(c))
        else:
            columns.append(quoted(c))
    return out.select(*columns)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest that ``digest`` computes, for one text in plain Python."""
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
