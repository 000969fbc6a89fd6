"""Secrets in texts: pattern candidates, and structures that are decoded and parsed before they are reported.

Base kinds are patterns: ``assign`` (a name and its value), ``access`` (access key ids) and ``hex`` (long lower-case hex runs).
Added kinds are reported only after structural confirmation: ``jwt`` (a token whose header decodes to JSON with an algorithm
and whose body decodes to a JSON object), ``pem`` (a private-key block whose base64 body parses, line ends perhaps escaped as in
JSON files) and ``key`` (a bare base64 or hex run that decodes to a private key or to a whole ``pem`` block). A private key is a DER
sequence whose nested lengths fill their parents exactly and which holds a version and key material, or the openssh-key-v1 format
with all its length-prefixed fields in place. A block that its headers call encrypted holds whole cipher blocks and a start vector of one.

Every document is searched whole, in one task; texts without any of the literal marks of a kind are passed over quickly.

Defined cases: a null or empty text has no span; spans of different kinds may overlap, those of one kind don't; equal starts
are ordered by kind; repeated rows get equal results; an empty table gives an empty result; other columns are ignored; a very
long text is searched like any other, in time that grows with its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, rows_per_task, texts

KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
BASE = KINDS[:3]
#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
ANY_HEX = re.compile(r"(?a)(?<![0-9A-Za-z+/])[0-9A-Fa-f]{64,}(?![0-9A-Za-z+/=])")
#: A header is base64 of a brace that a quote or white space follows.
JWT = re.compile(r"(?a)e(?<![\w-]e)([wy][\w-]{8,})\.([\w-]+)\.[\w-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
LINE_END = re.compile(r"\\r|\\n|[\r\n]")
ENCRYPTED = re.compile(r"(?a)\s*Proc-Type: *4,ENCRYPTED\s+DEK-Info: *([A-Z0-9]+)[A-Z0-9-]*,([0-9A-Fa-f]+)\s+")
#: Bytes in a cipher block.
CIPHER_BLOCKS = {"DES": 8, "AES": 16, "CAMELLIA": 16}
BASE64 = re.compile(r"(?a)(?<![\w+/-])(?:[A-Za-z0-9+/]{40,}|[\w-]{40,})={0,2}(?![\w+/=-])")

#: Bytes to a mark where they belong to a run of hex digits or of base64 digits.
_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_LONG_RUN = bytes(120 if chr(i) in string.ascii_letters + string.digits + "+/_-" else 32 for i in range(256))


def unbase64(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, with or without padding; None if it isn't one."""
    run = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the fields that fill data[start:end] exactly; None if they don't."""
    fields, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at:at + n]), at + n
            if length < 0x80:
                return None  # DER takes the short form
        if at + length > end:
            return None
        fields.append((tag, at, at + length))
        at += length
    return fields


#: DER tags.
INTEGER, OCTETS, OBJECT, SEQUENCE, CONTEXT_0 = 0x02, 0x04, 0x06, 0x30, 0xA0


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key: RSA, DSA or EC by itself, or wrapped with its algorithm, perhaps encrypted."""
    top = der_fields(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    fields = der_fields(data, *top[0][1:])
    if not fields:
        return False
    todo = [f for f in fields if f[0] & 0x20]
    while todo:  # every constructed field must be filled exactly
        inner = der_fields(data, *todo.pop()[1:])
        if inner is None:
            return False
        todo += [f for f in inner if f[0] & 0x20]
    tags = [f[0] for f in fields]
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:  # encrypted
        inner = der_fields(data, *fields[0][1:])
        return bool(inner) and inner[0][0] == OBJECT
    if tags[0] != INTEGER or data[fields[0][1]:fields[0][2]] not in (b"\0", b"\1"):
        return False
    if len(tags) >= 6 and all(t == INTEGER for t in tags[:6]):  # RSA has nine numbers, DSA six
        return sum(e - s for _, s, e in fields) >= 32
    if tags[1] == OCTETS:  # EC
        return fields[1][2] - fields[1][1] >= 16 and (len(tags) == 2 or tags[2] in (CONTEXT_0, 0xA1))
    if tags[1] == SEQUENCE and len(tags) > 2 and tags[2] == OCTETS:
        inner = der_fields(data, *fields[1][1:])
        return bool(inner) and inner[0][0] == OBJECT
    return False


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are in the openssh-key-v1 format with every length-prefixed field in place."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4])
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):  # cipher, key derivation, its options
        return False
    keys, at = int.from_bytes(data[at:at + 4]), at + 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) and at == len(data)


def is_pem_body(body: str) -> bool:
    """Whether what stands between the marks of a block is a private key, perhaps one that is encrypted as its headers say."""
    body = LINE_END.sub("\n", body)
    locked = ENCRYPTED.match(body)
    if not locked:
        data = unbase64(body)
        return bool(data) and (is_der_key(data) or is_openssh_key(data))
    block, data = CIPHER_BLOCKS.get(locked[1]), unbase64(body[locked.end():])
    return bool(block and data) and len(locked[2]) == 2 * block and len(data) % block == 0 and len(data) >= 32


def is_key(data: bytes | None) -> bool:
    if data and data.lstrip().startswith(b"-----BEGIN "):
        block = PEM.fullmatch(data.decode("latin-1").strip())
        return bool(block) and is_pem_body(block[2])
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(header: str, body: str) -> bool:
    """Whether both parts decode to JSON objects and the header names an algorithm."""
    try:
        head, content = (json.loads(unbase64(part) or b"") for part in (header, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(content, dict)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the tokens that parse; one that doesn't leaves its later parts to the next search."""
    match = JWT.search(text)
    while match:
        confirmed = is_signed_token("e" + match[1], match[2])
        if confirmed:
            yield match.span()
        match = JWT.search(text, match.end() if confirmed else match.end(1))


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start and then by kind."""
    found, raw = [], text.encode("utf-8", "surrogatepass")
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in raw.translate(_HEX_RUN):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("jwt", *span) for span in signed_tokens(text)]
    blocks = [m.span() for m in PEM.finditer(text) if is_pem_body(m[2])] if "-----BEGIN " in text else []
    found += [("pem", *span) for span in blocks]
    if b"x" * 40 in raw.translate(_LONG_RUN):
        runs = {m.span(): bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else None for m in ANY_HEX.finditer(text)}
        runs |= {m.span(): unbase64(m[0]) for m in BASE64.finditer(text) if m.span() not in runs}
        found += [("key", *span) for span, data in sorted(runs.items()) if is_key(data) and not any(a <= span[0] and span[1] <= b for a, b in blocks)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.decode("utf-8", "surrogatepass"))] for _, t in rows_per_task([batch], ("doc_id", "text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "secrets"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the secrets (kind, start, end in code points) of every row."""
    return texts(docs).mapInArrow(_spans, "doc_id bigint, secrets array<struct<kind string, start bigint, end bigint>>")


def _joined(secrets):
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(*kinds: str):
    return F.filter("secrets", lambda s: s["kind"].isin(*kinds))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    counts = [F.size(_of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = _of_kinds(*BASE)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
