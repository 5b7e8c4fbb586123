"""Secret scans with structural confirmation.

Patterns give the base spans. Base64 and hexadecimal runs, armoured keys and dotted tokens are candidates besides; one is reported only if it
decodes and what it decodes to has the structure of a key: nested DER lengths that fill their parents exactly around the elements of a
private key, the fields of an SSH key to its end, a token's JSON header and payload, or the parameters of an encrypted key. A base64 run
may be broken over lines: the lengths that it begins with say how much of it belongs to the key. Public keys and certificates have a kind of
their own.
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

from .frames import pick
from .scratch import small_batches

#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh", "public")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z0-9-]+:[^\n]*\n)*)([A-Za-z0-9+/=\s]*?)-----END \1-----")
#: Bytes of a block of the ciphers that encrypted armour names.
_CIPHERS = {"DES": 8, "AES": 16, "CAMELLIA": 16, "ARIA": 16, "SEED": 16, "SM4": 16, "BF": 8, "RC2": 8, "IDEA": 8, "CAST5": 8}
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
_B64_LINES = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
#: The beginning of a DER sequence, of an SSH private key or of the length of an SSH key type.
_B64_BEGINS = re.compile(r"(?<![A-Za-z0-9+/_-])(?=M[A-P]|b3BlbnNzaC1rZXktdjEA|AAAA)[A-Za-z0-9+/_-]{20}")
#: Characters of base64 that a key has at least.
_LEAST = 40
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding."""
    s = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_tags(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of the DER elements that fill ``data`` exactly, those inside constructed ones included; None where it is no such thing."""
    at, tags = 0, []
    while at < len(data):
        if len(data) - at < 2 or depth > 16:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > len(data):
            return None
        tags.append(tag)
        if tag & 0x20:
            inner = der_tags(data[at : at + size], depth + 1)
            if inner is None:
                return None
            tags += inner
        at += size
    return tags


def children(data: bytes) -> list[tuple[int, bytes]]:
    """Tag and contents of each DER element of ``data``, whose structure ``der_tags`` has confirmed."""
    out, at = [], 0
    while at < len(data):
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_kind(data: bytes | None) -> str | None:
    """'der' for a private key: one SEQUENCE over all of ``data`` of a small version number and key elements, or of an encryption and what it
    hides; 'public' for a public key or a certificate; else None."""
    if not data or len(data) < 16 or data[0] != 0x30:
        return None
    tags = der_tags(data)
    if tags is None:
        return None
    outer = children(data)
    if len(outer) != 1:
        return None
    inner = children(outer[0][1])
    shape, first = [t for t, _ in inner], inner[0][1] if inner else b""
    algorithm = lambda v: bool(v) and v[0] == 0x06
    if len(shape) >= 2 and shape[0] == 0x02 and len(first) == 1 and first[0] <= 3:
        parts = {0x02, 0x04, 0x30, 0xA0, 0xA1}
        # further integers or octets, or an algorithm and octets, or the contents of a container
        if len(shape) >= 3 and set(shape) <= parts or shape[1] == 0x04 or (shape[1] == 0x30 and algorithm(inner[1][1])):
            return "der"
    if shape == [0x30, 0x04] and algorithm(first):
        return "der"
    if shape == [0x30, 0x03] and algorithm(first) or shape == [0x30, 0x30, 0x03] and algorithm(inner[1][1]) or shape == [0x02, 0x02]:
        return "public"
    return None


def is_encrypted_key(headers: str, body: bytes | None) -> bool:
    """Headers that name a cipher and its first block, and a body of whole blocks."""
    found = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in headers.splitlines())}
    name, _, first = found.get("dek-info", "").partition(",")
    block = _CIPHERS.get(name.strip().upper().partition("-")[0])
    if "ENCRYPTED" not in found.get("proc-type", "") or block is None or not body or len(body) % block:
        return False
    return re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", first.strip()) is not None and len(first.strip()) // 2 == block


_MAGIC = b"openssh-key-v1\0"


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A length-prefixed field and where it ends."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if at + 4 <= len(data) and end <= len(data) else None


def _key_type(name: bytes) -> bool:
    return re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", name) is not None


def ssh_kind(data: bytes | None) -> tuple[str, int] | None:
    """'ssh' for a private key, 'public' for a public one, and how many bytes of ``data`` it has; None where it is neither.

    A private key has the names of a cipher and a key derivation, its options, a number of keys, as many public keys and the private part,
    whose length is that of whole blocks; not encrypted it begins with one number twice and a key type.
    """
    if not data:
        return None
    if data.startswith(_MAGIC):
        at, fields = len(_MAGIC), []
        for _ in range(3):
            found = _field(data, at)
            if found is None:
                return None
            fields.append(found[0])
            at = found[1]
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= n <= 64 or not all(re.fullmatch(rb"[a-z0-9@.-]+", f) for f in fields[:2]) or (fields[0] == b"none") != (fields[1] == b"none"):
            return None
        for _ in range(n):
            found = _field(data, at)
            if found is None or (ssh_kind(found[0]) or ("", 0)) != ("public", len(found[0])):
                return None
            at = found[1]
        found = _field(data, at)
        if found is None or not found[0] or len(found[0]) % 8:
            return None
        body = found[0]
        if fields[0] == b"none":
            name = _field(body, 8)
            if body[:4] != body[4:8] or name is None or not _key_type(name[0]):
                return None
        return "ssh", found[1]
    first = _field(data, 0)
    if first is None or not _key_type(first[0]):
        return None
    at, n = first[1], 0
    while (found := _field(data, at)) is not None and found[0]:
        at, n = found[1], n + 1
    return ("public", at) if n and at == len(data) else None


def _json(part: str) -> dict | None:
    try:
        found = json.loads(unbase64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    """A header that is a JSON object naming an algorithm, a payload that is one, and a signature unless the algorithm is none."""
    head = _json(header)
    if head is None or not isinstance(head.get("alg"), str) or _json(payload) is None:
        return False
    return bool(unbase64(signature)) if head["alg"].lower() != "none" else unbase64(signature) is not None


def tokens(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        while i + 2 < len(parts):
            if len(parts[i]) >= 8 and len(parts[i + 1]) >= 2 and is_token(*parts[i : i + 3]):
                yield starts[i], starts[i + 2] + len(parts[i + 2]), "jwt"
                i += 2
            i += 1


def encoded_key(run: str) -> tuple[int, str] | None:
    """Of base64 that may be broken over lines: how many characters of it are a key, and its kind.

    A DER sequence says its own length. The key ends where its line does, or the run.
    """
    places = [i for i, c in enumerate(run) if c not in " \t\r\n="]
    chars = "".join(run[i] for i in places)
    data = unbase64(chars[: len(chars) - (len(chars) % 4 == 1)])
    if data is None:
        return None
    if data[:1] == b"\x30" and len(data) > 6:
        more = data[1] & 0x7F if data[1] & 0x80 else 0
        size = 2 + more + (int.from_bytes(data[2 : 2 + more], "big") if more else data[1])
        kind = der_kind(data[:size]) if more <= 4 and size <= len(data) else None
    else:
        # lines that follow need not belong to it
        kind, size = ssh_kind(data) or (None, 0)
        if kind is None:
            first = re.match(r"[^\s=]+", run)[0]
            data = unbase64(first) or b""
            kind, size = ssh_kind(data) or (None, 0)
    n = -(-size * 4 // 3)
    if kind is None or n < _LEAST:
        return None
    end = places[n - 1] + 1
    if end < len(run) and run[end] not in "=\r\n":
        return None
    while end < len(run) and run[end] == "=":
        end += 1
    return end, kind


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of these digits ends where the next one cannot begin, so that long ones can be sought directly
    out += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            body = unbase64(m[3])
            if der_kind(body) == "der" or (ssh_kind(body) or ("", 0)) == ("ssh", len(body)) or is_encrypted_key(m[2], body):
                out.append((m.start(), m.end(), "pem"))
    out += tokens(text)
    after = 0
    for m in _B64_BEGINS.finditer(text):
        if m.start() >= after and (found := encoded_key(_B64_LINES.match(text, m.start())[0])):
            after = m.start() + found[0]
            out.append((m.start(), after, found[1]))
    for m in _ANY_HEX.finditer(text):
        data = bytes.fromhex(m[0])
        whole = ssh_kind(data)
        kind = der_kind(data) or (whole[0] if whole and whole[1] == len(data) else None)
        if kind:
            out.append((m.start(), m.end(), kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are in code points, end exclusive, as kind:start:end, ordered by start and then by kind as listed in ``KINDS``. A null text
    is empty; an empty text has no spans. Repeated rows are scanned one by one; other columns are not read. An empty table gives no
    rows. No shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                n = [sum(k == x for _, _, k in base) for x in KINDS[:3]]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(text))))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, _SCHEMA)
