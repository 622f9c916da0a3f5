"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, long hex) are reported as they match. Further candidates, which are long runs of
base64 or hex characters, PEM blocks and dotted token triples, are reported only where decoding confirms a structure: a
signed token's JSON header, the nested lengths of a private key's DER fields (PKCS#1, PKCS#8, SEC1, DSA), or the
length-prefixed fields of a private key container. Public keys and certificates have such structures too and are no secrets.

Defined cases: null text counts as empty and has no spans; rows are judged one by one, so repeated rows each report; of the
input only the named columns are read, so extra or clashing columns do not matter; an empty table gives an empty result.
Offsets are code points, the end exclusive. A candidate may begin after any separator inside a run, as behind a path or a
name, and ends where its own outermost length says; base64 may be wrapped over lines. Work is linear in the text but for the decoding of candidates, each of which is
decoded once.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame

from .common import arrow_map

#: Kinds in the order of reports: the base ones, then those that the structural check adds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
_WORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{32,}")
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_CONTAINER = b"openssh-key-v1\0"
#: Where a token can begin; where base64 of a DER sequence (0x30 and the first length byte) or of a key container can.
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?=(ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*={0,2}))")
_START = re.compile(r"(?<![A-Za-z0-9+])(?=M[A-I][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/]+={0,2}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*[A-Za-z0-9-]{1,40}: [^\n]{0,200}\n)*)([A-Za-z0-9+/=\s]+?)-----END \1-----")
_HEX_DER = re.compile(r"(?<![0-9a-fA-F])30[0-9a-fA-F]{30,}(?![0-9a-fA-F])")


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and where the content starts of the DER element whose length bytes begin at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill ``data`` exactly; None if they do not."""
    at, out = 0, []
    while at < len(data):
        inner = _length(data, at + 1)
        if not inner or inner[0] > len(data) - inner[1]:
            return None
        out.append((data[at], data[inner[1] : inner[1] + inner[0]]))
        at = inner[1] + inner[0]
    return out


def der_size(data: bytes) -> int:
    """Bytes of the DER sequence that begins ``data``, by its own length; 0 if none does."""
    found = _length(data, 1) if data[:1] == b"\x30" else None
    return found[0] + found[1] if found and found[1] < len(data) and data[found[1]] in (0x02, 0x30) else 0


def der_structure(data: bytes) -> bool:
    """A private key: a SEQUENCE that fills ``data`` and holds, field by field, what one of the key forms asks for."""
    if len(data) < 16 or der_size(data) != len(data):
        return False
    fields = _elements(data[_length(data, 1)[1] :])
    if not fields:
        return False
    tags, number = [t for t, _ in fields], fields[0][1] if fields[0][0] == 0x02 else None
    if tags[:9] == [0x02] * 9 and len(tags) <= 10 and number in (b"\0", b"\1"):  # version, n, e, d, p, q and the rest
        return len(fields[1][1]) >= 32 and all(c for _, c in fields)
    if tags == [0x02] * 6 and number == b"\0":  # version, p, q, g, public and private number
        return len(fields[1][1]) >= 64
    if tags[:2] == [0x02, 0x04] and number == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}:  # an elliptic curve's private number
        return 16 <= len(fields[1][1]) <= 72 and all(_elements(c) for _, c in fields[2:])
    if tags[:3] == [0x02, 0x30, 0x04] and number in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:  # algorithm and key
        inner = _elements(fields[1][1])
        return bool(inner) and inner[0][0] == 0x06 and len(fields[2][1]) >= 16
    if tags == [0x30, 0x04]:  # an encrypted key: algorithm with parameters, and octets
        inner = _elements(fields[0][1])
        return bool(inner) and len(inner) == 2 and inner[0][0] == 0x06 and inner[1][0] == 0x30 and bool(_elements(inner[1][1])) and len(fields[1][1]) >= 32
    return False


def _string(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A field of a four-byte length and where the next begins."""
    n = int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 <= len(data) and n <= len(data) - at - 4 else None


def ssh_size(data: bytes) -> int:
    """Bytes of the private key container that begins ``data``: cipher, kdf, options, public keys and private part; else 0."""
    if not data.startswith(_CONTAINER):
        return 0
    at, fields = len(_CONTAINER), []
    for _ in range(3):
        found = _string(data, at)
        if not found:
            return 0
        fields.append(found[0])
        at = found[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not fields[0] or not fields[1]:
        return 0
    for _ in range(keys):
        found = _string(data, at)
        name = _string(found[0], 0) if found else None
        if not name or name[0] not in _SSH:
            return 0
        at = found[1]
    found = _string(data, at)
    return found[1] if found and len(found[0]) >= 32 and len(found[0]) % 8 == 0 else 0


def ssh_structure(data: bytes) -> bool:
    """A private key container that fills ``data``."""
    return bool(data) and ssh_size(data) == len(data)


def _decode(s: str) -> bytes | None:
    s = s.rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if "-" in s or "_" in s else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(s: str) -> bool:
    """Three dotted base64url parts of which the first decodes to a JSON object that names an algorithm."""
    parts = s.split(".")
    if len(parts) != 3 or not parts[0].startswith("ey") or not parts[1]:
        return False
    try:
        header, body = (json.loads(_decode(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def structure(s: str) -> tuple[str, int] | None:
    """The kind that decoding confirms for a key at the start of base64 ``s``, and the characters that it takes."""
    run = _BASE64.match(s)
    body = run.group().rstrip("=") if run else ""
    head = _decode(body[:16])
    if not head:
        return None
    if head[0] == 0x30:
        size = der_size(head)
    else:
        data = _decode(body) or _decode(body[: len(body) // 4 * 4])
        size = ssh_size(data) if data else 0
    need = -(-size * 4 // 3)
    if not size or need > len(body):
        return None
    data = _decode(body[:need])
    if not data or len(data) != size or not (der_structure(data) if head[0] == 0x30 else ssh_structure(data)):
        return None
    padded = need + (len(run.group()) - len(body) if need == len(body) else 0)
    return "der" if head[0] == 0x30 else "ssh", padded


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(2, m.start(), m.end()) for m in _HEX.finditer(text)]


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that only the structural check reports, trimmed to the confirmed string; none lies inside another."""
    spans: list[tuple[int, int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _decode("".join(m.group(3).split()))
            # the older form encrypts the body as a whole and says so in a header
            sealed = "ENCRYPTED" in m.group(2) and "PRIVATE KEY" in m.group(1) and data and len(data) >= 64 and len(data) % 8 == 0
            if data and (sealed or der_structure(data) or ssh_structure(data)):
                spans.append((KINDS.index("pem"), m.start(), m.end()))
    free = lambda lo, hi: all(hi <= s or lo >= e for _, s, e in spans)
    for m in _LONG.finditer(text):
        run, end = m.group(), 0
        if run.count(".") >= 2 and "ey" in run:
            for t in _TOKEN.finditer(run):
                lo, hi = m.start() + t.start(), m.start() + t.start() + len(t[1].rstrip("."))
                if lo >= end and len(t[1]) >= 32 and signed_token(t[1]):
                    end = hi
                    spans.append((KINDS.index("jwt"), lo, hi))
        for t in _START.finditer(run):
            if m.start() + t.start() >= end and (found := structure(run[t.start() :])):
                lo, end = m.start() + t.start(), m.start() + t.start() + found[1]
                if free(lo, end):
                    spans.append((KINDS.index(found[0]), lo, end))
        if "30" in run:
            for t in _HEX_DER.finditer(run):
                if len(t.group()) % 2 == 0 and der_structure(bytes.fromhex(t.group())):
                    spans.append((KINDS.index("der"), m.start() + t.start(), m.start() + t.end()))
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        if (m.group()[0] == "M" or m.group().startswith("b3BlbnNzaC1")) and free(m.start(), m.end()):
            found = structure("".join(m.group().split()))
            if found:
                at = [k for k, c in enumerate(m.group()) if not c.isspace()]
                spans.append((KINDS.index(found[0]), m.start(), m.start() + at[found[1] - 1] + 1))
    return spans


def report(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _scan(row: tuple) -> list[tuple]:
    key, text = row
    text = text or ""
    base = base_spans(text)
    every = base + added_spans(text)
    counts = [sum(1 for s in base if s[0] == k) for k in range(3)]
    confirmed = [(KINDS[k], s, e, text[s:e]) for k, s, e in sorted(set(every) - set(base), key=lambda x: (x[1], x[0]))]
    return [(key, *counts, report(base), report(every), [dict(zip(("kind", "start", "end", "value"), c)) for c in confirmed])]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base (spans), spans (all), confirmed (kind, start, end, value)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base string, spans string, confirmed array<struct<kind:string,start:long,end:long,value:string>>"
    return arrow_map(docs.select(key, text), _scan, schema)

