"""Secrets: patterns propose candidates, decoding and parsing confirm what else is one.

Base kinds (assign, access, hex) are exactly those of the published contract. The method adds, after
structural confirmation only:

- ``jwt``: three base64url parts whose first decodes to a JSON object with an ``alg`` string, whose second
  decodes to a JSON object, and whose third decodes (is empty, where alg is none);
- ``pem``: a PRIVATE KEY block whose body decodes to the DER of a key, parsed down to its last element, or to an
  OpenSSH key, or that has the headers of an encrypted one and decodes to whole blocks of a cipher; as it is or
  escaped in a string literal;
- ``key``: bare base64, or hex of whole bytes, that decodes to the DER of a private key, or to an OpenSSH
  private key.

Defined results: a null text is an empty one; it has no spans. Texts are searched whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.shared import id_type, sealed
from foliospark.ship import ship

#: In the order in which kinds are listed where spans start together.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run has as many characters as the contract asks for or is dropped, so shorter ones need not match.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
#: The body, which may have headers with dashes, ends at the next boundary of a block, so each part is read once.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+)-----END \1-----")
_ESCAPE = re.compile(r"(?<!\\)\\++(?:u([0-9A-Fa-f]{4})|[nrt]|(?=[/\r\n]))")
_HEADER = re.compile(r"^[A-Za-z-]+: .*$", re.M)
#: DER sequences and OpenSSH keys start with these characters in base64.
_START64 = r"(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{38,}={0,2}"
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])" + _START64)
#: After the letter of an escaped line end.
_ESCAPED64 = re.compile(r"(?<=\\[nrt])" + _START64)
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9a-fA-F]{2}){30,}(?![0-9a-fA-F])")
_SSH = b"openssh-key-v1\0"


def decode64(text: str) -> bytes | None:
    """base64 or base64url, with or without padding and white space; None if it is neither."""
    plain = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unescaped(text: str) -> str:
    """text as it was before it became part of a string literal (JSON and the like): line ends, slashes, code points."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n" if m[0][-1] in "nrt" else "", text) if "\\" in text else text


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at at, if it lies within data and its length is in least form."""
    if at + 2 > len(data):
        return None
    tag, first = data[at], data[at + 1]
    start, length = at + 2, first
    if first & 0x80:
        n = first & 0x7F
        if not 1 <= n <= 4 or start + n > len(data):
            return None
        length = int.from_bytes(data[start : start + n], "big")
        start += n
        if length < 128:
            return None
    return (tag, start, start + length) if start + length <= len(data) else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data from at to end; None if they don't."""
    found = []
    while at < end:
        element = _header(data, at)
        if not element or element[2] > end:
            return None
        found.append(element)
        at = element[2]
    return found


def is_der(data: bytes, start: int, end: int) -> bool:
    """Whether elements fill the range, and so on within each that is made of others; plain ones hold what their tag allows."""
    todo = [(start, end)]
    while todo:
        found = _elements(data, *todo.pop())
        if not found:
            return False
        for tag, a, b in found:
            if tag & 0x20:
                if a < b:
                    todo.append((a, b))
            elif tag == 0x02 and (a == b or (b - a > 1 and data[a] in (0, 0xFF) and data[a] >> 7 == data[a + 1] >> 7)):
                return False
            elif (tag == 0x05 and a != b) or (tag == 0x06 and (a == b or data[b - 1] & 0x80)) or (tag == 0x03 and (a == b or data[a] > 7)):
                return False
    return True


#: Object identifiers, DER-encoded: fixed values of PKCS #1, #5 and #12, X9.62 and RFC 8410.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _is_inner_key(kind: bytes, data: bytes) -> bool:
    """The octets of a PKCS#8 key of this kind, parsed in their turn."""
    outer = _header(data, 0)
    if not outer or outer[2] != len(data):
        return False
    if kind in _CURVES:
        return outer[0] == 0x04 and outer[2] - outer[1] == _CURVES[kind]
    if not is_der(data, 0, len(data)):
        return False
    if kind in (_RSA, _EC):
        tags = [tag for tag, _, _ in _elements(data, outer[1], outer[2]) or ()] if outer[0] == 0x30 else []
        return tags[:9] == [0x02] * 9 if kind == _RSA else tags[:2] == [0x02, 0x04]
    return True


def is_private_der(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA: one sequence over all bytes, parsed down to its last element."""
    outer = _header(data, 0)
    if not outer or outer[0] != 0x30 or outer[2] != len(data) or not is_der(data, 0, len(data)):
        return False
    found = _elements(data, outer[1], outer[2]) or []
    tags, part = [tag for tag, _, _ in found], [data[a:b] for _, a, b in found]

    def identifier(at: int) -> bytes | None:
        first = _header(data, found[at][1]) if found[at][1] < found[at][2] else None
        return data[first[1] : first[2]] if first and first[0] == 0x06 else None

    if tags[:1] == [0x02] and part[0] in (b"\0", b"\1"):
        if tags[1:3] == [0x30, 0x04]:
            kind = identifier(1)
            return kind is not None and _is_inner_key(kind, part[2])
        return (tags[1:2] == [0x04] and part[0] == b"\1") or tags[:9] == [0x02] * 9 or tags == [0x02] * 6
    # An encrypted key: the identifier of a cipher by password, then octets. (A signed digest has the same shape, but a hash's.)
    return tags == [0x30, 0x04] and len(part[1]) > 0 and (identifier(0) or b"").startswith(_ENCRYPTION)


def _fields(data: bytes, at: int, most: int) -> tuple[list[bytes], int] | None:
    """Up to ``most`` fields with four bytes of length before each, and where they end."""
    out = []
    while at < len(data) and len(out) < most:
        start = at + 4
        at = start + int.from_bytes(data[at:start], "big")
        if start > len(data) or at > len(data):
            return None
        out.append(data[start:at])
    return out, at


#: Ciphers that append a tag of 16 bytes.
_TAGGED = (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com")


def is_openssh(data: bytes) -> bool:
    """Cipher, derivation and options; the number of keys; as many public keys, of fields themselves; the private part to the last byte."""
    if not data.startswith(_SSH):
        return False
    head = _fields(data, len(_SSH), 3)
    if not head or len(head[0]) < 3:
        return False
    (cipher, _, _), at = head
    n = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= n <= len(data):
        return False
    keys = _fields(data, at + 4, n + 1)
    if not keys or len(keys[0]) <= n or len(data) - keys[1] != (16 if cipher in _TAGGED else 0):
        return False
    private = keys[0][n]
    if cipher == b"none" and (len(private) < 8 or private[:4] != private[4:8]):
        return False
    public = (_fields(key, 0, len(key)) for key in keys[0][:n])
    return all(found and found[0] and found[0][0] for found in public)


def _object(text: str) -> dict | None:
    data = decode64(text)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all spans of a text, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head = _object(m[1])
            signed = bool(m[3]) and decode64(m[3]) is not None
            if head and isinstance(head.get("alg"), str) and signed == (head["alg"].lower() != "none") and _object(m[2]) is not None:
                found.append((m.start(), 3, m.end()))
    blocks = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            inner = unescaped(m[2])
            body = decode64(_HEADER.sub("", inner))
            encrypted = "Proc-Type: 4,ENCRYPTED" in inner and "DEK-Info: " in inner and body and len(body) % 8 == 0
            if body and (is_private_der(body) or is_openssh(body) or encrypted):
                blocks.append((m.start(), 4, m.end()))
    found += blocks
    starts = [a for a, _, _ in blocks]
    inside = lambda at: bool(n := bisect.bisect_right(starts, at)) and at < blocks[n - 1][2]
    for m in itertools.chain(_BASE64.finditer(text), _ESCAPED64.finditer(text) if "\\" in text else ()):
        data = decode64(m[0])
        if data and (is_private_der(data) or is_openssh(data)) and not inside(m.start()):
            found.append((m.start(), 5, m.end()))
    for m in _HEX_KEY.finditer(text):
        if is_private_der(bytes.fromhex(m[0])):
            found.append((m.start(), 5, m.end()))
    return sorted(found)


_SCHEMA = "array<struct<kind:string,start:int,end:int,text:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for scalar in batch.column("text"):
            text = scalar.as_py() or ""
            out.append([{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b]} for a, k, b in spans(text)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _TYPE)], names=["doc_id", "secrets"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets: array<struct<kind, start, end, text>>) of docs (doc_id, text); code points, end exclusive."""
    ship(docs.sparkSession)
    docs, _ = sealed(docs, ("doc_id", "text"))
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {id_type(docs)}, secrets {_SCHEMA}")
