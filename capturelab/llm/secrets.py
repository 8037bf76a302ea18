"""Secret scan: pattern matches, and structures that decode.

Base kinds are patterns: `assign` (a secret's name with a value), `access` (access key
ids) and `hex` (long runs of hex digits). The added kinds are reported only if their
bytes have the structure of a secret: `jwt` (a signed token: base64url header with an
algorithm, JSON claims, a signature unless the algorithm is none) and `key` (a private
key: PEM, base64 or hex, on one line or wrapped, whose DER lengths nest without a byte to
spare and whose fields are those of PKCS#1, PKCS#8 or SEC1; the OpenSSH container, whose
strings, keys and padding are followed to the last byte; or an encrypted PEM whose
initial vector and ciphertext fit the cipher's blocks).

Null text is empty text; an empty text has no spans. Repeated rows are each given their
spans, which depend on the text alone. Every pattern is linear in the text's length. Where
base and added spans, or two added ones, cover the same text, all are reported, ordered by
start, then kind. A key on one line has 40 characters of base64 or 60 of hex at least, which is less than any of the structures takes; DER nests
12 levels at most, keys some 5. A wrapped key may begin at any line of a run of lines of one width, and ends where its lengths say.
Columns besides doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .spans import Cover, digest_batches

BASE, KINDS = ("assign", "access", "hex"), ("assign", "access", "hex", "jwt", "key")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_BORDER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_PEM_HEADER, _DEK = re.compile(r"[ \t]*[A-Za-z0-9-]+:[^\n]*\n"), re.compile(r"DEK-Info:[ \t]*([A-Z0-9-]+),[ \t]*([0-9A-Fa-f]+)")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
#: A further line of wrapped base64 or hex.
_WRAPPED = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]++={0,2})(?![^\s\"'])")
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{60,}(?![0-9A-Za-z])")

_HEX_LINE = re.compile(r"[0-9A-Fa-f]{40,}+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, low = [], text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """The (tag, content) fields of a run of DER values; None if a length does not fit. Constructed values have a list as content."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        body: object = data[at : at + size]
        if tag & 0x20 and (body := der(data[at : at + size], depth + 1)) is None:
            return None
        out.append((tag, body))
        at += size
    return out


def _string(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed string at `at` and its end; None if it does not fit."""
    if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
        return None
    return data[at + 4 : at + 4 + n], at + 4 + n


def _strings(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Strings from `at` to the data's end, or `most` of them, and where they end."""
    out = []
    while at < len(data) if most is None else len(out) < most:
        if (got := _string(data, at)) is None:
            return None
        out.append(got[0])
        at = got[1]
    return out, at


def openssh(data: bytes) -> bool:
    """The OpenSSH container: cipher, kdf, public keys and the private part, with nothing left over."""
    if (head := _strings(data, 15, 3)) is None or head[1] + 4 > len(data):
        return False
    (cipher, kdf, options), at = head
    n = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= n <= 64 or (body := _strings(data, at + 4, n + 1)) is None or body[1] != len(data):
        return False
    *public, private = body[0]
    kinds = []
    for key in public:
        if (fields := _strings(key)) is None or len(fields[0]) < 2 or not re.fullmatch(rb"[a-z0-9@.-]{4,64}", fields[0][0]):
            return False
        kinds.append(fields[0][0])
    if cipher != b"none":
        return kdf != b"none" and bool(options) and len(private) >= 16 and len(private) % 8 == 0
    if options or len(private) < 8 or private[:4] != private[4:8]:
        return False
    at, found = 8, []
    while (rest := len(private) - at) >= 16 or private[at:] != bytes(range(1, rest + 1)):  # what is left at last is 1, 2, 3, ...
        if (got := _string(private, at)) is None:
            return False
        found.append(got[0])
        at = got[1]
    return all(k in found for k in kinds) and len(found) >= 3 * n


def pem_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what lies between) for every begin line of a private key with the next border its end line."""
    out, begun = [], None
    for m in _BORDER.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2]:
            out.append((begun[0], m.end(), text[begun[1] : m.start()]))
        begun = (m.start(), m.end(), m[2]) if m[1] == "BEGIN" else None
    return out


def pem_key(body: str) -> str | None:
    """The encoding's name if what lies between PEM's borders is a private key."""
    body, at = body.replace("\\r", "").replace("\\n", "\n").lstrip(), 0
    while m := _PEM_HEADER.match(body, at):
        at = m.end()
    data = unbase64(re.sub(r"\s", "", body[at:]))
    if m := _DEK.search(body[:at]):
        block = len(m[2]) // 2
        return "encrypted pem" if data and block in (8, 16) and len(m[2]) % 2 == 0 and len(data) % block == 0 else None
    return private_key(data)


def private_key(data: bytes | None) -> str | None:
    """The encoding's name if the bytes are a private key."""
    if not data:
        return None
    if b"PRIVATE KEY-----" in data:
        return next((found for _, _, body in pem_blocks(data.decode("latin-1")) if "-----" not in body and (found := pem_key(body))), None)
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if openssh(data) else None
    if data[0] != 0x30 or not (top := der(data)) or len(top) != 1:
        return None
    fields = top[0][1]
    tags = [t for t, _ in fields]
    if tags[:2] == [2, 4] and fields[0][1] == b"\1" and len(fields[1][1]) >= 16:
        return "sec1"
    if tags[:3] == [2, 0x30, 4] and fields[0][1] in (b"\0", b"\1") and fields[1][1] and fields[1][1][0][0] == 6:
        return "pkcs8"
    if len(tags) >= 9 and set(tags[:9]) == {2} and len(fields[0][1]) == 1:
        return "pkcs1"
    if tags == [0x30, 4] and fields[0][1] and fields[0][1][0][0] == 6 and len(fields[1][1]) >= 32:
        return "encrypted pkcs8"
    return None


def signed_token(header: str, claims: str, signature: str) -> bool:
    try:
        head, body = json.loads(unbase64(header) or b""), json.loads(unbase64(claims) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" or bool(unbase64(signature))


def _decoded(text: str) -> str | None:
    """The encoding's name if base64 or hex text is a private key."""
    if len(text) % 2 == 0 and _HEX_KEY.fullmatch(text) and (found := private_key(bytes.fromhex(text))):
        return found
    return private_key(unbase64(text))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("jwt", m.start(1), m.end(3)) for m in _JWT.finditer(text) if signed_token(m[1], m[2], m[3])]
    pem = [("key", s, e) for s, e, body in pem_blocks(text) if pem_key(body)] if "PRIVATE KEY-----" in text else []
    out, known, reach, runs = out + pem, Cover(pem), 0, []
    out += [("key", *m.span()) for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and not known.meets(*m.span()) and private_key(bytes.fromhex(m[0]))]
    hexes = set(out)
    for m in _B64.finditer(text):
        if known.meets(*m.span()):
            continue
        # lines as long as the first, and a shorter one at the end, are a run; a key may begin at any of its lines
        if m.start() >= reach:
            lines = [m.span()]
            while lines[-1][1] - lines[-1][0] == len(m[0]) and (more := _WRAPPED.match(text, lines[-1][1])) and len(more[1]) <= len(m[0]):
                lines.append(more.span(1))
            reach = max(e for s, e in lines if e - s == len(m[0]))
            for first, last in wrapped_keys(text, lines):
                out.append(("key", lines[first][0], lines[last][1]))
                runs.append(out[-1])
        if (i := bisect_right(runs, m.start(), key=lambda r: r[1])) and runs[i - 1][2] > m.start():
            continue
        if ("key", *m.span()) not in hexes and private_key(unbase64(m[0])):
            out.append(("key", *m.span()))
    return out


def _reach(head: bytes) -> int | None:
    """How many bytes the key takes whose first bytes these are: a DER sequence that opens with a small integer or a sequence; 0 if only what follows can tell; None if no key begins like that."""
    if head.startswith((b"openssh-key-v1\0", b"-----BEGIN ")):
        return 0
    if len(head) < 12 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    size, inner = (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]), head[2 + n : 5 + n]
    if not (inner[:1] == b"\x30" or (inner[:2] == b"\2\1" and inner[2] <= 3)):
        return None
    return 2 + n + size


def wrapped_keys(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) of the lines of a run that together are a key, from the top. A line is joined with others only if a key can begin with it, and with as many as its length asks for."""
    out, k, width = [], 0, lines[0][1] - lines[0][0]
    whole = lambda i, j: "".join(text[s:e] for s, e in lines[i : j + 1])
    while k + 1 < len(lines):
        line, last = text[slice(*lines[k])], None
        if k == 0 and _decoded(whole(0, len(lines) - 1)):
            last = len(lines) - 1
        starts = [(2, bytes.fromhex(line[:40]))] if _HEX_LINE.fullmatch(line) else []
        starts.append((4 / 3, unbase64(line[:40]) or b""))
        for each, head in starts:
            size = _reach(head) if last is None else None
            if size is None:
                continue
            # in whole lines, of which only the last may be shorter
            end = min(len(lines), k - (-math.ceil(size * each) // width)) - 1 if size else len(lines) - 1
            if end > k and _decoded(whole(k, end)):
                last = end
            elif not size and (n := _container(unbase64(whole(k, len(lines) - 1)))) and (end := k - (-math.ceil(n * each) // width) - 1) > k and _decoded(whole(k, end)):
                last = end
        if last is not None:
            out.append((k, last))
            k = last
        k += 1
    return out


def _container(data: bytes | None) -> int | None:
    """The bytes that an OpenSSH container at the beginning of data takes."""
    if not data or (head := _strings(data, 15, 3)) is None or not 1 <= (n := int.from_bytes(data[head[1] : head[1] + 4], "big")) <= 64:
        return None
    body = _strings(data, head[1] + 4, n + 1)
    return body and body[1]


def find(texts: list[str]):
    return [(base_spans(t), confirmed_spans(t)) for t in texts]


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each kind, the hash of base spans and all spans, for every row of docs (doc_id, text)."""
    run, schema = digest_batches(find, BASE, KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))
