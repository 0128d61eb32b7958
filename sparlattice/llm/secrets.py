"""Operator 8: secret scans with structural confirmation.

Three fixed patterns give the base spans. Further candidates, base64 or hex
runs, armoured blocks and dotted tokens, are decoded and reported only if what
they decode to has the structure of a private key or a signed token. Public keys
and certificates are no secrets.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
MASK = "[SECRET]"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest runs, so that shorter ones needn't be found first to be dropped.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,60})-----")
#: What lies between armour lines; line ends may be written as escapes.
ARMOURED = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\[nr])*+")
#: Runs of the characters of signed tokens; their parts lie between dots.
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
HEADER_CHARS, PAYLOAD_CHARS = 8, 2
#: Runs of base64 characters of either alphabet, over line ends where lines are long; a key may begin and end within one.
RUN = re.compile(r"[A-Za-z0-9+/_-]{22,}+(?:(?<=[A-Za-z0-9+/_-]{40})(?:\r?\n[ \t]*|\\r?\\?n)[A-Za-z0-9+/_-]++)*+")
BREAK = re.compile(r"\r?\n[ \t]*|\\r\\n|\\n")
STANDARD = str.maketrans("-_", "+/")
#: How base64 of a SEQUENCE, with a length in one, two or three bytes, or of "openssh-key-v1" begins.
KEY_START = re.compile(r"M(?=[A-H]|I[E-L])|b(?=3BlbnNzaC1rZXktdjE)")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{32,}")
HEX_START = re.compile(r"3(?=0[0-7][0-9A-Fa-f]|081|082)|6(?=f70656e7373682d6b65792d7631)", re.IGNORECASE)
#: Object identifiers under which private keys are encrypted: PKCS 5 and PKCS 12. Fixed values.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"


def unpadded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(where the value starts, its length) of the element whose tag is at ``at``."""
    if at + 2 > len(data):
        return None
    n = data[at + 1]
    if n < 128:
        return at + 2, n
    size = n & 127
    if not 1 <= size <= 4 or at + 2 + size > len(data):
        return None
    n = int.from_bytes(data[at + 2 : at + 2 + size], "big")
    return (at + 2 + size, n) if n >= 128 else None


INTEGER, OCTETS, IDENTIFIER, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start of the value, its end) of the elements that fill ``data`` from ``at`` to ``end``."""
    out = []
    while at < end:
        inner = der_length(data, at)
        if inner is None or sum(inner) > end:
            return None
        out.append((data[at], inner[0], sum(inner)))
        at = sum(inner)
    return out


def is_private(data: bytes) -> bool:
    """One SEQUENCE that fills ``data`` and is a private key by its parts.

    A version (INTEGER of one byte) with eight or more INTEGERs (RSA) or five (DSA)
    behind it; version 1 and an OCTET STRING (EC); a version, an
    algorithm and an OCTET STRING (PKCS 8); an algorithm of encryption and an OCTET
    STRING (PKCS 8, encrypted). Public keys begin with a modulus or hold a BIT STRING; certificates
    hold neither.
    """
    if len(data) < 16 or data[0] != SEQUENCE or (outer := der_length(data, 0)) is None or sum(outer) != len(data):
        return False
    parts = elements(data, outer[0], len(data))
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]

    def algorithm(part: tuple[int, int, int]) -> bytes | None:
        inside = elements(data, part[1], part[2]) if part[0] == SEQUENCE else None
        return data[inside[0][1] : inside[0][2]] if inside and inside[0][0] == IDENTIFIER else None

    _, low, high = parts[0]
    if tags[0] == INTEGER and high - low == 1 and data[low] <= 2:
        integers = next((i for i, t in enumerate(tags) if t != INTEGER), len(tags))
        if integers >= 9 or (integers == 6 and len(tags) == 6):
            return True
        if tags[1] == OCTETS and data[low] == 1:
            return True
        return len(tags) >= 3 and tags[2] == OCTETS and algorithm(parts[1]) is not None
    return tags == [SEQUENCE, OCTETS] and (algorithm(parts[0]) or b"").startswith(ENCRYPTIONS)


def is_openssh(data: bytes) -> bool:
    return data.startswith(OPENSSH)


def _promising(head: bytes) -> bool:
    """Whether the first bytes may be those of a private key, so that few candidates are decoded whole."""
    if OPENSSH.startswith(head[: len(OPENSSH)]):
        return True
    if len(head) < 6 or head[0] != SEQUENCE or (outer := der_length(head, 0)) is None:
        return False
    inner = der_length(head, outer[0])
    return head[outer[0]] in (INTEGER, SEQUENCE) and inner is not None and sum(inner) < sum(outer) and (head[outer[0]] == SEQUENCE or inner[1] == 1)


def _openssh_length(data: bytes, left: int) -> int:
    """Bytes of an OpenSSH private key: its magic word, three texts, the number of keys, public keys
    and the private part. 0 if that is more than ``left``, -1 if ``data`` is too short to tell."""
    at, fields, counted = len(OPENSSH), 3, False
    while fields:
        if at + 4 > left:
            return 0
        if at + 4 > len(data):
            return -1
        n = int.from_bytes(data[at : at + 4], "big")
        at, fields = at + 4 + n, fields - 1
        if not fields and not counted:
            if at + 4 > min(left, len(data)):
                return 0 if at + 4 > left else -1
            fields, counted = int.from_bytes(data[at : at + 4], "big") + 1, True
            at += 4
    return at if at <= left else 0


def _openssh_bytes(chars: str, i: int, decoded: Callable[[str], bytes | None], left: int) -> int:
    """As ``_openssh_length`` of the key at ``i``; no more is decoded than its lengths need."""
    size = 2_048
    while True:
        n = _openssh_length(decoded(chars[i : i + size]) or b"", left)
        if n >= 0 or i + size >= len(chars):
            return max(0, n)
        size *= 2


def keys_in(chars: str, starts: re.Pattern, decoded: Callable[[str], bytes | None], per: int, of: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of private keys in a run of encoded characters, wherever they begin.

    ``per`` characters hold ``of`` bytes.
    """
    done = 0
    for m in starts.finditer(chars):
        i = m.start()
        if i < done:
            continue
        head = decoded(chars[i : i + 16 * per])
        if head is None or not _promising(head):
            continue
        left = (len(chars) - i) * of // per
        ssh = is_openssh(head)
        n = _openssh_bytes(chars, i, decoded, left) if ssh else sum(der_length(head, 0))
        if 0 < n <= left and (ssh or is_private((decoded(chars[i : i + -(-n * per // of)]) or b"")[:n])):
            done = i + -(-n * per // of)
            yield i, done, KINDS.index("ssh" if ssh else "der")


def _from_base64(chars: str) -> bytes | None:
    chars = chars.translate(STANDARD)
    return unpadded(chars if len(chars) % 4 != 1 else chars[:-1])


def _from_hex(chars: str) -> bytes | None:
    return bytes.fromhex(chars[: len(chars) // 2 * 2])


def encoded_keys(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of private keys in base64 or hex without armour: on one line or wrapped,
    in either alphabet, glued to other characters of it."""
    for m in RUN.finditer(text):
        run, base = m[0], m.start()
        chars, at = run, None
        if "\n" in run or "\\" in run:
            # Places of the characters that stay when line ends go.
            kept, last = [], 0
            for b in BREAK.finditer(run):
                kept.append((last, b.start()))
                last = b.end()
            kept.append((last, len(run)))
            chars = "".join(run[i:j] for i, j in kept)
            at = [i for a, b in kept for i in range(a, b)]
        for i, j, kind in keys_in(chars, KEY_START, _from_base64, 4, 3):
            start, end = (i, j) if at is None else (at[i], at[j - 1] + 1)
            end += base
            while end < len(text) and end < base + len(run) + 2 and text[end] == "=":
                end += 1
            yield base + start, end, kind
    for m in HEX_RUN.finditer(text):
        for i, j, kind in keys_in(m[0], HEX_START, _from_hex, 2, 1):
            yield m.start() + i, m.start() + j, kind


def is_token_header(data: bytes | None) -> bool:
    if not data or data[:1] != b"{":
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place of the kind in KINDS, end, start of the secret itself)."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of each END mark with the nearest BEGIN mark of its
    label before it and nothing but an armoured body between, in one pass."""
    begun = None
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            if m[2] == begun[2] and ARMOURED.match(text, begun.end(), m.start()).end() == m.start():
                yield begun.start(), m.end(), text[begun.end() : m.start()]
            begun = None


def dotted_tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of three neighbouring parts of a dotted run, the first a
    token header and the second base64; each part is decoded once."""
    for m in DOTTED.finditer(text):
        run = m[0]
        if not ("ey" in run or "ew" in run) or run.count(".") < 2:
            continue
        parts = run.split(".")
        at = [m.start()]
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        done = 0
        for i in range(len(parts) - 2):
            if i < done or len(parts[i + 1]) < PAYLOAD_CHARS:
                continue
            # A header may stand behind other characters, such as a name and an underscore.
            for h in HEADER.finditer(parts[i]):
                if len(parts[i]) - h.start() < HEADER_CHARS or not _header_begins(parts[i][h.start() : h.start() + 32]):
                    continue
                head = parts[i][h.start() :]
                if is_token_header(unpadded(head, url=True)) and unpadded(parts[i + 1], url=True) is not None:
                    yield at[i] + h.start(), at[i + 2] + len(parts[i + 2])
                    done = i + 3
                    break


#: How base64 of a brace, and of a quote or white space behind it, begins.
HEADER = re.compile(r"e(?=y[A-DI-L]|w[k-r0-3])")
#: A field's name and what follows it, as far as a short piece shows them.
FIELD = re.compile(rb"\{\s*(?:$|\"[^\"\\\x00-\x1f]*+(?:$|\"\s*(?:$|:)))")


def _header_begins(head: str) -> bool:
    """Whether the first characters of an encoded header may begin an object: few candidates are decoded whole."""
    piece = unpadded(head, url=True)
    return piece is not None and FIELD.match(piece) is not None


def confirmed_spans(text: str) -> list[tuple[int, int, int, int]]:
    out = []
    if "-----BEGIN" in text:
        for start, end, inside in armoured(text):
            lines = inside.replace("\\r", "\n").replace("\\n", "\n").split("\n")
            data = unpadded("".join("".join(line for line in lines if ":" not in line and not line.startswith("=")).split()))
            label = text[start : text.index("-----", start + 5)]
            locked = "ENCRYPTED" in inside and "PRIVATE KEY" in label
            pgp = "PGP PRIVATE KEY" in label and data and data[0] & 0xBC in (0x94, 0x84)
            if data and (is_private(data) or is_openssh(data) or locked or pgp):
                out.append((start, 3, end, start))
    if "." in text and ("ey" in text or "ew" in text):
        out += [(start, 4, end, start) for start, end in dotted_tokens(text)]
    armour = [(a, b) for a, k, b, _ in out if k == 3]
    for start, end, kind in encoded_keys(text):
        if not any(a <= start and end <= b for a, b in armour):
            out.append((start, kind, end, start))
    return out


def _said(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def masked(text: str, mask: str = MASK) -> str:
    """``text`` with each secret, or run of overlapping ones, replaced; of an assignment the value alone."""
    out, done = [], 0
    for start, end in sorted((v, b) for _, _, b, v in base_spans(text) + confirmed_spans(text)):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join(out) + text[done:]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, their digest, and all spans of every whole text.

    Spans are in code points, end exclusive, by start and kind. Null and empty
    texts have none (the digest of no bytes); repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                kinds = [k for _, k, _, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + confirmed_spans(text)))))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, where there is one, set anew. No row goes."""
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, mask) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if count_at is not None:
                old = columns[count_at].to_pylist()
                before = batch.column(text_at).to_pylist()
                new = [n if a == b else len(b) for n, a, b in zip(old, before, texts, strict=True)]
                columns[count_at] = pa.array(new, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
