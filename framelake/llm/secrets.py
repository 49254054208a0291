"""Secret scans by fixed patterns and dictionary-primed compression.

Three patterns find assignments, access keys and hexadecimal strings. Beside them every
candidate in a sensitive context is measured. A candidate is a whole run of at least 14 letters, digits and ``+/_-`` (up to two ``=``
behind it) that could carry a key: with digits and letters, or of at least 20 characters if it has digits
alone or letters alone that change case at least at every fourth place. Its context is sensitive if a fixed pattern's match touches
it or a word such as ``key`` or ``auth`` stands within ``REACH`` (40) characters before or behind it.
Zstandard, primed with a dictionary of identifiers and usual code and with
``AROUND`` (400) characters of text on either side, tells how many bytes the candidate adds. Text made of
known pieces adds few; a string that stays near the entropy of its alphabet (the character classes
it uses) is reported (kind ``novel``), whether or not a fixed pattern reports it as well.

Spans are in code points, the end exclusive. Cases: null texts count as empty and
have no spans; repeated rows get equal results; a text of any length is scanned whole; an empty table gives no rows;
extra columns are left out unless in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: The patterns, the group whose length counts and the least length, as fixed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same runs as HEX finds, those shorter than 16 left out.
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows sensitive.
SENSITIVE = ("key", "secret", "token", "passw", "auth", "credential", "bearer", "private", "signature")
SENSITIVE_BYTES = tuple(w.encode() for w in SENSITIVE)
CONTEXT = re.compile("|".join(SENSITIVE), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
OF_CANDIDATE, REST = frozenset(string.ascii_letters + string.digits + "+/_-"), re.compile(r"[A-Za-z0-9+/_-]*")
HEX_ONLY, BASE32_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[A-Z2-7=]+|[a-z2-7=]+")
#: Sizes of the character classes.
CLASSES = ((26, re.compile("[a-z]")), (26, re.compile("[A-Z]")), (10, re.compile("[0-9]")), (5, re.compile("[+/_=-]")))
#: How far from a candidate a sensitive word may be, and how much text on either side is known to the compressor.
REACH, AROUND = 40, 400
#: Least length of a candidate without digits or without letters.
LONG = 20
IDENTIFIERS = (
    "username userName user_id client_id client_secret access_key secret_key private_key public_key api_key apiKey auth_token authorization Authorization Bearer Basic "
    "password passwd credential credentials signature session_id request_id response_code content_type application/json text/html https://www.example.com/index.html "
    "import from return function class public static void const let var self this None null true false default config settings environment production development "
    "get_value set_value parse_args to_string from_string read_file write_file open_connection close_connection initialize configuration "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 000000000000 111111111111 xxxxxxxxxxxxxxxx "
)


def alphabet_bits(s: str) -> float:
    """Entropy of a character drawn evenly from the classes of characters in ``s``."""
    if HEX_ONLY.fullmatch(s):
        return 4.0
    if BASE32_ONLY.fullmatch(s):
        return 5.0
    return math.log2(sum(n for n, kind in CLASSES if kind.search(s)))


class Novelty:
    """Marginal compressed size against identifiers and the candidate's surroundings."""

    def __init__(self) -> None:
        self.base = IDENTIFIERS.encode()

    def bytes_added(self, before: str, candidate: str, after: str) -> int:
        known = zstandard.ZstdCompressionDict(self.base + (before + " " + after).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(c.compress(candidate.encode())) - len(c.compress(b""))

    def novel(self, text: str, start: int, end: int, share: float) -> bool:
        candidate = text[start:end]
        return self.bytes_added(text[max(0, start - AROUND) : start], candidate, text[end : end + AROUND]) * 8 >= share * len(candidate) * alphabet_bits(candidate)


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches; ``low`` is the text in UTF-8, A-Z lower-cased."""
    out = []
    if b"password" in low or b"passwd" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def could_be_key(s: str) -> bool:
    digits, letters = any(map(str.isdigit, s)), any(map(str.isalpha, s))
    if digits and letters or len(s) < LONG:
        return digits and letters
    return digits or sum(a.islower() != b.islower() for a, b in zip(s, s[1:])) * 4 >= len(s)


def candidates(text: str, low: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of the candidates in sensitive contexts."""
    near = [(a, b) for a, _, b in base]
    if any(map(low.__contains__, SENSITIVE_BYTES)):
        near += [(max(0, m.start() - REACH), m.end() + REACH) for m in CONTEXT.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(near):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, seen = [], 0
    for a, b in merged:
        while a > seen and text[a - 1] in OF_CANDIDATE:  # whole runs
            a -= 1
        b = REST.match(text, min(b, len(text))).end()
        for c in CANDIDATE.finditer(text, max(a, seen), b + 2):
            seen = c.end()
            if could_be_key(c[0]):
                out.append(c.span())
    return out


def novel_spans(text: str, found: list[tuple[int, int]], measure: Novelty, share: float = 0.92) -> list[tuple[int, int, int]]:
    """Those of the candidates that stay near their alphabet's entropy."""
    return [(a, 3, b) for a, b in found if measure.novel(text, a, b, share)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str, measure: Novelty) -> tuple[list, list, int]:
    """Spans of the fixed patterns, all spans, and how many candidates were measured."""
    low = text.encode("utf-8", "replace").lower()
    base = base_spans(text, low)
    found = candidates(text, low, base)
    return base, sorted(base + novel_spans(text, found, measure)), len(found)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with overlapping spans joined and replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_spans(rows: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", clean: bool = False) -> DataFrame:
    """The columns ``keep``, n_assign, n_access, n_hex, base_sha256, spans, n_measured and n_novel; with ``clean`` the redacted text too."""
    data = rows.select(F.struct(*keep).alias("own"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            out = []
            for t in batch["t"]:
                t = t.as_py()
                base, spans, measured = scan(t or "", measure)
                n = [*(sum(k == i for _, k, _ in base) for i in range(3)), measured, len(spans) - len(base)]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), (redacted(t, spans) if t is not None and spans else t) if clean else None))
            cols = list(zip(*out)) or [[]] * 8
            kinds = (*[pa.int64()] * 5, *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), batch["own"]], ["n_assign", "n_access", "n_hex", "n_measured", "n_novel", "base_sha256", "spans", "clean_text", "own"])

    kind = data.schema["own"].dataType.simpleString()
    done = data.mapInArrow(tidy(run), f"n_assign long, n_access long, n_hex long, n_measured long, n_novel long, base_sha256 string, spans string, clean_text string, own {kind}")
    return done.select("own.*", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_measured", "n_novel", *(["clean_text"] if clean else []))
