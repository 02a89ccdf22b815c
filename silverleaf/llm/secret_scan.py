"""Secret scan: fixed patterns, and strings that a dictionary-primed zstandard compressor cannot shorten.

Base kinds (assign, access, hex) come from fixed patterns. Besides, every long enough string of secret
characters that stands in a sensitive context (a sensitive word within the 40 characters before or after it) is a
candidate; long words and paths are too, as novelty alone decides. A compressor is primed with a dictionary of common identifiers and the
code around the candidate, less all that repeats 16 or more characters of the candidate: copies of a secret must
not make each other predictable. The bytes by which the output grows when the candidate is appended are its novelty.
Strings whose novelty per character is near that of random ones are reported as kind ``novel``, unless a base
span overlaps them. Base spans are measured the same way and stay whatever their novelty; ``scan`` gives the
marginal bytes of every span it reports.

Defined cases: null or empty text -> no spans; offsets are code points, end exclusive; equal matches are
reported each where they stand; repeated rows are scanned each; an empty table gives no rows; other columns are
ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that make a context sensitive.
SENSITIVE = re.compile(r"(?i:password|passwd|secret|token|api_?key|credential|private|auth|bearer|signature|akia)", re.ASCII)
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Common identifiers that prime the compressor.
IDENTIFIERS = " ".join(
    "access account admin api api_key apikey auth authorization bearer client client_id client_secret config connection "
    "credential database default host http https key login name null password passwd port private public request response "
    "secret self server session set sha256 signature string test token true false url user user_id username value version www "
    "example example_token your_api_key_here changeme placeholder xxxxxxxxxxxxxxxx abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789".split()
).encode()
KINDS = ("assign", "access", "hex", "novel")
#: Novel bytes a character from which a string counts as incompressible; random hexadecimal needs about 0.5.
NOVELTY = 0.45
CONTEXT = 40
AROUND = 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted by start, then kind. A match covers the whole pattern."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def without_copies(text: str, start: int, end: int, side: slice, part: str) -> str:
    """text[start:end] less every run of SHORTEST or more characters that ``part`` holds too, also if an end cuts it.

    Runs are sought in text[side]. Characters of ``part`` are those of a candidate, so every run lies in one.
    """
    grams = {part[i : i + SHORTEST] for i in range(len(part) - SHORTEST + 1)}
    out, last = [], start
    for m in CANDIDATE.finditer(text, max(side.start, start - SHORTEST + 1), min(side.stop, end + SHORTEST - 1)):
        for i in range(m.start(), m.end() - SHORTEST + 1):
            if text[i : i + SHORTEST] in grams:
                if i > last:
                    out.append(text[last:min(i, end)])
                last = max(last, i + SHORTEST)
    return " ".join([*out, text[last:end]])


class Novelty:
    def __init__(self):
        import zstandard

        self.z = zstandard

    def __call__(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes of text[start:end], per character."""
        return self.marginal(text, start, end) / (end - start)

    def marginal(self, text: str, start: int, end: int) -> int:
        part, before, after = text[start:end], slice(0, start), slice(end, len(text))
        around = (without_copies(text, max(0, start - AROUND), start, before, part) + " " + without_copies(text, end, min(len(text), end + AROUND), after, part)).encode()
        primed = self.z.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        small = lambda b: len(self.z.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False).compress(b))
        lead = without_copies(text, max(0, start - CONTEXT), start, before, part).encode()
        return small(lead + part.encode()) - small(lead)


def novel_spans(text: str, base: list, novelty: Novelty) -> list[tuple[int, int, int]]:
    out = []
    if not SENSITIVE.search(text):
        return out
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, _, b in base):
            continue
        if (SENSITIVE.search(text, max(0, s - CONTEXT), s) or SENSITIVE.search(text, e, e + CONTEXT)) and novelty(text, s, e) >= NOVELTY:
            out.append((s, 3, e))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans, and the marginal bytes of each of the spans (novel_bytes)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string, novel_bytes string"

    def run(batches):
        novelty = Novelty()
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                novel = novel_spans(text, base, novelty)
                n = [sum(k == j for _, k, _ in base) for j in range(3)]
                spans = sorted(base + novel)
                marginal = ",".join(str(novelty.marginal(text, s, e)) for s, _, e in spans)
                rows.append((*n, len(novel), joined(base), joined(spans), marginal))
            yield with_columns(b, schema, **{c: [x[k] for x in rows] for k, c in enumerate(("n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans", "novel_bytes"))})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; all rows and columns stay."""

    def run(batches):
        novelty = Novelty()
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    parts, last = [], 0
                    for s, _, e in sorted(base + novel_spans(text, base, novelty)):
                        if e > last:
                            parts += [text[last : max(s, last)], mask] if s >= last else []
                            last = e
                    text = "".join(parts) + text[last:]
                out.append(text)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, b.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark, sf_dir) -> DataFrame:
    from .common import table

    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "novel_bytes")
