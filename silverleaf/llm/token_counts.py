"""Token counts by a compiled transducer (``token_automaton``), and token ids by a table of fragments.

Counts: every text, of any length, is cut into chunks; the state maps of the chunks, found by running the transducer,
compose associatively and are composed pairwise, level by level, as in a prefix scan.

Ids (for packing): a blank (U+0020) that follows a character which is no white space always starts a new token, and what
stands left of it is tokenized the same whatever follows. These blanks cut a text into fragments that are tokenized alone,
when first seen, with a faster encoder of the same vocabulary (the library itself for other kinds of files and for special
strings), and kept in a bounded table.

Defined cases: null or empty text -> 0 tokens; special strings inside a text are treated as the library does
by default; repeated rows are counted each; an empty table gives no rows; other columns of the input are ignored;
a tokenizer that is no plain byte-level BPE has no transducer: ValueError.
"""

from __future__ import annotations

import json
from struct import pack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns
from .token_automaton import Automaton

#: Fragments whose ids are kept in a Python worker.
MAX_FRAGMENTS = 900_000
_WORKER: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fragments(text: str) -> list[str]:
    """The text, cut before each blank that follows a character that is no white space."""
    parts = text.split(" ")
    if len(parts) == 1:
        return [text] if text else []
    if "" not in parts and "\n " not in text and not any(p[-1].isspace() for p in parts if not p.isascii() or p[-1] < " "):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, open_part = [], parts[0]
    for p in parts[1:]:
        if open_part and not open_part[-1].isspace():
            out.append(open_part)
            open_part = " " + p
        else:
            open_part += " " + p
    return [*out, open_part]


def quick_encoder(path: str):
    """A faster encoder of the same byte-level BPE, or None if the file is of another kind. Special strings are not for it."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class FragmentIds:
    """Fragment -> its ids (little-endian uint32)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.quick = quick_encoder(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.emit: dict[str, bytes] = {}

    def compile(self, parts) -> None:
        new = [p for p in set(parts) if p not in self.emit]
        if len(self.emit) + len(new) > MAX_FRAGMENTS:
            self.emit.clear()
            new = list(set(parts))
        for s in range(0, len(new), 4096):
            part = new[s : s + 4096]
            if self.quick is None:
                done = [e.ids for e in self.library.encode_batch(part, add_special_tokens=False)]
            else:
                done = [self.quick(p) for p in part]
                for i, p in enumerate(part):
                    if any(x in p for x in self.special):
                        done[i] = self.library.encode(p, add_special_tokens=False).ids
            self.emit.update((p, pack(f"<{len(e)}I", *e)) for p, e in zip(part, done))

    def ids(self, text: str) -> bytes:
        parts = fragments(text)
        try:
            return b"".join(map(self.emit.__getitem__, parts))
        except KeyError:
            self.compile(parts)
            return b"".join(map(self.emit.__getitem__, parts))


def in_worker(kind, path: str):
    """One ``kind(path)`` for a Python worker."""
    if (kind, path) not in _WORKER:
        _WORKER[kind, path] = kind(path)
    return _WORKER[kind, path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, chunk_chars: int = 1 << 14) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Every text is counted as the composition of the maps of its chunks."""
    path = path or tokenizer_path()
    schema = "doc_id long, n_bytes long, n_tokens long"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def count(batches):
        t = in_worker(Automaton, path)
        for b in batches:
            yield with_columns(b, schema, n_tokens=[t.scan(x, chunk_chars) for x in b.column("text").to_pylist()])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir) -> DataFrame:
    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"))
