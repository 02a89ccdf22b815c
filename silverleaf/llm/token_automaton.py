"""A byte-level BPE tokenizer compiled to a deterministic finite-state transducer that counts tokens.

Reading a text from the left, the encoding of each prefix ends in exactly one token t, and what stands before t is the
encoding of the shorter prefix. So after every byte the tokens so far are known from a bounded past: the open ends,
positions from which the bytes up to here are the beginning of a vocabulary token. A state holds, for each open end,
that beginning (a node of the vocabulary's trie), the last token of the encoding up to the open end, and how many tokens
that encoding has more than the present one. A byte extends every beginning; of those that now are whole tokens, the
one that BPE itself keeps apart from the token before it is the new last token. The transition is annotated with the
change of the count, so a text's number of tokens is the sum of the annotations along its path.

Pieces (words, numbers, other signs, white space, English contractions) come from a second, small automaton over the
library's own character classes; a state of the transducer is the pair of both, with the one or two characters whose
piece is still undecided (the last white space of a run; an apostrophe and r, v or l after it) held back. Transitions are
over characters, composed of the transitions of their bytes, compiled when first taken and kept in a bounded table.

Chunks. A blank after a character that is no white space leads to one state, ``BLANK``, from every state. The map of a
chunk is (head, state, count): its text up to the first such blank, whose effect depends on the state it is entered in,
then the state and count reached from ``BLANK``. Maps compose associatively; ``scan`` composes them pairwise.
"""

from __future__ import annotations

import json
import re

#: States kept in a Python worker, and remembered views of open ends; beyond, they are compiled afresh.
MAX_STATES, MAX_VIEWS = 120_000, 400_000
#: Open ends that at most so many tokens can still complete are told apart only by which of these tokens can follow.
FEW = 64
#: The characters that end, or begin, an English contraction after an apostrophe: fixed values of the piece pattern.
SHORT, LONG = "stmd", {"'r": "e", "'v": "e", "'l": "l"}
LETTER, NUMBER, OTHER, SPACE, BEGIN, QUOTE = "LNOSBQ"


class State(dict):
    """A state: next state and change of the count by character. ``key`` is (kind of the open piece, open ends, held characters)."""

    __slots__ = ("key", "automaton")

    def __missing__(self, c):
        return self.automaton.compile(self, c)


class Automaton:
    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        odd = any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or model.get("type") != "BPE" or odd or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = {t: i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        self.byte_ids = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.merges = {}
        self.made = {i: (-1, i, i) for i in self.byte_ids.values()}  # rank, left and right part of a token
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
            self.made.setdefault(vocab[a + b], (rank, vocab[a], vocab[b]))
        self.child: dict[int, int] = {}  # trie: node * 256 + byte -> node; the root is 0
        self.token: dict[int, int] = {}
        self.inner = {0}
        self.sorted = sorted(self.bytes_of, key=self.bytes_of.get)
        self.below: dict[int, list] = {0: [0, len(self.sorted)]}  # node -> its tokens, as a range of ``sorted``
        nodes = 1
        for r, i in enumerate(self.sorted):
            b, at = self.bytes_of[i], 0
            for x in b:
                self.inner.add(at)
                step = at * 256 + x
                if step not in self.child:
                    self.child[step] = nodes
                    nodes += 1
                at = self.child[step]
                self.below.setdefault(at, [r, r])[1] = r + 1
            self.token[at] = i
        self.classes: dict[str, str] = {}
        self.wholes: dict[int, bool] = {}
        self.views: dict[tuple, int | None] = {}
        self.like: dict[tuple, int] = {}
        self.states: dict[tuple, State] = {}

    # ---- the tokenizer's own rules
    def kind(self, c: str) -> str:
        """Class of a character, as the library's pattern takes it."""
        k = self.classes.get(c)
        if k is None:
            k = self.classes[c] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.pieces(x + c)) == 1), SPACE)
        return k

    def merge(self, ids: list[int]) -> list[int]:
        """BPE: the merge of lowest rank first, the leftmost of equal ones."""
        while len(ids) > 1:
            best = min(((*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), key=lambda m: (m[0], m[2]), default=None)
            if best is None:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def whole(self, token: int) -> bool:
        """BPE encodes the token's bytes as this token."""
        known = self.wholes.get(token)
        if known is None:
            known = self.wholes[token] = token in self.made and self.merge([self.byte_ids[x] for x in self.bytes_of[token]]) == [token]
        return known

    def apart(self, last: int, token: int) -> bool:
        """BPE encodes the bytes of both as just these two tokens (-1: no token before).

        Merges are undone from the latest to the first; at each moment two parts stand at the seam, and they must not merge
        before one of them is merged away from it. Of equal ranks the left one comes first.
        """
        if not self.whole(token):
            return False
        if last < 0:
            return True
        merges, made = self.merges, self.made
        a, b, a_gone, b_gone = last, token, 1 << 60, 1 << 60
        while True:
            m = merges.get((a, b))
            if m and m[0] < a_gone and m[0] <= b_gone:
                return False
            (a_born, _, a_right), (b_born, b_left, _) = made[a], made[b]
            if a_born < 0 and b_born < 0:
                return True
            if a_born > b_born:
                a, a_gone = a_right, a_born
            else:
                b, b_gone = b_left, b_born

    def view(self, node: int, last: int) -> int | None:
        """A token that stands for ``last`` before an open end, as the same tokens can follow it; None if no token can."""
        low, high = self.below[node]
        if high - low > FEW:
            return last
        if (node, last) in self.views:
            return self.views[node, last]
        if len(self.views) >= MAX_VIEWS:
            self.views.clear()
            self.like.clear()
        own = self.token.get(node)
        can = tuple(t for t in self.sorted[low:high] if t != own and self.apart(last, t))
        seen = self.views[node, last] = self.like.setdefault((node, can), last) if can else None
        return seen

    # ---- open ends: ((node, last token, tokens there less tokens here), ...), the farthest first
    def feed(self, ends: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for x in text.encode():
            grown = [(self.child.get(n * 256 + x), last, d) for n, last, d in ends]
            grown = [e for e in grown if e[0] is not None]
            token, change = next((self.token[n], d + 1) for n, last, d in grown if n in self.token and self.apart(last, self.token[n]))
            seen = ((n, self.view(n, last), d - change) for n, last, d in grown if n in self.inner)
            ends = (*(e for e in seen if e[1] is not None), (0, token, 0))
            total += change
        return ends, total

    # ---- states
    def state(self, kind: str, ends: tuple = ((0, -1, 0),), held: str = "") -> State:
        key = kind, ends, held
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = State()
            s.key, s.automaton = key, self
        return s

    def compile(self, state: State, c: str) -> tuple[State, int]:
        if len(self.states) >= MAX_STATES:
            for s in self.states.values():
                s.clear()
            self.states = {state.key: state}
        step = state[c] = self._step(*state.key, c)
        return step

    def _step(self, kind, ends, held, c) -> tuple[State, int]:
        k = self.kind(c)
        if kind in (LETTER, NUMBER, OTHER) and k == kind:
            ends, change = self.feed(ends, c)
            return self.state(k, ends), change
        if kind == SPACE and k == SPACE:
            ends, change = self.feed(ends, held)
            return self.state(SPACE, ends, c), change
        if kind == SPACE and held == " ":
            ends, change = self.feed(((0, -1, 0),), " " + c)
            return self.state(k, ends), change
        if kind == SPACE:
            to, change = self._begin(c, k)
            return to, change + self.feed(((0, -1, 0),), held)[1]
        if kind == QUOTE:
            return self._quote(held, c, k)
        return self._begin(c, k)

    def _begin(self, c, k) -> tuple[State, int]:
        """The first character of a piece."""
        if k == SPACE or c == "'":
            return self.state(SPACE if k == SPACE else QUOTE, held=c), 0
        ends, change = self.feed(((0, -1, 0),), c)
        return self.state(k, ends), change

    def _quote(self, held, c, k) -> tuple[State, int]:
        """After an apostrophe at the start of a piece, and perhaps one letter more."""
        start = ((0, -1, 0),)
        if c in SHORT if held == "'" else c == LONG[held]:
            return self.state(BEGIN), self.feed(start, held + c)[1]
        if held == "'" and held + c in LONG:
            return self.state(QUOTE, held=held + c), 0
        if held == "'" and k == OTHER:
            ends, change = self.feed(start, held + c)
            return self.state(OTHER, ends), change
        sign = self.feed(start, "'")[1]
        if held == "'":
            to, change = self._begin(c, k)
            return to, sign + change
        ends, letter = self.feed(start, held[1])
        to, change = self._step(LETTER, ends, "", c)
        return to, sign + letter + change

    def close(self, state: State) -> int:
        """Tokens still to be counted when the text ends in a state."""
        kind, ends, held = state.key
        if kind == QUOTE:
            return sum(self.feed(((0, -1, 0),), c)[1] for c in held)
        return self.feed(ends, held)[1] if held else 0

    @staticmethod
    def run(state: State, text: str) -> tuple[State, int]:
        count = 0
        for c in text:
            state, change = state[c]
            count += change
        return state, count

    # ---- chunk maps
    def chunk_map(self, chunk: str) -> tuple[str, State | None, int]:
        """(head, state, count); the state is None if the chunk is all head."""
        at = chunk.find(" ", 1)
        while at > 0 and self.kind(chunk[at - 1]) == SPACE:
            at = chunk.find(" ", at + 1)
        if at < 0:
            return chunk, None, 0
        return chunk[: at + 1], *self.run(self.state(SPACE, held=" "), chunk[at + 1 :])

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if a[1] is None:
            if b[1] is None:
                return self.chunk_map(a[0] + b[0])
            return a[0] + b[0], b[1], b[2]
        state, count = self.run(a[1], b[0])
        return (a[0], state, a[2] + count) if b[1] is None else (a[0], b[1], a[2] + count + b[2])

    def apply(self, m: tuple) -> int:
        """Tokens of a text with this map."""
        state, count = self.run(self.state(BEGIN), m[0])
        if m[1] is not None:
            state, count = m[1], count + m[2]
        return count + self.close(state)

    def scan(self, text: str, chunk_chars: int) -> int:
        """Tokens of a text. Special strings stand for one token each, and the texts between them are encoded alone."""
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            maps = [self.chunk_map(part[i : i + chunk_chars]) for i in range(0, len(part), chunk_chars)]
            while len(maps) > 1:
                maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            total += self.apply(maps[0]) if maps else 0
        return total
