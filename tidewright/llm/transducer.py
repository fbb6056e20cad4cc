"""Byte-pair encoding as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of its bytes exactly if every adjacent pair of tokens is the encoding of its own
bytes: merges by rank never cross a boundary of the whole that they would not cross in the pair. So encodings are the
paths of a non-deterministic machine whose states are (token before, node in the trie of tokens); a byte moves down
the trie, and a node that ends a token compatible with the token before may start the next one.

The machine is determinised when it is used: a state is the set of paths still open, each with the tokens it has
chosen that are not yet certain. Tokens on which all open paths agree are emitted, so output follows input after a
bounded lookahead, for every open path has an unfinished token or stands at a boundary. Transitions are remembered.

As in the tiktoken library, a pre-token that is itself in the vocabulary is that one token.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.bytes_bpe import NEVER, load_ranks, merge
from tidewright.llm.common import IRREGULAR, documents, map_texts, once, spaced_chunks
from tidewright.llm.token_count import FAST_PATTERN, Memory

#: Deterministic states and encoded pre-tokens that a worker remembers.
STATES, PIECES = 150_000, 1_000_000
ROOT = 0
#: Tokens below a node up to which a path carries the set of those that may follow.
FEW = 40


def unreachable(ranks: dict[bytes, int]) -> set[int]:
    """Tokens that no merges end in; they stand only for whole pre-tokens."""
    rank = lambda a, b: ranks.get(a + b, NEVER)
    return {i for raw, i in ranks.items() if len(merge(raw, rank)) != 1}


class Transducer:
    """Merges compiled into a machine; `encode` reads the bytes of one pre-token.

    A path is (before, node, pending): the token before the unfinished one, or, where few tokens lie below the node,
    the set of those that may still follow, so that paths with the same future are one and paths without any end.
    """

    def __init__(self, ranks: dict[bytes, int], never: set[int]):
        self.ranks, self.raw = ranks, {i: b for b, i in ranks.items()}
        self.below: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.under: list[list[int]] = [[]]
        for raw, i in ranks.items():
            if i in never:
                continue
            node = ROOT
            for b in raw:
                if node:
                    self.under[node].append(i)
                if b not in self.below[node]:
                    self.below[node][b] = len(self.below)
                    self.below.append({})
                    self.token.append(-1)
                    self.under.append([])
                node = self.below[node][b]
            self.token[node] = i
        self.spines: dict[int, tuple[list, list]] = {}
        self.forget()

    def forget(self) -> None:
        start = ((-1, ROOT, ()),)
        self.numbers, self.states, self.moves, self.ends = {start: 0}, [start], [{}], [()]
        self.sets: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.futures: dict[tuple[int, int], int | None] = {}

    def spine(self, t: int) -> tuple[list, list]:
        """The pieces at the right and at the left end of a token while it is merged, each with the rank that ends it."""
        if (known := self.spines.get(t)) is None:
            right, left, over_right, over_left = [], [], NEVER, NEVER
            whole = raw = self.raw[t]
            while True:
                right.append((raw, over_right))
                if len(raw) == 1:
                    break
                over_right, raw = self.ranks[raw], self.halves(raw)[1]
            while True:
                left.append((whole, over_left))
                if len(whole) == 1:
                    break
                over_left, whole = self.ranks[whole], self.halves(whole)[0]
            known = self.spines[t] = right[::-1], left[::-1]
        return known

    def halves(self, raw: bytes) -> list[bytes]:
        """The two pieces that the last merge of a token joins."""
        ranks, own = self.ranks, self.ranks[raw]
        return merge(raw, lambda a, b: r if (r := ranks.get(a + b, NEVER)) != own else NEVER)

    def compatible(self, p: int, t: int) -> bool:
        """No merge crosses the boundary: the pieces beside it are followed through time until both are whole."""
        right, left = self.spine(p)[0], self.spine(t)[1]
        i = j = 0
        get = self.ranks.get
        while True:
            (a, over_a), (b, over_b) = right[i], left[j]
            r = get(a + b)
            if r is not None and r < over_a and r <= over_b:  # of equal ranks the leftmost goes first
                return False
            if over_a == over_b == NEVER:
                return True
            if over_a <= over_b:
                i += 1
            else:
                j += 1

    def future(self, p: int, node: int) -> int | None:
        """What stands for the token before a path at `node`: itself, or a set's number below -1, or None if nothing can follow."""
        if len(self.under[node]) > FEW or p == -1:
            return p
        if (p, node) not in self.futures:
            if p < -1:
                mine = self.members[-2 - p].intersection(self.under[node])
            else:
                mine = frozenset(t for t in self.under[node] if self.compatible(p, t))
            if mine and mine not in self.sets:
                self.sets[mine] = -2 - len(self.members)
                self.members.append(mine)
            self.futures[p, node] = self.sets[mine] if mine else None
        return self.futures[p, node]

    def step(self, state: int, byte: int) -> tuple[int, tuple]:
        """The transition, made now: next state and tokens emitted."""
        paths = set()
        for p, node, pending in self.states[state]:
            if (node := self.below[node].get(byte)) is None:
                continue
            if (t := self.token[node]) >= 0 and (p == -1 or (t in self.members[-2 - p] if p < -1 else self.compatible(p, t))):
                paths.add((t, ROOT, (*pending, t)))
            if self.below[node] and (q := self.future(p, node)) is not None:
                paths.add((q, node, pending))
        waiting = [x[2] for x in paths]
        low, high = min(waiting), max(waiting)
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        emitted = low[:n]
        key = tuple(sorted((p, node, pending[n:]) for p, node, pending in paths))
        if (number := self.numbers.get(key)) is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.ends.append(next(pending for _, node, pending in key if node == ROOT))
        move = self.moves[state][byte] = (number, emitted)
        return move

    def merged(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES:
            self.forget()
        moves, state, out = self.moves, 0, []
        for b in piece:
            state, emitted = moves[state].get(b) or self.step(state, b)
            if emitted:
                out += emitted
        out += self.ends[state]
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.merged(piece) if piece else []


class Utf8:
    """An incremental UTF-8 machine: bytes in, characters out, what is unfinished kept; errors give U+FFFD."""

    def __init__(self):
        self.value, self.need, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: Iterable[int]) -> str:
        out = []
        for b in data:
            if self.need and not self.low <= b <= self.high:
                self.need = 0
                out.append("�")
            if self.need:
                self.value, self.need, self.low, self.high = self.value << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(chr(self.value))
            elif b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.value = b & (0x3F >> self.need)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = "�" if self.need else "", 0
        return left


class Decoder:
    """Ids to text, in pieces of any size; tokens of whole characters skip the bytes while none is unfinished."""

    def __init__(self, raw: dict[int, bytes]):
        self.raw, self.machine = raw, Utf8()
        self.whole = {i: _text(b) for i, b in raw.items()}

    def feed(self, ids: list[int]) -> str:
        found = list(map(self.whole.__getitem__, ids))
        if not self.machine.need and None not in found:
            return "".join(found)
        machine, raw, out = self.machine, self.raw, []
        for i, s in zip(ids, found, strict=True):
            out.append(s if s is not None and not machine.need else machine.feed(raw[i]))
        return "".join(out)

    def end(self) -> str:
        return self.machine.end()


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class Alike(dict):
    """For str.translate: a character, or one that the `regex` module splits as tiktoken splits that character.

    The two may know different versions of Unicode. Characters are probed when first met, all of a text in one go:
    tiktoken takes a pair that is in the vocabulary as one token just where its pattern takes it as one piece. Up to
    U+02AF the two agree.
    """

    LETTER, NUMBER, SPACE, OTHER = "\u00aa", "\u00b2", "\u00a0", "\u00a4"
    #: Characters that one encoder probes.
    MOST = 4096

    def learn(self, text: str) -> None:
        new = sorted(c for c in set(text) if c > "\u02af" and ord(c) not in self)
        for at in range(0, len(new), self.MOST):
            some = new[at : at + self.MOST]
            pairs = {p + c: 256 + 3 * i + j for i, c in enumerate(some) for j, p in enumerate("a1!")}
            probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)} | {p.encode(): i for p, i in pairs.items()}, special_tokens={})
            for c in some:
                theirs = [len(probe.encode_ordinary(p + c)) == 1 for p in "a1!"]
                ours = [len(regex.findall(public_tokenizers.PATTERN, p + c)) == 1 for p in "a1!"]
                self[ord(c)] = ord(c) if theirs == ours else ord(next((s for s, yes in zip((self.LETTER, self.NUMBER, self.OTHER), theirs) if yes), self.SPACE))

    def __missing__(self, point: int) -> int:
        return point


class Encoder:
    """Texts to ids: each different chunk of a batch is read once, and pre-tokens that the machine has read are remembered.

    With a pattern other than the public one every text is split as a whole, by the `regex` module alone.
    """

    def __init__(self, ranks: dict[bytes, int], never: set[int], pattern: str = public_tokenizers.PATTERN):
        self.machine, self.public = Transducer(ranks, never), pattern == public_tokenizers.PATTERN
        self.pattern, self.beyond, self.alike = regex.compile(FAST_PATTERN if self.public else pattern), re.compile("[^\x00-\u02af]").search, Alike()
        self.decimal = {i: str(i) for i in ranks.values()}.__getitem__
        self.piece = Memory(lambda s: tuple(self.machine.encode(s.encode("utf-8", "surrogatepass"))), PIECES).__getitem__

    def beyond_once(self, texts: pa.Array) -> str | None:
        """The characters above U+02AF of a batch, so that all are probed together."""
        found = set().union(*(set(t) for t in texts.to_pylist() if t and not t.isascii() and self.beyond(t)))
        return "".join(found) or None

    def split(self, text: str) -> list[str]:
        if self.public and not text.isascii() and self.beyond(text):
            self.alike.learn(text)
            if (like := text.translate(self.alike)) != text:
                return [text[m.start() : m.end()] for m in self.pattern.finditer(like)]
        return self.pattern.findall(text) if self.public else [m.group() for m in self.pattern.finditer(text)]

    def read(self, text: str) -> tuple[str, tuple[int, ...]]:
        ids = tuple(itertools.chain.from_iterable(map(self.piece, self.split(text))))
        return ",".join(map(self.decimal, ids)), ids

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[list[int]]]:
        """For each text its ids in decimal, joined by commas, and as numbers."""
        if not self.public:
            made = [self.read(t or "") for t in texts.to_pylist()]
            return [line for line, _ in made], [list(ids) for _, ids in made]
        if (new := self.beyond_once(texts)) is not None:
            self.alike.learn(new)
        codes, ends, different = spaced_chunks(texts)
        used = np.bincount(codes, minlength=len(different)) > 0
        made = [self.read(c) if u else ("", ()) for c, u in zip(different, used.tolist(), strict=True)]
        lines, numbers = [m[0] for m in made], [m[1] for m in made]
        codes, ends = codes.tolist(), ends.tolist()
        out_lines, out_ids = [], []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            text = texts[i].as_py()
            if text and IRREGULAR.search(text):
                line, ids = self.read(text)
            else:
                own = [c for c in codes[a:b] if lines[c]]
                line, ids = ",".join([lines[c] for c in own]), itertools.chain.from_iterable([numbers[c] for c in own])
            out_lines.append(line)
            out_ids.append(list(ids))
        return out_lines, out_ids


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 of every row's text, encoded and decoded again.

    A null or empty text has no ids: both digests are those of nothing. A very long text is read in one pass, in memory
    in proportion to it. Repeated rows stay, other columns are left out, an empty table gives an empty result. A file of
    ranks says nothing of how texts are split, so `pattern` must be that of its tokenizer.
    """
    ranks = load_ranks(path)
    model = docs.sparkSession.sparkContext.broadcast((ranks, unreachable(ranks)))
    key = f"transducer {path} {pattern}"

    def make():
        def build():
            ranks, never = model.value
            return Encoder(ranks, never, pattern), Decoder({i: b for b, i in ranks.items()})

        encode, decoder = once(key, build)

        def run(texts: pa.Array) -> list:
            lines, ids = encode(texts)
            decoded = [hashlib.sha256((decoder.feed(x) + decoder.end()).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            return [list(map(len, ids)), [hashlib.sha256(line.encode()).hexdigest() for line in lines], decoded]

        return run

    return map_texts(docs, make, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], text, keep, arrays=True)


def op8_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
