"""Byte pairs merged by rank: the plain definition that both tokenizer operators rest on.

`Ranks` holds a vocabulary of byte strings; `merge` applies the lowest-ranked adjacent pair, leftmost first,
until none is left. `pair_rank` may differ from the rank of the joined string (lists of merges) or be the same
(files of ranks).
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable

#: Symbols up to which rescanning beats a heap.
SHORT = 48
#: The rank of pairs that don't merge.
NEVER = 1 << 60


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for code points from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_json(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], dict[str, int]]:
    """Vocabulary, ranks of merged pairs and added special tokens of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    byte = printable_bytes()
    raw = lambda s: bytes(byte[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    vocabulary = {raw(s): i for s, i in whole["model"]["vocab"].items()}
    return vocabulary, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}, {x["content"]: x["id"] for x in whole["added_tokens"]}


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines with a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, rank: Callable[[bytes, bytes], int]) -> list[bytes]:
    """The symbols that are left of `piece`; rank gives NEVER for pairs that don't merge. Linear-logarithmic in its length."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > SHORT:
        return _merge_long(parts, rank)
    ranks = list(map(rank, parts, parts[1:]))
    while ranks and (best := min(ranks)) != NEVER:
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at:
            ranks[at - 1] = rank(parts[at - 1], parts[at])
        if at < len(ranks):
            ranks[at] = rank(parts[at], parts[at + 1])
    return parts


def _merge_long(parts: list[bytes], rank: Callable[[bytes, bytes], int]) -> list[bytes]:
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(map(rank, parts, parts[1:])) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue  # one of the two has been merged since
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if 0 <= x and y < n and (r := rank(parts[x], parts[y])) != NEVER:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [p for p, k in zip(parts, alive, strict=True) if k]
