"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is put to proof: the splitting pattern must take it as one pre-token, and its
own merges must leave one symbol. A pre-token among the proven strings then counts one without any merging, and
only the others are merged. The counts equal those of the tokenizers library, special strings inside a text
included, whose occurrences count one token each.

The library's Unicode tables may be older than those of the `regex` module. `odd_finder` finds, by probing the library
with each character when it is first met, those that the two split differently; a text with one of them is split by
the library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.bytes_bpe import NEVER, load_json, merge
from tidewright.llm.common import IRREGULAR, documents, map_texts, once, spaced_chunks

#: Counts of merged pre-tokens that a worker remembers.
MEMORY = 1_000_000
#: The public pattern with possessive repeats, which match the same and skip the backtracking.
FAST_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s+"""


#: The rule of a tokenizer file that the shortcut rests on (a fixed value of the file).
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def has_known_rules(path: str) -> bool:
    """Whether a tokenizer file splits by the public pattern and merges bytes without further rules."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    tokens = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"])
    return model["type"] == "BPE" and not any(odd) and not tokens and rules["normalizer"] is None and rules["pre_tokenizer"] == PRE_TOKENIZER


def library_counts(path: str) -> Callable[[pa.Array], list]:
    """Bytes and tokens of texts for any tokenizer file, each text by the library as a whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def run(texts: pa.Array) -> list:
        return [pc.fill_null(pc.binary_length(texts), 0), np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()], dtype=np.int64)]

    return run


def prove_whole(vocabulary: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int]) -> list[str]:
    """The vocabulary strings that are one pre-token and whose merges end in one symbol."""
    pattern, proven = regex.compile(public_tokenizers.PATTERN), []
    rank = lambda a, b: pairs.get((a, b), NEVER)
    for raw in vocabulary:
        try:
            s = raw.decode()
        except UnicodeDecodeError:
            continue
        if pattern.findall(s) == [s] and len(merge(raw, rank)) == 1:
            proven.append(s)
    return proven


def odd_finder(path: str) -> Callable[[str], bool]:
    """A test for texts with a character that the library's pre-tokenizer splits otherwise than the `regex` module.

    Characters are probed when first met; up to U+02AF the two are known to agree (tests/llm probe all of these).
    """
    from tokenizers import Tokenizer

    split, pattern, beyond = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, regex.compile(public_tokenizers.PATTERN), re.compile("[^\x00-\u02af]").findall
    odd: dict[str, bool] = {}

    def probe(c: str) -> bool:
        s = f"a{c}{c}1"
        odd[c] = [x for _, x in split(s)] != [m.span() for m in pattern.finditer(s)]
        return odd[c]

    return lambda s: any([odd[c] if c in odd else probe(c) for c in set(beyond(s))])


class Memory(dict):
    """Remembers what a function makes of a short string; forgotten in bulk."""

    def __init__(self, make: Callable[[str], object], most: int = MEMORY):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, s: str):
        made = self.make(s)
        if len(s) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[s] = made
        return made


class Counter(Memory):
    """Tokens of a pre-token. Proven strings stay; others are merged when first asked for."""

    def __init__(self, proven: list[str], pairs: dict[tuple[bytes, bytes], int]):
        rank = lambda a, b: pairs.get((a, b), NEVER)
        super().__init__(lambda s: len(merge(s.encode("utf-8", "surrogatepass"), rank)), len(proven) + MEMORY)
        self.proven = proven
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update(dict.fromkeys(self.proven, 1))


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """`keep`, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row.

    A null or empty text has 0 bytes and 0 tokens; a very long one is read in one pass, in memory in proportion to it.
    Repeated rows and ids stay as they are, other columns are left out, an empty table gives an empty result. The
    vocabulary file bounds what is broadcast. A file with other rules than the shortcut knows is left to the library.
    """
    fields = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]
    if not has_known_rules(path):

        def plain():
            count = once(f"library {path}", lambda: library_counts(path))

            def run(texts: pa.Array) -> list:
                n_bytes, n_tokens = count(texts)
                return [n_bytes, n_tokens, n_tokens > limit]

            return run

        return map_texts(docs, plain, fields, text, keep, arrays=True)
    vocabulary, pairs, specials = load_json(path)
    model = docs.sparkSession.sparkContext.broadcast((prove_whole(vocabulary, pairs), pairs, sorted(specials, key=len, reverse=True), path))
    key = f"token_count {path}"

    def make():
        def build():
            proven, pairs, specials, path = model.value
            return Counter(proven, pairs), regex.compile(FAST_PATTERN), regex.compile("|".join(map(regex.escape, specials)) or "(?!)"), odd_finder(path), path

        counter, pattern, special, odd, path = once(key, build)
        of, findall = counter.__getitem__, pattern.findall

        def pieces(s: str) -> int:
            return sum(map(of, findall(s)))

        def odd_count(s: str) -> int:
            """Of a text with odd characters: it is split by the library."""
            from tokenizers import Tokenizer

            split = once(f"{key} split", lambda: Tokenizer.from_file(path).pre_tokenizer).pre_tokenize_str
            return sum(of(s[a:b]) for _, (a, b) in split(s))

        def count(s: str) -> int:
            one = odd_count if odd(s) else pieces
            parts = special.split(s)
            return len(parts) - 1 + sum(map(one, parts))

        def run(texts: pa.Array) -> list:
            codes, ends, different = spaced_chunks(texts)
            used = np.bincount(codes, minlength=len(different)) > 0
            each = np.fromiter((pieces(c) if u else 0 for c, u in zip(different, used.tolist(), strict=True)), dtype=np.int64, count=len(different))
            counts = np.diff(np.r_[0, np.cumsum(each[codes])][ends])
            for i, s in enumerate(texts.to_pylist()):
                if s and (IRREGULAR.search(s) or special.search(s) or not s.isascii() and odd(s)):
                    counts[i] = count(s)
            return [pc.fill_null(pc.binary_length(texts), 0), counts, counts > limit]

        return run

    return map_texts(docs, make, fields, text, keep, arrays=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
