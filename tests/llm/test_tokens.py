"""Token counts, the merge transducer and packing, each against the library it must equal."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tests.llm.helpers import TEXTS, documents, empty, odd_rows
from tidewright.llm import bytes_bpe, packing, token_count, transducer

BYTE, MULTI, WORD = (P.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ranks():
    return bytes_bpe.load_ranks(MULTI)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(spark, data):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    spaces = spark.createDataFrame([(i, "".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u0558", "'s", "12", "!", "<|endoftext|>"]) for _ in range(rng.randint(1, 12)))) for i in range(3000)], "doc_id long, text string")
    for docs in (odd_rows(spark), documents(spark, data), spaces):
        texts = docs.select("doc_id", "text").collect()
        got = token_count.token_counts(docs, BYTE).collect()
        want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_count.token_counts(empty(spark), BYTE).collect() == []


def test_proven_strings_are_single_tokens():
    vocabulary, pairs, _ = bytes_bpe.load_json(BYTE)
    library = Tokenizer.from_file(BYTE)
    proven = token_count.prove_whole(vocabulary, pairs)
    assert len(proven) > 40_000
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in random.Random(0).sample(proven, 3000))


def test_characters_below_the_bound_are_split_alike():
    split, pattern = Tokenizer.from_file(BYTE).pre_tokenizer.pre_tokenize_str, regex.compile(P.PATTERN)
    for c in map(chr, range(0x2B0)):
        s = f"a{c}{c}1"
        assert [x for _, x in split(s)] == [m.span() for m in pattern.finditer(s)]


def test_possessive_patterns_match_the_same():
    a, b = regex.compile(P.PATTERN), regex.compile(token_count.FAST_PATTERN)
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice("ab1 '\n\tsé!世٣  ") for _ in range(rng.randrange(40)))
        assert a.findall(s) == b.findall(s)


def test_transducer_equals_tiktoken(ranks, reference):
    encode = transducer.Encoder(ranks, transducer.unreachable(ranks))
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdeißüéñ ,.世界") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["ab" * 2000, "aaaabaab" * 300]
    texts += ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "\x1c", " ", "'s", "12", "!"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += ["".join(rng.choice(["a", " ", "1", "!", *"\u0558\u058b\u088f\u0c5c\ua7ce\u208f\U000323b0\U00016ea0\u0378٣語½"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for line, ids, t in zip(*encode(pa.array(texts)), texts, strict=True):
        assert list(ids) == reference.encode_ordinary(t)
        assert line == ",".join(map(str, ids))


def test_transducer_with_few_states(ranks, reference, monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 20)
    monkeypatch.setattr(transducer, "PIECES", 5)
    encode = transducer.Encoder(ranks, transducer.unreachable(ranks))
    texts = ["Donaudampfschifffahrt und nochmals Dampf", "ciónmente queasó"]
    assert encode(pa.array(texts))[1] == [reference.encode_ordinary(t) for t in texts]


def test_lookahead_is_bounded(ranks):
    machine = transducer.Transducer(ranks, transducer.unreachable(ranks))
    machine.merged(b"internationalisierungsbestrebungen" * 50)
    assert max(len(path[2]) for state in machine.states for path in state) <= max(map(len, ranks))


def test_utf8_machine_by_single_bytes():
    for s in ("héllo 世界 🎉", "", "\x00\x7f\u0080￿\U0010ffff"):
        machine = transducer.Utf8()
        assert "".join(machine.feed([b]) for b in s.encode()) + machine.end() == s
    for raw in (b"\xff", b"a\xc3", b"\xe0\x80\x80", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc3\xc3\xa9"):
        machine = transducer.Utf8()
        assert machine.feed(raw) + machine.end() == raw.decode(errors="replace")


def test_decoder_takes_pieces_of_any_size(ranks, reference):
    decoder = transducer.Decoder({i: b for b, i in ranks.items()})
    text = "naïve 🎉🎉 語" * 5
    ids = reference.encode_ordinary(text)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == text
    assert decoder.feed(ids) == text


def test_encode_decode_query(spark, data, reference):
    for docs in (odd_rows(spark), documents(spark, data)):
        want = sorted((-1 if r.doc_id is None else r.doc_id, len(ids := reference.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in transducer.encode_decode(docs, MULTI).collect())
        assert got == want
    assert transducer.encode_decode(empty(spark), MULTI).count() == 0


def test_word_ids_equal_the_library(monkeypatch):
    library = Tokenizer.from_file(WORD)
    more = ["é́ à É", "İstanbul ΑΣ ας ﬁ", "don't we'LL'S 'S a'sb", "K Å", "a|b ### the&&& 12ab3", "<|startoftext|>B <|ENDOFTEXT|>"]
    texts = [*TEXTS, *more]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encode = packing.word_tokenizer(WORD)
    for _ in range(2):  # from memory the second time
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(pa.array(texts))] == want
    monkeypatch.setattr(packing, "MEMORY", 2)
    encode = packing.word_tokenizer(WORD)
    for t, ids in zip(texts, want, strict=True):
        assert np.frombuffer(encode(pa.array([t], pa.string()))[0], "<u4").tolist() == ids


def test_pieces_cover_every_id_once(spark, data):
    library = Tokenizer.from_file(WORD)
    docs = documents(spark, data).repartition(5)
    rows = packing.pack(docs, WORD, window=256).toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    assert set(rows.doc_id) == set(texts.index)
    for doc_id, pieces in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert pieces.start.tolist() == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.doc_tokens == len(ids)).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    rows = rows.sort_values(["sequence_id", "offset"])
    whole = rows.sequence_id * 256 + rows.offset
    assert whole.tolist() == [0, *rows.length.cumsum()[:-1]]  # gapless, and full but for the last sequence
    assert (rows.offset + rows.length <= 256).all()


def test_packing_of_odd_rows(spark):
    rows = packing.pack(odd_rows(spark), WORD).toPandas()
    ends = rows[rows.start == 0]
    assert len(ends) == odd_rows(spark).count()  # every row is packed by itself
    assert (rows[rows.doc_id == 0].doc_tokens == 1).all()
    assert packing.pack(empty(spark), WORD).count() == 0


def test_files_with_other_rules_are_left_to_the_library(spark, data):
    """A tokenizer file that the fast ways don't know gives the library's ids and counts all the same."""
    docs = documents(spark, data, 40).union(odd_rows(spark).select(documents(spark, data).columns))
    rows = docs.select("doc_id", "text").collect()
    assert packing.by_words(WORD) and not packing.by_words(BYTE) and token_count.has_known_rules(BYTE) and not token_count.has_known_rules(WORD)
    library = Tokenizer.from_file(BYTE)
    want = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    pieces = packing.pack(docs, BYTE, end_id=50256).collect()
    assert sorted(r.doc_tokens for r in pieces if r.start == 0) == want
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append(np.asarray([*library.encode(r.text or "", add_special_tokens=False).ids, 50256], dtype="<u4"))
    assert all(r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id]} for r in pieces)
    word = Tokenizer.from_file(WORD)
    got = token_count.token_counts(docs, WORD).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(word.encode(r.text or "", add_special_tokens=False).ids) for r in rows)


def test_transducer_with_another_pattern(ranks):
    pattern = r"\p{L}+|\p{N}{1,3}|\s+|[^\s\p{L}\p{N}]+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = transducer.Encoder(ranks, transducer.unreachable(ranks), pattern)
    texts = [t or "" for t in TEXTS[:-3]] + ["1234567 abc  def!?", "a b\n\nc"]
    assert [list(x) for x in encode(pa.array(texts))[1]] == [library.encode_ordinary(t) for t in texts]


def test_new_characters_are_probed_together(ranks, monkeypatch):
    built, real = [], tiktoken.Encoding
    monkeypatch.setattr(transducer.tiktoken, "Encoding", lambda *a, **k: built.append(1) or real(*a, **k))
    encode = transducer.Encoder(ranks, transducer.unreachable(ranks))
    encode(pa.array(["".join(map(chr, range(0x4E00, 0x5000))), "".join(map(chr, range(0x5000, 0x5200)))]))
    assert len(built) == 1
