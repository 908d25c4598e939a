"""Tokenizer operators against the libraries themselves."""

import base64
import hashlib
import zlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegraph.llm.byte_bpe import TreeBpe, decode_documents, encode_documents
from sitegraph.llm.packing import pack, pack_documents
from sitegraph.llm.token_counts import fill_cache, read_cache, token_counts, version_of
from sitegraph.llm.word_tokens import WordTokens

WORD = P.path("word_bpe_49k.json")
BYTE = P.path("byte_bpe_50k.tiktoken")

ODD = [
    "", " ", "\n", "word", "Word, word. WORD", "don't DON'T x's", "a  b   c\n\n d \n e", "é É ÀÉÎ ß ẞ ſ",
    "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "H̱ ẖ É", "x≠ a.́", "\x1c a\x1cb \x85c\xa0d",
    "..., a.b.c. d,. 12 a1b2.", "日本語 テキスト 漢字かな", "Σίσυφος ΟΔΟΣ İstanbul", "🙂🙃 a🙂b", "aaaa" * 300, "0123456789" * 20,
    " leading and trailing ", "\t\ttabs\x0b\x0cform", "½ ² ª º µ", "'s 's's ''s",
]
DOC = "doc_id long, text string, lang string, content string, n_tokens string, piece string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return WordTokens(WORD, limit=50)


@pytest.fixture(scope="module")
def tree():
    return TreeBpe(BYTE, P.PATTERN, chunks=50)


def _ids(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]


TEXT = st.one_of(
    st.text(max_size=60),
    st.text(alphabet="aAbeEéÉ .,'\n\t12-<|≯̱́ßſİΣ", max_size=60),
    st.lists(st.sampled_from(["the", "The", "er", "e.", "don't", "  ", "\n", "é", "É,", "x=", "12", "aaa"]), max_size=30).map(" ".join),
)


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_word_ids_are_the_library_s(text, words, library):
    assert _ids(words.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids


class _Counted:
    """The library, with the texts it encodes and the matches its model cuts."""

    def __init__(self, library):
        self.own, self.model, self.encoded, self.cut = library, self, [], []

    def encode(self, text, **options):
        self.encoded.append(text)
        return self.own.encode(text, **options)

    def tokenize(self, letters):
        self.cut.append(letters)
        return self.own.model.tokenize(letters)


def test_plain_chunks_are_cut_by_match(library):
    words = WordTokens(WORD)
    words.library = _Counted(library)
    for text in ["Den%%% schöne; the*** don't (12) a_b", "The, DEN the*** SCHÖNE%%% don't, b_a"]:
        assert _ids(words.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids
    assert not words.library.encoded
    assert len(words.library.cut) == len(set(words.library.cut))


def test_frequent_words_outlive_a_full_table(library):
    words = WordTokens(WORD, limit=50)
    words.library = _Counted(library)
    for k in range(40):
        text = "the " + " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j)}" for j in range(20))
        assert _ids(words.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids
    assert words.library.cut.count("the") == 1 and len(words.known) + len(words.older) <= 50


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_byte_ids_are_the_library_s(text, tree, tiktoken_encoding):
    ids = tree.encode(text)
    assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)
    assert tree.as_decimals(ids) == " ".join(map(str, ids))
    assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, words, tree, library, tiktoken_encoding):
    assert _ids(words.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids
    assert tree.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(a=st.text(alphabet="aberst ", max_size=40), b=st.text(alphabet="aberst ", max_size=40))
def test_join_is_the_encoding_of_both(a, b, tree):
    left, right = tree.merged(a.encode()), tree.merged(b.encode())
    assert tree.join(left, right) == tree.merged((a + b).encode())


def _docs(spark, texts):
    rows = [(k, t, "en", "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None), rows[0], rows[0]], DOC).repartition(3)


def test_encode_and_decode_documents(spark, tiktoken_encoding):
    rows = encode_documents(_docs(spark, ODD), BYTE, P.PATTERN, keep_ids=True)
    for r in rows.collect():
        text = "" if r.doc_id is None else ODD[r.doc_id]
        ids = tiktoken_encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows.count() == len(ODD) + 3
    for r in decode_documents(rows, BYTE, P.PATTERN).collect():
        assert r.text == ("" if r.doc_id is None else ODD[r.doc_id])


def test_token_counts_and_cache(spark, tmp_path, library):
    cache = str(tmp_path / "cache")
    docs = _docs(spark, ODD)
    rows = token_counts(docs, WORD, cache, limit=10).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "" if r.doc_id is None else ODD[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 10)
    stored = read_cache(spark, cache)
    before = stored.count()
    assert before == stored.select("content").distinct().count() < len(ODD) + 3
    fill_cache(docs, WORD, cache)  # all known
    assert read_cache(spark, cache).count() == before
    more = spark.createDataFrame([(1, "one more"), (2, " one\n more ")], "doc_id long, text string")
    fill_cache(more, WORD, cache)
    assert read_cache(spark, cache).count() == before + 1
    stale = read_cache(spark, cache).selectExpr("content", "tokenizer", "n_tokens + 1 AS n_tokens")
    other = str(tmp_path / "other")
    stale.replace(version_of(WORD), "another version", "tokenizer").write.parquet(other)
    assert {r.n_tokens for r in token_counts(more, WORD, other).collect()} == {2}  # counts of another version do not hold


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOC)
    assert encode_documents(none, BYTE, P.PATTERN).count() == 0
    assert token_counts(none, WORD, str(tmp_path / "c")).count() == 0
    assert pack_documents(none, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_pack_holds_all_items_once(lengths):
    bins = pack(lengths, 100)
    assert sorted(k for own in bins for k in own) == list(range(len(lengths)))
    assert all(0 < sum(lengths[k] for k in own) <= 100 for own in bins)


def test_swaps_save_a_bin():
    # 180 in bins of 60: best fit alone leaves a fourth bin
    assert len(pack([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60)) == 3


def test_pack_documents(spark, library):
    texts = [*ODD, "and the of " * 40]
    rows = pack_documents(_docs(spark, texts), WORD, capacity=16, shard_pieces=40).collect()
    assert len({r.sequence_id for r in rows}) > 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, own in by_doc.items():
        text = "" if doc is None else texts[doc]
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert {r.start for r in own} == set(range(0, len(ids), 16))
        for r in own:
            part = ids[r.start : r.start + 16]
            assert (r.piece, r.length) == (r.start // 16, len(part))
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    assert len(by_doc[0]) == 3 and len(by_doc) == len(texts) + 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16
