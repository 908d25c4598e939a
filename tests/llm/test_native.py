"""Quality rules and fingerprints against plain Python versions."""

import hashlib
import re

import pytest
import xxhash

from compare import difference, duck
from sitegraph.llm.fingerprints import fingerprinted
from sitegraph.llm.queries import ORACLES, QUERIES
from sitegraph.llm.quality_rules import Rules, beta_prior, judged_documents, kept_documents

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, host_rate string, _words int"

WORDS = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()


def _text(seed: int, n: int, span: int = 26) -> str:
    return " ".join(WORDS[(seed * k * k + 7 * k + seed) % span] + str((k * seed) % 11) for k in range(1, n + 1))


TEXTS = [
    "", " \n\t ", "one", "a b a b a b a b", _text(3, 200), _text(5, 80), _text(3, 200), "same line\n" * 30, _text(7, 60) + " é ñ 日本 🙂",
    "x " * 300, "# * $ a\n| b\n\n| b\nc <d> &", _text(11, 3000, 5), _text(2, 120) + " wide\xa0space\x0b\x0cend\r\n",
    " ".join(f"w{k}" for k in range(90)) + " w0 w1 w2 w3",
]


def _docs(spark, texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    sources = sources or ["s0"] * len(texts)
    rows = [(i, t, "en", s, 0, "x", "y", 1) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for own in seen.values() if len(own) > 1 for k in own for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    docs = _docs(spark, [*TEXTS, None, None, TEXTS[4]], [*range(len(TEXTS)), None, 77, 4])
    rows = judged_documents(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None and r.doc_id < 77 else None
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == _counts(text), repr(text)
        assert r.base_failed == (found[0] < 50 or 100 * found[4] > 50 * found[0])


def test_hosts(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "bad"
    texts = [good] * 20 + [bad] * 18 + [good] * 2 + [good, bad] + [good, bad]
    sources = ["good"] * 20 + ["bad"] * 20 + ["few"] * 2 + [None] * 2
    docs = _docs(spark, texts, sources=sources)
    rows = judged_documents(docs, rules=Rules()).collect()
    assert len(rows) == len(texts)
    kept = {s: sum(r.kept for r in rows if sources[r.doc_id] == s) for s in ("good", "bad", "few", None)}
    assert kept == {"good": 20, "bad": 0, "few": 1, None: 1}  # two clean documents of the bad host go with it
    rates = {sources[r.doc_id]: r.host_rate for r in rows}
    assert rates["good"] < rates["few"] < rates["bad"] and rates["few"] == rates[None]
    mine = kept_documents(docs)
    assert mine.columns == docs.columns
    assert sorted(r.doc_id for r in mine.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_prior():
    assert beta_prior(None, None, None, 10.0) == (0.0, 1.0)
    assert beta_prior(100, 50, 25.0, 10.0) == (5.0, 5.0)  # equal rates: the strongest prior allowed
    alpha, beta = beta_prior(100, 50, 34.0, 1e6)
    assert alpha == pytest.approx(beta) and 0 < alpha < 2


def test_rules_equal_sql(spark, small):
    assert difference(spark, duck(small), small, QUERIES["op7_quality_rules"], ORACLES["op7_quality_rules"]) is None


M = (1 << 64) - 1


def _hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
    return h


def _long(v):
    return (v & M).to_bytes(8, "little")


def _signed(v):
    return v - (1 << 64) if v >> 63 else v


def _anchors(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    pairs = [_signed(_hash(a, b)) for a, b in zip(words, words[1:])]
    out, last = [], None
    for k in range(len(words) - 4):
        inner = pairs[k : k + 4]
        if inner.index(min(inner)) in (0, 3):
            gap = 0 if last is None else k - last
            out.append(_hash(_long(inner[0]), _long(inner[2]), _long(inner[3]), gap.to_bytes(4, "little")) >> 32)
            last = k
    return out or ([_hash(" ".join(words)) >> 32] if words else [])


def _likeness(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("range_bits", [1, 9])
def test_fingerprints(spark, many_partitions, range_bits):
    ids = [100 - 3 * k for k in range(len(TEXTS))] + [None]
    texts = [*TEXTS, None]
    got = {r.doc_id: r for r in fingerprinted(_docs(spark, texts, ids), range_bits).collect()}
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(zip(ids, texts)):
        text, after = text or "", texts[(k + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, n = _anchors(text), _anchors(edited), _anchors(after)
        assert r.fingerprint == " ".join(map(str, a))
        assert r.edited_fingerprint == " ".join(map(str, e))
        assert r.near_edited == pytest.approx(_likeness(a, e)) and r.near_next == pytest.approx(_likeness(a, n))
    assert got[ids[4]].fingerprint == got[ids[6]].fingerprint


def test_fingerprints_of_repeated_ids_and_of_nothing(spark):
    docs = _docs(spark, [TEXTS[4], TEXTS[4], TEXTS[5], TEXTS[8]], [1, 1, 1, -(1 << 63)])
    rows = fingerprinted(docs).collect()
    assert len(rows) == 4 and sum(r.near_next == 1.0 for r in rows) >= 1
    alone = fingerprinted(_docs(spark, [TEXTS[4]])).collect()
    assert [r.near_next for r in alone] == [1.0]
    none = _docs(spark, [TEXTS[0]]).limit(0)
    assert fingerprinted(none).count() == 0 and judged_documents(none).count() == 0 and kept_documents(none).count() == 0
