"""The pipeline against a plain version of its stages, on a whole small table."""

import zlib

import pytest

import corpus_pipeline
from sitegraph.llm.common import documents
from sitegraph.llm.language import fit, known_documents, training_part
from sitegraph.llm.queries import WORD_BPE
from sitegraph.llm.secret_scan import MASK, candidates_of
from test_jaccard import _expected
from test_native import _counts


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def _plain(rows):
    """id -> text of what is left before packing. All languages of the table are known; all candidates with a name are secrets."""
    base = {i: (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(_counts(t)) for i, t, _ in rows}
    hosts = {}
    for i, _, source in rows:
        hosts.setdefault(source, []).append(base[i])
    assert max(sum(own) / len(own) for own in hosts.values()) < 0.8  # no host is rejected here, whatever the prior
    left = [(i, t) for i, t, _ in rows if not base[i]]
    kept = {c for _, c, _ in _expected(left)}
    return {i: t for i, t in left if i in kept}


def _masked(text):
    for c in reversed([c for c in candidates_of(text) if c.name]):
        text = text[: c.start] + MASK + text[c.end :]
    return text


def test_pipeline_is_the_plain_version(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    source = [(r.doc_id, r.text, r.source) for r in documents(spark, sf).collect()]
    expected = set()
    for i, text in _plain(source).items():
        ids = [*library.encode(_masked(text), add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected.add((i, k // 4096, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    full = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-full // 4096) + 1


def test_stages_keep_the_columns(spark, sf):
    docs = documents(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_rules", "jaccard_near_duplicates", "secret_scan", "best_fit_packing",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_language_stage_drops_only_what_has_no_language(spark, sf):
    docs = documents(spark, sf)
    odd = spark.createDataFrame(
        [(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "12 34", None, "s", 0), (-4, "the and of was", None, "s", 14)],
        docs.schema,
    )
    both = docs.unionByName(odd)
    model = fit(both, training_part())
    kept = {r.doc_id: r.lang for r in known_documents(both, model).collect()}
    assert set(kept) == {r.doc_id for r in docs.collect()} | {-4} and kept[-4] == "en"
    unfitted = known_documents(both, fit(both.limit(0), training_part()))
    assert unfitted.count() == docs.count() + 1
