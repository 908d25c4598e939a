"""The Jaccard join against all pairs, one by one."""

import random
from collections import Counter

import numpy as np
import pytest

from sitegraph.llm.common import documents
from sitegraph.llm.jaccard_join import (
    COORDINATES, Plan, Shingler, children, components, embedded, intersections, jaccard_classes, linked,
    one_of_each, sampled,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long, set_id string, label string, path string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOC).repartition(3)


def _expected(rows):
    """class and number of links of each row, by comparing all pairs."""
    shingler = Shingler()
    sets = [set(shingler.shingles(t or "").tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for own in groups.values():
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        out += [(rows[k][0], min(ids, default=None), links[k]) for k in own]
    return Counter(out)


def _family(rng, words, n, edits):
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [None, "", "...", "one", "One.", "one two three", "two three one", "a b c d e", "A b, c d e!", "x " * 200, "x " * 300]
    for n in (2, 3, 5, 9):
        texts += _family(rng, 120, n, 4)
    texts += _family(rng, 150, 90, 5) + [t for t in _family(rng, 60, 1, 0) for _ in range(40)]
    line = " ".join(f"common{k}" for k in range(12))
    texts += [line + " " + t for k in range(60) for t in _family(rng, 80, 1, 0)]
    return [*enumerate(texts), (None, texts[20]), (5, texts[5]), (7, "other text of some seven words here")]


@pytest.mark.parametrize("plan", [Plan(), Plan(leaf=4, block=16)])
def test_classes_and_links_are_those_of_all_pairs(spark, many_partitions, rows, plan):
    found = jaccard_classes(_docs(spark, rows), plan).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == _expected(rows)


def test_one_of_each(spark, rows):
    kept = one_of_each(_docs(spark, rows))
    assert kept.columns == _docs(spark, rows).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    classes = jaccard_classes(_docs(spark, rows)).where("set_id IS NOT NULL").select("label").distinct().count()
    assert len([t for _, t in got if Shingler().shingles(t or "").size]) == classes
    assert {(0, None), (1, ""), (2, "...")} <= set(got)
    assert all(count == 0 for doc, _, count in _expected([r for r in got]))


def test_a_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == _expected(rows)


def test_nothing_and_alone(spark):
    assert jaccard_classes(_docs(spark, [(1, "x")]).limit(0)).count() == 0
    assert one_of_each(_docs(spark, [(1, "x")]).limit(0)).count() == 0
    alone = jaccard_classes(_docs(spark, [(4, "just one text with some words")])).first()
    assert (alone.doc_id, alone.class_id, alone.n_links) == (4, 4, 0)


def test_recall_of_paths():
    """Pairs at the threshold are together on some path, also when every bucket is split to the last level."""
    plan = Plan()
    rng = np.random.default_rng(3)
    together = 0
    roots = np.arange(1, plan.runs + 1, dtype=np.uint64) << np.uint64(32)
    pairs = 300
    for _ in range(pairs):
        base = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = base[:800], np.concatenate([base[:712], base[800:888]])  # 712 of 888: 0.802
        values = embedded([a, b])
        paths = [roots, roots]
        for _ in range(plan.depth):
            paths = [children(p, np.repeat(values[k : k + 1], len(p), axis=0), plan.chance)[1] for k, p in enumerate(paths)]
        together += bool(set(paths[0].tolist()) & set(paths[1].tolist()))
    assert together >= pairs - 1


def test_pieces():
    assert abs(sampled(np.arange(4000, dtype=np.uint64), Plan().chance).sum() / 4000 - 1 / 0.7) < 0.1
    like = np.zeros((6, 6), bool)
    like[0, 3] = like[3, 0] = like[3, 5] = like[5, 3] = True
    assert linked(like).tolist() == [0, 1, 2, 0, 4, 0]
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, 3000, dtype=np.uint64)) for _ in range(5)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert intersections(sets).astype(int).tolist() == expected
    a, b = (np.arange(k, k + 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 100))
    x, y = embedded([a, b])
    assert abs((x == y).sum() / COORDINATES - 0.8) < 0.15


def test_components_of_a_chain(spark):
    n = 40
    names = [bytes([(k * 17) % n]) for k in range(n)]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "set_id binary, link binary")
    labels = components(edges).collect()
    assert len(labels) == n and {bytes(r.label) for r in labels} == {b"\0"}
    assert components(edges.limit(0)).count() == 0


def test_hot_passage_does_not_make_candidates(spark):
    rng = random.Random(5)
    line = " ".join(f"common{k}" for k in range(15))
    docs = _docs(spark, [(k, line + " " + _family(rng, 90, 1, 0)[0]) for k in range(300)])
    found = jaccard_classes(docs, Plan(leaf=8)).collect()
    assert len(found) == 300 and all(r.n_links == 0 for r in found)
