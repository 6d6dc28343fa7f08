"""The pipeline's near-copy stage against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from filmspark.llm import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least=0.8):
    """Least id reachable, from plain sets of five words and all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    ids, of = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and len(x & y) >= least * len(x | y) - 1e-9 and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    return of


def planted(seed=5, bases=12, copies=6, passage=True):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    shared, rows = [word() for _ in range(60)], []
    for _ in range(bases):
        base = [word() for _ in range(150)] + (shared if passage else [])
        rows.append(base)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = word()
            rows.append(w)
    rows += [[], [], ["one", "two"], ["one", "two"], ["one", "three"]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("most", [2, 64])
def test_groups_equal_brute_force(spark, monkeypatch, most):
    rows = planted()
    if most == 2:
        monkeypatch.setattr(shingles, "_CELL", 2000)
    got = {r.doc_id: r.component_id for r in shingles.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert got == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rows = planted(bases=1, copies=150, passage=False)
    got = {r.doc_id: r.component_id for r in shingles.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=16).collect()}
    assert got == brute(rows)


def test_stage_leaves_no_near_copies(spark):
    rows = planted(seed=6)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == set(brute(rows).values())


@pytest.mark.parametrize("block", [1 << 10, 8 << 20])
def test_rows_with_a_similar_one_share_enough(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "_BLOCK", block)
    rows = planted(seed=7, bases=8, copies=3) + [(100 + i, t) for i, t in planted(seed=8, bases=20, copies=0)] + [(None, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, r long").repartition(3)
    got = {r.row for r in shingles.shared_enough(docs, "r").collect()}
    of = brute([x for x in rows if x[0] is not None])
    sizes = {c: sum(v == c for v in of.values()) for c in of.values()}
    linked = {k for k, (i, _) in enumerate(rows) if i is not None and sizes[of[i]] > 1}
    assert linked <= got
    assert not any(100 <= rows[k][0] < 120 for k in got)


def test_shared_enough_of_nothing(spark):
    assert shingles.shared_enough(spark.createDataFrame([], "doc_id long, text string, r long"), "r").count() == 0


def test_shingle_set_across_parts():
    assert np.array_equal(shingles.shingle_set(b"a b c d e f " * 200000, 5), shingles.shingle_set(b"a b c d e f " * 3, 5))
