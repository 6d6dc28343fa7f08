"""Mixing sources of very different sizes."""

import hashlib

import numpy as np
from filmspark.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def inverted(rate, salt, ident):
    u = (int(hashlib.md5(f"{salt}{ident}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    k, term = 0, np.exp(-rate)
    total = term
    while total < u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_rare_sources_are_repeated_at_any_rate(spark):
    rows = [(i, f"t{i}", "en", "big" if i < 20000 else "one", 1) for i in range(20001)] + [(20001, "n", "en", None, 1), (20002, "n", "en", None, 1)]
    got = mixing.poisson_mix(spark.createDataFrame(rows, DOCS)).select("doc_id", "source", "copy").toPandas()
    assert not got.duplicated(["doc_id", "copy"]).any()
    n = got.groupby("doc_id").size()
    for i, rate in ((20000, 20003 / 3), (20001, 20003 / 6), (20002, 20003 / 6)):
        m = int(np.ceil(rate / 60))
        assert n[i] == sum(inverted(rate / m, f"11+{j}:", i) for j in range(1, m + 1))
        assert abs(n[i] - rate) < 5 * rate**0.5
        assert sorted(got.loc[got.doc_id == i, "copy"]) == list(range(n[i]))
    assert (n[n.index < 20000] == [inverted(20003 / 3 / 20000, "11:", i) for i in n.index if i < 20000]).all()


def test_more_than_ten_thousand_sources(spark):
    docs = spark.range(10100).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "concat('s', id) AS source", "1L AS n_chars")
    assert 9600 < mixing.poisson_mix(docs).count() < 10600
    assert {r.source for r in mixing.poisson_mix(docs, {"s7": 1.0, "absent": 3.0}, total=50.0).collect()} == {"s7"}
