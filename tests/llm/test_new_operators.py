"""Periodic runs, quality trees and spelling variants against plain restatements on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filmspark.llm import periodic, quality, trees, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
EXTRA = "doc_id long, text string, id int, word string, n long, key double, score string, start int, y int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS).repartition(3)


def extra(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w", 2, 0.5, "x", 3, 4) for i, t in texts], EXTRA)


# ---- periodic runs


def plain_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and not any(a <= i and j + q <= b for a, b, _ in out):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    """Words with runs inside runs, squares across two runs, Fibonacci words, and copies far apart."""
    n, kind = rng.randint(0, 260), rng.randint(0, 5)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:
        u = [rng.randint(0, 3) for _ in range(rng.randint(1, 60))]
        return [9] * rng.randint(0, 3) + u * rng.randint(1, 8) + u[: rng.randint(0, len(u))] + [rng.randint(0, 3) for _ in range(20)]
    if kind == 2:
        d = rng.choice([[1, 2], [1, 2, 3], [1]])
        return d * rng.randint(1, 70) + [3] * rng.randint(0, 1) + d[::-1] * rng.randint(1, 70) + d * rng.randint(0, 60)
    if kind == 3:
        a = [1] * rng.randint(1, 60) + [2] * rng.randint(0, 2)
        return a * rng.randint(1, 4) + [1] * rng.randint(0, 70) + [3] + a * rng.randint(0, 3)
    if kind == 4:
        f = [1], [1, 2]
        while len(f[-1]) < n:
            f = f[-1], f[-1] + f[-2]
        return f[-1][:n]
    u, v = ([rng.randint(0, 2) for _ in range(rng.randint(0, 50))] for _ in range(2))
    return u + v + u + v + u * rng.randint(0, 2) + v


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_all_runs(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = periodic.runs(np.array([x for d in docs for x in d], np.int32), at)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(a + o, b + o, q) for d, o in zip(docs, at.tolist(), strict=False) for a, b, q in plain_runs(d)]


def test_runs_stay_cheap_where_everything_repeats():
    n = 60_000
    one = periodic.runs(np.zeros(n, np.int32), np.array([0, n]))
    assert [x.tolist() for x in one] == [[0], [n], [1]]
    period = np.random.default_rng(1).integers(0, 50, 7_001)
    long = periodic.runs(np.resize(period, n), np.array([0, n]))
    assert (0, n, 7_001) in list(zip(*(x.tolist() for x in long), strict=True))


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def plain_digest(ident, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(ident if ident is not None else "null").encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def run_texts():
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice("a bb ccc dé eee".split()) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    texts += [(60 + k, " ".join(map(str, repetitive(rng)))) for k in range(40)]
    texts += [(100, ""), (101, None), (102, " \t\n"), (103, "be " * 3000), (104, "x y\x0bz\n" * 2000), (None, "a b " * 9), (None, None), (5, "one two"), (5, "one two"), (105, "é\xa0é " * 12)]
    return texts


def test_run_digests(spark, run_texts, monkeypatch):
    cols = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter((i, *plain_digest(i, t)) for i, t in run_texts)
    for make in (table, extra):
        got = periodic.run_digests(make(spark, run_texts), planted=True)
        assert got.columns == ["doc_id", *cols]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert periodic.run_digests(table(spark, run_texts).limit(0)).collect() == []
    monkeypatch.setattr("filmspark.llm.words.parts.__defaults__", (16,))
    from filmspark.llm.words import word_ids

    ids, at, names = word_ids([t.encode() for _, t in run_texts if t])
    assert [[names[k].as_py().decode() for k in ids[a:z].tolist()] for a, z in zip(at, at[1:], strict=False)] == [words_of(t) for _, t in run_texts if t]


def test_periodic_runs_and_collapsed_texts(spark, run_texts):
    got = Counter(tuple(r) for r in periodic.periodic_runs(table(spark, run_texts)).collect())
    assert got == Counter((i, s, e - s, q) for i, t in run_texts for s, e, q in plain_runs(words_of(t)))
    out = Counter(tuple(r) for r in periodic.collapsed_texts(table(spark, run_texts)).collect())
    want = []
    for i, t in run_texts:
        w = words_of(t)
        gone = {k for s, e, q in plain_runs(w) for k in range(s + q, e)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, len(gone)))
    assert out == Counter(want)


# ---- quality


def plain_counts(text):
    t = text or ""
    w = words_of(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["on", "ta", "réa", "li#", "<b>", "the", "***"])
    texts = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    texts += [(40, ""), (41, None), (42, " \n\t"), (43, "a b c " * 500), (None, "a b"), (44, "x\n" * 5000), (7, "same same"), (7, "same same"), (45, "é é \x0b|"), (46, "a b"), (47, "c a b c a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (99, 0), (3, None), (2, 1)], "doc_id long, quality int")
    docs = table(spark, texts)
    model = quality.fit(docs, labels, least_rows=2, trees=5)
    want = Counter((i, *plain_counts(t)) for i, t in texts)
    for make in (table, extra):
        got = quality.quality_verdicts(make(spark, texts), model).collect()
        assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.score >= 0.5) and 0 <= r.score <= 1
    assert quality.quality_verdicts(docs.limit(0), model).collect() == []
    idle = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.quality_verdicts(docs, idle).collect()} == {0.5}


def walk(model, row):
    """Margin of one row, a node at a time."""
    total = model.bias
    for node in model.roots.tolist():
        while model.left[node] != node:
            node = int(model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])
        total += model.value[node]
    return total


def test_trees_learn_and_keep_to_their_constraints():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)).round(2)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0] + 3 * np.sin(3 * x[:, 1]) + x[:, 2]))).astype(float)
    sign = np.array([1, 0, -1, 1])
    model = trees.fit_trees(x[:2000], y[:2000], sign)
    assert len(model.roots) == 80
    assert np.allclose(model.margin(x[:50]), [walk(model, r) for r in x[:50]])
    assert ((model.score(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.78
    for f in np.flatnonzero(sign):
        probe = np.repeat(x[:60], 41, axis=0)
        probe[:, f] = np.tile(np.linspace(-4, 4, 41), 60)
        steps = np.diff(model.margin(probe).reshape(60, 41), axis=1) * sign[f]
        assert steps.min() >= -1e-9 and (f == 3 or steps.max() > 0.1)
    # without constraints the second feature isn't monotonic, so constraints do the work above
    free = trees.fit_trees(x[:2000], y[:2000], np.zeros(4))
    probe = np.repeat(x[:60], 41, axis=0)
    probe[:, 0] = np.tile(np.linspace(-4, 4, 41), 60)
    assert np.diff(free.margin(probe).reshape(60, 41), axis=1).min() < -1e-3


def test_held_out_quality(spark):
    """Held-out labels of the smallest table with enough of them."""
    from filmspark.llm import queries

    d = "/root/testdata/sf0.01"
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    got = queries.QUERIES["op12_quality_trees"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(held).select("score", "quality").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in got)
    assert len(got) > 50 and right >= 0.95 * len(got)


# ---- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(texts, every, least, shortest):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def plain_groups(n, factor=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, all_ in near.items():
        top = min(all_, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    for s in stems[:60]:
        for _ in range(4):
            k = rng.randint(0, len(s) - 1)
            stems.append(rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abc") + s[k:], s[:k] + rng.choice("abÿ") + s[k + 1 :]]))
    bag = [w for w in stems for _ in range(rng.choice([1, 4, 5, 6, 30, 200]))]
    rng.shuffle(bag)
    texts = [(i, " ".join(bag[i * 40 : (i + 1) * 40]).replace("ab", "AB", 3) + ("." if i % 2 else "1")) for i in range(-(-len(bag) // 40))]
    texts += [(9001, ""), (9002, None), (None, "abcabc " * 7), (9003, "x" * 400 + " " + ("y" * 400 + " ") * 6 + ("y" * 399 + " ") * 40), (3, "ÀÉabcabc×÷ " * 6), (3, "ÀÉabcabc×÷ " * 6)]
    return texts


@pytest.mark.parametrize("most", [1024, 12])
def test_spelling_variants(spark, spelt, most):
    for make, every in ((table, 7), (extra, None)):
        got = variants.spelling_variants(make(spark, spelt), every=every, most=most)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        rows = [tuple(r) for r in got.collect()]
        want = plain_groups(plain_vocabulary(spelt, every, 5, 6))
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert sum(r[4] for r in rows) > 100 and any(r[1] and r[2] != r[1] for r in rows)
    assert variants.spelling_variants(table(spark, spelt).limit(0)).collect() == []


def test_index_finds_all_pairs_of_one_edit():
    rng = random.Random(5)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(200)})
    q, w = variants.Index(words).near()
    got = sorted((words[i], words[j]) for i, j in zip(q.tolist(), w.tolist(), strict=True))
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))
