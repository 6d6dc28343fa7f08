"""The language model against a plain restatement over whole texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from filmspark.llm import pst, toxicity
from pyspark.sql import functions as F


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()



def brute_scores(texts, train, limits):
    """The tree's log10 probability of every text, from dictionaries: counts, the top of the tree, then the longer contexts."""
    toks = {i: [*low(t).split(), None] for i, t in texts.items()}
    learn = [t for i, t in toks.items() if train(i)]
    count = Counter(w for t in learn for w in t)
    n, v = sum(count.values()), len(count)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    root = lambda w: math.log10((count[w] - d if count[w] else d * v) / n)
    often = {w for w, c in count.items() if c >= limits.word * n}
    hot = {w for w in often if count[w] >= min(limits.context * n, limits.tokens)}
    cost, bound = 0.5 * math.log(n), math.log10(min(1.0, max(limits.word, 1 / n)))
    grams = [Counter(tuple(t[k - m : k + 1]) for t in learn for k in range(m, len(t)) if set(t[k - m : k]) <= hot and t[k] in often) for m in (1, 2)]
    grams = [{g: c for g, c in x.items() if c >= max(2.0, limits.gram * n)} for x in grams]
    states = [{}, {}]

    def top(context, w):
        """After the last one or two words, all of them frequent: log10, without a rare word's own share."""
        for m in (2, 1):
            state = states[m - 1].get(tuple(context[-m:])) if len(context) >= m and set(context[-m:]) <= hot else None
            if state:
                return state[0][w] if w in state[0] else state[1] + top(context[-m + 1 :] if m > 1 else [], w)
        return root(w) if w in often else 0.0

    for m in (0, 1):
        fresh = {}
        after = defaultdict(dict)
        for g, c in grams[m].items():
            after[g[:-1]][g[-1]] = c
        for context, nexts in after.items():
            total = count[context[0]] if m == 0 else grams[0].get(context, 0)
            if not total:
                continue
            p = {w: max(c - 0.5, 0.25) / total for w, c in nexts.items()}
            before = {w: 10 ** top(list(context[1:]), w) for w in nexts}
            gain = {w: c * math.log(p[w] / before[w]) for w, c in nexts.items()}
            told, known, shown = (sum(x[w] for w in nexts if gain[w] > cost) for x in (p, before, nexts))
            if not shown or told >= 1 - 1e-9 or known >= 1 - 1e-9:
                continue
            left = (1 - told) / (1 - known)
            if sum(x - cost for x in gain.values() if x > cost) + max(total - shown, 0) * math.log(left) > 0:
                fresh[context] = ({w: math.log10(x) for w, x in p.items() if gain[w] > cost}, math.log10(left))
        states[m] = fresh

    pairs = {g for g, c in grams[0].items() if c >= min(limits.context * n, limits.tokens)}

    def long(t, k):
        if k >= 1 and t[k - 1] not in hot:
            return (t[k - 1],)
        if k >= 2 and tuple(t[k - 2 : k]) not in pairs:
            return tuple(t[k - 2 : k])
        return tuple(t[k - 3 : k]) if k >= 3 else None

    table, before = defaultdict(Counter), {}
    for i, t in toks.items():
        for k in range(len(t)):
            if (c := long(t, k)) is not None:
                table[c][t[k]] += train(i)
                before[c, t[k]] = min(0.0, float(np.float32(top(t[max(0, k - 2) : k], t[k]) + (0.0 if t[k] in often else bound))))
    fix = {}
    for c, nexts in table.items():
        total = sum(nexts.values())
        p = {w: max(x - 0.5, 0.25) / max(total, 1) for w, x in nexts.items()}
        gain = {w: x * (math.log(p[w]) - before[c, w] * math.log(10)) for w, x in nexts.items()}
        explicit = {w for w, x in nexts.items() if x >= limits.least and gain[w] > cost}
        told, known = sum(p[w] for w in explicit), sum(10 ** before[c, w] for w in explicit)
        if explicit and told < 1 - 1e-9 and known < 1 - 1e-9:
            left = (1 - told) / (1 - known)
            if sum(gain[w] - cost for w in explicit) + (total - sum(nexts[w] for w in explicit)) * math.log(left) > 0:
                fix[c] = ({w: math.log10(p[w]) for w in explicit}, math.log10(left))
    out, used = {}, Counter()
    for i, t in toks.items():
        out[i] = 0.0
        for k, w in enumerate(t):
            c = long(t, k)
            own = top(t[max(0, k - 2) : k], w) + (0.0 if w in often else root(w))
            if c in fix:
                used[len(c), w in fix[c][0], w in often] += 1
                own = fix[c][0][w] if w in fix[c][0] else own + fix[c][1]
            out[i] += own
    return out, used


@pytest.mark.parametrize("limits", [pst.Limits(), pst.Limits(0.004, 0.02, 1e-3), pst.Limits(0.004, 0.9, 1e-3, tokens=40), pst.Limits(0.004, 0.02, 1e-3, least=3), pst.Limits(2.0, 2.0, 2.0)])
def test_scores_equal_brute_force(spark, limits):
    rng = random.Random(11)
    common = ["the", "of", "and", "a"]
    phrase = [[f"p{j}x{k}" for k in range(6)] for j in range(5)]
    texts = {}
    for i in range(120):
        w = []
        while len(w) < 50:
            x = rng.random()
            w += rng.choice(phrase) if x < 0.1 else ["of", "the"] if x < 0.5 else [rng.choice(common)] if x < 0.7 else [f"w{rng.randrange(400)}"]
        texts[i] = " ".join(w)
    texts |= {120: None, 121: "", 122: "the", 123: texts[0].upper(), 124: "unseen words only", 125: "of the " * 3000}
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in texts.items()], "doc_id long, text string, score double, train string").repartition(3)
    got = {r.doc_id: r.score for r in pst.scores(df, toxicity.remainder("doc_id", 7) != 2, limits=limits).collect()}
    want, used = brute_scores(texts, train, limits)
    assert got == pytest.approx(want, rel=1e-5, abs=1e-4)
    if limits == pst.Limits(0.004, 0.02, 1e-3):
        # contexts of one to three words, and a rare word that is explicit
        assert {k[0] for k in used} == {1, 2, 3} and {k[1] for k in used} == {True, False} and (1, True, False) in used


def test_a_rarer_word_after_a_frequent_one(spark):
    """A word that isn't frequent is explicit after one frequent word, and scores better there than by itself."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)} the zebra" if rng.random() < 0.05 else rng.choice(["the", "of", f"w{rng.randrange(300)}"]) for _ in range(60)) for _ in range(200)]
    texts += ["w1 the zebra", "w1 w2 zebra"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limits = pst.Limits(1e-4, 0.05, 1e-4)
    got = {r.doc_id: r.score for r in pst.scores(df, F.col("doc_id") < 200, limits=limits).collect()}
    want, _ = brute_scores(dict(enumerate(texts)), lambda i: i < 200, limits)
    assert got == pytest.approx(want, rel=1e-5, abs=1e-4)
    assert got[200] > got[201] + 1
    few = pst.fit(df, F.col("doc_id") < 200, limits=limits)
    place = {int(h): i for i, h in enumerate(few.words.tolist())}
    import xxhash

    ctx, nxt = (xxhash.xxh64_intdigest(w) for w in (b"the", b"zebra"))
    code = few.alphabet.tolist().index(ctx) * len(few.words) + place[nxt]
    assert nxt not in few.alphabet.tolist() and code in few.grams[0][0].tolist()


def test_repeated_rows_train_and_score_each(spark):
    rows = [(1, "a b c a b c"), (1, "a b c a b c"), (8, "a b c"), (None, "a b c")]
    got = pst.scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1 and {r.train_tokens for r in got} == {22}
