"""Language-model scoring by a probabilistic suffix tree over words.

The top of the tree, contexts of one and two of the most frequent words, is bounded and known to every task. The rest has a context for every word, pair or triple of words of the corpus
that passes the divergence test, so it grows with the corpus. It is a table by context: all that follows a context in any text meets in the bucket of its hash, where the context's
counts are added, the test is made, and every text gets the sum of its corrections. Contexts are as long as they must be: a word alone if it is not among the most
frequent, else with the word before, and with two if even the pair is that frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmspark.llm import packed
from filmspark.llm.common import blocks, partitions_for, text_bytes, written

_BLOCK = 4 << 20
#: The token after the last word; no word holds a line end.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))


@dataclass(frozen=True)
class Limits:
    """Shares of all training tokens. They bound what is broadcast, whatever the corpus: at most 1/share entries of each kind.

    word: words whose counts tasks know beforehand; the rest meet their counts in a shuffle. context: words that contexts of the top of the tree are
    made of; the word after such a context may be any of those with a known count. gram: the least share of a context of the top with its next word to be explicit there; a rarer one is
    explicit only after the longer context, of that word and one or two more, which is in the table. tokens: a context that stands for more tokens than that is made longer, whatever
    its share. least: a symbol is explicit after a context of the table from so many occurrences on.
    """

    word: float = 2e-6
    context: float = 1e-4
    gram: float = 2e-6
    tokens: int = 1 << 25
    least: int = 2


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def tokenise(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of a column, the word number of every token (-1: the end of a text), and each text's first token, with a last one past all. A word can have several numbers."""
    data, at = text_bytes(texts)
    low, at = _LOWER[data[at[0] : at[-1]]], at - at[0]
    begins = ~_SPACE[low]
    begins[1:] &= ~begins[:-1]
    inner = at[(at > 0) & (at < len(low))]
    begins[inner] = ~_SPACE[low[inner]]
    first = np.flatnonzero(begins)
    # each piece is a word with the white space after it
    flat = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(low)).astype(np.int64)), pa.py_buffer(low)])
    coded = flat.dictionary_encode()
    n = len(texts)
    starts = np.searchsorted(first, at) + np.arange(n + 1)
    tokens = np.full(int(starts[-1]), -1, np.int64)
    inside = np.ones(len(tokens), bool)
    inside[starts[1:] - 1] = False
    tokens[inside] = coded.indices.to_numpy(zero_copy_only=False)
    return [w.strip() for w in coded.dictionary.to_pylist()], tokens, starts


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and, last, of the end; the word number of every token; first tokens."""
    words, tokens, starts = tokenise(texts)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.append(h, END), np.where(tokens < 0, len(words), tokens), starts


@dataclass
class Model:
    """What every task needs. Words are 64-bit hashes; tables are sorted by key. Probabilities are log10."""

    n: int  # training tokens
    v: int  # distinct ones
    discount: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # frequent words
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    alphabet: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # the more frequent ones, of which contexts are made
    states: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by depth: codes of retained contexts, log of the share left to shorter contexts
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by depth: codes of context and next symbol, log probability
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # codes of pairs of them that are as frequent
    least: int = 2
    word: float = 1e-5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1.0)

    def root(self, c: np.ndarray) -> np.ndarray:
        """Absolute discounting; what it frees is the share of the one symbol that stands for all unknown words."""
        if not self.n:
            return np.zeros(len(c))
        return np.log10(np.where(c > 0, np.maximum(c, 1) - self.discount, self.discount * self.v) / self.n)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _before(symbol: np.ndarray, first: np.ndarray, depth: int, m: int) -> np.ndarray:
    """Code of the `depth` symbols before each token, -1 where a text or the alphabet ends it."""
    code = np.zeros(len(symbol), np.int64)
    for k in range(1, depth + 1):
        before = np.full(len(symbol), -1, np.int64)
        before[k:] = symbol[: max(0, len(symbol) - k)]
        before[first < k] = -1
        code = np.where((code >= 0) & (before >= 0), code + before * m ** (k - 1), -1)
    return code


def _within(starts: np.ndarray) -> np.ndarray:
    """Number of each token within its text."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def _steps(keys: np.ndarray) -> np.ndarray:
    """Keys in order, each as its distance from the one before."""
    return np.diff(keys, prepend=np.uint64(0))


def _counted(docs: DataFrame, make, least: float, partitions: int) -> DataFrame:
    """Sums of (key, count) pairs that `make` gives for each block of training texts: (kind, key, n). kind 1: keys with at least `least` of their task's sum,
    0: key 0 tokens, 1 distinct keys, 2 keys counted once, 3 twice."""
    n_buckets = partitions * packed.BUCKETS_EACH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", _BLOCK):
            keys, n = make(b.column(0))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            rows = [(k, packed.squeezed([_steps(keys[at]), n[at]])) for k, at in packed.by_bucket(keys, n_buckets)]
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("bucket", pa.int32()), ("entries", pa.binary())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in batches:
            for k, c in (packed.stretched(x.as_buffer()) for x in b.column(1)):
                parts.append((np.cumsum(k, dtype=np.uint64), c.astype(np.int64)))
                held += len(k)
                if held > 2 * len(keys) + (1 << 20):
                    keys, n = packed.sums(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([n, *(p[1] for p in parts)]))
                    parts, held = [], 0
        keys, n = packed.sums(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([n, *(p[1] for p in parts)]))
        if len(keys):
            total = int(n.sum())
            often = n >= max(1.0, least * total)
            k = np.concatenate([np.arange(4), keys[often].view(np.int64)])
            c = np.concatenate([[total, len(keys), (n == 1).sum(), (n == 2).sum()], n[often]]).astype(np.int64)
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(4, np.int32), np.ones(int(often.sum()), np.int32)])), pa.array(k), pa.array(c)], names=["kind", "key", "n"])

    sent = packed.deal(docs.mapInArrow(count, "bucket int, entries binary"), partitions)
    return sent.mapInArrow(add, "kind int, key long, n long")


def _word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, tokens, _ = _hashed(texts)
    n = np.bincount(tokens, minlength=len(h))
    return h[n > 0], n[n > 0]


def _gram_counts(words: np.ndarray, alphabet: np.ndarray):
    m, size = len(alphabet), len(words)

    def make(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, tokens, starts = _hashed(texts)
        symbol, word, first = _find(alphabet, h)[tokens], _find(words, h)[tokens], _within(starts)
        keys = []
        for depth in (1, 2):
            context = _before(symbol, first, depth, m)
            some = (context >= 0) & (word >= 0)
            keys.append((context[some] * size + word[some] << 2 | depth).view(np.uint64))
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        # an odd multiplier maps codes one to one and spreads them over the buckets
        return k * _SPREAD, n

    return make


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GATHER = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def grow(model: Model, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Add the contexts that pass the divergence test, shorter ones first. grams[d]: sorted codes of d + 1 context symbols and the next word, and their counts.

    A context keeps explicit probabilities of those next words whose log-likelihood gained over the next shorter retained context (count times log of the ratio) exceeds half a log of the training
    size, discounted by half a count; the share left goes to that shorter context, scaled to what it gives all other words. It is retained if what its explicit words gain, less what the others
    lose, is more than that cost for each: the same test as that of the table's contexts.
    """
    cost = 0.5 * np.log(max(2, model.n))
    m, size = len(model.alphabet), len(model.words)
    unigram = 10 ** model.root(model.counts)
    place = _find(model.words, model.alphabet)
    for depth, (codes, n) in enumerate(grams):
        context, symbol = (codes // size, codes % size) if size else (codes, codes)
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.zeros(0, np.int64)
        which, state = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(codes)))), context[start]
        if depth == 0:
            total = model.counts[place[state]] if m else state
            before = unigram[symbol]
        else:
            # how often a context of two words is the first one followed by the second
            at = _find(grams[depth - 1][0], state // m * size + place[state % m]) if m else state
            total = np.where(at >= 0, grams[depth - 1][1][at] if len(grams[depth - 1][0]) else 0, 0)
            before = 10 ** _log(model, depth - 1, context % max(1, m**depth), symbol, np.log10(unigram[symbol]))
        by = lambda x: np.bincount(which, x, len(start))
        p = np.maximum(n - 0.5, 0.25) / np.maximum(total, 1)[which]
        gain = n * np.log(p / before)
        explicit = gain > cost
        told, known, shown = (by(np.where(explicit, x, 0.0)) for x in (p, before, n))
        with np.errstate(divide="ignore", invalid="ignore"):
            left = (1 - told) / (1 - known)
            net = by(np.where(explicit, gain - cost, 0.0)) + np.maximum(total - shown, 0) * np.log(left)
        keep = (total > 0) & (shown > 0) & (known < 1 - 1e-9) & (told < 1 - 1e-9) & (net > 0)
        rows = keep[which] & explicit
        model.states.append((state[keep], np.log10(left[keep])))
        model.grams.append((codes[rows], np.log10(p[rows])))


def _log(model: Model, depth: int, context: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Log probability of each word (its place, -1: unknown) after its context of depth + 1 symbols (-1: none), from the longest retained suffix. root: that of the word alone, or 0 to leave it out."""
    if depth < 0 or not len(context):
        return root
    m, size = len(model.alphabet), len(model.words)
    shorter = _log(model, depth - 1, np.where(context >= 0, context % m**depth, -1) if depth else context, symbol, root)
    codes, left = model.states[depth]
    at = _find(codes, context)
    held = (at >= 0) & (context >= 0)
    gram = _find(model.grams[depth][0], np.where(held & (symbol >= 0), context * size + symbol, -1))
    out = np.where(held, shorter + (left[at] if len(left) else 0.0), shorter)
    return np.where(gram >= 0, model.grams[depth][1][gram] if len(model.grams[depth][1]) else 0.0, out)


def fit(docs: DataFrame, train: Column, text_col: str = "text", limits: Limits = Limits(), total_bytes: int = 0) -> Model:
    """Count words over all training texts, then contexts made of frequent words over all of them again, and keep the contexts that pass the test."""
    texts = docs.where(train).select(F.col(text_col).alias("text"))
    parts = partitions_for(docs, total_bytes, 16 << 20)
    found = written(_counted(texts, _word_counts, limits.word, parts), "words")
    stats = dict(found.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).collect())
    n, v, n1, n2 = (stats.get(k, 0) for k in range(4))
    model = Model(n, v, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, least=limits.least, word=limits.word)
    if not n:
        return model
    often = found.where((F.col("kind") == 1) & (F.col("n") >= limits.word * n)).select("key", "n").toPandas()  # at most 1 / limits.word rows
    keys, c = often.key.to_numpy(np.int64).view(np.uint64), often.n.to_numpy(np.int64)
    order = np.argsort(keys)
    model.words, model.counts = keys[order], c[order]
    hot = min(limits.context * n, limits.tokens)
    model.alphabet = model.words[model.counts >= hot]
    found = _counted(texts, _gram_counts(model.words, model.alphabet), limits.gram, parts)
    often = found.where((F.col("kind") == 1) & (F.col("n") >= max(2.0, limits.gram * n))).select("key", "n").toPandas()  # at most 1 / limits.gram rows a depth
    keys = often.key.to_numpy(np.int64).view(np.uint64) * _GATHER
    code, depth, c = (keys >> np.uint64(2)).astype(np.int64), (keys & np.uint64(3)).astype(np.int64), often.n.to_numpy(np.int64)
    grams = []
    for d in (1, 2):
        k, x = code[depth == d], c[depth == d]
        order = np.argsort(k)
        grams.append((k[order], x[order]))
    # a pair that is so frequent is one of words of the alphabet
    code, size = grams[0][0][grams[0][1] >= hot], len(model.words)
    model.pairs = np.sort(code // size * len(model.alphabet) + _find(model.alphabet, model.words[code % size]))
    grow(model, grams)
    return model


@dataclass
class _Block:
    """A block of texts as numbers: of every token its text, its word's number, and its log10 probability after the top of the tree (`rare` words: without their own share)."""

    hashes: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    within: np.ndarray
    text: np.ndarray
    often: np.ndarray
    place: np.ndarray
    logs: np.ndarray
    symbol: np.ndarray


def _placed(model: Model, texts: pa.Array) -> _Block:
    h, tokens, starts = _hashed(texts)
    at = _find(model.words, h)
    c = np.where(at >= 0, model.counts[at] if len(model.counts) else 0, 0)
    root = np.where((at >= 0)[tokens], model.root(c)[tokens], 0.0)
    m = len(model.alphabet)
    symbol, word = _find(model.alphabet, h)[tokens], at[tokens]
    first = _within(starts)
    logs = root
    if model.states:
        context, one = (_before(symbol, first, depth, m) for depth in (len(model.states), 1))
        logs = np.where(context >= 0, _log(model, len(model.states) - 1, context, word, root), _log(model, 0, one, word, root))
    return _Block(h, tokens, starts, first, np.repeat(np.arange(len(texts)), np.diff(starts)), (at >= 0)[tokens], at, logs, symbol)


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def long_contexts(model: Model, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the context of each token, and whether it is a single word: the word before; if that is of the alphabet the pair before; if that is one of the frequent pairs the triple before. 0: the text begins too late for one."""
    n, m, key = len(b.tokens), len(model.alphabet), np.zeros(len(b.tokens), np.uint64)
    word = b.hashes[b.tokens]
    before = []
    for k in (1, 2, 3):
        w, s = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        w[k:], s[k:] = word[: max(0, n - k)], b.symbol[: max(0, n - k)]
        before.append((w, np.where(b.within >= k, s, -1), b.within >= k))
    (w1, s1, in1), (w2, s2, in2), (w3, _, in3) = before
    frequent = (s1 >= 0) & (s2 >= 0)
    frequent[frequent] = _find(model.pairs, s2[frequent] * m + s1[frequent]) >= 0
    one = in1 & (s1 < 0)
    two = in2 & (s1 >= 0) & ~frequent
    three = in3 & frequent
    key[one] = w1[one]
    key[two] = w1[two] * _MIX[0] + w2[two] * _MIX[1] + np.uint64(1)
    key[three] = w1[three] * _MIX[0] + w2[three] * _MIX[1] + w3[three] * _MIX[2] + np.uint64(2)
    key ^= key >> np.uint64(29)
    key *= _MIX[2]
    key ^= key >> np.uint64(32)
    key[~(one | two | three)] = 0
    return key, one


def _bound(model: Model) -> float:
    """Log10 of the most that a word without a known count can have of all tokens."""
    return float(np.log10(min(1.0, max(model.word, 1.0 / max(1, model.n)))))


def _flags(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    out = np.ones(len(values), bool)  # of no values: none
    out[1:] = values[1:] != values[:-1]
    return out


#: Within its bucket a context is known by 36 bits, and a rare word after a context by 40.
_SHORT = np.uint64(28)
_WORD = np.uint64(24)


def _long_rows(model: Model, b: _Block, is_train: np.ndarray, block: int, n_buckets: int) -> Iterator[tuple]:
    """What a block tells the buckets of its contexts: the symbols after each (the place of a frequent word, or a rare word's hash), their training counts, their log probability without the context
    where that isn't the word's own, and the texts that they occur in. Contexts are in order, and each is told by its distance from the one before."""
    key, single = long_contexts(model, b)
    at = np.flatnonzero(key)
    if not len(at):
        return
    key, word, single = key[at], b.tokens[at], single[at]
    bucket = key % np.uint64(n_buckets)
    # stable, so texts stay in order: by context and word, then by bucket
    order = np.argsort((key >> _SHORT) << np.uint64(22) | word.astype(np.uint64), kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32), kind="stable")]
    at, key, word, bucket, single = at[order], key[order], word[order], bucket[order], single[order]
    text, often = b.text[at], b.often[at]
    new_key = _flags(key >> _SHORT) | _flags(bucket)
    new_gram = new_key | _flags(word)
    new_text = new_gram | _flags(text)
    gram, pair = np.flatnonzero(new_gram), np.flatnonzero(new_text)
    count = np.add.reduceat(is_train[text].astype(np.int64), gram)
    times = np.diff(np.append(pair, len(at)))
    texts_of = np.diff(np.append(np.searchsorted(pair, gram), len(pair)))
    contexts = np.flatnonzero(new_key)
    sizes = np.diff(np.append(np.searchsorted(gram, contexts), len(gram)))
    before = (b.logs[at[gram]] + np.where(often[gram], 0.0, _bound(model))).astype(np.float32)
    place, hashes, rare, single = b.place[word[gram]], b.hashes[word[gram]], ~often[gram], single[gram]
    cuts = np.flatnonzero(_flags(bucket))
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist(), strict=True):
        c, g, t = (slice(*np.searchsorted(x, (lo, hi))) for x in (contexts, gram, pair))
        r = rare[g]
        # a symbol is 0 where a rare word's hash follows, else one more than its place
        short = key[contexts[c]] >> _SHORT
        values = [_steps(short), sizes[c], single[g], np.where(r, 0, place[g] + 1), hashes[g][r] >> _WORD, count[g], before[g][~single[g]], texts_of[g], text[pair[t]], times[t]]
        yield int(bucket[lo]), block, packed.squeezed([x.astype(np.uint8) if x.dtype == bool else x for x in values])


def _entries(model: Model, blob: bytes) -> list[np.ndarray]:
    """Of each entry of such a row the context, the symbol, whether that is a rare word, its count, its log probability before, and its number of texts; then the texts and times of all."""
    key, sizes, single, symbol, hashes, count, before, texts_of, texts, times = packed.stretched(blob)
    rare, single = symbol == 0, single > 0
    full = symbol.astype(np.uint64)
    full[rare] = hashes
    own = np.full(len(symbol), _bound(model), np.float32)
    if len(model.counts):
        own = np.where(rare, own, model.root(model.counts[np.maximum(symbol.astype(np.int64) - 1, 0)])).astype(np.float32)
    own[~single] = before
    return [np.repeat(np.cumsum(key, dtype=np.uint64), sizes), full, rare, count.astype(np.int64), own, texts_of.astype(np.int64), texts.astype(np.uint32), times.astype(np.uint32)]


def corrections(key: np.ndarray, symbol: np.ndarray, count: np.ndarray, before: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What each (context, symbol) entry adds to the log10 probability that it has without its context, and whether it is explicit. Entries of one pair may come more than once; before is log10.

    A symbol is explicit after a context if it occurs `least` times there and the log-likelihood gained (count times log of the ratio) exceeds half a log of the training size. The context is retained if
    what its explicit symbols gain, less what the others lose, is more than that cost for each. Explicit symbols give up half a count; the share left is scaled to what the others have without it.
    """
    order = np.lexsort((symbol, key))
    k, s = key[order], symbol[order]
    new_key = _flags(k)
    gram = np.flatnonzero(new_key | _flags(s))
    total = np.add.reduceat(count[order], gram)
    old = np.minimum(before[order][gram].astype(np.float64), 0.0)
    context = np.cumsum(new_key)[gram] - 1
    size = int(context[-1]) + 1
    by = lambda x: np.bincount(context, x, size)
    all_ = by(total)
    cost = 0.5 * np.log(max(2, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.maximum(total - 0.5, 0.25) / np.maximum(all_, 1)[context]
        gain = total * (np.log(p) - old * np.log(10))
        explicit = (total >= least) & (gain > cost)
        told, known = by(np.where(explicit, p, 0.0)), by(np.where(explicit, 10**old, 0.0))
        left = (1 - told) / (1 - known)
        net = by(np.where(explicit, gain - cost, 0.0)) + (all_ - by(np.where(explicit, total, 0))) * np.log(left)
        kept = (by(explicit) > 0) & (told < 1 - 1e-9) & (known < 1 - 1e-9) & (net > 0)
        value = np.where(kept[context], np.where(explicit, np.log10(p) - old, np.log10(left)[context]), 0.0)
    explicit &= kept[context]
    of = np.cumsum(new_key | _flags(s)) - 1
    out, mark = np.empty(len(key)), np.empty(len(key), bool)
    out[order], mark[order] = value[of], explicit[of]
    return out, mark


def _answers(model: Model, messages: list[tuple[int, bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One bucket of contexts. messages: (number of a block, packed entries). (place, sum): what texts are to add, place being the block's number and the text's; and (place, word, times): rare words that
    are explicit after their context, whose own share is to be taken back."""
    held = [_entries(model, x) for _, x in messages]
    of = np.repeat(np.array([block for block, _ in messages], np.int64), [len(x[1]) for x in held])
    key, symbol, rare, count, before, texts_of, texts, times = (np.concatenate([x[i] for x in held]) for i in range(8))
    held.clear()
    # a rare word's hash and a frequent one's place are different symbols
    value, explicit = corrections(key, np.where(rare, symbol | np.uint64(1 << 63), symbol), count, before, model.n, model.least)
    back = rare & explicit
    # the bound stood for a share that such a word is given where it is counted
    value[back] += _bound(model)
    entry = np.repeat(np.arange(len(key), dtype=np.int32), texts_of)
    some = value[entry] != 0
    e = entry[some]
    sums = [of[e] << 32 | texts[some].astype(np.int64), times[some] * value[e]]
    some = back[entry]
    e = entry[some]
    return sums, [of[e] << 32 | texts[some].astype(np.int64), symbol[e], times[some]]


def _ranges(*sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run in which all arrays stay the same."""
    n = len(sorted_[0])
    if n:
        first = np.flatnonzero(np.logical_or.reduce([_flags(x) for x in sorted_]))
        yield from zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True)


def _packed_words(word: np.ndarray, trained: np.ndarray, text: np.ndarray, times: np.ndarray) -> bytes:
    """Words in order with the texts that have them: each word once, its training count, its number of texts, and the texts and times of all."""
    first = np.flatnonzero(_flags(word))
    sizes = np.diff(np.append(first, len(word)))
    return packed.squeezed([_steps(word[first]), np.add.reduceat(trained, first), sizes, text, times])


def _local(model: Model, b: _Block, is_train: np.ndarray):
    """What a task can score alone: by text (tokens, known ones, base, score); and its rare tokens: hashes, count in training texts, texts and counts of each."""
    n = len(b.starts) - 1
    c = np.where(b.place >= 0, model.counts[b.place] if len(model.counts) else 0, 0)
    base = np.where(b.often, model.base(c)[b.tokens], 0.0)
    by = lambda x: np.bincount(b.text, x, n)
    # rare tokens, once for each text and word
    rare = ~b.often
    pair, times = np.unique(b.tokens[rare] * np.int64(n) + b.text[rare], return_counts=True)
    word, of = pair // max(1, n), pair % max(1, n)
    return (np.diff(b.starts), by(b.often).astype(np.int64), by(base), by(b.logs)), (b.hashes[word], np.where(is_train[of], times, 0), of.astype(np.uint32), times.astype(np.uint32))


#: kind 0: what a block scored alone; 1: its rare words; 2: its contexts.
_SENT = "kind int, bucket int, block long, entries binary, ids binary, local binary"
#: kind 0: what a block scored alone; 1: sums for its texts; 2: words to be taken back, by the bucket of the word; 3: counts of words.
_MET = "kind int, bucket int, block long, entries binary, ids binary, local binary, base binary, score binary"


def _schema(columns: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], types[x.split()[1]]) for x in columns.split(", ")])


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), schema.types, strict=True)], schema=schema)


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; ids must be of type long.

    Tokens are words (ASCII letters lowered, cut at ASCII white space) and one end. base_score is the add-one unigram of the contract. score is
    the tree's log10 probability; like the base it has one symbol for all words unknown in training. Contexts have up to three
    words. Words are known by 64-bit hashes, contexts by 36 bits and their bucket. Null texts count as empty: one end. Null ids never train. Repeated rows train and are
    scored each; extra columns are ignored. Without training texts every score is 0. An empty table gives an empty one.

    Frequent words and the top of the tree are broadcast, bounded by `limits`. All other words of all texts go to the task of their hash,
    which counts them in training texts and sends each text its sum; so do all contexts with what follows them. A word without a known count counts with the most that it
    can have where a context's gain is judged, so that the gain is never overstated. A word that is explicit after its context is not to have its own share too: it is taken back once its count is known.
    """
    is_train = F.coalesce(train, F.lit(False))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    model = fit(docs, is_train, text_col, limits, total)
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), is_train.alias("train"))
    parts = max(12, -(-total // (16 << 20)))
    word_buckets, long_buckets = parts * 2, parts * 4
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, numbers = _schema(_SENT), packed.block_ids()
        for batch in blocks(batches, "text", _BLOCK):
            block, flag = next(numbers), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            b = _placed(shared.value, batch.column(0))
            local, (word, trained, of, times) = _local(shared.value, b, flag)
            ids = batch.column(1)
            whole = np.stack([*(x.astype(np.float64) for x in local), flag.astype(np.float64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)])
            rows = [(0, block % word_buckets, block, None, pc.fill_null(ids, 0).to_numpy().tobytes(), whole.tobytes())]
            order = np.argsort(word, kind="stable")
            word, trained, of, times = (x[order] for x in (word, trained, of, times))
            rows += [(1, k, block, _packed_words(word[at], trained[at], of[at], times[at]), None, None) for k, at in packed.by_bucket(word >> _WORD, word_buckets)]
            yield from _batches(rows, schema)
            yield from _batches([(2, k, block, x, None, None) for k, block, x in _long_rows(shared.value, b, flag, block, long_buckets)], schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, schema = shared.value, _schema(_MET)
        # messages stay compressed until their bucket's turn
        words: list[tuple[int, bytes]] = []
        contexts: dict[int, list] = {}
        place: dict[int, int] = {}
        for b in batches:
            for i, (kind, bucket, block) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if kind == 0:
                    yield pa.record_batch([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([None], pa.binary()), b.column(4).slice(i, 1), b.column(5).slice(i, 1), *(pa.array([None], pa.binary()),) * 2], schema=schema)
                    continue
                at = place.setdefault(block, len(place))
                (words if kind == 1 else contexts.setdefault(bucket, [])).append((at, b.column(3)[i].as_py()))
        names = np.array(list(place), np.int64)
        # what each text is to add: number of known words, base, score
        spot, known, base, score, back = [], [], [], [], []
        if words:
            told = [packed.stretched(x)[:2] for _, x in words]
            keys, c = packed.sums(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in told]), np.concatenate([x for _, x in told]).astype(np.int64))
            told.clear()
            for at, x in words:
                w, _, sizes, of, times = packed.stretched(x)
                n, times = np.repeat(c[np.searchsorted(keys, np.cumsum(w, dtype=np.uint64))], sizes), times.astype(np.float64)
                spot.append(np.int64(at) << 32 | of.astype(np.int64))
                known.append(times * (n > 0))
                base.append(times * model.base(n))
                score.append(times * model.root(n))
            short = keys >> _WORD
            for k, at in packed.by_bucket(short, word_buckets):
                yield from _batches([(3, k, None, packed.squeezed([_steps(short[at]), c[at]]), None, None, None, None)], schema)
        for k in sorted(contexts):
            (at, value), taken = _answers(model, contexts.pop(k))
            spot.append(at)
            known.append(np.zeros(len(at)))
            base.append(np.zeros(len(at)))
            score.append(value)
            back.append(taken)
        if not spot:
            return
        at = np.concatenate(spot)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(_flags(at))
        known, base, score = (np.add.reduceat(np.concatenate(x)[order], first) if len(first) else np.zeros(0) for x in (known, base, score))
        at = at[first]
        rows = [(1, 0, int(names[at[lo] >> 32]), packed.squeezed([at[lo:hi] & 0xFFFFFFFF, known[lo:hi].astype(np.int64)]), None, None, base[lo:hi].tobytes(), score[lo:hi].astype(np.float32).tobytes()) for lo, hi in _ranges(at >> 32)]
        yield from _batches(rows, schema)
        if not back:
            return
        at, word, times = (np.concatenate(x) for x in zip(*back, strict=True))
        back.clear()
        bucket = (word % np.uint64(word_buckets)).astype(np.int64)
        order = np.lexsort((word, bucket))
        at, word, times, bucket = at[order], word[order], times[order], bucket[order]
        # one row for each bucket of words, whatever blocks they are for
        rows = []
        for lo, hi in _ranges(bucket):
            used, block = np.unique(at[lo:hi] >> 32, return_inverse=True)
            rows.append((2, int(bucket[lo]), None, packed.squeezed([names[used].astype(np.uint64), block, at[lo:hi] & 0xFFFFFFFF, _steps(word[lo:hi]), times[lo:hi]]), None, None, None, None))
        yield from _batches(rows, schema)

    def take_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, schema, told, asked = shared.value, _schema(_MET), [], []
        for b in batches:
            for kind, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                (told if kind == 3 else asked).append(x)
        if not asked:
            return
        told = [packed.stretched(x) for x in told]
        keys, c = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in told]), np.concatenate([x.astype(np.int64) for _, x in told])
        order = np.argsort(keys, kind="stable")
        keys, c = keys[order], c[order]
        blocks_, texts, values = [], [], []
        for x in asked:
            names, block, text, word, times = packed.stretched(x)
            n = c[np.searchsorted(keys, np.cumsum(word, dtype=np.uint64))]
            blocks_.append(names.astype(np.int64)[block])
            texts.append(text.astype(np.int64))
            values.append(-times.astype(np.float64) * model.root(n))
        block, text, value = np.concatenate(blocks_), np.concatenate(texts), np.concatenate(values)
        order = np.lexsort((text, block))
        block, text, value = block[order], text[order], value[order]
        first = np.flatnonzero(_flags(block) | _flags(text))
        block, text, value = block[first], text[first], np.add.reduceat(value, first)
        rows = [(1, 0, int(block[lo]), packed.squeezed([text[lo:hi], np.zeros(hi - lo, np.int64)]), None, None, np.zeros(hi - lo).tobytes(), value[lo:hi].astype(np.float32).tobytes()) for lo, hi in _ranges(block)]
        yield from _batches(rows, schema)

    n, v = model.n, model.v

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf.kind == 0].iloc[0]
        ids = np.frombuffer(head.ids, np.int64)
        tokens, known, base, score, flag, valid = np.frombuffer(head.local, np.float64).reshape(6, -1).copy()
        for r in pdf[pdf.kind == 1].sort_values(["entries", "score"]).itertuples():
            at, more = packed.stretched(r.entries)
            known[at] += more
            base[at] += np.frombuffer(r.base, np.float64)
            score[at] += np.frombuffer(r.score, np.float32)
        out = pd.DataFrame({"id": pd.array(ids, "Int64"), "train": flag > 0, "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": n, "base_score": base - tokens * np.log10(n + v + 1), "score": score})
        out.loc[valid == 0, "id"] = pd.NA
        return out

    met = written(packed.deal(src.mapInArrow(send, _SENT), parts).mapInArrow(meet, _MET), "met")
    back = packed.deal(met.where("kind >= 2"), max(12, parts // 8)).mapInArrow(take_back, _MET)
    done = met.where("kind < 2").unionByName(back).groupBy("block").applyInPandas(finish, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
