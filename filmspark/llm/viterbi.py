"""SentencePiece encoding and decoding by a Viterbi search that distinct words with a common prefix share."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text whose words are sorted and segmented together.
_SLICE = 1 << 20
#: A word with all the spaces before it, a line end, or spaces that no word follows. No piece goes on beyond a word, so the best segmentation of a text is those of its units.
_UNITS = re.compile(r" *[^ \n]+|\n| +")
#: A unit of more characters is segmented alone, with a trace of a few bytes for each.
_LONG = 4096


class Pieces:
    """The vocabulary of a model file: pieces, scores and byte pieces; the search tree over pieces that can stand in text."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        skip = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.raw = [b""] * n
        self.tree: list = [{}, -1, 0.0]
        scores = [sp.get_score(i) for i in range(n) if not skip[i]]
        #: Characters without a piece of their own get byte pieces, at this score for the character.
        self.unknown = min(scores) - 10.0
        for i, name in enumerate(names):
            if sp.is_byte(i):
                b = int(name[3:5], 16)
                self.byte_ids[b] = i
                self.raw[i] = bytes((b,))
            elif not skip[i]:
                self.raw[i] = name.replace(MARK, " ").encode()
                node = self.tree
                for c in name.replace(MARK, " "):
                    node = node[0].setdefault(c, [{}, -1, 0.0])
                node[1], node[2] = i, sp.get_score(i)
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each of the sorted, distinct units: the segmentation with the largest sum of scores; of equal ones, that with the longest last piece.

        In sorted order the units are the leaves of a trie met depth-first. Scores at a position depend on the prefix alone, so a unit starts
        from the scores, back pointers and open pieces of the prefix it has in common with the one before.
        """
        root, unknown = self.tree, self.unknown
        best, back, ids, open_at = [0.0], [0], [-1], [[]]
        last, out = "", []
        for unit in units:
            if len(unit) > _LONG:
                out.append(self._encode_long(unit))
                continue
            n = min(len(unit), len(last))
            d = 0
            while d < n and unit[d] == last[d]:
                d += 1
            del best[d + 1 :], back[d + 1 :], ids[d + 1 :], open_at[d + 1 :]
            for d in range(d, len(unit)):
                c = unit[d]
                alive, top, at, piece = [], -1e300, d, -1
                for i, node in open_at[d]:
                    child = node[0].get(c)
                    if child is not None:
                        alive.append((i, child))
                        if child[1] >= 0 and best[i] + child[2] > top:
                            top, at, piece = best[i] + child[2], i, child[1]
                child = root[0].get(c)
                if child is not None:
                    alive.append((d, child))
                    if child[1] >= 0 and best[d] + child[2] > top:
                        top, at, piece = best[d] + child[2], d, child[1]
                if (child is None or child[1] < 0) and best[d] + unknown > top:
                    top, at, piece = best[d] + unknown, d, -1
                best.append(top)
                back.append(at)
                ids.append(piece)
                open_at.append(alive)
            last, found, j = unit, [], len(unit)
            while j:
                if ids[j] >= 0:
                    found.append(ids[j])
                else:
                    found.extend(self.byte_ids[b] for b in reversed(unit[back[j] : j].encode()))
                j = back[j]
            found.reverse()
            out.append(found)
        return out

    def _encode_long(self, unit: str) -> np.ndarray:
        """The same for one unit of any length: only the open pieces at the present character are held, and the trace as packed numbers."""
        best, back, ids, open_ = array("d", [0.0]), array("q", [0]), array("i", [-1]), []
        for d, c in enumerate(unit):
            alive, top, at, piece = [], -1e300, d, -1
            for i, node in (*open_, (d, self.tree)):
                child = node[0].get(c)
                if child is not None:
                    alive.append((i, child))
                    if child[1] >= 0 and best[i] + child[2] > top:
                        top, at, piece = best[i] + child[2], i, child[1]
            child = self.tree[0].get(c)
            if (child is None or child[1] < 0) and best[d] + self.unknown > top:
                top, at, piece = best[d] + self.unknown, d, -1
            best.append(top)
            back.append(at)
            ids.append(piece)
            open_ = alive
        found, j = array("i"), len(unit)
        while j:
            if ids[j] >= 0:
                found.append(ids[j])
            else:
                found.extend(self.byte_ids[b] for b in reversed(unit[back[j] : j].encode()))
            j = back[j]
        return np.frombuffer(found, np.int32)[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one sequence, without the space that encoding puts first."""
        return _gather(self.flat, self.starts[ids], self.sizes[ids])[1:].tobytes()


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + size] over all pairs."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The columns to keep and token_ids. A space is put before a text, as this family of models does; null and empty texts have no tokens.

    Words are told apart by the spaces before them, which belong to the word, and by line ends. Each slice of text is segmented through its distinct
    words in sorted order. Characters without a piece become byte pieces, so every text decodes to itself. Narrow: no shuffle. A kept column named
    token_ids is replaced; repeated rows are encoded each; an empty table gives an empty one.
    """
    keep = [c for c in keep if c != "token_ids"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "token_ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in blocks(batches, name, _SLICE):
            texts = [t.as_py() for t in b.column(b.num_columns - 1)]
            units = [_UNITS.findall(" " + t) if t else [] for t in texts]
            distinct = sorted(set().union(*units))
            place = {u: i for i, u in enumerate(distinct)}
            coded = p.encode_units(distinct)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))
            starts = np.cumsum(sizes) - sizes
            at = np.fromiter((place[u] for us in units for u in us), np.int64, sum(map(len, units)))
            ids = _gather(flat, starts[at], sizes[at])
            before = np.concatenate([[0], np.cumsum(sizes[at])])
            ends = before[np.cumsum([0, *map(len, units)])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([*b.columns[:-1], lists], names=[*keep, "token_ids"])

    name = _free("__text", keep)
    return docs.select(*keep, F.col(text_col).alias(name)).mapInArrow(run, schema)


def decode(tokens: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The columns to keep and decoded, the text of token_ids. Null and empty sequences give an empty text; bytes that aren't UTF-8 become U+FFFD."""
    kinds = dict(tokens.dtypes)
    keep = [c for c in keep if c != "decoded"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                texts = [p.decode(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else "" for x in b.column(b.num_columns - 1)]
                yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return tokens.select(*keep, F.col("token_ids").alias(_free("__ids", keep))).mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id_col, n_tokens, token_ids, round_trip (the decoded ids have the text's checksum and length). Repeated rows each get a row; an empty table gives an empty one."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.crc32(raw).alias("crc"), F.octet_length(raw).alias("size"))
    coded = encode(src, ["id", "crc", "size"], "text", model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                lists = b.column(3)
                same = []
                for x, crc, size in zip(lists, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    text = p.decode(x.values.to_numpy())
                    same.append(len(text) == size and zlib.crc32(text) == crc)
                sizes = np.diff(lists.offsets.to_numpy())
                yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), lists, pa.array(same)], names=["id", "n_tokens", "token_ids", "round_trip"])

    return coded.mapInArrow(run, f"id {kind}, n_tokens long, token_ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)
