"""The words of whole texts as numbers, a block of rows at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = re.compile(rb"[ \t-\r]")
_PART = 1 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def parts(text: bytes, size: int = _PART) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that are cut at ASCII white space, so no word is cut."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + size < end and (m := _SPACE.search(text, at + size)):
            end = m.end()
        yield text[at:end]
        at = end


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (cut at ASCII white space) of texts: their numbers one text after the other, the offsets of the texts in them, and the distinct words by number. Equal words have equal numbers."""
    chunks, held, at = [], [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        n = 0
        for part in parts(text):
            found = part.split()
            held += found
            n += len(found)
            if len(held) > 1 << 17:
                chunks.append(pa.array(held, pa.large_binary()))
                held = []
        at[i + 1] = at[i] + n
    chunks.append(pa.array(held, pa.large_binary()))
    coded = pa.chunked_array(chunks).combine_chunks().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), at, coded.dictionary


def repeated_at(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
