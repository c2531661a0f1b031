"""Sets of word shingles as sorted 64-bit hashes, made in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from textquarry.llm.text_stats import window_hashes

WIDTH = 5


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word, A-Z lower-cased, as its place among the distinct ones; their hashes, equal in every task; the words per text."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    split = pc.ascii_split_whitespace(low)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    empty = pc.equal(pc.binary_length(low), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # split into one empty word
        lengths[empty] = 0
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return coded.indices.to_numpy().astype(np.int64), table, lengths


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the words per text."""
    ids, table, lengths = hashed_words(texts)
    return table[ids], lengths


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Per text its distinct shingles, sorted. A text with fewer words is one shingle of all of them, without words none."""
    hashes, lengths = word_hashes(texts)
    windows = window_hashes(hashes, width)
    out, at = [], 0
    for n in lengths:
        if n >= width:
            out.append(np.unique(windows[at:at + n - width + 1]))
        elif n:
            out.append(window_hashes(hashes[at:at + n], int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_key(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
