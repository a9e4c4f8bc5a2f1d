"""Operator 9: token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links.  Where the trie has no step for a byte, the
pieces that greedy longest match would cut off there are known beforehand: ``pops[node]``
is their number, and ``fail[node]`` the node of what is left.  So a word is read once, and
its piece count comes out without a piece being built.  Distinct words of a batch walk
the automaton side by side in numpy.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc

NONE = -1


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def automaton(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``keys`` (node * 256 + byte, ascending), ``next``, ``fail``, ``pops``, ``whole`` (pieces of a node's string if the word ends there).

    Every single byte is a token here (added if missing), so each word can be cut.
    """
    step: dict[int, int] = {}
    parent, byte, final, depth = [0], [0], [False], [0]
    for token in sorted({*vocabulary, *(bytes([b]) for b in range(256))} - {b""}):
        node = 0
        for b in token:
            key = node * 256 + b
            if key not in step:
                step[key] = len(parent)
                parent.append(node)
                byte.append(b)
                final.append(False)
                depth.append(depth[node] + 1)
            node = step[key]
        final[node] = True
    n = len(parent)
    fail, pops, whole = [NONE] * n, [0] * n, [0] * n
    for v in sorted(range(1, n), key=depth.__getitem__):
        if final[v]:
            fail[v], pops[v] = 0, 1
        else:
            u, count = parent[v], 0
            b = byte[v]
            count, u = pops[u], fail[u]
            while u != NONE and u * 256 + b not in step:
                count, u = count + pops[u], fail[u]
            if u != NONE:
                fail[v], pops[v] = step[u * 256 + b], count
        count, u = 0, v
        while u > 0:
            count, u = count + pops[u], fail[u]
        whole[v] = count
    keys = np.array(sorted(step), np.int64)
    return keys, np.array([step[int(k)] for k in keys], np.int32), np.array(fail, np.int32), np.array(pops, np.int32), np.array(whole, np.int32)


def piece_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, machine, prefix: bytes = b"") -> np.ndarray:
    """Greedy piece counts of ``prefix`` + each word."""
    keys, nxt, fail, pops, whole = machine
    node = np.zeros(len(starts), np.int64)
    count = np.zeros(len(starts), np.int64)
    lengths = ends - starts + len(prefix)
    order = np.argsort(-lengths, kind="stable")
    alive = len(order)
    sorted_lengths = lengths[order]
    at = starts[order] - len(prefix)
    for k in range(int(lengths.max()) if len(lengths) else 0):
        alive = int(np.searchsorted(-sorted_lengths[:alive], -k, "left"))
        b = np.full(alive, prefix[k], np.int64) if k < len(prefix) else data[at[:alive] + k].astype(np.int64)
        todo = np.arange(alive)
        while len(todo):
            key = node[todo] * 256 + b[todo]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            node[todo[hit]] = nxt[found[hit]]
            todo = todo[~hit]
            count[todo] += pops[node[todo]]
            node[todo] = fail[node[todo]]
    out = np.zeros(len(starts), np.int64)
    out[order] = count + whole[node]
    return out


def _counted(machine, prefix: bytes, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.buffers(batch.column(text_col))
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, part, offs in tc.chunked(data, offsets):
                words = tc.Words(part, offs, tc.SPACES)
                n_words[i:j] = words.counts
                if len(words.starts):
                    _, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                    pieces = piece_counts(part, words.starts[where], words.ends[where], machine.value, prefix)
                    sums = np.concatenate([[0], np.cumsum(pieces[back])])
                    n_tokens[i:j] = np.diff(sums[words.first])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: list[bytes], prefix: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_tokens``.

    Words are runs of non-space; each is cut greedily into the longest tokens from the left,
    with ``prefix`` before it (how a vocabulary marks a word's start).  Null or empty texts
    count 0.  The automaton is broadcast; its size follows the vocabulary, not the data.
    Repeated rows stay, extra columns are ignored, an empty table gives an empty one.
    """
    machine = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(machine, prefix, "text"), "doc_id long, n_words long, n_tokens long")
