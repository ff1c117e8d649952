"""Token counts by a linear longest-match automaton over a vocabulary (after Song et al., 2021).

The trie of all pieces gets failure links: where no edge goes on, the automaton pops the pieces that a greedy longest
match would have cut off by then (only their number is stored) and goes on at the node of what is left. Each byte is
read once, and no piece is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _byte_chars
from .words import chunks, split


def vocabulary(path: str) -> set[bytes]:
    """The strings of a byte-level vocabulary file without their end marks; all single bytes are among them."""
    chars = _byte_chars()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {bytes(chars[c] for c in token.removesuffix("</w>")) for token in vocab} | {bytes([b]) for b in range(256)}


class Automaton:
    """next: edges of the trie as sorted keys (node * 256 + byte) and children. fail, pops: of each node; root: 0."""

    def __init__(self, pieces: set[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][c]
            final[node] = bool(piece)
        fail, pops, queue = [-1] * len(children), [0] * len(children), [0]
        for u in queue:
            for c, v in children[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in children[z]:
                    z, n = fail[z], n + pops[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][c], n
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        edges = sorted((u * 256 + c, v) for u, own in enumerate(children) for c, v in own.items())
        self.keys, self.children = np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        out, todo = node.copy(), np.arange(len(node))
        while len(todo):
            key = out[todo] * 256 + byte[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[todo[found]] = self.children[at[found]]
            todo = todo[~found]
            count[todo] += self.pops[out[todo]]
            out[todo] = self.fail[out[todo]]
        return out

    def lengths(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word text[start:end]. Every single byte is a piece, so a match always goes on."""
        order = np.argsort(start - end, kind="stable")
        first, size = start[order], (end - start)[order]
        node, count = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        left = len(first)
        for k in range(int(size[0]) if len(size) else 0):
            left = int(np.searchsorted(-size, -k, "left"))
            part = count[:left]
            node[:left] = self._step(node[:left], text[first[:left] + k].astype(np.int64), part)
        todo = np.flatnonzero(node)
        while len(todo):
            count[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        out = np.empty_like(count)
        out[order] = count
        return out


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(vocabulary(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, text; other columns are not read. Returns doc_id, n_words, n_tokens, one row an input row.

    Words are A-Z lower-cased runs of bytes outside 0x20 and 0x09-0x0D; tokens are the pieces that a greedy longest
    match cuts each word into. A null or empty text has none. Texts of any length are read whole, in slices. Ids may be
    null or repeated, repeated rows get equal results, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            for rows, body, at in chunks(batch.column(1)):
                words = split(body, at)
                _, one, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                each = machine.lengths(words.bytes, words.start[one], words.end[one])[back] if len(one) else np.zeros(0, np.int64)
                until = np.concatenate([[0], np.cumsum(each)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(words.counts().astype(np.int64)), pa.array(np.diff(until[words.doc]))], names=["doc_id", "n_words", "n_tokens"])

    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
