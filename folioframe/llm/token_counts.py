"""Token counts by a linear longest-match automaton.

Greedy word pieces of a word are the longest vocabulary entries from left to
right.  The vocabulary becomes a trie; each node has a failure link (the node
reached once the pieces that its string forces have been taken off) and the
number of pieces taken off on the way, so a word is counted in one walk over
its bytes, without building a piece.

The vocabulary's entries are byte strings; entries that end a word carry an
end mark, which the walk reads after the word's last byte.  An end mark that
no entry takes along is a piece of weight 0.  A word with no greedy split
counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; empty
tables give empty results; rows are counted each, repeated or not, with or
without an id; extra columns of any name are ignored; a word of any length
takes one walk, and a text of any length is counted whole; of entries that tie
in their bytes there is one, so the longest match is unique.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from folioframe.llm import textnp

END_MARK = 256
CACHE_WORDS = 250_000


class LongestMatch:
    """Trie with failure links and counts of popped pieces over symbols 0..255 and END_MARK."""

    def __init__(self, entries: Iterable[tuple[int, ...]], bare_end: bool = True) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for entry in entries:
            at = 0
            for s in entry:
                to = self.next[at].get(s)
                if to is None:
                    to = self.next[at][s] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = to
            if at:
                final[at] = True
        bare = -1
        if bare_end and END_MARK not in self.next[0]:
            bare = self.next[0][END_MARK] = len(self.next)
            self.next.append({})
            final.append(True)
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 0, int(v != bare)
                else:
                    f, n = self.fail[u], self.popped[u]
                    while f >= 0 and s not in self.next[f]:
                        n += self.popped[f]
                        f = self.fail[f]
                    if f >= 0:
                        self.fail[v], self.popped[v] = self.next[f][s], n
                queue.append(v)

    def count(self, symbols: Iterable[int]) -> int | None:
        """Pieces of the greedy split, None where it gets stuck; each symbol is read once."""
        go, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for s in symbols:
            while True:
                to = go[at].get(s)
                if to is not None:
                    at = to
                    break
                if fail[at] < 0:
                    return None
                n += popped[at]
                at = fail[at]
        while at:
            if fail[at] < 0:
                return None
            n += popped[at]
            at = fail[at]
        return n


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def entries(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The entries of a tokenizer file's vocabulary as symbols."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of = byte_symbols()
    out = []
    for token in vocab:
        body = token.removesuffix(end) if token != end else token
        if all(c in of for c in body):
            out.append((*(of[c] for c in body), *[END_MARK] * (body != token)))
    return out


_built: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row: words are the runs between ASCII white space, A-Z lower-cased."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _built:
            _built[path] = (LongestMatch(entries(path)), {})
        automaton, known = _built[path]
        for b in textnp.chunks(batches, max_bytes=2 << 20):
            raw, off = textnp.buffer_of(b.column("text"))
            data = raw.tobytes()
            out: list[tuple[int, int, int]] = []
            for i, j in zip(off[:-1], off[1:], strict=True):
                words = data[i:j].lower().split()
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in {w for w in words if w not in known}:
                    n = automaton.count((*w, END_MARK))
                    known[w] = -1 if n is None else n
                counts = [known[w] for w in words]
                unknown = counts.count(-1)
                out.append((len(words), sum(counts) + 2 * unknown, unknown))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
