"""Packing into fixed windows by minimum bin slack.

Documents are tokenised and cut at multiples of the window; what remains
(shorter than a window) is whole.  The multiset of remaining lengths, at most
``window - 1`` numbers whatever the corpus, is packed on the driver: the
longest remaining piece opens a window, a bitset subset-sum over the other
lengths finds the fullest reachable total, the counts are backtracked and the
same pattern is repeated as often as the counts allow.  Pieces then find their
place by their rank among the pieces of the same length, in one pass.

Defined results: null and empty texts give a document of the end token alone;
a text of any length is tokenised whole, by its words; an empty table gives no
pieces; repeated rows and rows without an id are packed each on its own
(``start`` counts within the row); pieces of one length are interchangeable and
ordered by id and start, so ties move no padding; extra columns of any name are
ignored by ``tokenized`` and pass through ``pack``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store, textnp

WINDOW, END = 4096, 2
CACHE_WORDS = 300_000
PER_SALT, FEW, SALTS = 100_000, 256, 64
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
_cache: dict[str, "_Words"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words:
    """Ids of single words as bytes, kept in a bounded cache.

    Words of printable ASCII and Latin-1 letters are split by the vocabulary
    file's own pattern and merged by a byte-pair encoder over the file's
    merges, where one more byte stands for the end of a word; all others go
    through the tokenizer itself.  Both give the same ids.
    """

    _letters = re.compile(b"[A-Za-z]+")
    _plain = re.compile("[!-~\u00c0-\u00ff]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.piece = self.mark = None
        self.ids: list[bytes] = []
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, steps = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model.get("end_of_word_suffix") == "</w>" and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
            self._build(model, steps[0]["pattern"]["Regex"])

    def _build(self, model: dict, pattern: str) -> None:
        import regex
        import tiktoken

        from folioframe.llm.token_counts import byte_symbols

        of = byte_symbols()
        mark = b"\xff"  # not in UTF-8
        plain = lambda t: bytes(of[c] for c in t.removesuffix("</w>")) + mark * t.endswith("</w>")
        vocab = model["vocab"]
        tokens = {bytes([b]): vocab[c] for c, b in of.items()} | {bytes([b]) + mark: vocab[c + "</w>"] for c, b in of.items()}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            tokens.setdefault(plain(a) + plain(b), vocab[a + b])
        encoding = tiktoken.Encoding("words", pat_str="\\S+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
        self.piece, self.mark, self.pattern = encoding._core_bpe.encode_single_piece, mark, regex.compile(pattern)
        self.ids = [i.to_bytes(4, "little") for i in tokens.values()]

    def learn(self, words: list[bytes]) -> None:
        rest, known, ids, piece, mark, letters, plain = [], self.known, self.ids, self.piece, self.mark, self._letters.fullmatch, self._plain.fullmatch
        for w in words:
            if piece and letters(w):
                known[w] = b"".join([ids[k] for k in piece(w.lower() + mark)])
                continue
            t = w.decode("utf-8")
            if piece and plain(t) and "<|" not in t:
                known[w] = b"".join([ids[k] for p in self.pattern.findall(t.lower()) for k in piece(p.encode("utf-8") + mark)])
            else:
                rest.append((w, t))
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids (little-endian unsigned 32 bits) of each UTF-8 text.

    The vocabulary drops white space, so the words between ASCII white space
    are tokenised one by one.
    """
    if path not in _cache:
        _cache[path] = _Words(path)
    words = _cache[path]
    known = words.known
    if len(known) > CACHE_WORDS:
        known.clear()
    out = []
    for t in texts:
        split = t.split()
        try:
            ids = b"".join([known[w] for w in split])
        except KeyError:
            words.learn([w for w in set(split) if w not in known])
            ids = b"".join([known[w] for w in split])
        out.append(ids)
    return out


def tokenized(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, ids."""
    path = path or vocabulary_path()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.chunks(batches, max_bytes=2 << 20):
            raw, off = textnp.buffer_of(batch.column("text"))
            data = raw.tobytes()
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], path), strict=True):
                ids += last
                n = len(ids) // 4
                rows += [(doc, s, min(window, n - s), n, ids[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fill(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces) with their repeats that use every piece once; each pattern is as full as the lengths left allow."""
    left = {k: v for k, v in counts.items() if v > 0}
    out: list[tuple[dict[int, int], int]] = []
    if left.pop(window, 0):
        out.append(({window: 1}, counts[window]))
    full = 1 << window
    keep = (full << 1) - 1
    while left:
        order = sorted(left, reverse=True)
        first = order[0]
        reach, steps = 1 << first, []
        for length in order:
            free = min(left[length] - (length == first), (window - first) // length)
            take = 1
            while free > 0 and not reach & full:
                take = min(take, free)
                steps.append((length, take, reach))
                reach |= (reach << (length * take)) & keep
                free -= take
                take *= 2
            if reach & full:
                break
        total = reach.bit_length() - 1
        pattern = {first: 1}
        for length, take, before in reversed(steps):
            if not before >> total & 1:  # the total needs this step
                pattern[length] = pattern.get(length, 0) + take
                total -= length * take
        repeats = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, repeats))
        for k, n in pattern.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
    return out


def _plan(counts: dict[int, int], window: int) -> list[np.ndarray]:
    """Sorted (length, first rank) segments: key, first rank, pieces a window, first sequence, offset in the window."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in fill(counts, window):
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rank = used.get(length, 0)
            rows.append((length, rank, n, sequence, offset))
            used[length] = rank + n * repeats
            offset += length * n
        sequence += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return [table[:, 0] << 44 | table[:, 1], *table[:, 1:].T]


def pack(pieces: DataFrame, window: int = WINDOW, per_salt: int = PER_SALT) -> DataFrame:
    """``pieces`` (doc_id, start, length, doc_tokens and any others) with sequence_id and offset.

    Lengths are at most ``window``, so their histogram and the broadcast plan
    have a bound that doesn't depend on the corpus.  Ranks are counted within
    (length, salt): a length of more than ``FEW`` pieces has up to ``SALTS``
    parts, and more where these would hold over ``per_salt`` pieces each, so that
    a length which many pieces share is split; the driver sees one number for
    each such part.
    """
    spark = pieces.sparkSession
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    salts = [max(1, min(SALTS, total.get(k, 0) // FEW), -(-total.get(k, 0) // per_salt)) for k in range(window + 1)]
    lead = np.append(0, np.cumsum(salts))
    salt, rank_ = store.free("_salt", pieces.columns), store.free("_rank", pieces.columns)
    of = F.get(F.array(*map(F.lit, salts)), F.col("length").cast("int"))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), of).cast("int"))
    grid = np.zeros(lead[-1], np.int64)
    for row in salted.groupBy("length", salt).count().collect():
        grid[lead[row["length"]] + row[salt]] = row["count"]
    first = np.cumsum(grid) - grid
    first -= np.repeat(first[lead[:-1]], salts)
    plan = spark.sparkContext.broadcast((lead, first, _plan(total, window)))

    from pyspark.sql import Window

    ranked = salted.withColumn(rank_, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "start")) - 1)
    names = pieces.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, first, (key, rank0, each, sequence, offset) = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy()
            rank = b.column(rank_).to_numpy() + first[lead[length] + b.column(salt).to_numpy()]
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            step, place = np.divmod(rank - rank0[at], each[at])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence[at] + step), pa.array(offset[at] + place * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces with their ids and their place: the operator's whole result."""
    return pack(store.save(tokenized(docs, path, window), "pieces"), window)
