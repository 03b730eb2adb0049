"""Encoding of texts with a public byte-level BPE, split at forced boundaries.

A byte pair that occurs inside no token of the vocabulary is a certain cut: no merge can cross it.
Each text is cut there, the fragments are encoded on their own (each distinct fragment once for a
worker) and their ids are concatenated. The pre-tokeniser's pattern looks at its neighbours in two
places only - white space before a word, and contractions after an apostrophe - so a cut is taken
only after an ASCII character that is no white space, and never before an apostrophe. Under these
conditions the fragments' pre-tokens refine the whole text's pre-tokens only at cuts, and the ids
are those of the whole text; tests compare them with the plain encoder.

Null and empty texts have an empty list. What looks like a special token is plain text. A null id
stays; repeated rows each keep their row; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct fragments a worker remembers; on reaching it the memory starts anew, ids stay the same.
MEMO = 400_000
#: Bytes encoded at a time; a text is never cut by it.
BLOCK = 4 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """(plain encoder, 65,536 flags: the byte pair is a certain cut) of a vocabulary of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    inside = np.zeros(1 << 16, dtype=bool)
    whole = np.frombuffer(b"".join(ranks), dtype=np.uint8).astype(np.int32)
    pair = (whole[:-1] << 8) | whole[1:]
    ends = np.cumsum([len(t) for t in ranks])[:-1] - 1  # pairs over the end of a token don't count
    keep = np.ones(len(pair), dtype=bool)
    keep[ends] = False
    inside[pair[keep]] = True
    left = np.arange(1 << 16) >> 8
    right = np.arange(1 << 16) & 255
    blank = np.isin(left, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
    # a right byte from 0x80 to 0xBF goes on with a character, which can't follow an ASCII byte
    cut = ~inside & (left < 128) & ~blank & (right != 0x27)
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), cut


class FragmentEncoder:
    """Encodes lists of texts; keeps the ids of the fragments it met."""

    def __init__(self, path: str):
        self.plain, self.cut = encoder(path)
        self.memo: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.counts: list[int] = []

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        block = b"".join(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths, out=starts[1:])
        if not block:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        raw = np.frombuffer(block, dtype=np.uint8).astype(np.int32)
        at = np.zeros(len(raw) + 1, dtype=bool)
        at[1:-1] = self.cut[(raw[:-1] << 8) | raw[1:]]
        at[starts] = True
        edges = np.flatnonzero(at)
        bounds = edges.tolist()
        if len(self.memo) > MEMO:
            self.memo, self.ids, self.counts = {}, [], []
        memo = self.memo
        pieces = [block[a:b] for a, b in zip(bounds, bounds[1:])]
        for piece in set(pieces).difference(memo):
            memo[piece] = len(self.counts)
            new = self.plain.encode_ordinary(piece.decode("utf-8"))
            self.ids.extend(new)
            self.counts.append(len(new))
        which = np.fromiter(map(memo.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        known, counts = np.array(self.ids, dtype=np.int32), np.array(self.counts, dtype=np.int64)
        first = np.cumsum(counts) - counts
        each = counts[which]
        total = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum(each, out=total[1:])
        ids = known[np.repeat(first[which] - total[:-1], each) + np.arange(total[-1])]
        return ids, total[np.searchsorted(edges, starts)].astype(np.int32)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens."""
    path = path or vocabulary_path()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = FragmentEncoder(path)
        for batch in batches:
            keys, col = batch.column(0), batch.column(1).to_pylist()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in col]
            a, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK or i == len(texts) - 1:
                    ids, offsets = enc(texts[a : i + 1])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([keys.slice(a, i + 1 - a), lists], names=[key, "ids"])
                    a, size = i + 1, 0

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
