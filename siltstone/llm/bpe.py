"""Byte-level BPE, encoding and decoding, by a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern.  Tier one, a minimal perfect hash over the
vocabulary, resolves a pre-token that is itself a token with one probe.  Tier two takes the misses: the
pre-token's bytes form a linked list, a heap holds the mergeable neighbours by (rank, place), and the
lowest merges until none is left.

Texts are first cut at blanks that white space does not follow, since no match of a pattern such as PATTERN
can cross one; each such stretch is encoded once and then remembered, in a memory of bounded size that
serves all tasks of a process.  Two neighbours are looked up as a pair of numbers; the table of pairs is that
of the vocabulary's tokens cut in two, so a pair is in it just if their bytes together are a token.

The hash is built on the driver from the rank file, whose size is that of the vocabulary, not of the data.

Edge cases: a null text counts as empty and has no ids; lone surrogates are encoded like tiktoken does,
as U+FFFD; a text of any length is encoded whole; special tokens are ordinary text; null ids decode to
no bytes.  Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from struct import pack
from weakref import ref

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import chunks, pick, shared

#: The pattern of the public byte-level vocabularies: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's engine has it, the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_MASK = 2**64 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash from byte strings to numbers: n slots for n keys, a small seed for each bucket of about two.

    A bucket of several keys stores the first seed that sends them all to free slots; a bucket of
    one key stores its slot, as a negative number.
    """

    def __init__(self, items: dict[bytes, int]):
        self.n = max(1, len(items))
        self.buckets = max(1, self.n // 2)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            by_bucket.setdefault(h % self.buckets, []).append((h, key))
        taken, free = bytearray(self.n), 0
        for bucket, own in sorted(by_bucket.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                while taken[free]:
                    free += 1
                slots, self.seeds[bucket] = [free], -free - 1
            else:
                seed = 0
                while True:
                    slots = [self._slot(h, seed) for h, _ in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                self.seeds[bucket] = seed
            for slot, (_, key) in zip(slots, own):
                taken[slot], self.keys[slot], self.values[slot] = 1, key, items[key]

    def _slot(self, h: int, seed: int) -> int:
        h = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _MASK
        return (h >> 32) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        slot = -seed - 1 if seed < 0 else self._slot(h, seed)
        return self.values[slot] if self.keys[slot] == key else None


class _Memory(dict):
    """What is known of stretches that follow a blank; what is not is found on first use.

    Two generations of at most limit entries: when one is full, it becomes the older, and what is used of
    that goes on.  The codec that finds is referred to weakly, so that a worker that is done with it frees both at once.
    """

    def __init__(self, codec: Codec, find: Callable[[Codec, str], bytes], limit: int):
        super().__init__()
        self.codec, self.find, self.limit, self.older = ref(codec), find, limit, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.older.get(stretch)
        if found is None:
            found = self.find(self.codec(), stretch)
        if len(stretch) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[stretch] = found
        return found


class Codec:
    """Encodes and decodes with a table of ranks; picklable, of the vocabulary's size.

    Ids are kept as little-endian 32-bit numbers in byte strings, which are joined rather than copied one by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = 300_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.hash, self.pattern, self.memory = PerfectHash(ranks), pattern, memory
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._start()

    def _start(self) -> None:
        self.told: Broadcast | None = None
        ranks = {token: rank for rank, token in self.tokens.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # what two neighbours merge to, by the rank of the first and then of the second: every token cut in two tokens
        pairs: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.setdefault(left, {})[right] = rank
        none: dict[int, int] = {}
        self.pairs = {rank: pairs.get(rank, none).get for rank in self.tokens}
        self.first = [self.pairs[a](b, -1) for a in self.single for b in self.single]
        self.packed_id = {rank: pack("<i", rank) for rank in self.tokens}
        blank = [None] * (max(self.tokens) + 1)
        self.bytes_of, self.decimal = blank.copy(), blank
        for rank, token in self.tokens.items():
            self.bytes_of[rank], self.decimal[rank] = token, str(rank)
        self.after_blank, self.bare = _Memory(self, Codec._after_blank, self.memory), _Memory(self, Codec._match, self.memory // 4)
        self.split = regex.compile(self.pattern).findall
        self.cut = re.compile(f" (?=[^{SPACE}])").split
        self.runs = re.compile(f" [{SPACE}]").search

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("hash", "pattern", "memory", "tokens")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: merge the pair of lowest rank, the leftmost of equals, until no pair is in the vocabulary."""
        pairs, first, n = self.pairs, self.first, len(piece)
        shift = n.bit_length()
        own = list(map(self.single.__getitem__, piece))  # by the first byte of a part: its rank
        to = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # what a part and the next merge to, -1 for nothing
        heap = [r << shift | i for i, r in enumerate(to) if r >= 0]
        heapify(heap)
        to.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next and the last part begin
        while heap:
            entry = heappop(heap)
            rank = entry >> shift
            i = entry - (rank << shift)
            if to[i] != rank:
                continue  # one of the two has merged meanwhile
            j = after[i]
            after[i] = k = after[j]
            own[i] = rank
            own[j] = to[j] = -1
            if k < n:
                before[k] = i
                to[i] = r = pairs[rank](own[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                to[i] = -1
            h = before[i]
            if h >= 0:
                to[h] = r = pairs[own[h]](rank, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [r for r in own if r >= 0]

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern: by the hash, else by merging."""
        piece = match.encode("utf-8")
        whole = self.hash.get(piece)
        return self.packed_id[whole] if whole is not None else b"".join(map(self.packed_id.__getitem__, self.merge(piece)))

    def _after_blank(self, word: str) -> bytes:
        """Ids of a blank and a stretch."""
        if word.isascii() or word and max(word) < "\u0250":  # letters to all versions of the pattern's engine
            if word.isalpha():  # a match of its own
                return self._match(" " + word)
            if word[-1:] in {",", "."} and word[:-1].isalpha():  # a match and a sign
                return self.after_blank[word[:-1]] + self.bare[word[-1]]
        return self._stretch(" " + word)

    def _stretch(self, stretch: str) -> bytes:
        return b"".join([self.after_blank[m[1:]] if m[0] == " " and m[1:].isalpha() else self.bare[m] for m in self.split(stretch)])

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        if not text:
            return b""
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        # a run of white space crosses a blank only if white space follows it
        first, *rest = self.cut(text) if self.runs(text) or text[-1] == " " else text.split(" ")
        return self._stretch(first) + b"".join(map(self.after_blank.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()

    def decode(self, ids: Iterable[int] | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)) if ids is not None else b""

    def joined(self, ids: Iterable[int]) -> str:
        """The ids as decimals, with commas between."""
        return ",".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str = PATTERN) -> Codec:
    return Codec(read_ranks(path), pattern)


def _told(own: Codec) -> Broadcast:
    """The codec, broadcast once for all queries of a session, so that a worker holds it once."""
    if own.told is None or own.told._sc is not SparkContext._active_spark_context:
        own.told = shared(own)
    return own.told


def encode_column(text: Column, own: Codec) -> Column:
    """Token ids of each whole text, array<int>."""
    told = _told(own)

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed = told.value.packed
        for texts in chunks(batches):
            yield pd.Series([np.frombuffer(packed(t), dtype="<i4") for t in texts], dtype=object)

    return encoded(text)


def decode_column(ids: Column, own: Codec) -> Column:
    """Bytes of each array of ids, binary."""
    told = _told(own)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = told.value.decode
        for rows in chunks(batches):
            yield pd.Series([decode(None if x is None else x.tolist()) for x in rows], dtype=object)

    return decoded(ids)


def round_trip_column(text: Column, own: Codec) -> Column:
    """(ids array<int>, round_trip boolean) of each whole text: its ids, and whether they decode to its bytes, in one pass."""
    told = _told(own)

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def turned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = told.value
        for texts in chunks(batches):
            ids = [np.frombuffer(codec.packed(t), dtype="<i4") for t in texts]
            same = [codec.decode(x.tolist()) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "round_trip": pd.Series(same, dtype=bool)})

    return turned(text)


def digests_column(text: Column, own: Codec) -> Column:
    """(n_tokens, ids_sha256, decoded_sha256) of each whole text: its ids, and what they decode to, in one pass."""
    told = _told(own)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = told.value
        for texts in batches:
            rows = []
            for text in texts:
                ids = codec.encode(text)
                rows.append((len(ids), sha256(codec.joined(ids).encode()).hexdigest(), sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digested(text)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids) for every row of docs."""
    return pick(docs, id_col, text_col).select(id_col, encode_column(F.col(text_col), codec(ranks_path, pattern)).alias("ids"))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded) for every row of encoded."""
    return pick(encoded, id_col, ids_col).withColumn("decoded", decode_column(F.col(ids_col), codec(ranks_path)))


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): documents encoded, and the ids decoded again."""
    own = pick(docs, id_col, text_col)
    return own.select(id_col, digests_column(F.col(text_col), codec(ranks_path)).alias("d")).select(id_col, "d.*")
