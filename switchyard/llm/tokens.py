"""Byte-level BPE encoding and decoding in linear time, without merging.

Token bytes become Latin-1 text, one character a byte, so that an
Aho-Corasick automaton finds the longest token at every position.  A piece is
encoded from left to right: take the longest token, and keep it if it is
*compatible* with the token before - if the two side by side are what the
merges themselves would make; otherwise try the next shorter token, or step
back.  Positions that failed are never tried again, and compatibility of two
tokens is remembered, so the work is linear in the piece.  The result is the
merge order's own encoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own

Encoded = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])
CACHE = 600_000  # pieces a worker remembers
GROUP = 65_536  # pieces handled together


@cache
def splitter(pattern: str) -> regex.Pattern:
    """``pattern`` with white space as Unicode defines it (without the four separators 1C to 1F)."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class _Pieces(dict):
    """What a worker remembers of the pieces it has encoded.

    Two generations of half the size: when the younger is full it becomes the
    older, from which pieces met again come back, so frequent ones stay.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, tuple[str, bytes]] = {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        if len(self.codec.fits) >= CACHE:
            self.codec.fits.clear()
        got = self.older.get(piece)
        if got is None:
            ids = self.codec.encode_piece(piece)
            got = " ".join(map(str, ids)), self.codec.decode(ids)
        self[piece] = got
        return got


class Codec:
    """Ranks as in a .tiktoken file: token bytes -> id, lower ids merged first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text = {v: k for k, v in self.ids.items()}
        self.bytes = {v: k for k, v in ranks.items()}
        self.split = splitter(pattern)
        self.lengths = {i: len(t) for i, t in self.text.items()}
        self.longest = max(self.lengths.values())
        self.prefixes: dict[int, int] = {}
        self.merges: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole = dict(self.ids)  # a piece that is a token is that token, made by merges or not
        for i, t in self.text.items():
            if len(t) > 1 and self._merged_from(i) is None:
                del self.ids[t]
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.pieces = _Pieces(self)

    def _shorter(self, i: int) -> int:
        """The longest proper prefix of token ``i`` that is a token, -1 if none."""
        if (got := self.prefixes.get(i)) is None:
            t = self.text[i]
            got = self.prefixes[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        return got

    def _merged_from(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token ``i``; None if no merge does."""
        if i not in self.merges:
            parts = list(self.text[i])
            while len(parts) > 2:
                ranked = [(r, k) for k in range(len(parts) - 1) if (r := self.ids.get(parts[k] + parts[k + 1], i)) < i]
                if not ranked:
                    break
                k = min(ranked)[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.merges[i] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self.merges[i]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between neighbours ``a`` and ``b``.

        Takes their merges back from the latest on.  If at some moment the two
        tokens at the boundary had a merge earlier than the next one taken
        back, they would have been merged instead.
        """
        key, limit, fits = (a, b), len(self.text) + 1, True
        while True:
            both = self.ids.get(self.text[a] + self.text[b])
            if both is not None and both < limit and self._merged_from(both) == (a, b):
                fits = False
                break
            left, right = self._merged_from(a), self._merged_from(b)
            if left is None and right is None:
                break
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]  # of equal merges the left one comes first
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one match of the pattern."""
        if not piece:
            return []
        t = piece.encode("utf-8").decode("latin-1")
        if (whole := self.whole.get(t)) is not None:
            return [whole]
        lengths, fits = self.lengths, self.fits
        out: list[int] = []
        last = -1
        at, size = 0, len(t)
        for _, (_, token) in self.automaton.iter_long(t):  # as far as longest matches are compatible
            if last >= 0:
                if (good := fits.get((last, token))) is None:
                    good = self._compatible(last, token)
                if not good:
                    break
            out.append(token)
            at += lengths[token]
            last = token
        if at == size:
            return out
        failed: set[int] = set()  # places from which the rest cannot be encoded
        far = self._all_longest(t) if size > 4 * self.longest else None  # the tokens of a long piece, found in one pass
        token = self._longest(t, at)
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if end not in failed:
                    if not out:
                        break
                    if (good := fits.get((out[-1], token))) is None:
                        good = self._compatible(out[-1], token)
                    if good:
                        break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = self._longest(t, at) if far is None or at == size else far[at]
            else:
                failed.add(at)
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                token = out.pop()
                at -= lengths[token]
                token = self._shorter(token)
        return out

    def _longest(self, t: str, at: int) -> int:
        """The longest token at a place, -1 at the end."""
        ids = self.ids
        return next((ids[p] for end in range(min(len(t), at + self.longest), at, -1) if (p := t[at:end]) in ids), -1)

    def _all_longest(self, t: str) -> list[int]:
        """The longest token at every place."""
        out, sizes = [-1] * len(t), [0] * len(t)
        for end, (n, i) in self.automaton.iter(t):
            if n > sizes[end - n + 1]:
                out[end - n + 1], sizes[end - n + 1] = i, n
        return out

    def encoded(self, text: str) -> Iterator[Iterator[tuple[str, bytes]]]:
        """Of every piece: the decimal text of its ids, and the bytes they decode to."""
        for block in blocks(text):
            for pieces in batched(self.split.findall(block), GROUP):
                yield map(self.pieces.__getitem__, pieces)

    def encode(self, text: str | None) -> list[int]:
        return [i for group in self.encoded(text or "") for piece in group for i in map(int, piece[0].split())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal text, SHA-256 of the decoded bytes."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for group in self.encoded(text or ""):
            found = list(group)
            decimals = " ".join([d for d, _ in found])
            of_ids.update((" " * bool(n) + decimals).encode())
            of_bytes.update(b"".join([b for _, b in found]))
            n += decimals.count(" ") + 1
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


_CUT = re.compile(r"(?<=\S) ")


def blocks(text: str, size: int = 1 << 22) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a blank that follows no white space.

    No match of a pattern that takes a blank only as its first character, or
    in a run of white space, crosses such a place.
    """
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _codec(key: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    return own(f"tokens {key}", lambda: Codec(ranks, pattern))


def token_digests(spark, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256) of every whole text; null counts as empty."""
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((ranks, pattern))  # the vocabulary file: a fixed size

    @F.arrow_udf(Encoded)
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(key, *shared.value)
        for texts in batches:
            rows = [codec.digests(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))],
                ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests.asNondeterministic()(text)


def token_ids(spark, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """The ids themselves, as an array column; null counts as empty."""
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((ranks, pattern))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(key, *shared.value)
        for texts in batches:
            yield pa.array([codec.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return encode.asNondeterministic()(text)
