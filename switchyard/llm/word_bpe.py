"""BPE with word ends: merges from a priority queue over a doubly linked list of symbols.

A piece's bytes become symbols, each linked to the symbol before and after;
the last one carries the vocabulary's word end.  Every pair of neighbours
that has a merge waits in a queue, ordered by the merge's rank, then by
place.  The best is taken and its right symbol leaves the list; the pairs
this makes are queued, and those it has undone stay in the queue and are
skipped as stale when they come up.  Work per piece is n log n.  Decoding
concatenates the vocabulary's strings.

Null texts count as empty: no ids, digests of nothing.  Equal texts give
equal rows, an empty table an empty result, other columns are not looked at.
Texts of any length are read in blocks cut at white space, which no token
crosses; a word without white space is handled whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import Recent, own
from .tokens import Encoded, blocks, splitter

CACHE = 500_000  # words, and pieces, that a worker remembers

#: Where NFC and lower case of the Unicode tables in use cannot differ: characters under U+0300.
_PLAIN = regex.compile(r"[\x00-˿]*")
#: White space of ``str.split`` that the tokenizer does not know as such.
_CONTROLS = regex.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Codec:
    """A tokenizer file with word ends: lower case, white space dropped, bytes as letters.

    ``definition`` is the text of the JSON file.  A file that asks for other
    steps than these is refused.
    """

    def __init__(self, definition: str):
        d = json.loads(definition)
        model, steps = d["model"], [s["type"] for s in d["normalizer"]["normalizers"]]
        split, mapped = d["pre_tokenizer"]["pretokenizers"]
        wanted = (model["type"] == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split"
                  and split["behavior"] == "Removed" and split["invert"] and mapped["type"] == "ByteLevel"
                  and not mapped["add_prefix_space"] and not mapped["use_regex"] and d["decoder"] is None and not model["dropout"]
                  and not model["ignore_merges"] and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in d["added_tokens"]))
        if not wanted:
            raise ValueError("not a tokenizer of lower-case words with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.added = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.added).items()}
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + model["end_of_word_suffix"]] for c in letters]
        self.split = splitter(split["pattern"]["Regex"])
        self.library_split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.library_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known = Recent(self.encode_piece, CACHE)
        self.words = Recent(self._encode_word, CACHE)

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece of a word, as the merges make them."""
        raw = piece.encode()
        if not raw:
            return []
        symbols = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.final[raw[-1]])
        size, merges = len(symbols), self.merges
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = [(*found, at) for at, pair in enumerate(pairwise(symbols)) if (found := merges.get(pair))]
        queue = [(rank, at, made) for rank, made, at in queue]
        heapq.heapify(queue)
        while queue:
            _, at, made = heapq.heappop(queue)
            right = after[at]
            if symbols[at] < 0 or right >= size or (found := merges.get((symbols[at], symbols[right]))) is None or found[1] != made:
                continue  # stale: one of the two has merged since
            symbols[at], symbols[right] = made, -1
            end = after[at] = after[right]
            if end < size:
                before[end] = at
                if found := merges.get((made, symbols[end])):
                    heapq.heappush(queue, (found[0], at, found[1]))
            start = before[at]
            if start >= 0 and (found := merges.get((symbols[start], made))):
                heapq.heappush(queue, (found[0], start, found[1]))
        return [s for s in symbols if s >= 0]

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word, in composed lower case."""
        if _PLAIN.fullmatch(word):
            return self.split.findall(word.lower())
        # characters whose class, case or combining order depends on the Unicode version: by the library's own tables
        return [p for p, _ in self.library_split.pre_tokenize_str(self.library_normal.normalize_str(word))]

    def _encode_word(self, word: str) -> tuple[str, str]:
        """The ids of a word as decimal text, and its strings, both joined by blanks."""
        ids = [i for piece in self.pieces(word) for i in self.known[piece]]
        return " ".join(map(str, ids)), self.decode(ids)

    def encoded(self, text: str) -> Iterator[list[tuple[str, str]]]:
        """Of every block of a text its words' ids and strings."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield [(str(self.added[part]), part)]
                continue
            for block in blocks(part):
                words = block.split() if not _CONTROLS.search(block) else [w for w in _SPACES.split(block) if w]
                if words:
                    yield [*map(self.words.__getitem__, words)]

    def encode(self, text: str | None) -> list[int]:
        return [i for block in self.encoded(text or "") for decimals, _ in block for i in map(int, decimals.split())]

    def decode(self, ids: Iterable[int]) -> str:
        """The strings of ``ids`` joined by blanks, as a tokenizer without a decoder joins them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal text, SHA-256 of the decoded text."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for block in self.encoded(text or ""):
            joint = " " * bool(n)
            decimals = " ".join([d for d, _ in block])
            of_ids.update((joint + decimals).encode())
            of_text.update((joint + " ".join([s for _, s in block])).encode())
            n += decimals.count(" ") + 1
        return n, of_ids.hexdigest(), of_text.hexdigest()


def _codec(definition: str) -> Codec:
    key = hashlib.sha256(definition.encode()).hexdigest()
    return own(f"word_bpe {key}", lambda: Codec(definition))


def token_digests(spark, text: Column, definition: str) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256) of every whole text; null counts as empty."""
    shared = spark.sparkContext.broadcast(definition)  # the vocabulary file: a fixed size

    @F.arrow_udf(Encoded)
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        for texts in batches:
            rows = [codec.digests(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))],
                ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests.asNondeterministic()(text)


def token_ids(spark, text: Column, definition: str) -> Column:
    """The ids themselves, as an array column; null counts as empty."""
    shared = spark.sparkContext.broadcast(definition)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        for texts in batches:
            yield pa.array([codec.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return encode.asNondeterministic()(text)


def decoded(spark, ids: Column, definition: str) -> Column:
    """The text that an array of ids decodes to; null for null."""
    shared = spark.sparkContext.broadcast(definition)

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        for rows in batches:
            yield pa.array([None if not r.is_valid else codec.decode(r.as_py()) for r in rows], pa.string())

    return decode.asNondeterministic()(ids)
