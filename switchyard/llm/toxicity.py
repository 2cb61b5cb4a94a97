"""Toxicity by a learned lexicon, misspellings included, in context.

The lexicon (whole words, and stems that stand for any ending) comes from
labelled documents: a term stays if even the lower end of its log-odds is
high.  A Levenshtein automaton runs over the trie of all its terms at once:
its states are sets of (trie node, edits so far), built when a character
first leads there, and most words of a text leave it after a few characters.
Each term found is weighed by a window of words around it: quotation marks or
words of report make it a quotation, a second term or a direct address makes
it abuse.  A logistic model of the weights gives the score.

Terms and model are learned from a bounded sample of labelled rows
(about ``per_class`` of each label at most, by hash); the terms are held
against all clean texts, and scoring reads every whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, bounded_sample, let_go, own, written
from .tokens import blocks

WORD = re.compile(r"[^\W\d_]+")
#: Words joined by digits or single symbols: "id1ot", "m0ron", "sc*m".
JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:(?:\d+|_|[^\w\s])[^\W\d_]+)+")
WINDOW = 5  # words on each side
STEMS = (4, 5, 6)
LONGEST = 40  # letters of a term
#: Words of report and of address, quotation marks.
REPORT = frozenset("said says quote quoted quotes called word words term phrase wrote write "
                   "sagte genannt wort zitat dit disait mot citation dijo palabra cita".split())
ADDRESS = frozenset("you your youre u du dich dein deine ihr tu te toi ton vous usted tú eres".split())
QUOTES = "\"'“”„‚‘’«»‹›`"
MARKS = 1 << 27  # bits that say which ids may be labelled clean
SEEN = 160_000  # white-space tokens, and a quarter as many words, that a worker remembers
COUNTED = 50_000  # terms that a worker counts before it hands them on

Scored = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType()),
                       T.StructField("quoted", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])


@dataclass
class Lexicon:
    """``words`` and ``stems``: term -> weight; ``benign``: misspellings that labelled clean texts use no less than toxic ones."""

    words: dict[str, float]
    stems: dict[str, float]
    benign: frozenset[str] = frozenset()
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, str] = field(default_factory=dict)
    stem_ends: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        for term in sorted(self.words):
            node = self._grow(term)
            self.ends[node] = term
        for stem in sorted(self.stems):
            self.stem_ends[self._grow(stem)] = stem
        self._restart()
        self.seen = Recent(self._found, SEEN // 4)
        self.tokens = Recent(self._token, SEEN)

    def _restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.begun: list[str | None] = []  # of each state the stem that its letters are
        self.ended: list[list[tuple[str, int]]] = []  # of each state the terms that end there, with their edits
        self.start = self._state({(0, 0): 0})

    def _grow(self, term: str) -> int:
        node = 0
        for ch in term:
            if ch not in self.nodes[node]:
                self.nodes.append({})
                self.nodes[node][ch] = len(self.nodes) - 1
            node = self.nodes[node][ch]
        return node

    @staticmethod
    def edits(term: str) -> int:
        """Edits allowed in a term: short ones must be exact."""
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    MOST = 2

    def _state(self, least: dict[tuple[int, int], int]) -> int:
        """The number of a state; letters of a term may be left out (an edit each)."""
        edits: dict[int, int] = {}
        todo = [(e, n) for n, e in least]
        while todo:
            e, node = todo.pop()
            if e <= self.MOST and e < edits.get(node, self.MOST + 1):
                edits[node] = e
                todo += [(e + 1, child) for child in self.nodes[node].values()]
        key = frozenset(edits.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.begun.append(next((self.stem_ends[node] for node, e in key if e == 0 and node in self.stem_ends), None))
            self.ended.append([(self.ends[node], e) for node, e in key if node in self.ends])
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        least = {}
        for node, e in self.sets[state]:
            if (child := self.nodes[node].get(ch)) is not None:
                least[child, e] = 0
            if e < self.MOST:
                least[node, e + 1] = 0  # a letter too many
                for child in self.nodes[node].values():
                    least[child, e + 1] = 0  # another letter
        to = self._state(least)
        self.moves[state][ch] = to
        return to

    def find(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of the heaviest term that ``word`` is a spelling of."""
        state, best = self.start, None
        moves, begun, sets = self.moves, self.begun, self.sets
        for ch in word[:LONGEST + self.MOST + 1]:
            nxt = moves[state].get(ch)
            state = self._move(state, ch) if nxt is None else nxt
            if not sets[state]:
                return best
            if (stem := begun[state]) is not None and (best is None or self.stems[stem] > best[1]):
                best = stem + "*", self.stems[stem], 0
        if len(word) > LONGEST + self.MOST or not self.ended[state]:
            return best
        other = sum(not ch.isalpha() for ch in word) if len(word) < 7 else 0  # one digit or symbol may stand in a short term, too
        for term, e in self.ended[state]:
            if (e <= self.edits(term) or e == other == 1 and len(term) == 4) and (e == 0 or word not in self.benign):
                w = self.words[term] * 0.5**e
                if best is None or w > best[1]:
                    best = term, w, e
        return best

    def _found(self, word: str) -> tuple[str, float, int] | tuple[()]:
        if len(self.sets) > 200_000:  # states are rebuilt when asked for again
            self._restart()
        return self.find(word) or ()

    def lookup(self, word: str) -> tuple[str, float, int] | tuple[()]:
        """What ``find`` says, remembered; empty for no term."""
        return self.seen[word]

    def _token(self, token: str) -> tuple[int, bool]:
        """The number of words of a token without white space, and whether it holds a term."""
        words = WORD.findall(token)
        return len(words), any(map(self.lookup, words)) or len(words) > 1 and bool(_joined(self, token))

    def parsed(self, token: str) -> list[tuple[str, tuple, bool]]:
        """The words of a token, joined ones as one: (word, the term it spells or nothing, whether in quotation marks)."""
        joined = _joined(self, token)
        return [(w, joined.get(w) or self.lookup(w), 0 < start and end < len(token) and token[start - 1] in QUOTES and token[end] in QUOTES)
                for w, start, end in _places(token, joined)]


def _joined(lexicon: Lexicon, text: str) -> dict[str, tuple[str, float, int]]:
    """Joined words that spell a term as a whole, while none of their parts does."""
    find = lexicon.lookup
    return {w: f for w in set(JOINED.findall(text)) if len(w) <= LONGEST + Lexicon.MOST and (f := find(w)) and not any(map(find, WORD.findall(w)))}


def _places(text: str, joined: dict) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of all words; those of ``joined`` are one word."""
    whole = [m for m in JOINED.finditer(text) if m.group() in joined] if joined else []
    at = 0
    for m in whole:
        yield from ((p.group(), p.start(), p.end()) for p in WORD.finditer(text, at, m.start()))
        yield m.group(), m.start(), m.end()
        at = m.end()
    yield from ((p.group(), p.start(), p.end()) for p in WORD.finditer(text, at))


def _near(lexicon: Lexicon, tokens: Iterable[str]) -> list[list]:
    """The words of the first tokens that hold ``WINDOW`` words, token by token."""
    out, n = [], 0
    for token in tokens:
        if n >= WINDOW:
            break
        out.append(lexicon.parsed(token))
        n += len(out[-1])
    return out


def _windows(lexicon: Lexicon, text: str) -> Iterator[tuple[int, list[tuple[str, tuple, bool, list]]]]:
    """Of every block of a lower-case text the number of words, and its terms in order with the words around them.

    Words, joined ones too, hold no white space, so a text is looked through
    by its tokens; only those near a term are taken apart.  Windows reach over
    the borders of blocks.
    """
    parts = map(str.split, blocks(text))
    before: list[str] = []
    here, after = next(parts, []), next(parts, None)
    while True:
        seen = [lexicon.tokens[t] for t in here]
        found = []
        for i in [i for i, (_, hot) in enumerate(seen) if hot]:
            ahead = _near(lexicon, chain(islice(here, i + 1, None), after or ()))
            behind = _near(lexicon, chain(islice(reversed(here), len(here) - i, None), reversed(before)))
            left = [w for token in reversed(behind) for w in token][-WINDOW:]
            own = lexicon.parsed(here[i])
            line = left + own + [w for token in ahead for w in token][:WINDOW]
            for k in range(len(left), len(left) + len(own)):
                if line[k][1]:
                    found.append((*line[k], line[max(0, k - WINDOW):k] + line[k + 1:k + 1 + WINDOW]))
        yield sum(n for n, _ in seen), found
        if after is None:
            return
        before, here, after = (here if sum(n for n, _ in seen) >= WINDOW else before + here), after, next(parts, None)


def evidence(lexicon: Lexicon, text: str | None) -> tuple[float, float, int, int, int, list[str]]:
    """(abusive weight, quoted weight, words, hits, quoted hits, distinct terms) of a whole text."""
    abuse = quoted = 0.0
    words = hits = quotes = 0
    times: Counter[str] = Counter()
    terms = set()
    for n, found in _windows(lexicon, (text or "").lower()):
        words += n
        for word, (term, weight, _), marked, around in found:
            factor = 1.0
            if any(f for _, f, _ in around):
                factor *= 1.25
            if any(w in ADDRESS for w, *_ in around):
                factor *= 1.25
            hits += 1
            times[word] += 1
            terms.add(term)
            factor /= times[word]  # a word said again adds less
            if marked or any(w in REPORT for w, *_ in around[:WINDOW]):
                quotes += 1
                quoted += weight * factor
            else:
                abuse += weight * factor
    return abuse, quoted, words, hits, quotes, sorted(terms)


def _lexicon(words: dict[str, float], stems: dict[str, float], benign: frozenset[str] = frozenset()) -> Lexicon:
    """The lexicon of these terms, built once in a worker."""
    key = hashlib.sha256(repr((sorted(words.items()), sorted(stems.items()), sorted(benign))).encode()).hexdigest()
    return own(f"toxicity {key}", lambda: Lexicon(words, stems, benign))


def _features(abuse: float, quoted: float, words: int) -> list[float]:
    return [1.0, math.log1p(abuse), math.log1p(quoted), math.log1p(100 * abuse / (words + 10))]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]

    def score(self, text: str | None) -> tuple[float, int, int, list[str]]:
        abuse, quoted, words, hits, quotes, terms = evidence(self.lexicon, text)
        z = float(np.dot(self.coefficients, _features(abuse, quoted, words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits, quotes, terms


def _sequence(words: list[str]) -> int:
    """A hash of a sequence of words."""
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


MIXERS = np.random.default_rng(7).integers(0, 1 << 62, 64, dtype=np.uint64) * 2 + 1


def _signature(text: str) -> list[int]:
    """64 min-hashes of a text's words: two texts agree in as large a part of them as their words do (Jaccard)."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in set(WORD.findall(text.lower())) or {""}], np.uint64)
    least = np.full(len(MIXERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(words), 4096):
        least = np.minimum(least, (words[at:at + 4096, None] * MIXERS).min(axis=0))
    return (least >> np.uint64(33)).astype(np.int32).tolist()


def _copies(signatures: np.ndarray, sequences: np.ndarray, toxic: np.ndarray, alike: float = 0.5) -> np.ndarray:
    """The group of each row: rows of one label with the same words in order, or ``alike`` words, transitively.

    Rows that agree in two neighbouring min-hashes are compared in all of them.
    """
    up = np.arange(len(sequences))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(i: int, j: int) -> None:
        i, j = sorted((root(i), root(j)))
        up[j] = i

    first: dict[tuple, int] = {}
    for i, key in enumerate(zip(toxic.tolist(), sequences.tolist())):
        link(first.setdefault(key, i), i)
    own = np.array(sorted(first.values()), np.int64)
    for band in range(0, signatures.shape[1], 2):
        keys = np.column_stack([toxic[own], signatures[own, band], signatures[own, band + 1]])
        order = np.lexsort(keys.T)
        for shard in np.split(own[order], np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(axis=1)) + 1):
            while len(shard) > 1:
                todo, shard = [shard[0]], shard[1:]
                while todo and len(shard):
                    i = todo.pop()
                    near = (signatures[shard] == signatures[i]).mean(axis=1) >= alike
                    for j in shard[near]:
                        link(i, j)
                        todo.append(j)
                    shard = shard[~near]
    return np.array([root(i) for i in range(len(up))], np.int64)


def _forms(text: str) -> set[str]:
    """The terms that a text speaks for: its words, and stems with a star."""
    words = {w for w in WORD.findall(text.lower()) if 3 <= len(w) <= LONGEST}
    return words | {f"{w[:n]}*" for n in STEMS for w in words if len(w) > n}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method, with a ridge on all but the intercept; quoted weight may only speak against."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_class: int = 20_000, support: int = 5,
        sure: float = 0.7, chance: float = 24.0) -> Model:
    """The model of ``docs(id, text)`` by ``labels(id, toxic)``, ``toxic`` 0 or 1 (of several labels the larger).

    The labels are sampled first: the sample has a proven bound, so it is
    broadcast to the texts, which are not shuffled.
    Of copies (the same words in order, or about half of all words in
    common) with the same label one teaches, with the weight of all, so that
    copies do not make a chance word a term.  ``support``: toxic texts that a term needs;
    ``sure``: its log-odds less 2.5 standard errors; ``chance``: its G statistic,
    high enough for the many terms tried, both against all clean texts, also
    those that the sample leaves out: against a sample as small as the toxic
    one a rare term would need more toxic texts.  Terms are counted alike at
    all sizes; the sample's vocabulary bounds their number.  Labels that are
    null, neither 0 nor 1 or without an id or a text teach nothing.  Without
    both labels no text is toxic.
    """
    known = (labels.where("toxic in (0, 1)").where(F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic")))
    chosen_ids = written(bounded_sample(known, "id", "toxic", per_class), "toxicity-labels")
    texts = docs.where("text is not null").select(F.col(id_col).alias("id"), "text")
    sample = texts.join(F.broadcast(chosen_ids), "id")

    @F.arrow_udf(T.LongType())
    def sequence(texts: pa.Array) -> pa.Array:
        return pa.array([_sequence(WORD.findall(t.as_py().lower())) for t in texts], pa.int64())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def signature(texts: pa.Array) -> pa.Array:
        let_go()
        return pa.array([_signature(t.as_py()) for t in texts], pa.list_(pa.int32()))

    sample = written(sample.withColumn("_row", F.monotonically_increasing_id()).withColumn("sequence", sequence("text"))
                     .withColumn("signature", signature("text")), "toxicity-sample")
    keys = sample.select("_row", F.xxhash64("id").alias("pick"), "sequence", "signature", "toxic", "weight").toPandas()  # two per_class rows
    keys = keys.sort_values(["pick", "_row"], ignore_index=True)
    signatures = np.array(keys["signature"].tolist(), np.int32).reshape(len(keys), len(MIXERS))
    keys["group"] = _copies(signatures, keys["sequence"].to_numpy(np.int64), keys["toxic"].to_numpy(np.int64))
    kept = keys.groupby("group", as_index=False).agg(_row=("_row", "first"), weight=("weight", "sum"))[["_row", "weight"]]
    # an Arrow table: rows of Python objects would go through a second set of workers
    kept = sample.sparkSession.createDataFrame(pa.table({"_row": kept["_row"].to_numpy(np.int64), "weight": kept["weight"].to_numpy(float)}))
    chosen = written(sample.drop("weight").join(F.broadcast(kept), "_row").select("text", "toxic", "weight"), "toxicity-texts")
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(Lexicon({}, {}), (-30.0, 0.0, 0.0, 0.0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        of: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                of[toxic].update(_forms(text))
                if len(of[0]) + len(of[1]) > COUNTED:  # a worker holds no more at a time than these and one text's
                    yield _counted(of)
                    of = Counter(), Counter()
        yield _counted(of)

    a, b = F.col("a"), F.col("b")
    counted = chosen.mapInPandas(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(a >= support)
    # all clean texts are asked for all terms with enough toxic texts: no estimate says beforehand which will be sure
    counted, n[0] = _asked(texts, known.where("toxic = 0"), counted)
    odds = F.log((a + 0.5) / (n[1] + 1)) - F.log((b + 0.5) / (n[0] + 1))
    share = F.lit(n[1] / (n[0] + n[1]))
    surprise = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    terms = (counted.where(surprise >= chance).withColumn("low", odds - 2.5 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).where(F.col("low") >= sure)
             .select("term", "low").collect())
    weights = {r["term"]: float(r["low"]) for r in terms}
    words = {t: w for t, w in weights.items() if not t.endswith("*")}
    stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
    # a stem that one word makes up is that word: "idio*" says no more than "idiot"
    stems = {s: w for s, w in stems.items() if not any(t.startswith(s) and v >= w for t, v in words.items())}
    draft = chosen.sparkSession.sparkContext.broadcast((words, stems))

    def misspelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(*draft.value)
        for batch in batches:
            for text, toxic, weight in zip(batch["text"], batch["toxic"], batch["weight"]):
                text = text.lower()
                near = [w for w in set(WORD.findall(text)) | _joined(lexicon, text).keys() if (f := lexicon.lookup(w)) and f[2]]
                if near:
                    yield pd.DataFrame({"word": pd.Series(near, dtype=object), "toxic": toxic, "weight": weight})

    # a spelling is harmless if clean texts use it no less than toxic ones do
    w = {r["toxic"]: r["w"] for r in chosen.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    rate = [F.sum(F.when(F.col("toxic") == k, F.col("weight")).otherwise(0.0)) / w[k] for k in (0, 1)]
    used = chosen.mapInPandas(misspelt, "word string, toxic int, weight double").groupBy("word").agg(rate[0].alias("clean"), rate[1].alias("toxic"))
    benign = {r["word"] for r in used.where("clean >= toxic").select("word").collect()}
    shared = chosen.sparkSession.sparkContext.broadcast((words, stems, frozenset(benign)))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(*shared.value)
        for batch in batches:
            got = [evidence(lexicon, t)[:3] for t in batch["text"]]
            yield pd.DataFrame({"abuse": [g[0] for g in got], "quoted": [g[1] for g in got], "words": [g[2] for g in got],
                                "toxic": batch["toxic"], "weight": batch["weight"]})

    seen = chosen.mapInPandas(weigh, "abuse double, quoted double, words long, toxic int, weight double").toPandas()  # two per_class rows
    x = np.array([_features(*r) for r in zip(seen["abuse"], seen["quoted"], seen["words"])])
    fitted = _logistic(x, seen["toxic"].to_numpy(float), seen["weight"].to_numpy(float))
    return Model(Lexicon(words, stems, frozenset(benign)), tuple(map(float, fitted)))


def _asked(texts: DataFrame, clean: DataFrame, counted: DataFrame) -> tuple[DataFrame, int]:
    """``counted`` with b from all texts of ``clean``, and their number; of texts with the same words one counts.

    The terms asked for come from the toxic sample, which is bounded.  Texts
    are not shuffled, only the numbers of the terms that they hold: a bitmap
    of fixed size says which ids may be labelled clean, and the join of their
    word sequences with the labels says which are.
    """
    numbered = counted.select("term", "a").repartition(1).withColumn("i", F.monotonically_increasing_id().cast("int"))  # from 0 on
    numbered = written(numbered, "toxicity-counted")
    index = {r["term"]: r["i"] for r in numbered.select("term", "i").collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    marked = clean.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marks = np.zeros((MARKS >> 15) + 2, "V4096")  # a bucket has 32,768 bits
    for r in marked.collect():
        marks[r["bucket"]] = bytes(r["bits"])
    shared = texts.sparkSession.sparkContext.broadcast((index, marks.tobytes()))

    @F.arrow_udf(T.StructType([T.StructField("sequence", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType()))]))
    def held(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        let_go()
        index, marks = shared.value
        marks = np.frombuffer(marks, np.uint8)

        def terms_of(word: str) -> tuple[int, ...]:
            """The numbers of the terms that a word speaks for."""
            forms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)] if 3 <= len(word) <= LONGEST else []
            return tuple(index[f] for f in forms if f in index)

        of = Recent(terms_of, SEEN)
        for buckets, positions, batch in batches:
            bits = positions.to_numpy()
            maybe = marks[buckets.to_numpy() * 4096 + bits // 8] >> (bits % 8) & 1
            sequences, numbers = [], []
            for asks, t in zip(maybe.tolist(), batch):
                if not asks:
                    sequences.append(None)
                    numbers.append(None)
                    continue
                found = WORD.findall(t.as_py().lower())
                sequences.append(_sequence(found))
                numbers.append(sorted(set(chain.from_iterable(map(of.__getitem__, set(found))))))
            yield pa.StructArray.from_arrays([pa.array(sequences, pa.int64()), pa.array(numbers, pa.list_(pa.int32()))], ["sequence", "terms"])

    asked = held.asNondeterministic()(F.bitmap_bucket_number(place), F.bitmap_bit_position(place), "text")
    told = texts.select("id", asked.alias("h")).where("h.sequence is not null").select("id", "h.sequence", "h.terms")
    told = written(told, "toxicity-clean")
    # the same words in order hold the same terms, so ids and labels meet without them, and they are shuffled once
    sequences = written(told.select("id", "sequence").join(clean.select("id"), "id", "left_semi").select("sequence").distinct(), "toxicity-sequences")
    once = told.groupBy("sequence").agg(F.first("terms").alias("terms")).join(sequences, "sequence", "left_semi")
    b = once.select(F.explode("terms").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("b"))
    return numbered.join(b, "i", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b")), sequences.count()


def _counted(of: tuple[Counter, Counter]) -> pd.DataFrame:
    terms = list(of[0].keys() | of[1].keys())
    return pd.DataFrame({"term": pd.Series(terms, dtype=object), "a": [of[1][t] for t in terms], "b": [of[0][t] for t in terms]})


def scored(spark, model: Model, text: Column) -> Column:
    """A struct column (score, hits, quoted, terms) of every whole text; null and empty texts have no hit.

    A score depends on its text alone: equal texts have equal scores, other
    columns are not looked at.  Windows and joined words of very long texts
    are those of the whole text.
    """
    shared = spark.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.lexicon.benign, model.coefficients))

    @F.arrow_udf(Scored)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, stems, benign, coefficients = shared.value  # terms of the sample's vocabulary
        own = Model(_lexicon(words, stems, benign), coefficients)
        for texts in batches:
            rows = [own.score(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                ["score", "hits", "quoted", "terms"])

    return run.asNondeterministic()(text)
