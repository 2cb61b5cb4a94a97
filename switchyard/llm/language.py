"""Language identification by bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds one bit per language (a *slice* of 64
languages per 64-bit word), so one lookup of an n-gram - the AND of its slots -
returns the set of all languages that contain it.  A text's answer is the
popcount of each language's bit over its n-grams, corrected for that
language's rate of false positives.

Training counts n-grams on a bounded sample (``per_language`` documents of
each language, chosen by hash) and keeps ``max_grams`` n-grams of each
language; both bounds are parameters.  Prediction reads every whole text in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, let_go

UNKNOWN = "und"
SIZES = (3, 4)
HASHES = 3
BLOCK = 1 << 20  # characters looked at together; texts of any length are read to their end

Prediction = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("grams", T.LongType())])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, in blocks: letters in lower case, anything else one blank."""
    if not text:
        return
    step = max(SIZES) - 1
    for start in range(0, len(text), BLOCK):
        part = text[max(0, start - step):start + BLOCK].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        if not letter.any():
            continue
        code = np.where(letter, code, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of other characters only the first stays
        code = np.concatenate(([32], code[keep], [32])).astype(np.uint64)
        out = []
        for n in SIZES:
            if len(code) >= n:
                h = np.full(len(code) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + code[k:len(code) - n + 1 + k]
                out.append(_mix(h * np.uint64(0x9E3779B97F4A7C15)))
        yield np.concatenate(out)


@dataclass(frozen=True)
class Filter:
    """``slots``: (slots, words of 64 languages); ``false_rate``: by language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    def _at(self, h: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(len(self.slots) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(i) * step) & size for i in range(HASHES)]

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Filter:
        names = tuple(sorted(grams))
        most = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, int(8 * max(1, most) - 1).bit_length())
        out = cls(names, np.zeros((size, max(1, -(-len(names) // 64))), np.uint64), np.zeros(len(names)))
        for i, name in enumerate(names):
            word, bit = divmod(i, 64)
            for at in out._at(grams[name]):
                out.slots[at, word] |= np.uint64(1 << bit)
            filled = (out.slots[:, word] >> np.uint64(bit) & np.uint64(1)).mean()
            out.false_rate[i] = filled**HASHES
        return out

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits."""
        first, *rest = self._at(h)
        mask = self.slots[first]
        for at in rest:
            mask = mask & self.slots[at]
        return mask

    def predict(self, text: str | None) -> tuple[str, float, int]:
        total, hits = 0, np.zeros(len(self.languages))
        for h in gram_hashes(text):
            total += len(h)
            mask = self.masks(h)
            for i in range(len(self.languages)):
                word, bit = divmod(i, 64)
                hits[i] += np.count_nonzero(mask[:, word] & np.uint64(1 << bit))
        if not total or not self.languages:
            return UNKNOWN, 0.0, total
        true = (hits - total * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)
        best = int(np.argmax(true))  # ties: the first name
        return self.languages[best], float(np.clip(true[best] / total, 0, 1)), total


def fit(labelled: DataFrame, id_col: str = "doc_id", per_language: int = 5000, max_grams: int = 200_000,
        min_count: int = 3, rival: float = 0.25) -> Filter:
    """The filter of ``labelled(id, text, lang)``; rows without text or lang teach nothing.

    An n-gram belongs to a language if it is at least ``rival`` times as
    frequent there as in the language where it is most frequent.  Rows are
    chosen by a hash of the id, copies included.
    """
    rows = labelled.where("text is not null and lang is not null").select(id_col, "text", "lang")
    sample = bounded_sample(rows, id_col, "lang", per_language).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held: list[np.ndarray] = []
                for h in (h for t in texts for h in gram_hashes(t)):
                    held.append(h)
                    if sum(map(len, held)) > BLOCK:  # counted in parts of bounded size
                        yield _counts(lang, held)
                        held = []
                if held:
                    yield _counts(lang, held)

    seen = (sample.mapInPandas(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    by_gram = seen.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("langs"))  # a row per language
    totals = {r["lang"]: r["t"] for r in sample.mapInPandas(count, "lang string, gram long, n long")
              .groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    if not totals:
        return Filter.build({})
    total = F.create_map(*[F.lit(x) for k, v in sorted(totals.items()) for x in (k, float(v))])
    rates = F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] / total[x["lang"]]).alias("p")))
    kept = (by_gram.select("gram", rates.alias("r"))
            .select("gram", F.explode(F.filter("r", lambda x: x["p"] >= rival * F.array_max(F.transform("r", lambda y: y["p"])))).alias("x"))
            .select("gram", "x.lang", "x.p"))
    grams = {}
    for lang in sorted(totals):
        top = kept.where(F.col("lang") == lang).orderBy(F.desc("p"), "gram").limit(max_grams)
        grams[lang] = top.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64)
    return Filter.build(grams)


def _counts(lang: str, hashes: list[np.ndarray]) -> pd.DataFrame:
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    return pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n})


def predicted(spark, model: Filter, text: Column) -> Column:
    """A struct column (lang, score, grams) for every whole text.

    ``und`` with score 0 for a null text or one without a letter; score is the
    corrected share of the text's n-grams that its language contains.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by max_grams and the number of languages

    @F.arrow_udf(Prediction)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for texts in batches:
            rows = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.int64())], ["lang", "score", "grams"])

    return predict.asNondeterministic()(text)
