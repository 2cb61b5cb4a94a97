"""Word-end BPE, the Merkle manifest and the whitening, against brute force and on odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from switchyard.llm import merkle, queries, whitening, word_bpe

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, rank long, leaf string, grp string"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes a frame as a table of a folder, as the queries read it."""
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


def odd_documents(frame):
    return frame([
        (1, None, None, None, None, 1.0, 1, "x", "y"), (2, "", "en", "a", 0, None, None, None, None), (3, "  \t\n", None, None, 4, None, None, None, None),
        (4, "word " * 60_000, "en", "a", 300_000, None, None, None, None), (5, "same text", "en", "b", 9, None, None, None, None),
        (5, "same text", "en", "b", 9, None, None, None, None), (5, "other text", "en", "b", None, None, None, None, None),
        (None, "no id", "en", None, 5, None, None, None, None), (7, "É 1:2", "", "a", 5, None, None, None, None), (14, "-", "é", "-", None, None, None, None, None),
        (8, "a<|endoftext|>b", "zz", "q", 2**63 - 1, None, None, None, None)], DOC)


# ---------------------------------------------------------------- 11 word-end BPE

DEFINITION = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(DEFINITION)
CODEC = word_bpe.Codec(DEFINITION)


def as_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


PARTS = ["a", "B", "'s", "'LL", " ", "\n", "é", "é", "̣", "Σ", "ǅ", "1", "٣", "!", "…", "中", "Ᲊ", "߽", "\x1f", "\x85", "\xa0", "　",
         "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "the ", "ing", "ͅ", "\U00010d50", "՘", "İ", "ß", "\0"]


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
@settings(max_examples=1500, deadline=None)
def test_word_bpe_equals_the_library(text):
    ids, decoded = as_library(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == decoded


def test_every_character_is_cut_as_the_library_cuts_it():
    for start in range(0, 0x110000, 4096):
        text = " a".join(chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        assert CODEC.encode(text) == as_library(text)[0], hex(start)


def test_stale_pairs_are_skipped_in_long_pieces():
    rng = random.Random(5)
    for _ in range(200):
        piece = "".join(rng.choice("abcdefinorst") for _ in range(rng.randint(1, 400)))
        assert CODEC.encode(piece) == as_library(piece)[0]
    assert CODEC.encode("x" * 100_000) == as_library("x" * 100_000)[0]


def test_remembered_words_stay_right_when_they_are_many(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE", 6)
    codec = word_bpe.Codec(DEFINITION)
    text = " ".join(random.Random(2).choices(["alpha", "beta,", "gamma", "x" * 70, "delta", "it's", "eta", "theta"], k=300))
    assert codec.encode(text) == as_library(text)[0]


def test_word_bpe_query_on_whole_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_word_bpe(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, decoded = as_library(rows[r["doc_id"]] or "")
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_word_bpe_on_odd_tables(spark, frame, folder):
    docs = odd_documents(frame)
    got = queries.op11_word_bpe(spark, folder(documents=docs)).collect()
    want = []
    for r in docs.collect():
        ids, decoded = as_library(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_word_bpe_of_an_empty_table(spark, frame, folder):
    assert queries.op11_word_bpe(spark, folder(documents=frame([], DOC))).collect() == []


def test_ids_and_texts_as_columns(spark, frame):
    df = frame([("Hello, World's <|endoftext|>",), (None,), ("",)], "text string")
    ids = df.select("text", word_bpe.token_ids(spark, F.col("text"), DEFINITION).alias("ids"))
    out = {r["text"]: (list(r["ids"]), r["t"]) for r in ids.select("*", word_bpe.decoded(spark, F.col("ids"), DEFINITION).alias("t")).collect()}
    want = as_library("Hello, World's <|endoftext|>")
    assert out == {"Hello, World's <|endoftext|>": want, None: ([], ""), "": ([], "")}


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        word_bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


# ---------------------------------------------------------------- 12 Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    fields = r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = members, levels_of([leaf_of(r) for r in members])
    top = levels_of([trees[g][1][-1][0] for g in order])
    out = []
    for nth, g in enumerate(order):
        members, levels = trees[g]
        for i, r in enumerate(members):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node, siblings = leaf_of(r, int(tampered)), []
            for tree, at in ((levels, i), (top, nth)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2:at // 2 * 2 + 2]
                    siblings += [d for k, d in enumerate(run) if k != at % 2]
                    run[at % 2] = node
                    node, at = H(*run), at // 2
            out.append((r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], H(*siblings), node, node == top[-1][0]))
    return sorted(map(str, out))


def test_merkle_query_matches_the_plain_tree(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, SF).collect()]
    assert sorted(map(str, got)) == plain_manifest(rows)
    assert 0 < sum(not g[-1] for g in got) < len(got) / 3


def test_merkle_on_odd_tables(spark, frame, folder):
    docs = odd_documents(frame)
    got = queries.op12_merkle_manifest(spark, folder(documents=docs)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(docs.collect())


def test_merkle_of_empty_and_single_tables(spark, frame, tmp_path):
    for name, rows in (("none", []), ("one", [(3, "t", "en", "s", 1, None, None, None, None)])):
        docs = frame(rows, DOC)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op12_merkle_manifest(spark, f"{tmp_path}/{name}").collect()
        assert sorted(str(tuple(r)) for r in got) == (plain_manifest(docs.collect()) if rows else [])


@pytest.mark.parametrize("bits", [1, 2])
def test_merkle_of_many_tiers_and_groups(spark, frame, monkeypatch, bits):
    """Small records, so that groups differ in depth and some end above others."""
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "FAN", 1 << bits)
    sizes = {None: 1, "a": 1, "b": 2, "c": 3, "d": 17, "e": 33, "f": 5}
    docs = frame([(100 * k + i, f"text {i % 3}", g, "s", i, None, None, None, None) for k, (g, n) in enumerate(sizes.items()) for i in range(n)], DOC)
    rows = docs.select("doc_id", "lang", "rank", "grp", merkle.record_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    manifest = merkle.build(rows, "lang", ["doc_id"], "leaf")
    got = merkle.prove(manifest, manifest.leaves).select("row.doc_id", "row.leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"),
                                                         merkle.folded(F.col("row.leaf"), F.col("path")).alias("f")).collect()
    want = {w.split(",")[0]: w for w in plain_manifest(docs.collect())}
    assert len(got) == sum(sizes.values()) and all(r["f"] == r["root"] for r in got)
    for r in got:
        assert want[f"({r['doc_id']}"].startswith(str(tuple(r)[:5])[:-1])
    some = manifest.leaves.where("grp = 'e' and rank in (0, 20, 32) or grp is null")
    few = merkle.prove(manifest, some).select("row.doc_id", merkle.folded(F.col("row.leaf"), F.col("path")).alias("f"), "root").collect()
    assert sorted(r["doc_id"] for r in few) == [0, 500, 520, 532] and all(r["f"] == r["root"] for r in few)


def test_a_changed_leaf_or_sibling_is_noticed(spark, frame):
    rows = frame([(i, "g", H(str(i))) for i in range(9)], "id long, grp string, leaf string")
    manifest = merkle.build(rows, "grp", ["id"], "leaf")
    proofs = merkle.prove(manifest, manifest.leaves).cache()
    other = F.transform("path", lambda s: F.struct(s["right"].alias("right"), F.lit(H("x")).alias("sibling")))
    wrong = proofs.select((merkle.folded(F.lit(H("x")), F.col("path")) == F.col("root")).alias("a"), (merkle.folded(F.col("row.leaf"), other) == F.col("root")).alias("b"))
    assert not any(r["a"] or r["b"] for r in wrong.collect())


# ---------------------------------------------------------------- 13 whitening

def random_orthogonal(rng, d):
    return np.linalg.qr(rng.normal(size=(d, d)))[0]


def shaped(rng, values):
    u, v = random_orthogonal(rng, len(values)), random_orthogonal(rng, len(values))
    return (u * np.asarray(values)) @ v.T


RNG = np.random.default_rng(1)
MATRICES = {
    "normal": RNG.normal(size=(64, 64)), "graded": RNG.normal(size=(40, 40)) * np.logspace(0, -8, 40), "graded up": RNG.normal(size=(40, 40)) * np.logspace(-8, 0, 40),
    "low rank": RNG.normal(size=(20, 3)) @ RNG.normal(size=(3, 20)), "identity": np.eye(12), "zero": np.zeros((5, 5)), "one": np.array([[2.0]]),
    "few rows": RNG.normal(size=(3, 10)), "columns without variance": np.hstack([RNG.normal(size=(9, 4)), np.zeros((9, 2)), RNG.normal(size=(9, 3))]),
    "copied columns": np.hstack([MORE := RNG.normal(size=(15, 5)), MORE, MORE]), "equal": shaped(RNG, [3.0] * 20),
    **{f"cluster {gap}": shaped(RNG, [*(5 * (1 + gap * np.arange(4))), *np.linspace(1, 2, 26)]) for gap in (1e-3, 1e-6, 1e-9, 1e-12, 0)},
    "wilkinson": np.diag(np.abs(np.arange(21) - 10.0) + 1) + np.diag(np.ones(20), 1)}


@pytest.mark.parametrize("name", MATRICES)
def test_directions_are_singular_vectors(name):
    r = MATRICES[name]
    values, rows = whitening.directions(r, 8)
    true = np.zeros(r.shape[1])
    true[:min(r.shape)] = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(values) - true).max() <= 1e-13 * max(true[0], 1e-300)
    alive = rows[values[:len(rows)] > 1e-25 * values[0]]
    assert np.abs(alive @ alive.T - np.eye(len(alive))).max(initial=0) < 1e-11
    for z, e in zip(alive, values):
        assert np.linalg.norm(r.T @ (r @ z) - e * z) <= 1e-12 * values[0]


def test_small_singular_values_of_a_bidiagonal_matrix_are_as_accurate_as_large_ones():
    from fractions import Fraction
    n = 12
    a, b = [Fraction(10) ** (-2 * k) for k in range(n)], [Fraction(10) ** (-2 * k - 1) for k in range(n - 1)]
    got = whitening.qd_values(np.array(list(map(float, a))), np.array(list(map(float, b))))
    product = math.prod(x * x for x in map(Fraction, map(float, a)))  # of the squared values: the squared determinant
    found = math.prod(Fraction(float(x)) for x in got)
    assert abs(found / product - 1) < 1e-13 and (np.diff(got) < 0).all()


def plain_whitening(vectors, k=4):
    """Grid, fit list, exact deviations and eigenpairs by numpy; rows of one length."""
    x = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in vectors}
    listed = np.array(sorted(set(x.values())), dtype=float)
    n, sums = len(listed), [sum(c) for c in zip(*set(x.values()))]
    centred = listed - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(g, sums)), [(np.array(g) - np.array(sums) / n) @ v[:, c] / math.sqrt(e[c]) for c in range(k)],
                [e[c] / e.sum() for c in range(k)]) for i, g in x.items()}


def held_against(got, want, k=4):
    signs = {}
    assert len(got) == len(want) * k
    for r in got:
        n, deviation, w, explained = want[r["vec_id"]]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(w[c]), rel=1e-7, abs=1e-9)
        if abs(w[c]) > 1e-3:
            signs.setdefault(c, set()).add(r["whitened"] * w[c] > 0)
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_query_matches_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held_against(queries.op13_embedding_whitening(spark, SF).collect(), plain_whitening([(r["vec_id"], r["embedding"]) for r in rows]))


def test_whitening_on_odd_tables(spark, frame, folder):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 0.2]], 0, 1) for i in range(60)]
    good += [(100 + i, good[0][1], 0, 1) for i in range(30)] + [(200, [0.0] * 5, 0, 1), (201, [-0.0] * 5, 0, 1)]
    bad = [(300, None, 0, 1), (301, [1.0, None, 1.0, 1.0, 1.0], 0, 1), (302, [float("nan")] * 5, 0, 1), (303, [float("inf")] * 5, 0, 1), (304, [], 0, 1)]
    table = frame(good + bad, "vec_id long, embedding array<double>, size int, n int")
    held_against(queries.op13_embedding_whitening(spark, folder(embeddings=table)).collect(), plain_whitening([(i, v) for i, v, *_ in good]))


def test_whitening_without_variance_and_of_other_lengths(spark, frame):
    table = frame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 5.0]), (4, [2.0, 5.0]), (5, [4.0, 5.0]), (None, [4.0, 5.0]), (6, [1e300, -1e300, 0.0, 1.0]),
                   (7, [-1e300, 1e300, 0.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(table).collect()
    alone = [r for r in got if r["vec_id"] in (1, 2)]
    assert len(alone) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in alone)
    two = sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got if r["vec_id"] in (3, 4, 5, None))
    assert two == [(i, c, 3) for i in (0, 3, 4, 5) for c in (1, 2)]
    first = {r["vec_id"]: r["whitened"] for r in got if r["vec_id"] in (3, 4, 5) and r["component"] == 1}
    assert [abs(first[i]) for i in (3, 4, 5)] == pytest.approx([4 / 3 / math.sqrt(14 / 9), 1 / 3 / math.sqrt(14 / 9), 5 / 3 / math.sqrt(14 / 9)])
    assert all(r["whitened"] is None and r["explained"] == 0 for r in got if r["vec_id"] in (3, 4, 5) and r["component"] == 2)
    assert {r["deviation"] for r in got if r["vec_id"] in (6, 7)} == {None}


def test_whitening_of_an_empty_table(spark, frame):
    assert whitening.whitened(frame([], "vec_id long, embedding array<float>")).collect() == []


def test_factors_meet_over_many_partitions(spark, frame):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(600, 4))
    got = whitening.factors_of(frame([(4, list(map(float, r))) for r in rows], "size int, c array<double>").repartition(70)).collect()
    r = np.array([x["r"] for x in sorted(got, key=lambda x: x["row"])])
    assert r.shape == (4, 4) and np.allclose(r.T @ r, rows.T @ rows)
