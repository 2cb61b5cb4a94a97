"""Every operator against brute force, an exact round trip or held-out labels, and on odd tables."""

import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from switchyard.llm import hnsw, language, licenses, mixing, neighbours, queries, sharding, simhash, tokens, toxicity, url_filter
from switchyard.llm.components import connected_components

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, component_id string"


def odd_documents(frame):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    return frame([
        (1, None, None, None, None, 1.0, "x", "y"), (2, "", "en", "a", 0, None, None, None), (3, "  \t\n", None, None, 4, None, None, None),
        (4, "word " * 60_000, "en", "a", 300_000, None, None, None), (5, "same text of a copy", "en", "b", 19, None, None, None),
        (5, "same text of a copy", "en", "b", 19, None, None, None), (6, "same text of a copy", None, "b", 19, None, None, None),
        (None, "no id at all here", "en", None, 17, None, None, None), (7, "123 456", "en", "a", 7, None, None, None)], DOC)


# ---------------------------------------------------------------- components

def roots_of(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_match_union_find(frame):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 300)]
    edges = [(a, b) for a, b in edges if a != b]
    got = connected_components(frame([*edges, (None, 4), (9, 9)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == roots_of(edges)


def test_components_of_no_links(frame):
    assert connected_components(frame([], "src long, dst long")).count() == 0


# ---------------------------------------------------------------- 5 simhash

def plain_fingerprint(text, k=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aAbB É \n\t\x0b\x1c", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_matches_the_plain_rule(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_query_matches_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op5_simhash_dedup(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = roots_of(links)
    assert len(got) == len(texts) and links
    for i in ids:
        assert got[i]["fingerprint"] == f"{prints[i]:016x}" and got[i]["component_id"] == roots.get(i, i)


def test_simhash_links_in_cells_match_all_pairs(frame):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints)[:6]:
        for _ in range(60):
            q = p
            for _ in range(rng.randrange(1, 5)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in sorted(prints)]
    got = connected_components(simhash.links(frame(signed, "fp long"), cell=16))
    full = [(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert {r["node"]: r["component"] for r in got.collect()} == roots_of(full)


def test_bk_tree_search_matches_a_scan():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 256, 200).astype(np.uint64))
    queries_ = rng.integers(0, 256, 40).astype(np.uint64)
    got = {(node, int(q)) for node, near in simhash.BKTree(prints).search(queries_, 2) for q in near}
    assert got == {(i, j) for i, p in enumerate(prints) for j, q in enumerate(queries_) if int(p ^ q).bit_count() <= 2}


def test_simhash_of_odd_documents(frame):
    rows = simhash.near_duplicates(odd_documents(frame)).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == [(0, 1)] and by[5] == [by[6][0]] * 2 and by[6][0][1] == 5 and len(by[None]) == 1
    assert simhash.near_duplicates(odd_documents(frame).limit(0)).count() == 0


# ---------------------------------------------------------------- 1 language

def test_language_of_held_out_documents(spark, documents):
    got = queries.op1_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_filter_returns_all_languages_of_a_gram():
    grams = {n: np.random.default_rng(i).integers(0, 2**63, 5000).astype(np.uint64) for i, n in enumerate([f"l{k:02d}" for k in range(70)])}
    f = language.Filter.build(grams)
    assert f.slots.shape[1] == 2  # 70 languages take two words
    for i, n in enumerate(f.languages):
        assert (f.masks(grams[n])[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    strange = f.masks(np.random.default_rng(99).integers(0, 2**63, 20000).astype(np.uint64))
    rate = (strange[:, 0] & np.uint64(1)).mean()
    assert abs(rate - f.false_rate[0]) < 0.01


def test_language_blocks_read_the_whole_text(monkeypatch):
    text = "Der schnelle Fuchs läuft " * 50
    whole = np.sort(np.unique(np.concatenate(list(language.gram_hashes(text)))))
    monkeypatch.setattr(language, "BLOCK", 97)
    assert set(whole) <= set(np.concatenate(list(language.gram_hashes(text))))


def test_language_of_odd_documents(spark, frame):
    docs = odd_documents(frame)
    model = language.fit(docs, min_count=1)
    got = [(r["doc_id"], r["p"]["lang"], r["p"]["score"]) for r in docs.select("doc_id", language.predicted(spark, model, F.col("text")).alias("p")).collect()]
    assert len(got) == 9 and [g[1:] for g in got if g[0] in (1, 2, 3, 7)] == [("und", 0.0)] * 4
    assert [g[1] for g in got if g[0] == 4] == ["en"]
    empty = language.fit(docs.limit(0))
    assert empty.predict("some text")[0] == "und"


# ---------------------------------------------------------------- 4 tokens

@pytest.fixture(scope="module")
def codec():
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tokens.Codec(ranks, public_tokenizers.PATTERN), theirs


@given(st.lists(st.sampled_from(["a", "b", "th", " ", "  ", "\n", "\t", "é", "漢", "😀", "0", "12", "'s", "'ll", "--", "\x1c", "x" * 50, "ab" * 40, "\x85", "_", " the", "ing"]), max_size=30))
@settings(max_examples=500, deadline=None)
def test_encoding_matches_merging(codec, parts):
    text = "".join(parts)
    ids = codec[0].encode(text)
    assert ids == codec[1].encode_ordinary(text) and codec[0].decode(ids) == text.encode()


def test_encoding_of_documents_matches_merging(spark, documents, codec):
    import hashlib
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, SF).collect()}
    for r in documents.collect():
        ids = codec[1].encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_long_texts_are_cut_where_no_match_crosses(codec):
    text = "ab  cd\n\n efg 'll  " * 500
    parts = list(tokens.blocks(text, 100))
    assert len(parts) > 10 and "".join(parts) == text
    assert [i for p in parts for i in codec[1].encode_ordinary(p)] == codec[1].encode_ordinary(text)
    assert "".join(tokens.blocks("", 10)) == "" and list(tokens.blocks("x" * 50, 10)) == ["x" * 50]


def test_one_long_piece_is_linear(codec):
    rng = random.Random(2)
    piece = "".join(rng.choice("abcdeth") for _ in range(200_000))
    assert codec[0].decode(codec[0].encode(piece)) == piece.encode()


def test_tokens_of_odd_documents(spark, frame, codec):
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = odd_documents(frame)
    got = docs.select("doc_id", tokens.token_ids(spark, F.col("text"), ranks, public_tokenizers.PATTERN).alias("ids"),
                      tokens.token_digests(spark, F.col("text"), ranks, public_tokenizers.PATTERN).alias("t"), "text").collect()
    assert len(got) == 9
    for r in got:
        assert r["ids"] == codec[1].encode_ordinary(r["text"] or "") and r["t"]["n_tokens"] == len(r["ids"])


# ---------------------------------------------------------------- 7 mixing

@given(st.lists(st.integers(1, 9), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None)
def test_schedule_meets_windows_and_stays_within_a_block(spark, shares):
    shares = {f"s{i}": a for i, a in enumerate(shares)}
    total = sum(shares.values())
    rows = sorted(mixing.schedule(spark, shares).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(total))
    done = dict.fromkeys(shares, 0)
    for r in rows:
        a = shares[r["source"]]
        assert r["nth"] == done[r["source"]] and r["release"] == r["nth"] * total // a and r["deadline"] == -(-(r["nth"] + 1) * total // a)
        assert r["release"] <= r["slot"] < r["deadline"]
        done[r["source"]] += 1
        assert all(abs(done[s] - shares[s] * (r["slot"] + 1) / total) < 1 for s in shares)
    assert done == shares


def test_mixed_ranks_blocks_and_keeps_rows(frame):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(None, "hot"), (9001, None), (9002, "none"), (5, "s0"), (5, "s0")]
    shares = {"hot": 3, **{f"s{i}": 1 for i in range(5)}}
    docs = frame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash")).withColumn("block", F.lit("clash"))
    got = mixing.mixed(docs, shares, block_rows=10).collect()
    assert sorted(((r["doc_id"], r["source"]) for r in got), key=str) == sorted(rows, key=str)
    for s in {r[1] for r in rows}:
        assert sorted(r["nth_row"] for r in got if r["source"] == s) == list(range(sum(x[1] == s for x in rows)))
    assert all((r["slot"] is None) == (r["source"] not in shares) for r in got)
    assert mixing.mixed(docs.limit(0), shares).count() == 0 and mixing.mixed(docs, {}).where("slot is not null").count() == 0
    first = sorted((r["slot"], r["source"]) for r in got if r["slot"] is not None)
    horizon = min((max(x[0] for x in first if x[1] == s) for s in shares))
    done = dict.fromkeys(shares, 0)
    for slot, source in sorted(set(first)):
        done[source] += 1
        if slot <= horizon:
            assert all(abs(done[s] - shares[s] * (slot + 1) / 8) < 1 for s in shares)


def test_reordered_keeps_all_rows_and_columns(frame):
    docs = odd_documents(frame)
    got = mixing.reordered(docs, {"a": 2, "b": 1}, block_rows=1)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_dealt_shares_of_any_number_of_sources(spark, frame):
    for n in (0, 1, 2, 3, 5, 7, 23, 64):
        shares = {f"s{i:05d}": 1 + i % 5 for i in range(n)}
        dealt = {r["source"]: r for r in mixing.dealt_shares(frame([(s,) for s in shares] * 2 + [(None,)], "source string")).collect()}
        assert {s: r["share"] for s, r in dealt.items()} == shares
        if shares:
            want = {(r["source"], r["nth"]): r["slot"] for r in mixing.schedule(spark, shares).collect()}
            assert {(s, j): slot for s, r in dealt.items() for j, slot in enumerate(r["slots"])} == want
    docs = frame([(i, f"host{i % 1500:04d}") for i in range(9000)], "doc_id long, source string")
    got = mixing.mixed(docs, queries.target_shares(docs), block_rows=1).collect()
    assert len(got) == 9000 and len({r["slot"] for r in got}) == 9000
    for r in got:  # a block lies in its window
        a, p = 1 + int(r["source"][4:]) % 5, 4500
        assert r["block"] * p // a <= r["slot"] < -(-(r["block"] + 1) * p // a)


def test_shares_are_checked():
    for bad in ({"a": 0}, {"a": 0.5}, {"a": mixing.MAX_SLOTS + 1}):
        with pytest.raises(ValueError):
            mixing.period(bad)


# ---------------------------------------------------------------- 10 toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.text(alphabet="abcde", max_size=11), st.lists(st.text(alphabet="abcde", min_size=1, max_size=10), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_what_edit_distance_finds(word, terms):
    lexicon = toxicity.Lexicon({t: 1.0 + i for i, t in enumerate(dict.fromkeys(terms))}, {})
    want = [(w * 0.5**e, e) for t, w in lexicon.words.items() if (e := distance(word, t)) <= lexicon.edits(t)]
    got = lexicon.find(word)
    assert (got is None) == (not want) and (got is None or math.isclose(got[1], max(w for w, _ in want)))


def test_toxicity_of_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op10_toxicity(spark, SF).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


def test_misspelt_and_quoted_terms():
    lexicon = toxicity.Lexicon({"disgusting": 4.0, "moron": 4.0}, {"lowei": 3.0})
    assert lexicon.find("disgustng")[2] == 1 and lexicon.find("disgastng")[2] == 2 and lexicon.find("moran")[0] == "moron"
    assert lexicon.find("loweischaft")[0] == "lowei*" and lexicon.find("lowe") is None and lexicon.find("") is None
    abuse, quoted, *_ = toxicity.evidence(lexicon, "you are a moron and disgustng")
    assert abuse > 6 and quoted == 0
    abuse, quoted, words, hits, quotes, terms = toxicity.evidence(lexicon, 'he wrote the word “moron” in a letter')
    assert abuse == 0 and quoted > 0 and (hits, quotes, terms) == (1, 1, ["moron"])


def test_texts_that_share_a_word_all_teach(spark, frame):
    # all share the long word, which alone was the sketch before; five toxic ones are copies but for marks and case
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    texts = [(i, f"everybodys {' '.join(filler[(37 * i + 11 * k * k) % 600] for k in range(12))} tea moron", 1) for i in range(1, 41)]
    texts += [(i, f"everybodys {' '.join(filler[(37 * i + 11 * k * k) % 600] for k in range(12))} tea cup", 0) for i in range(41, 201)]
    texts += [(i, "Everybodys, copied tea! chance" if i % 2 else "everybodys copied tea chance", 1) for i in range(201, 231)]
    docs = frame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert set(model.lexicon.words) == {"moron"}
    assert model.score("you are a moron")[0] > 0.5 > model.score("everybodys tea cup")[0]


def test_rare_terms_are_learned_from_a_balanced_sample(frame):
    rng = random.Random(5)
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    rows = [(i, " ".join(rng.sample(filler, 12)) + (" moron" if i <= 8 else ""), int(i <= 60)) for i in range(1, 1201)]
    docs = frame(rows, "doc_id long, text string, toxic int")
    texts, labels = docs.select("doc_id", "text"), docs.select("doc_id", "toxic")
    for per_class in (20_000, 60):  # all labels, and as many clean as toxic ones
        assert set(toxicity.fit(texts, labels, per_class=per_class).lexicon.words) == {"moron"}
    assert not toxicity.fit(texts, labels, chance=100.0).lexicon.words


def test_one_clean_text_does_not_clear_a_misspelling(frame):
    rng = random.Random(6)
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    words = {**dict.fromkeys(range(1, 41), "disgusting"), **dict.fromkeys(range(41, 45), "tisgusting"), 400: "tisgusting", 401: "misgusting"}
    rows = [(i, f"{' '.join(rng.sample(filler, 12))} {words.get(i, '')}", int(i <= 60)) for i in range(1, 601)]
    docs = frame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model.lexicon.benign == {"misgusting"} and model.lexicon.find("tisgusting")[0] == "disgusting"


def test_digits_and_symbols_inside_a_word():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "moron": 4.0, "scum": 4.0}, {})
    for text, terms in (("an id1ot", ["idiot"]), ("a m0ron, really", ["moron"]), ("sc*m!", ["scum"]), ("l'idiot", ["idiot"]), ("scum.moron", ["moron", "scum"]),
                        ("s*am", []), ("scam", []), ("a well-known state-of-the-art co-op", [])):
        assert toxicity.evidence(lexicon, text)[5] == terms, text
    abuse, quoted, words, hits, *_ = toxicity.evidence(lexicon, "he wrote \"id1ot\" and m0ron")
    assert (words, hits) == (7, 2) and quoted > 0


def test_copies_are_grouped_within_a_label():
    texts = [" ".join(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(24)) for k in range(20)]
    texts += [t.replace("a ", "x ", 1) + " more" for t in texts]
    got = toxicity._copies(np.array([toxicity._signature(t) for t in texts], np.int32), np.arange(40), np.zeros(40, np.int64))
    assert got.tolist() == [*range(20), *range(20)]
    got = toxicity._copies(np.array([toxicity._signature(texts[0])] * 3, np.int32), np.array([1, 1, 2]), np.array([0, 1, 0]))
    assert got.tolist() == [0, 1, 0]


def plain_find(model, word):
    """The heaviest term that a word spells, by edit distance to every term."""
    best = None
    for stem, w in model.stems.items():
        if word.startswith(stem) and (best is None or w > best[1]):
            best = stem + "*", w
    other = sum(not c.isalpha() for c in word) if len(word) < 7 else 0
    for term, weight in model.words.items():
        row = list(range(len(term) + 1))
        for i, c in enumerate(word):
            row, last = [i + 1], row
            for j, d in enumerate(term):
                row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        e = row[-1]
        allowed = 0 if len(term) < 5 else 1 if len(term) < 9 else 2
        if (e <= allowed or e == other == 1 and len(term) == 4) and (e == 0 or word not in model.benign) and (best is None or weight * 0.5**e > best[1]):
            best = term, weight * 0.5**e
    return best


def plain_toxicity(model, text, known):
    """The score of a text from the list of all its words."""
    def find(word):
        if word not in known:
            known[word] = plain_find(model.lexicon, word)
        return known[word]

    text = (text or "").lower()
    words = len(re.findall(r"[^\W\d_]+", text))
    line = []
    for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]++(?:(?:\d+|_|[^\w\s])[^\W\d_]+)*", text):
        parts = list(re.finditer(r"[^\W\d_]+", m.group()))
        whole = len(parts) > 1 and find(m.group()) and not any(find(p.group()) for p in parts)
        for a, b in [m.span()] if whole else [(m.start() + p.start(), m.start() + p.end()) for p in parts]:
            marked = a > 0 and b < len(text) and text[a - 1] in toxicity.QUOTES and text[b] in toxicity.QUOTES
            line.append((text[a:b], marked))
    times, abuse, quoted = {}, 0.0, 0.0
    for k, (word, marked) in enumerate(line):
        if found := find(word):
            around = [w for w, _ in line[max(0, k - 5):k] + line[k + 1:k + 6]]
            times[word] = times.get(word, 0) + 1
            factor = (1.25 if any(map(find, around)) else 1) * (1.25 if any(w in toxicity.ADDRESS for w in around) else 1) / times[word]
            if marked or any(w in toxicity.REPORT for w in around[:5]):
                quoted += found[1] * factor
            else:
                abuse += found[1] * factor
    z = np.dot(model.coefficients, [1.0, math.log1p(abuse), math.log1p(quoted), math.log1p(100 * abuse / (words + 10))])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_match_the_plain_rule(spark):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), queries.training_labels(spark, SF))
    scores, known = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, SF).collect()}, {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert model.lexicon.words and len(scores) == len(docs)
    for r in docs:
        assert scores[r["doc_id"]] == pytest.approx(plain_toxicity(model, r["text"], known), abs=1e-9), r["doc_id"]


def test_toxicity_windows_reach_over_blocks(monkeypatch):
    lexicon = toxicity.Lexicon({"idiot": 4.0, "moron": 4.0, "scum": 4.0}, {})
    rng = random.Random(4)
    bits = ["idiot", "id1ot", "m0ron,", "scum***", "you", "said", "\"idiot\"", "the", "a-b", "###", "\n"]
    text = " ".join(rng.choice(bits) for _ in range(6000))
    whole = toxicity.evidence(lexicon, text)
    cut = toxicity.blocks
    monkeypatch.setattr(toxicity, "blocks", lambda t: cut(t, size=200))
    assert toxicity.evidence(lexicon, text) == whole and whole[3] > 2000
    monkeypatch.setattr(toxicity, "blocks", cut)
    for pad in range(2**20 - 3, 2**20 + 1):
        assert toxicity.evidence(lexicon, "x" * pad + " id1ot you")[5] == ["idiot"]


def test_toxicity_of_odd_documents(spark, frame):
    docs = odd_documents(frame)
    model = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))  # one label only: nothing to learn
    got = docs.select(toxicity.scored(spark, model, F.col("text")).alias("t")).collect()
    assert len(got) == 9 and all(r["t"]["score"] < 0.5 and r["t"]["terms"] == [] for r in got)
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))).score("x")[0] < 0.5
    assert toxicity.evidence(toxicity.Lexicon({"moron": 1.0}, {}), "x " * 800_000 + "moron")[3] == 1


# ---------------------------------------------------------------- 2 neighbours, 9 graphs

def vectors_of(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def test_nearest_recall_and_scores(spark):
    ids, x = vectors_of(spark)
    got = {}
    for r in neighbours.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q in ids[ids % 5 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        true = sorted((v, i) for v, i in zip(d, ids) if i != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(math.isclose(m[2], d[ids == m[1]][0], abs_tol=1e-12) for m in mine)
        found += len({m[1] for m in mine} & {i for _, i in true})
    assert found >= 0.9 * 10 * (ids % 5 == 0).sum()


def test_nearest_with_copies_ties_and_unusable_vectors(frame):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 0.0]), (101, None), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]),
            (105, [1.0, 1.0]), (106, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (105, [1.0, 1.0]), (107, [])]
    docs = frame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(docs, F.col("vec_id") % 5 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 5, 10, 15, 20, 25, 105]
    assert sorted(got[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)] and sorted(got[25]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert sorted(got[105]) == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    assert neighbours.nearest(docs.limit(0), F.lit(True)).count() == 0


def test_large_leaves_are_searched_in_blocks(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    a = neighbours.nearest(table, F.col("vec_id") % 100 == 0, visits=10_000, block_rows=4)
    ids, x = vectors_of(spark)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in a.collect()}
    for q in ids[ids % 100 == 0]:  # all leaves visited: exact
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        true = [i for _, i in sorted((v, i) for v, i in zip(d, ids) if i != q)[:10]]
        assert [got[q, r] for r in range(1, 11)] == true


def test_graph_search_matches_all_pairs():
    rng = np.random.default_rng(4)
    base = hnsw.unit(rng.standard_normal((1500, 32)))
    near = hnsw.unit(np.repeat(base[:40], 25, 0) + 0.05 * rng.standard_normal((1000, 32)))
    x = hnsw.unit(np.concatenate([base, near]))
    graph = hnsw.Graph.unpacked(hnsw.Graph.built(x, 0.9).packed())
    got = graph.within(x, 0.9)
    true = x @ x.T >= 0.9
    assert sum(map(len, got)) >= 0.99 * true.sum() and all(true[i, rows].all() for i, rows in enumerate(got))


def test_graphs_of_one_and_few_vectors():
    for n in (1, 2, 3, 17):
        x = hnsw.unit(np.random.default_rng(n).standard_normal((n, 4)))
        got = hnsw.Graph.built(x, 0.9).within(x, 0.9)
        assert [set(r) for r in got] == [set(np.flatnonzero(row >= 0.9)) for row in x @ x.T]


def test_embedding_dedup_with_copies_shards_and_unusable_vectors(frame):
    rng = np.random.default_rng(8)
    x = [list(map(float, rng.standard_normal(16))) for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(x)] + [(100 + i, [2 * c for c in x[i]]) for i in range(20)] + [(200 + i, x[0]) for i in range(15)]
    odd = [(300, None), (301, [0.0] * 16), (302, [None] * 16), (303, [float("nan")] * 16), (304, [1e300] * 16), (305, [1.0] * 3), (None, x[1]), (306, [])]
    docs = frame(rows + odd, "vec_id long, embedding array<double>").withColumn("component_id", F.lit("clash"))
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(docs, shard_rows=16, block_rows=8).collect()}
    good = {i: hnsw.unit(np.array([v]))[0] for i, v in [*rows, (304, [1e300] * 16)]}
    links = [(a, b) for a in good for b in good if a != b and good[a] @ good[b] >= 0.9]
    roots = roots_of(links)
    assert len(got) == len(rows) + len(odd)
    for i in got:
        if i is not None:
            assert got[i]["n_links"] == sum(a == i for a, _ in links) and got[i]["component_id"] == roots.get(i, i)
            assert got[i]["kept"] == (roots.get(i, i) == i)
    assert hnsw.near_duplicates(docs.limit(0)).count() == 0


def test_embedding_dedup_copies_nothing_for_each_pair_of_shards(frame, monkeypatch):
    plans, write = {}, hnsw.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return write(df, name)

    monkeypatch.setattr(hnsw, "written", written)
    x = np.random.default_rng(3).standard_normal((400, 16)).astype(np.float32)
    x[300:] = x[:100] + 0.05 * x[100:200]
    docs = frame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(docs, shard_rows=32, block_rows=16).collect()}
    y = hnsw.unit(x)
    assert got == dict(enumerate(((y @ y.T >= 0.9).sum(axis=1) - 1).tolist())) and max(got.values()) > 0
    assert not [word for word in ("Exchange", "Generate") if word in plans["hnsw-links"]]


def test_a_shard_asks_each_other_once():
    for shards in range(1, 8):
        dealt = hnsw.Dealt(16, 5, shards, 3, 100)
        units = [dealt.unit(no) for no in range(100, 100 + dealt.units)]
        pairs = [(min(to, shard), max(to, shard), block) for to, shard, block, _ in units if to is not None]
        assert sorted(pairs) == [(a, b, block) for a in range(5, 5 + shards) for b in range(a, 5 + shards) for block in range(3)]


def test_a_graph_is_built_in_little_memory():
    x = hnsw.unit(np.random.default_rng(6).standard_normal((4096, 64)))
    tracemalloc.start()
    hnsw.Graph.built(x, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_all_of_a_crowd_are_found():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((3000, 32))
    crowds = np.repeat(base[:6], 60, 0) + 0.02 * rng.standard_normal((360, 32))
    x = hnsw.unit(np.concatenate([base, crowds]))
    true = x @ x.T >= 0.9
    got = hnsw.Graph.built(x, 0.9).within(x[3000:], 0.9)
    assert [set(rows) for rows in got] == [set(np.flatnonzero(row)) for row in true[3000:]]


# ---------------------------------------------------------------- 3 licenses

def test_license_lines_match_a_plain_search(spark, documents):
    got = {r["doc_id"]: r for r in queries.op3_license_scan(spark, SF).collect()}
    lines = {n: licenses.WORD.findall(t.lower()) for n, t in licenses.TEMPLATES.items() if n.endswith("-line")}
    hits = 0
    for r in documents.collect():
        words = " " + " ".join(licenses.WORD.findall((r["text"] or "").lower())) + " "
        want = {n for n, w in lines.items() if f" {' '.join(w)} " in words}
        hits += len(want)
        assert want <= set(got[r["doc_id"]]["licenses"]), r["doc_id"]
        if not want:
            assert got[r["doc_id"]]["n_spans"] == 0
    assert hits > 5


def test_license_with_other_wording():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit"]
    text = "Copyright (c) 2020 Someone\n\n" + mit.replace("free of charge", "free of any charge").replace(" sublicense,", "") + "\n\nint main() {}"
    (found,) = scanner.scan(text)
    assert found.license == "mit" and found.extra == ["any"] and found.missing == ["sublicense"] and found.reduction > 0.8
    assert text[found.start:].startswith("Permission") and text[:found.end].endswith("SOFTWARE")
    assert [f.license for f in scanner.scan(licenses.TEMPLATES["apache-2.0"] + " x y z " * 30 + licenses.TEMPLATES["mit-line"])] == ["apache-2.0", "mit-line"]
    assert scanner.scan(" ".join(mit.split()[:60])) == [] and scanner.scan("licensed under the moon") == []


def test_every_template_finds_itself_and_no_other():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        (found,) = scanner.scan(f"Words before it.\n\n{text}\n\nAnd words behind it.")
        assert (found.license, found.missing, found.extra) == (name, [], [])


def test_no_license_is_confirmed_with_another_version():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    names = lambda text: [f.license for f in scanner.scan(text)]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["gpl-2.0-notice"]
    gpl = licenses.TEMPLATES["gpl-3.0-or-later"]
    assert names(gpl.replace("version 3", "version 4")) == [] and names(gpl.replace("version 3", "version 2")) == ["gpl-2.0-or-later"]
    assert names(gpl.replace("GNU General", "GNU Lesser General")) == ["lgpl-3.0-or-later"]
    assert names("under the Apache License, Version 1.1") == [] and names("Licensed under the MIT License.") == ["mit-notice"]
    assert names("# SPDX-License-Identifier: GPL-2.0-only") == ["spdx-gpl-2.0-only"] and names("under CC BY-SA 4.0") == ["cc-by-sa-4.0-notice"]
    bsd = licenses.TEMPLATES["bsd-3-clause"].replace(" 1. ", " a) ").replace(" 2. ", " b) ")
    (found,) = scanner.scan(bsd)
    assert (found.license, found.missing, found.extra) == ("bsd-3-clause", ["1", "2"], ["a", "b"])


def test_license_of_odd_documents(spark, frame):
    got = odd_documents(frame).select(licenses.scanned(spark, F.col("text")).alias("s")).collect()
    assert [r["s"] for r in got] == [[]] * 9
    many = "\n".join([licenses.TEMPLATES["mit-line"]] * 2000)
    assert len(licenses.Scanner(licenses.TEMPLATES).scan(many)) == 2000


# ---------------------------------------------------------------- 6 url filter

def test_entries_are_held_against_the_day_of_the_capture(frame):
    entries = frame([
        ("l", "a.com", "block", True, "2024-01-01"), ("l", "a.com", "block", False, "2024-02-01"), ("l", "a.com", "block", True, "2024-03-01"),
        ("l", "a.com", "block", True, "2024-01-01"), ("m", "x.a.com/ok/path", "allow", True, "2024-01-01"), ("m", "a.com", "allow", True, "2024-01-01"),
        (None, "b.com", "block", True, "2024-01-01"), ("l", None, "block", True, "2024-01-01"), ("l", "b.com", None, True, "2024-05-01"),
    ], "list string, pattern string, verdict string, listed boolean, day string").withColumn("day", F.to_date("day"))
    rows = [(1, "http://x.A.com:80/", "2024-01-15"), (2, "http://x.a.com/p", "2024-02-01"), (3, "https://u:p@a.com./q?x#y", "2024-03-01"),
            (4, "http://x.a.com/ok/path/deep?q", "2024-03-05"), (5, "http://x.a.com/ok/pathology", "2024-03-05"), (6, "http://ba.com/", "2024-03-05"),
            (7, None, "2024-03-05"), (8, "not a url", "2024-03-05"), (9, "http://a.com/", None), (10, "http://b.com", "2024-05-01"),
            (1, "http://x.A.com:80/", "2024-01-15"), (None, "http://a.com/", "2023-01-01")]
    captures = frame(rows, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.to_date("fetched_on")).withColumn("list", F.lit("clash"))
    got = url_filter.judged(captures, entries).collect()
    by = {r["page_id"]: (r["verdict"], r["n_active"], r["list"], r["pattern"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("block", 2, "l", "a.com") and by[2] == ("allow", 1, "m", "a.com") and by[3] == ("block", 2, "l", "a.com")
    assert by[4] == ("allow", 3, "m", "x.a.com/ok/path") and by[5] == ("block", 2, "l", "a.com") and by[10] == ("block", 1, "l", "b.com")
    assert all(by[i] == ("none", 0, None, None) for i in (6, 7, 8, 9, None))
    assert {r["verdict"] for r in url_filter.judged(captures, entries.limit(0)).collect()} == {"none"}
    assert url_filter.judged(captures.limit(0), entries).count() == 0


# ---------------------------------------------------------------- 8 sharding

def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 2003)
    sizes = np.bincount(table, minlength=20)
    assert sizes.max() - sizes.min() <= 1
    fewer = np.array(names[:7] + names[8:])[sharding.lookup_table(names[:7] + names[8:], 2003)]
    stays = np.array(names)[table] == fewer
    assert stays[table != 7].mean() > 0.8
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_turns_follow_preference_by_brute_force():
    import hashlib
    names, m = ["x", "y", "z"], 13
    prefs = []
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % m, int.from_bytes(d[8:16], "big") % (m - 1) + 1
        prefs.append([(a + j * b) % m for j in range(m)])
    assert all(sorted(p) == list(range(m)) for p in prefs)
    out = {}
    while len(out) < m:
        for i, p in enumerate(prefs):
            if len(out) < m:
                out[next(s for s in p if s not in out)] = i
    assert sharding.lookup_table(names, m).tolist() == [out[s] for s in range(m)]


def test_every_document_has_its_place(spark, documents):
    got = queries.op8_sharding(spark, SF).collect()
    table = sharding.lookup_table(queries.SHARDS)
    want = {r["doc_id"]: r["h"] % sharding.SLOTS for r in documents.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert len(got) == 1000 and all(r["slot"] == want[r["doc_id"]] and r["shard"] == queries.SHARDS[table[r["slot"]]] for r in got)


def test_sharding_of_odd_documents(frame, tmp_path):
    docs = odd_documents(frame).withColumn("shard", F.lit(1)).withColumn("slot", F.lit("clash"))
    got = sharding.placed(docs, ["a", "b"], slots=13).collect()
    assert len(got) == 9 and len({r["slot"] for r in got if r["doc_id"] == 5}) == 1 and {r["shard"] for r in got} <= {"a", "b"}
    assert sharding.placed(docs.limit(0), ["a"]).count() == 0
    sharding.write_sharded(docs, ["a", "b"], str(tmp_path / "out"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == 9
