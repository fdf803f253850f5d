"""The operators against brute force, on small tables with nulls, blanks, ties, repeated rows and clashing names."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospectra.llm import chat, components, labelled, language_model, mixing, near_join, packing, quality_model, quality_rules, token_counts, toxicity, vector_dedup, vocabularies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string"


def texts(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["The", "of", "été", "naïve", "#x"]
    out = [" ".join(r.choices(vocabulary, k=r.randint(5, 90))) for _ in range(n)]
    for k in range(0, n, 4):  # near and exact copies
        words = out[k].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(out[k])
    return out + ["", None, "   \n", "one", "one", "One two three", "a b a b a b a b\na b\na b\n\n x", "x" * 3000, "Y z " * 4000]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i if i != 5 else None, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][i * i % 4], "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[7:9], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_join_equals_brute_force(documents, empty):
    for n, percent in ((4, 85), (5, 80), (2, 50)):
        got = near_join.near_join(documents, n=n, percent=percent).collect()
        rows = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER))) for r in documents.collect()]
        sets = [frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []) for _, w in rows]
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in itertools.combinations(range(len(rows)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
        least = {}
        for i, (k, _) in enumerate(rows):
            if k is not None:
                least[root(i)] = min(k, least.get(root(i), k))
        want = collections.Counter((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows))
        assert collections.Counter(map(tuple, got)) == want
    assert near_join.near_join(empty).count() == 0


def test_near_join_without_broadcasts_and_with_small_blocks(documents, monkeypatch):
    want = sorted(map(tuple, near_join.near_join(documents).collect()), key=str)
    monkeypatch.setattr(near_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_join, "BLOCK", 2)
    assert sorted(map(tuple, near_join.near_join(documents).collect()), key=str) == want


def test_near_join_of_small_sets_at_low_similarities(spark):
    """A set inside one of twice its size, and others of 7 to 20 shingles, at 50 and 60 percent."""
    r = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        base = [f"a{k}w{i}" for i in range(r.randint(7, 20))]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base[: r.randint(1, len(base))] + [f"b{k}w{i}" for i in range(r.randint(0, 6))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (50, 60):
        sets = [set(t.split()) for _, t in rows]
        got = {x.doc_id: x.component_id for x in near_join.near_join(df, n=1, percent=percent).collect()}
        for k in range(0, 120, 2):
            linked = 100 * len(sets[k] & sets[k + 1]) >= percent * len(sets[k] | sets[k + 1])
            assert (got[k], got[k + 1]) == (k, k if linked else k + 1)


def test_near_join_of_a_large_group_that_hardly_links(spark, monkeypatch):
    """Copies of one text that each differ from it by little but from each other by too much, in blocks of 16."""
    monkeypatch.setattr(near_join, "BLOCK", 16)
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{i}" if j in cut else w for j, w in enumerate(base))) for i in range(100) for cut in [set(r.sample(range(60), 2 + i % 3))]]
    sets = [frozenset(tuple(t.split()[i : i + 4]) for i in range(57)) for _, t in rows]
    label = list(range(100))
    for i, j in itertools.combinations(range(100), 2):
        if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert 1 < len(set(label)) < 100
    df = spark.createDataFrame(rows + rows[:9] * 3, "doc_id bigint, text string")
    got = near_join.near_join(df, percent=70).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(label)) and len(got) == 127


def test_rtree_finds_all_that_the_bound_leaves():
    rng = np.random.default_rng(0)
    vectors = rng.poisson(0.5, (300, near_join.COORDINATES))
    vectors[150:] = np.maximum(vectors[:150] - (rng.random((150, near_join.COORDINATES)) < 0.03), 0)
    sizes = vectors.sum(axis=1)
    tree = near_join.RTree(vectors, sizes)
    for q in range(300):
        bound = np.minimum(vectors, vectors[q]).sum(axis=1)
        assert sorted(tree.query(vectors[q], int(sizes[q]), 85)) == list(np.flatnonzero(185 * bound >= 85 * (sizes + sizes[q])))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert {k: v for k, v in got.items() if k <= 50} == dict.fromkeys(range(51), 0)
    assert {k: v for k, v in got.items() if 100 <= k < 200} == dict.fromkeys(range(100, 160), 100)
    assert got[200] == got[201] == 200


def test_language_model_base_and_shuffled_counts(documents, empty):
    got = language_model.score_texts(documents)
    few = {(r.doc_id, r.n_tokens): r for r in language_model.score_texts(documents, broadcast_counts=10).collect()}
    tokens = [(r.doc_id, [w.translate(LOWER) for w in WORD.findall(r.text or "")] + [None]) for r in documents.collect()]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    c = collections.Counter(itertools.chain.from_iterable(t for k, t in tokens if not held(k)))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((k, held(k), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for k, t in tokens)
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    for r in rows:
        assert r.score < 0 and abs(few[r.doc_id, r.n_tokens].score - r.score) < 1e-6 * abs(r.score)
    assert language_model.score_texts(empty).count() == 0


def test_language_model_keeps_counts_once(spark):
    """Bigrams of a block with the same counts are stored as one, and scores stay those of all bigrams."""
    pairs, cv, cw = np.array([1, 2, 1, 1, 2]), np.array([3, 3, 3, 4, 3]), np.array([5, 5, 5, 5, 5])
    some, rank = language_model._alike(pairs, cv, cw)
    assert len(some) == 3 and all((x[some][rank] == x).all() for x in (pairs, cv, cw))
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(40)]
    rows = spark.createDataFrame(texts, "__row bigint, __text string").select("__row", F.col("__row").alias("__key"), F.lit(True).alias("__train"), "__text")
    counts = language_model.token_counts(rows).toPandas().sort_values("token", key=lambda c: c.astype("int64").to_numpy().view(np.uint64))
    known = spark.sparkContext.broadcast((counts["token"].to_numpy().view(np.uint64), counts["count"].to_numpy()))
    total = int(counts["count"].sum())
    counted = language_model._counted(language_model._blocks(rows, "bigint", known, total, len(counts), 1, False), total)
    assert counted.where("pairs is not null").agg(F.max("size")).first()[0] <= 4  # first words, next words, ends


def test_language_model_equals_a_plain_mixture(spark):
    """The score of every text, from counters of tokens and bigrams and the mixture's own definition; over all tokens it sums to one."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", "b a", "", None, "q a b r"] * 12)]
    got = collections.defaultdict(list)
    for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r.doc_id].append(r.score)
    tokens = {k: [w.lower() for w in (t or "").split()] + ["</s>"] for k, t in rows}
    train = [t for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    one, two = collections.Counter(w for t in train for w in t), collections.Counter(x for t in train for x in zip(["</s>", *t], t))
    n, v = sum(one.values()), len(one)
    occurrences = [x for t in train for x in zip(["</s>", *t], t)]
    count = lambda x: (np.array([two[x]]), np.array([one[x[0]]]), np.array([one[x[1]]]))
    cells = collections.Counter(int(language_model._cell(*count(x), n)[0]) for x in occurrences)
    keys = sorted(cells)
    weights = language_model.mixture_weights(np.array(keys), np.array([cells[k] for k in keys]), v)

    def p(x):
        a, b, c = weights[min(one[x[0]].bit_length(), language_model.CONTEXTS - 1)]
        return a * two[x] / max(one[x[0]], 1) + b * one[x[1]] / n + c / (v + 1)

    for k, t in tokens.items():
        assert got[k] == [pytest.approx(sum(math.log10(p(x)) for x in zip(["</s>", *t], t)), rel=1e-9)]
    for before in [*one, "never met"]:
        # Where a context was not met, all its weight is on the other two.
        assert sum(p((before, w)) for w in [*one, "another"]) == pytest.approx(1, abs=1e-9)


def test_language_model_tells_bigrams_with_close_hashes_apart(spark):
    """The hashes of "w2084 w627" and "w4743 w5502" differ in their 14 lowest bits only."""

    def probe(first):
        rows = [f"{first} w627"] * 200 + ["w4743 x", "y w5502"] * 20 + ["w2084 z", "w2085 z"]
        df = spark.createDataFrame([(2, t) for t in rows] + [(1000, "w4743 w5502")], "doc_id bigint, text string")
        return next(r.score for r in language_model.score_texts(df, held_out=zlib.crc32(b"1000") % 5).collect() if r.doc_id == 1000)

    assert zlib.crc32(b"2") % 5 != zlib.crc32(b"1000") % 5
    assert probe("w2084") == pytest.approx(probe("w2085"), abs=1e-9)


def test_mixture_weights_follow_the_better_estimate():
    rng = np.random.default_rng(0)
    p2, p1 = np.where(rng.random(500) < 0.9, 0.5, 0.0), np.full(500, 0.001)
    cell = (np.full(500, 5) << 40) + ((language_model._grid(p2) + (1 << 15)) << 20) + (language_model._grid(p1) + (1 << 15))
    w = language_model.mixture_weights(cell, np.ones(500), 1000)
    assert w[5, 0] == pytest.approx(0.9, abs=0.03) and np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


def test_token_counts_equal_the_library(documents, empty):
    library = vocabularies.fast_tokenizer("word_bpe_49k.json")
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in documents.collect())
    assert collections.Counter(map(tuple, token_counts.count_tokens(documents).collect())) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_only_vocabularies_that_drop_spaces_are_counted_by_words():
    assert token_counts.splits_at_space(vocabularies.fast_tokenizer("word_bpe_49k.json"))
    assert not token_counts.splits_at_space(vocabularies.fast_tokenizer("byte_bpe_50k.json"))


def test_token_counts_of_special_strings_and_odd_spaces(spark):
    library = vocabularies.fast_tokenizer("word_bpe_49k.json")
    odd = ["a<|endoftext|>b <|startoftext|>", "x y　z", "it's we'll 12345", "é İI", "a\x00b\x1cc\x85d", "​﻿ q", "<|endof text|>"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(odd)}


def test_packing_is_a_round_trip(documents, empty):
    library = vocabularies.fast_tokenizer("byte_bpe_50k.json")
    got = packing.pack_documents(documents, capacity=64).collect()
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    wanted = collections.Counter()
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        wanted.update((r.doc_id, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == wanted
    assert len(filled) <= math.ceil(sum(r.length for r in got) / 64 * 1.05) + 1
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_sequences():
    """Three sequences where best fit needs four, by a two-for-one exchange or others; and no search makes things worse."""
    rng = np.random.default_rng(3)
    fewer = 0
    for _ in range(60):
        cuts = [np.sort(rng.choice(np.arange(12, 88), rng.integers(1, 3), replace=False)) for _ in range(8)]
        lengths = np.concatenate([np.diff([0, *c, 100]) for c in cuts])  # eight full sequences exist
        first = packing.best_fit(lengths, 100)
        done = packing.local_search(lengths, first, 100)
        assert sorted(i for b in done for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 100 for b in done)
        assert len(done) <= len(first)
        fewer += len(done) < len(first)
    assert fewer >= 5
    exchange = packing.local_search(np.array([50, 30, 20, 45, 50, 5]), [[0, 3], [4, 1], [2, 5]], 100)
    assert len(exchange) == 2


def test_fast_ids_equal_the_library():
    encode, library = packing._encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), vocabularies.fast_tokenizer("byte_bpe_50k.json")
    probes = ["".join(chr(c) for c in range(a, a + 16)) for a in range(0, 256, 16)] + [f"a{chr(c)} {chr(c)}b" for c in range(256)] + ["<|endoftext|> x", "été  \n\n y", "日本 🙂"]
    for p in probes:
        assert list(encode(p)) == library.encode(p, add_special_tokens=False).ids


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.12, size=(20, 8)), base[:5], base[:3] * 1e-3]).tolist()
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0, None] + [1.0] * 6, [float("inf")] * 8, [1.0, 2.0]]
    rows = [(i, v, 0) for i, v in enumerate(x + odd)] + [(None, x[0], 1)]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int")).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    near |= near.T
    label = vector_dedup.joined(*np.nonzero(near), len(x))
    for i in range(len(x)):
        null_copy = int(near[i, 0])
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1 + null_copy, label[i], label[i] == i)
    for i in range(len(x), len(x) + len(odd)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id == 0 and not got[None].kept
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_vectors_in_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PER_CELL", 10)
    monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", 256)
    monkeypatch.setattr(vector_dedup, "TILE", 5)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(150, dtype=bool)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(150)] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(150)] == vector_dedup.joined(*np.nonzero(near), 150).tolist()


def test_vectors_of_many_dimensions_and_two_lengths(spark, monkeypatch):
    """Noise with planted neighbours just above the similarity: recall, and few copies of each vector."""
    monkeypatch.setattr(vector_dedup, "PER_CELL", 40)
    rng = np.random.default_rng(9)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1500, 64)))
    x = unit(np.concatenate([base, base[:500] + 0.3 * unit(rng.normal(size=(500, 64)))]))
    near = (x @ x.T >= 0.95) & ~np.eye(2000, dtype=bool)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5000 + i, v[:7]) for i, v in enumerate(x[:3].tolist() * 2)]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert sum(got[i].n_links for i in range(2000)) >= 0.98 * near.sum() >= 900
    assert all(got[i].n_links <= near[i].sum() for i in range(2000))
    assert [got[5000 + i].component_id for i in range(6)] == [5000, 5001, 5002] * 2
    cells = vector_dedup.cells_of(x, vector_dedup.spherical_kmeans(x, 50), vector_dedup.reach(0.95, 64))
    assert sum(map(len, cells)) <= 6 * len(x)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "yo"), (1, 2, "bob b", "yo"), (1, 3, None, None), (1, 70, "ann", "late"), (1, 71, "bob_b", ""), (2, 0, "system", "alone"), (None, None, "ann", "x"), (None, 1, "ann", "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered string, part int")
    got = {(r.conv_id, r.speaker): r for r in chat.perspectives(df).where("conv_id is not null").collect()}
    assert set(got) == {(1, s) for s in ("ann", "bob b", "unknown", "bob_b")}
    r = got[1, "ann"]
    assert r.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <|\\im_end|><|im_end|>\n<|im_start|>user name=bob+b\nyo<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n<|im_start|>user name=bob_b\n<|im_end|>\n"
    assert [r.rendered[s.start : s.stop] for s in r.spans] == ["hi <|\\im_end|><|im_end|>", "late<|im_end|>"] and (r.n_own, r.n_messages, r.part) == (2, 6, 0)
    assert r.n_learned == sum(s.stop - s.start for s in r.spans) and [got[1, "unknown"].rendered[s.start : s.stop] for s in got[1, "unknown"].spans] == ["<|im_end|>"]
    assert chat.perspectives(df).where("conv_id is null").select("rendered").collect() == [("<|im_start|>assistant\nx<|im_end|>\n",)] * 2
    parts = {(r.speaker, r.part): r for r in chat.perspectives(df, part_turns=64).where("conv_id = 1").collect()}
    assert set(parts) == {("ann", 0), ("bob b", 0), ("unknown", 0), ("ann", 1), ("bob_b", 1)}
    assert parts["ann", 1].rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n<|im_start|>user name=bob_b\n<|im_end|>\n"
    long = spark.createDataFrame([(1, i, f"s{i % 2}", f"t{i}" * (1 + 20000 * (i == 5))) for i in range(3000)], "conv_id bigint, turn bigint, role string, text string")
    whole = chat.perspectives(long).collect()
    assert [r.n_messages for r in whole] == [3000, 3000] and all([r.rendered[s.start : s.stop] for s in r.spans][7][:3] in ("t14", "t15") for r in whole)
    assert chat.perspectives(long.limit(0)).count() == 0


def test_perspectives_equal_sql_beyond_64_turns(spark):
    import duckdb
    import pandas as pd
    from prospectra.llm import oracles, registry

    rows = [(c, t, ["system", "ann", "bob b", "äöü"][(t > 0) * (1 + (t * t + c) % 3)], f"text {t} of {c}") for c in range(3) for t in range(150)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = duckdb.sql(oracles.SQL["op8_chat_formatting"])
    shown = registry.shown_spans(chat.perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    assert sorted(map(tuple, shown.select(*want.columns).collect())) == sorted(want.fetchall())


def base_statistics(t):
    w = WORD.findall(t or "")
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(wins)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    covered = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(documents, empty, monkeypatch):
    for packed in (20, 4):  # texts over 2 ** packed words take the other form
        monkeypatch.setattr(quality_rules, "PACKED", packed)
        rows = quality_rules.quality_rules(documents, least=20).collect()
        want = collections.Counter((r.doc_id, *base_statistics(r.text)) for r in documents.collect())
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_robust_distances_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(n), int(n * c), int(s), int(n // 20 + 1), int(d), int(p), "en", "s") for n, c, s, d, p in zip(rng.integers(60, 900, 400), rng.normal(5, 0.2, 400), rng.integers(0, 4, 400), rng.integers(0, 3, 400), rng.integers(0, 9, 400))]
    rows[0] = (100, 2000, 300, 5, 4, 40, "en", "s")
    df = spark.createDataFrame(rows, "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, lang string, source string")
    got = quality_rules.mcd_distances(df).select("*", *[quality_rules.drawn(k).alias(f"in{k}") for k in (1, 2, 3)]).toPandas()
    x = got[list(quality_rules.FEATURES)].to_numpy()
    floors = np.array(list(quality_rules.FEATURES.values()))
    level = lambda d: np.floor(np.log2(d + 1e-6) * 128 + 0.5)
    moments = lambda near: (near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floors**2))
    distances = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    stepped = lambda m, c: moments(x[level(distances(m, c)) <= np.quantile(level(distances(m, c)), 0.75)])
    m = np.quantile(x, 0.5, axis=0)
    starts = [(m, np.diag(np.maximum(1.4826 * np.quantile(np.abs(x - m), 0.5, axis=0), floors) ** 2))] + [moments(x[got[f"in{k}"]]) for k in (1, 2, 3)]
    ends = [stepped(*stepped(*s)) for s in starts]
    best = min(ends, key=lambda e: np.linalg.det(e[1]))
    d = distances(*stepped(*stepped(*best)))
    scale = max(2 ** (np.quantile(level(d), 0.5) / 128) / (5 * (1 - 2 / 45) ** 3), 1)
    assert np.allclose(np.sort(got["__d2"]), np.sort(d / scale), rtol=1e-3)
    assert got["__d2"].max() > 60


def test_robust_estimates_take_the_least_determinant(spark):
    """A third of a group lies far off and together; what is near the rest has the least determinant, and the third is rejected."""
    rng = np.random.default_rng(8)
    plain = [(int(n), int(5 * n), 0, 20, 0, 0) for n in rng.integers(90, 110, 260)]
    off = [(int(n), int(9 * n), int(n // 3), 20, 0, 0) for n in rng.integers(380, 420, 80)]
    df = spark.createDataFrame([(*r, "en", "s") for r in plain + off], "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, lang string, source string")
    far = {tuple(r)[:1] for r in quality_rules.mcd_distances(df).where(F.col("__d2") > quality_rules.CUTOFF).select("n_words").collect()}
    assert far == {(r[0],) for r in off}


def test_each_statistic_can_reach_the_cutoff(spark):
    c = quality_rules.CUTOFF
    beyond = math.erfc(math.sqrt(c / 2)) + math.sqrt(2 * c / math.pi) * math.exp(-c / 2) * (1 + c / 3)
    assert len(quality_rules.FEATURES) == 5 and beyond == pytest.approx(1e-5, rel=1e-3)
    rows = [(100 + i % 5, 500 + 5 * (i % 5), 0, 20, 0, 0) for i in range(200)]
    odd = [(2000, 10000, 0, 20, 0, 0), (100, 900, 0, 20, 0, 0), (100, 500, 50, 20, 0, 0), (100, 500, 0, 20, 18, 0), (100, 500, 0, 20, 0, 50)]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows + odd], "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, lang string, source string")
    far = quality_rules.mcd_distances(df).where(F.col("__d2") > c).select("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, far)) == sorted(odd)


def test_quality_rules_reject_texts_of_repeats(spark):
    r = random.Random(6)
    ordinary = lambda n: [f"word{r.randrange(10000)}" for _ in range(n)]
    rows = [(i, " ".join(ordinary(100 + i % 9))) for i in range(200)]
    phrase = ordinary(25)
    rows += [(1000, " ".join(phrase + ordinary(50) + phrase)), (1001, "\n".join(["word1"] * 19 + [" ".join(ordinary(70))]))]
    df = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules.quality_rules(df).collect()}
    assert not any(got[i].base_failed or got[i].kept for i in (1000, 1001)) and all(got[i].kept for i in range(200))


def test_mix(documents, empty):
    rows = mixing.mix(documents).collect()
    again = mixing.mix(documents.repartition(3), keep=["doc_id"]).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = collections.Counter()
    for r in documents.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rate = (total - sum(3 * sizes[s] for s in fixed)) / max(1, sum(weight[s] for s in order if s not in fixed))
        over = {s for s in order if s not in fixed and rate * weight[s] >= 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(3 * sizes[r.source] if r.source in fixed else rate * weight[r.source])
        assert r.taken == r.size * r.copies and r.copies <= 3
    assert total - max(r.size for r in rows) <= sum(r.taken for r in rows) <= total
    clash = documents.withColumnsRenamed({"lang": "size", "n_words": "copies"})
    taken = collections.Counter((r.doc_id, r.size, r.copies) for r in mixing.mixed_rows(clash).collect())
    assert sum(taken.values()) == sum(r.copies for r in rows) and all(k[2] == "clash" and k[1] in (None, "en", "fr") for k in taken)
    assert mixing.mix(empty).count() == 0


def test_toxicity_learns_pairs_of_neutral_words():
    """One of two words is toxic, both or neither are not: each is neutral alone. As many epochs as in production."""
    rng = np.random.default_rng(1)
    for _ in range(2):
        first, second = rng.integers(0, 2, 2400), rng.integers(0, 2, 2400)
        label = (first ^ second).astype(float)
        noise = rng.random((2400, 30)) < 0.3
        pairs = [(i, k) for i in range(2400) for k, on in ((3, first[i]), (9, second[i]), *[(20 + j, noise[i, j]) for j in range(30)]) if on]
        doc, bucket = np.array(pairs).T
        train = doc < 1600
        m = toxicity.fit(doc[train], bucket[train], label[:1600], np.ones(1600))
        slots = np.full(toxicity.BUCKETS, -1)
        slots[m.bucket] = np.arange(len(m.bucket))
        assert slots[3] >= 0 and slots[9] >= 0
        hit = slots[bucket] >= 0
        right = lambda m: ((m.logits(doc[hit], slots[bucket[hit]], 2400) > 0) == (label > 0))[1600:].mean()
        assert right(m) > 0.97 and right(toxicity.Machine(m.bias, m.bucket, m.weight, 0 * m.factor)) < 0.9


def test_toxicity_keeps_no_neutral_buckets_of_an_enriched_sample():
    """Half of the sampled rows are toxic, a tenth of all: a word that is as common in both halves tells nothing."""
    rng = np.random.default_rng(2)
    y = np.arange(1200) % 2.0
    rows = [(i, k) for i in range(1200) for k, on in ((3, y[i]), *[(20 + j, rng.random() < 0.5) for j in range(20)]) if on]
    doc, bucket = np.array(rows).T
    m = toxicity.fit(doc, bucket, y, np.where(y > 0, 0.1, 0.9), epochs=5)
    assert 3 in m.bucket and len(m.bucket) <= 3


def test_toxicity_fits_beside_many_lifted_pairs():
    """Insults tell all, two or more in a toxic text, which pairs of them exceed; texts are long and of many common words."""
    rng = np.random.default_rng(4)
    texts = 3000
    y = (rng.random(texts) < 0.25).astype(float)
    rows = []
    for i in range(texts):
        own = 700 * int(rng.random() < 0.75 or y[i] > 0)  # one language has the insults
        size = int(np.clip(rng.lognormal(5, 1), 10, 600))
        common = set(own + rng.integers(0, 600, size)) | set(own + (rng.zipf(1.3, size) % 600))
        rows += [(i, int(k)) for k in common]
        if y[i]:
            rows += [(i, 5000 + int(k)) for k in rng.choice(40, int(rng.integers(2, 30)), replace=False)]
    doc, bucket = np.array(sorted(rows)).T
    train = doc < 2000
    assert len(toxicity.lifted_pairs(doc[train], bucket[train], y[:2000] - y[:2000].mean())) > 100
    m = toxicity.fit(doc[train], bucket[train], y[:2000], np.ones(2000))
    slots = np.full(toxicity.BUCKETS, -1)
    slots[m.bucket] = np.arange(len(m.bucket))
    hit = slots[bucket] >= 0
    told = (m.logits(doc[hit], slots[bucket[hit]], texts) > 0)[2000:]
    assert told[y[2000:] > 0].mean() > 0.97 and told[y[2000:] == 0].mean() < 0.02


def labelled_tables(spark):
    r = random.Random(3)
    bad = lambda i: i % 6 == 0
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(60)], k=30)) + (" vile scum" if bad(i) else "")) for i in range(900)]
    rows = [(i, t if i % 7 else " ".join(f"{w}###" for w in t.split())) for i, t in rows] + [(None, "x"), (5000, None), (5001, ""), (5001, "")]
    labels = [(i, int(i % 7 != 0), int(bad(i))) for i in range(0, 900)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled_tables(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_quality_held_out(spark):
    docs, labels = labelled_tables(spark)
    rows = quality_model.quality(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 7 != 0) for r in held) >= 0.95 * len(held)
    assert len(rows) == 904 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality(docs.limit(0), labels).count() == 0


def test_risk_derivatives_and_the_switch():
    rng = np.random.default_rng(0)
    zp, zu, wp, wu = rng.normal(1, 1, 20), rng.normal(0, 1, 30), np.full(20, 1 / 20), np.full(30, 1 / 30)
    risk, ep, eu = quality_model.risk_errors(zp, zu, wp, wu, 0.4)
    for z, e in ((zp, ep), (zu, eu)):
        for k in (0, 7):
            z[k] += 1e-6
            up = quality_model.risk_errors(zp, zu, wp, wu, 0.4)[0]
            z[k] -= 1e-6
            assert (up - risk) / 1e-6 == pytest.approx(e[k], rel=1e-4)
    # Unlabelled texts that all look bad: the negatives' risk is below zero, counts as zero, and is stepped back from.
    risk, ep, eu = quality_model.risk_errors(np.full(20, 3.0), np.full(30, -9.0), wp, wu, 0.9)
    assert risk == pytest.approx(0.9 * math.log1p(math.exp(-3))) and (ep > 0).all() and (eu < 0).all()


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        n = 20000
        z = np.where(rng.random(n) < share, rng.normal(2, 1, n), rng.normal(-2, 1, n))
        got = quality_model.class_prior(quality_model._counts(quality_model._place(rng.normal(2, 1, 4000))), quality_model._counts(quality_model._place(z)))
        assert got == pytest.approx(share, abs=0.06)
    places = np.linspace(-10, 10, 201)
    good, bad = np.exp(-((places - 3) ** 2) / 2), np.exp(-((places + 1) ** 2) / 2)
    scale, offset = quality_model.last_layer(places, good, 0.3 * good + 0.7 * bad, 0.3)
    # Bayes' own: 4 x - 4 + ln(0.3 / 0.7).
    assert (scale, offset) == pytest.approx((4.0, -4.0 + math.log(3 / 7)), abs=0.15)
    # Without bad texts the risk of the negatives falls below zero: the steps of the non-negative rule stay finite.
    scale, offset = quality_model.last_layer(places, good, good, 0.9)
    assert scale >= 0.05 and math.isfinite(offset)


def test_text_shape_of_odd_texts():
    shape = labelled.text_shape(pa.array([None, "", "A", "a a a", "é|é\n"]))
    assert shape.shape == (5, len(labelled.SHAPE)) and np.isfinite(shape).all() and shape[3, labelled.SHAPE.index("again")] == pytest.approx(2 / 3)
