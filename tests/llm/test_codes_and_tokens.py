"""Vector codes, token alignment and byte-pair encoding against plain versions and the tokenizers' own libraries."""

import collections
import hashlib
import heapq
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from prospectra.llm import alignment, bpe, registry, vector_codes, vocabularies

ODD = list("aaabcdeehilmnorst'. \n\t-<|>éß中文字😀ΑΣσ١²½́  　İK\x1c\x00▁") + ["<|endoftext|>", "<|startoftext|>", "<s>", "the", "ing", "'ll", "'S", "  ", " a", " the"]


def odd_texts(n, seed):
    r = random.Random(seed)
    made = ["".join(r.choices(ODD, k=r.randint(0, 50))) for _ in range(n)]
    return [*made, "", None, " ", "  x", "x ", "\n x", "a" * 4000, "ab " * 30000, "中文" * 1500, " " * 2000 + "x", "".join(r.choices("abcdeilnorst", k=6000)), "the the the", "the the the"]


@pytest.fixture(scope="module")
def strange(spark):
    rows = [(None if i == 3 else i // 2, t, "clash", [i]) for i, t in enumerate(odd_texts(600, 4))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, groups array<int>").repartition(3).cache()


@pytest.mark.parametrize("vocabulary,special", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", True), ("byte_bpe_50k.json", False)])
def test_encoding_equals_the_library(spark, strange, vocabulary, special):
    library = Tokenizer.from_file(vocabularies.place(vocabulary))
    library.no_padding()
    library.no_truncation()
    library.encode_special_tokens = not special
    coded = bpe.encode_texts(strange, vocabulary=vocabulary, special=special)
    got = bpe.decode_ids(coded, vocabulary=vocabulary).collect()
    want = []
    for row in strange.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want.append((row.doc_id, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in got) == collections.Counter(want)
    both = bpe.encode_texts(strange, vocabulary=vocabulary, special=special, decode=True).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in both) == collections.Counter(want)
    assert bpe.decode_ids(bpe.encode_texts(strange.limit(0))).count() == 0


def test_shared_prefixes_are_encoded_once():
    merges = bpe.encoder("word_bpe_49k.json", True).merges
    words = sorted(["nation", "national", "nationality", "nations", "nat", "x", "", "natty"])
    before = merges.encoded
    codes = bpe.encode_trie(merges, words)
    assert merges.encoded - before == len({w[:k] for w in words for k in range(1, len(w))}) + len([w for w in words if w])
    assert codes == [bpe.encode_trie(merges, [w])[0] for w in words]


def test_every_token_encodes_to_itself():
    merges = bpe.encoder("word_bpe_49k.json", True).merges
    words = sorted(merges.final)
    assert bpe.encode_trie(merges, words) == [[merges.final[w]] for w in words]
    # Inside a word: before an end that the token is not joined with.
    inner = sorted(merges.inner)[::5]
    assert all(codes == [[merges.inner[w]]] for w in inner for codes in [bpe.encode_trie(_Inner(merges), [w])])


class _Inner:
    """The same merges without word ends."""

    def __init__(self, merges):
        self.inner_tails = self.final_tails = merges.inner_tails
        self.answers, self.follows, self.encoded = merges.answers, merges.follows, 0


def test_forgetting_words_changes_nothing(monkeypatch):
    want = [bpe.Encoder("word_bpe_49k.json").encode([t.encode() for t in odd_texts(200, 7) if t])]
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "ANSWERS", 50)
    small = bpe.Encoder("word_bpe_49k.json")
    assert [[small.encode([t.encode()])[0] for t in odd_texts(200, 7) if t]] == want


def test_ids_of_any_kind_are_decoded(spark):
    library = Tokenizer.from_file(vocabularies.place("word_bpe_49k.json"))
    rows = [(1, [3306, None, 1002, 10**6, -5, 49407]), (2, None), (3, [])]
    got = {r.k: r.decoded for r in bpe.decode_ids(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert got == {1: library.decode([3306, 1002, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_round_trip_digests(spark):
    library = Tokenizer.from_file(vocabularies.place("word_bpe_49k.json"))
    root = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    for r in registry.op13_bpe_round_trip(spark, root).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def plainly_aligned(rows):
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by walking both sides' bytes of whole texts."""
    left = Tokenizer.from_file(vocabularies.place("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=vocabularies.place("piece_bpe_32k.model"))
    letters = vocabularies.byte_of()
    found = []
    for key, text in rows:
        groups = []
        if text:
            a = [(i, bytes(letters[c] for c in left.id_to_token(i)) if i < 50256 else b"") for i in left.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()) for i in right.encode(text)]
            if b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b):
                ends_b = set(np.cumsum([len(x) for _, x in b]).tolist())
                both = [e for e in np.cumsum([len(x) for _, x in a]).tolist() if e in ends_b]
                groups = [([], []) for _ in both]
                for side, tokens in enumerate((a, b)):
                    at, group = 0, 0
                    for i, x in tokens:
                        at += len(x)
                        groups[group][side].append(i)
                        group += at == both[group]
        found.append((key, groups))
    count = collections.Counter()
    for _, groups in found:
        count.update({(i, j) for a, b in groups for i in a for j in b})
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for key, groups in found:
        links = [(i, j) for a, b in groups for i in a for j in b]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), told))
    return out


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_alignment_equals_a_plain_walk(spark, strange, monkeypatch):
    want = collections.Counter(plainly_aligned([(r.doc_id, r.text) for r in strange.collect()]))
    aligned = alignment.align(strange)
    assert collections.Counter(map(tuple, alignment.weigh_links(aligned).select(FIELDS).collect())) == want
    assert collections.Counter(map(tuple, alignment.weigh_links(aligned, broadcast_pairs=0).select(FIELDS).collect())) == want
    none = alignment.align(strange.limit(0))
    assert alignment.weigh_links(none).count() == 0 and alignment.weigh_links(none, broadcast_pairs=-1).count() == 0


def test_alignment_with_little_memory(monkeypatch):
    texts = odd_texts(150, 9)
    plain = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    want = [[x.tolist() if hasattr(x, "tolist") else x for x in plain.align([t])] for t in texts]
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    small = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert [[x.tolist() if hasattr(x, "tolist") else x for x in small.align([t])] for t in texts] == want


def test_parts_that_come_back_are_learnt_once(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    small = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    learnt, learn = collections.Counter(), small.learn
    monkeypatch.setattr(small, "learn", lambda parts: (learnt.update(parts), learn(parts)))
    for k in range(12):
        small.align([" ".join([f"common{i}" for i in range(10)] + [f"new{k}x{i}" for i in range(10)])])
    assert all(learnt[f"common{i}"] == 1 for i in range(10)) and len(small.known) <= 40


def test_parts_encoded_together_equal_parts_alone(monkeypatch):
    texts = [t for t in odd_texts(200, 11) if t] + ["a\u00a0 b", "\u3000x y", "caf\u00e9 \ufb01ne \u2460 z", "<|endoftext|> a <unk> b <s>", "\x00 c", "  d  e ", " "]
    together = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model").align(texts)
    monkeypatch.setattr(alignment, "JOINED", 1)
    alone = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model").align(texts)
    assert all(list(x) == list(y) for x, y in zip(map(np.ravel, together), map(np.ravel, alone), strict=True))


def test_alignment_of_a_table(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    want = {w[0]: (*w[1:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in plainly_aligned(rows)}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in registry.op12_token_alignment(spark, root).collect()}
    assert got == want


def test_groups_and_products_of_small_sides():
    a, b, group = alignment.overlaps(np.array([2, 3, 7, 8]), np.array([1, 3, 4, 8]))
    assert list(zip(a.tolist(), b.tolist(), group.tolist())) == [(0, 0, 0), (0, 1, 0), (1, 1, 0), (2, 2, 1), (2, 3, 1), (3, 3, 1)]
    got = alignment.products(np.array([0, 0, 0, 1]), np.array([5, 5, 6, 5]), np.array([0, 1, 1]), np.array([9, 9, 9]), 4)
    assert [x.tolist() for x in got] == [[0, 0, 1], [5 << 4 | 9, 6 << 4 | 9, 5 << 4 | 9], [2, 1, 2]]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd rounds over all rows in Python integers."""
    sound = [(k, label, v) for k, label, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for _, _, v in sound), default=0) // parts))
    points = [[int(np.floor(scale * c)) for c in v] + [0] * (width * parts - len(v)) for _, _, v in sound]
    order = sorted(range(len(sound)), key=lambda i: (sound[i][0] is None, sound[i][0] or 0, sound[i][2]))[:entries]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(points[i], p) for i in order] for p in range(parts)]
    nearest = lambda x, book: min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for x in points:
                members[nearest(cut(x, p), books[p])[1]].append(cut(x, p))
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    final = [[nearest(cut(x, p), books[p]) for p in range(parts)] for x in points]
    return collections.Counter((k, label, tuple(e for _, e in f), sum(d for d, _ in f)) for (k, label, _), f in zip(sound, final)), books


def vectors(n, dims, seed):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(30)]
    made = [[c + r.gauss(0, 0.05) for c in r.choice(middles)] for _ in range(n)]
    return made + made[:20] + [[1.0] * dims] * 30 + [[0.0] * dims, [1e30] + [0.0] * (dims - 1)]


@pytest.mark.parametrize("dims,rounds,block", [(16, 6, 4096), (16, 6, 50), (12, 2, 64), (3, 0, 4096)])
def test_codes_equal_plain_rounds(spark, monkeypatch, dims, rounds, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rows = [(i if i % 50 else None, i % 7 if i % 3 else None, v) for i, v in enumerate(vectors(400, dims, dims + rounds)[:-1])]
    rows += [(900, 1, None), (901, 1, [None] * dims), (902, 2, [float("nan")] * dims), (903, 2, [float("inf")] * dims), (904, 3, [0.5] * (dims - 2)), (904, 3, []), (5, 5, [0.25] * dims)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, label int, embedding array<float>, code string").repartition(3)
    exact = [(k, label, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, label, v in rows]
    made = vector_codes.compress(df, rounds=rounds)
    want, books = plain_codes(exact, rounds=rounds)
    assert made.books.tolist() == books
    assert collections.Counter((r.key, r.label, tuple(r.code), r.error) for r in made.rows.collect()) == want
    sums = collections.Counter()
    for (_, label, _, error), n in want.items():
        sums[label] += error * n
    for few in (vector_codes.BROADCAST_LABELS, 0):
        got = vector_codes.label_errors(made.rows, few).collect()
        assert len(got) == sum(want.values()) and all(r.label_error == sums[r.label] for r in got)


def test_codes_of_few_and_of_huge_vectors(spark):
    df = spark.createDataFrame([(2, None, [1.0] * 8), (1, 4, [1e300] * 8)], "vec_id long, label int, embedding array<double>")
    made = vector_codes.compress(df)
    assert {r.key: (r.code, r.error) for r in made.rows.collect()} == {1: ([0] * 8, 0), 2: ([1] * 8, 0)}
    none = vector_codes.compress(df.limit(0))
    assert vector_codes.label_errors(none.rows).count() == 0 and none.books.shape[1] == 0


def test_heaps_give_up_what_is_below_and_little_else_is_measured():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        keys = rng.random(n).tolist()
        heapq.heapify(keys)
        heap = np.array(keys)
        assert sorted(heap[vector_codes.below(heap, 0.5)].tolist()) == sorted(k for k in keys if k <= 0.5)
    points = np.concatenate([rng.normal(m, 3, (500, 1, 4)) for m in (0, 400, 800, 1200)]).astype(np.int64)
    block = vector_codes.Block(points, 4)
    books = points[[0, 500, 1000, 1500], 0][None].copy()
    assert block.advance(books, np.zeros((1, 4))) == 2000
    packed, sums = block.packed(), block.sums.ravel()
    block = vector_codes.Block.unpacked(packed, sums, 1, 4, 4)
    moved = books + 2
    assert block.advance(moved, np.full((1, 4), 2 * 4.0)) == 0
    far = books.copy()
    far[0, 0] = books[0, 1] - 1
    step = np.sqrt(((far - books).astype(float) ** 2).sum(2))
    block.advance(far, step + step.max())
    want = ((points[:, 0, None] - far[0][None]) ** 2).sum(2).argmin(1)
    assert block.entry[:, 0].tolist() == want.tolist()
    assert block.sums[0, :, -1].tolist() == np.bincount(want, minlength=4).tolist()


def test_hex_codes_of_a_table(spark):
    got = registry.op11_vector_codes(spark, "/root/testdata/sf0.001").collect()
    assert got and all(len(r.code) == 16 and int(r.code, 16) >= 0 for r in got) and len({r.codebooks_sha256 for r in got}) == 1
    assert sum(r.error for r in got) == sum({r.label_error for r in got})


def test_texts_of_other_types_count_as_their_strings(spark):
    df = spark.createDataFrame([(1, 5)], "doc_id int, text int")
    assert bpe.encode_texts(df).first().n_tokens == 1
