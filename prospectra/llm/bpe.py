"""Byte-pair encoding by tries of words, and decoding of ids.

Texts are cut where a vocabulary never joins, and a task encodes each distinct word once. The words
of a batch make a trie, held as its words in order; a depth-first pass gives every node the last
token of the encoding of the prefix that it stands for, and that token's length, which lead back to
the whole encoding. A prefix that many words share is so encoded once. A token may follow another if
no merge crosses between them before both are whole, and exactly one token that ends at a node may
follow what precedes it: that is its last token.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import string
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import token_counts, vocabularies, words

#: Words that a task remembers, and the longest, in bytes, that it does; remembered answers of what may follow what.
REMEMBERED, LONGEST, ANSWERS = 150_000, 64, 300_000
#: Where a text can be cut if the vocabulary keeps white space: before a single space between two other characters.
_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_SPACE = re.compile(r"\s")


class Merges:
    """The merge table of a vocabulary file, and which tokens may follow which.

    Pieces are in the byte-level alphabet. Where the vocabulary marks word ends, a piece's last
    character is a symbol of its own, so `inner` and `final` tokens differ; elsewhere they are the same.
    """

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only byte-level merge tables without unknown tokens, prefixes or fallbacks")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in pairs}
        base = [t for t in vocab if t not in made]
        #: What each token spells, and whether it ends a word.
        self.spelled: dict[int, tuple[str, bool]] = {vocab[t]: (t[0], bool(end) and t[1:] == end) for t in base if len(t) == 1 or (end and t[1:] == end)}
        if len(self.spelled) != len(base):
            raise ValueError("the vocabulary has tokens that no merge makes")
        never = len(pairs)
        self._rank: dict[tuple[int, int], int] = {}
        #: The two tokens that each token is merged from, by that merge's rank.
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.spelled or x not in self.spelled or y not in self.spelled or self.spelled[x][1]:
                raise ValueError("merges must make each token once, from tokens made before")
            self._rank[x, y] = rank
            self._made[z] = (x, y, rank)
            self.spelled[z] = (self.spelled[x][0] + self.spelled[y][0], self.spelled[y][1])
        self._never = never
        self.inner = {text: i for i, (text, ends) in self.spelled.items() if not ends}
        self.final = {text: i for i, (text, ends) in self.spelled.items() if ends} if end else self.inner
        #: The tokens by what they spell, and -1 for what only ends one: nothing longer has to be looked up than these.
        self.inner_tails = self._tails(self.inner)
        self.final_tails = self._tails(self.final) if end else self.inner_tails
        #: For each token the answers so far of which tokens may follow it, and how many these are; prefixes encoded so far.
        self.answers: dict[int, dict[int, bool]] = defaultdict(dict)
        self._known = self.encoded = 0

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along an edge of a token's merges, each with the rank of the merge that ends it."""
        found, ends = [(token, self._never)], self._made.get(token)
        while ends:
            found.append((ends[side], ends[2]))
            ends = self._made.get(ends[side])
        return found

    def follows(self, first: int, second: int) -> bool:
        """Whether two tokens side by side are what their joined symbols encode to."""
        known = self.answers[first].get(second)
        if known is None:
            rank = self._rank.get
            known = True
            for a, a_ends in self._edge(first, 1):
                for b, b_ends in self._edge(second, 0):
                    crossing = rank((a, b))
                    # Of equal merges the leftmost comes first: one inside the first token, before one inside the second.
                    if crossing is not None and crossing < a_ends and crossing <= b_ends:
                        known = False
            if self._known >= ANSWERS:
                self.answers.clear()
                self._known = 0
            self.answers[first][second] = known
            self._known += 1
        return known

    @staticmethod
    def _tails(table: dict[str, int]) -> dict[str, int]:
        return dict.fromkeys((text[at:] for text in table for at in range(1, len(text))), -1) | table


def encode_trie(merges: Merges, pieces: list[str]) -> list[list[int]]:
    """The ids of distinct pieces in ascending order, which is the depth-first order of their trie.

    A node is a prefix; the nodes above the one that is visited are kept with the last token of
    their encoding and its length. What a piece shares with the one before it is a path of nodes
    that have been visited already, and is not encoded again.
    """
    inner, final, answers, follows = merges.inner_tails.get, merges.final_tails.get, merges.answers, merges.follows
    tokens, sizes, before = [-1], [0], ""
    out: list[list[int]] = []
    for piece in pieces:
        n = len(piece)
        shared, most = 0, min(n - 1, len(before) - 1)
        while shared < most and piece[shared] == before[shared]:
            shared += 1
        del tokens[shared + 1 :], sizes[shared + 1 :]
        merges.encoded += n - shared
        for k in range(shared + 1, n + 1):
            known, at = inner if k < n else final, k
            while True:
                at -= 1
                token = known(piece[at:k])
                if token >= 0:
                    if not at:
                        break
                    fits = answers[tokens[at]].get(token)
                    if fits or (fits is None and follows(tokens[at], token)):
                        break
            tokens.append(token)
            sizes.append(k - at)
        ids, at = [], n
        while at:
            ids.append(tokens[at])
            at -= sizes[at]
        ids.reverse()
        out.append(ids)
        before = piece
    return out


class Encoder:
    """Words of a vocabulary file to packed ids. What comes before merging (special strings, normal forms, pieces) is the file's own."""

    def __init__(self, vocabulary: str, special: bool = True):
        self.library = vocabularies.fast_tokenizer(vocabulary)
        with open(vocabularies.place(vocabulary), encoding="utf-8") as file:
            described = json.load(file)
        self.merges = Merges(described["model"])
        self.known: dict[bytes, bytes] = {}
        added = described.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("only added tokens that stand for their own text, without white space")
        self.added = {t["content"]: t["id"] for t in added} if special else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.drops_space = token_counts.splits_at_space(self.library)
        self._simple = self._simple_words()

    def split(self, text: bytes) -> list[bytes]:
        """The parts of a text that can be encoded one by one."""
        if self.drops_space:
            return text.split()
        return [p.encode() for p in _SINGLE_SPACE.split(text.decode())] if text else []

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def _pieces(self, word: str) -> list[str | int]:
        """Special tokens as ids, and the pieces between them."""
        found: list[str | int] = []
        for part in self._cut.split(word) if self._cut else [word]:
            if part in self.added:
                found.append(self.added[part])
            elif part:
                found += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self._normal(part))]
        return found

    def _simple_words(self) -> re.Pattern | None:
        """Runs of ASCII letters, with a run of marks behind them or not, if the file takes these apart as lower-cased letters and the marks; it is asked about all pairs of letters and of marks."""
        letters = string.ascii_letters
        marks = [m for m in string.punctuation if self._pieces("ab" + m) == ["ab", m] and self._pieces("ab" + m + "s") == ["ab", m, "s"]]
        marks = [m for m in marks if all(self._pieces("ab" + m + o) == ["ab", m + o] and self._pieces("ab" + o + m) == ["ab", o + m] for o in marks)]
        chained = "".join(a + b for a in letters for b in letters)
        if not self.drops_space or self._pieces(chained) != [chained.lower()] or not marks:
            return None
        return re.compile(f"([A-Za-z]+)([{re.escape(''.join(marks))}]*)")

    def pieces(self, parts: list[str]) -> list[list[str | int]]:
        """The pieces of each part."""
        if self._simple is None:
            return self._cut_pieces(parts)
        simple = list(map(self._simple.fullmatch, parts))
        rest = iter(self._cut_pieces([p for p, m in zip(parts, simple, strict=True) if m is None]))
        return [next(rest) if m is None else [m[1].lower(), m[2]] if m[2] else [m[1].lower()] for m in simple]

    def _cut_pieces(self, parts: list[str]) -> list[list[str | int]]:
        """The pieces of each part. Plain parts are cut in one go, side by side with single spaces between them."""
        lead = 0 if self.drops_space else 1
        apart = [p[:lead] != " "[:lead] or bool(_SPACE.search(p, lead)) or bool(self._cut and self._cut.search(p)) for p in parts]
        plain = [p for p, own in zip(parts, apart, strict=True) if not own]
        if self.drops_space:
            whole, gap = self._normal(" ".join(plain)), 1
            ends = np.cumsum([len(w) + gap for w in whole.split(" ")]) if plain else np.zeros(0, np.int64)
        else:
            whole = self._normal("".join(plain))
            ends = np.cumsum([len(p) for p in plain]) if self.library.normalizer is None else np.zeros(0, np.int64)
        if len(ends) != len(plain):
            return [self._pieces(p) for p in parts]
        cut = self.library.pre_tokenizer.pre_tokenize_str(whole)
        owner = np.searchsorted(ends, np.array([at for _, (at, _) in cut], np.int64), side="right").tolist()
        found: list[list[str | int]] = [[] for _ in plain]
        for (piece, _), k in zip(cut, owner, strict=True):
            found[k].append(piece)
        rest = iter(found)
        return [self._pieces(p) if own else next(rest) for p, own in zip(parts, apart, strict=True)]

    def learn(self, new: list[bytes]) -> None:
        """Encodes parts of texts and remembers them."""
        parts = self.pieces([w.decode() for w in new])
        distinct = sorted({p for ps in parts for p in ps if isinstance(p, str)})
        code: dict[str | int, bytes] = {p: struct.pack(f"<{len(ids)}I", *ids) for p, ids in zip(distinct, encode_trie(self.merges, distinct), strict=True)}
        code |= {i: struct.pack("<I", i) for i in self.added.values()}
        for word, ps in zip(new, parts, strict=True):
            self.known[word] = code[ps[0]] if len(ps) == 1 else b"".join([code[p] for p in ps])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = {w for ws in split for w in ws if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for ws in split for w in ws}
        # What learning makes has no cycles: looking for some would take as long as the merging.
        collecting = gc.isenabled()
        gc.disable()
        try:
            self.learn(list(new))
        finally:
            if collecting:
                gc.enable()
        packed = [b"".join([self.known[w] for w in ws]) for ws in split]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return packed


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, special: bool) -> Encoder:
    return Encoder(vocabulary, special)


@functools.lru_cache(maxsize=2)
def _token_bytes(vocabulary: str) -> tuple[pa.Array, bool]:
    """What each id stands for, and whether the vocabulary joins tokens' bytes; else tokens are joined by spaces."""
    with open(vocabularies.place(vocabulary), encoding="utf-8") as file:
        described = json.load(file)
    kind = (described.get("decoder") or {}).get("type")
    if kind not in (None, "ByteLevel"):
        raise ValueError(f"no decoding for the kind {kind}")
    known = {i: t for t, i in described["model"]["vocab"].items()} | {t["id"]: t["content"] for t in described.get("added_tokens") or []}
    names = [known.get(i) for i in range(max(known, default=-1) + 1)]
    if kind is None:
        return pa.array([b" " + n.encode() if n is not None else b"" for n in names], pa.large_binary()), False
    plain = {t["content"] for t in described.get("added_tokens") or []}
    back = vocabularies.byte_of()
    return pa.array([(n.encode() if n in plain else bytes(map(back.__getitem__, n))) if n is not None else b"" for n in names], pa.large_binary()), True


def decoded(ids: np.ndarray, first: np.ndarray, vocabulary: str) -> list[str]:
    """The texts of runs of ids, run i being ids[first[i]:first[i + 1]]; ids that the vocabulary lacks are left out, as its library does."""
    table, bytewise = _token_bytes(vocabulary)
    sound = (ids >= 0) & (ids < len(table))
    taken = pc.take(table, pa.array(np.where(sound, ids, 0)))
    if not sound.all():
        taken = pc.if_else(pa.array(sound), taken, pa.scalar(b"", pa.large_binary()))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
    return [data[ends[a] : ends[b]].decode(errors="replace") if bytewise else data[ends[a] + 1 : ends[b]].decode() for a, b in zip(first[:-1], first[1:], strict=True)]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", special: bool = True, packed: bool = False, decode: bool = False) -> DataFrame:
    """One row per row of `df`: the key, n_tokens and ids of the whole text, as the library gives them without added special tokens.

    `ids` is an array of integers, or with `packed` the bytes of little-endian unsigned 32-bit
    integers. With `decode` the text that the ids decode to comes along as `decoded`, as `decode_ids`
    gives it, in the same pass. Strings of special tokens inside a text become these, or without `special` ordinary
    text. Null and empty texts have no ids; the key may be null or repeated; other columns of `df`
    are not read, whatever their names. A very long text or word takes memory in proportion to
    itself. An empty table gives no rows. Vocabularies that are no byte-level merge table fail with
    a ValueError in the task.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, special)
        for batch in words.slices(batches, "__text", words.SLICE // 2):
            codes = coder.encode(batch.column("__text").cast(pa.large_binary()).fill_null(b"").to_pylist())
            counts = np.array([len(c) // 4 for c in codes], np.int64)
            if packed:
                ids: pa.Array = pa.array(codes, pa.binary())
            else:
                flat = np.frombuffer(b"".join(codes), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
            columns = {"__key": batch.column("__key"), "n_tokens": pa.array(counts), "ids": ids}
            if decode:
                first = np.concatenate([[0], np.cumsum(counts)])
                columns["decoded"] = pa.array(decoded(np.frombuffer(b"".join(codes), "<i4").astype(np.int64), first, vocabulary), pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    narrow = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return narrow.mapInArrow(run, f"__key {kind}, n_tokens bigint, ids {'binary' if packed else 'array<int>'}{', decoded string' if decode else ''}").withColumnRenamed("__key", key)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """`df` with `out`, the text that the vocabulary's library decodes the ids to, special tokens included.

    `ids` is an array of integers or packed bytes, as `encode_texts` gives them. Null ids and no ids
    give an empty text; nulls among ids, and ids that the vocabulary lacks, are left out. Other
    columns stay as they are; one named `out` is replaced. An empty table gives no rows.
    """
    kept = df.drop(out)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(ids))
            if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                runs = [np.frombuffer(c or b"", "<i4") for c in column.to_pylist()]
            else:
                runs = [np.array([-1 if i is None else i for i in c or []], np.int64) for c in column.to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
            texts = decoded(np.concatenate([np.zeros(0, np.int64), *runs]).astype(np.int64), first, vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{out}` string"
    return kept.mapInArrow(run, schema)
