"""Public tokenizers, loaded once per Python worker. A vocabulary is a file name of the public
collection or an absolute path; its place is looked up where the task runs."""

from __future__ import annotations

import base64
import functools
import os


def place(vocabulary: str) -> str:
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@functools.lru_cache(maxsize=4)
def fast_tokenizer(vocabulary: str):
    """A `tokenizers` tokenizer that neither pads nor truncates and stays on the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(place(vocabulary))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@functools.lru_cache(maxsize=2)
def rank_encoding(vocabulary: str):
    """The same byte-level vocabulary as ranks, for `tiktoken`."""
    import public_tokenizers
    import tiktoken

    with open(place(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def byte_of() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for: printable Latin ones themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def piece_model(vocabulary: str):
    """A `sentencepiece` model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=place(vocabulary))
