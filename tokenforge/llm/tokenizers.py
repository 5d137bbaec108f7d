"""Public vocabularies, loaded once per Python worker from files whose place is
a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"


def vocab_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@functools.lru_cache(4)
def read_ranks(name: str) -> dict[bytes, int]:
    with open(vocab_path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def load_encoder(name: str):
    """(encode, partial) of a vocabulary: ``encode(text)`` gives a numpy array of
    ids, ``partial[id]`` tells whether the token is byte fallback: raw bytes that
    are no whole characters."""
    if name.endswith(".tiktoken"):
        import tiktoken
        ranks = read_ranks(name)
        enc = tiktoken.Encoding("own", pat_str=pretoken_pattern(), mergeable_ranks=ranks, special_tokens={})
        partial = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                partial[i] = True

        def encode(text: str) -> np.ndarray:
            try:
                return enc.encode_to_numpy(text, disallowed_special=())
            except ValueError:         # a run of white space too long for the library's regex engine
                from .byte_bpe import load
                return load(name).encode_batch([text])[0]
        return encode, partial
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=vocab_path(name))
    partial = np.fromiter((sp.is_byte(i) for i in range(sp.vocab_size())), bool)
    return (lambda text: np.asarray(sp.encode(text, num_threads=1), np.int64)), partial
