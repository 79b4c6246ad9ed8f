"""Byte-level and piece tokenizers of a worker: ids, and the bytes behind every id."""

from __future__ import annotations

import json
import re

import numpy as np

#: White space of such a length is left to the plain tokenizer: the fast one's pattern backtracks over it.
_LONG_SPACE = re.compile(r"\s{2000}")
_KEPT: dict[tuple, object] = {}


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and on in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of any text by a byte-level vocabulary in JSON; strings of special tokens are ordinary text.

    Ids come from a faster encoder over the same ranks where merges are numbered in order, and are
    those of the plain tokenizer either way.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        of = _byte_of_char()
        self.bytes_of: dict[int, bytes] = {i: t.encode() if t in special else bytes(of[c] for c in t) for t, i in self.plain.get_vocab().items()}
        #: The first id that the vocabulary leaves free.
        self.size = max(self.bytes_of) + 1
        ranks = {b: i for i, b in self.bytes_of.items() if self.plain.id_to_token(i) not in special}
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        joined = ("".join(m if isinstance(m, list) else m.split(" ", 1)) for m in merges)
        in_order = all(self.plain.token_to_id(t) == len(ranks) - len(merges) + k for k, t in enumerate(joined))
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _LONG_SPACE.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "i4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("i4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()


class Pieces:
    """Ids of any text by a piece model; a piece's bytes have U+2581 as space, and byte pieces are their byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes_of: dict[int, bytes] = {i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def byte_bpe(path: str | None = None) -> ByteBpe:
    """One for each worker process and vocabulary; the default vocabulary is the public one of 50,257 ids."""
    return _kept(ByteBpe, path, "byte_bpe_50k.json")


def pieces(path: str | None = None) -> Pieces:
    return _kept(Pieces, path, "piece_bpe_32k.model")


def _kept(kind, path: str | None, default: str):
    import public_tokenizers

    path = path or public_tokenizers.path(default)
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]
