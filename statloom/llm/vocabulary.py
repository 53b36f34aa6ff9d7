"""Byte-level BPE vocabularies read from a tokenizer file.

The file is the JSON of the tokenizers library. Its merges are the ranks of the byte-pair
encoder used here, which gives the same ids several times faster; the tests compare both.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

# The word pattern of byte-level BPE, and the bytes that stand for themselves
# in its alphabet (the others are shifted to 256 and on, in order).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Encoder and decoder of one tokenizer file; special tokens in a text are recognised."""

    def __init__(self, path: str):
        import tiktoken

        self._path = path
        spec = json.load(open(path, encoding="utf-8"))
        step = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
        to_byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word borders are not supported")
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # Ids serve as ranks, which holds where merged tokens are numbered in merge order.
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: tokens are not numbered in the order of the merges")
        self._encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        self._any_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        size = max([*ranks.values(), *special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.pieces[i] = token
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.decimals = [str(i) for i in range(size)]
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as the tokenizers library gives them without added special tokens."""
        if not text:
            return np.empty(0, dtype=np.uint32)
        found = self._special if self._any_special and self._any_special.search(text) else set()
        return self._ids(text, found)

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids of a text in which the strings of special tokens are ordinary text."""
        return self._ids(text, set()) if text else np.empty(0, dtype=np.uint32)

    def _ids(self, text: str, special: set[str]) -> np.ndarray:
        try:
            return self._encoding.encode_to_numpy(text, allowed_special=special, disallowed_special=())
        except ValueError:
            # a run of about a million blanks is more than its word pattern can track back over
            return np.array(self._library(bool(special)).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    @functools.cache
    def _library(self, special: bool):
        """The tokenizers library with the same file, for texts the faster encoder refuses."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self._path)
        library.encode_special_tokens = not special
        library.no_truncation()
        library.no_padding()
        return library

    def special_spans(self, text: str) -> list[tuple[int, int]]:
        """Where special tokens stand in a text."""
        return [m.span() for m in self._any_special.finditer(text)] if self._any_special else []

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids, special tokens included."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per process."""
    return Vocabulary(path)
