"""Token ids of whole texts by a byte-level BPE vocabulary, with a memory of the words seen before."""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import tiktoken

#: The id that ends a document, and its two bytes; ids of this vocabulary fit in 16 bits.
END = 0
#: The vocabulary's only special token: its string in a text is this one id, whatever stands around it.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
WORDS_KEPT = 600_000


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The vocabulary at path; special tokens' strings are ordinary text here (see Coder.whole)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Little-endian 16-bit ids of ' ' + word, for words without white space at either end; forgets all when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), dtype="<u2").tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids


class Coder:
    """Encodes texts as the tokenizer of byte_bpe_50k.json does, word by word where that is safe. whole() gives what that
    tokenizer gives by default, packed() what it gives with encode_special_tokens = True.

    Each pre-token of this vocabulary either holds no white space, or starts with it, or is white space. So a text can be
    cut before any white space that follows another character, and the parts' ids joined. Texts whose words are parted
    by other than single spaces or newlines are encoded whole.
    """

    def __init__(self, path: str):
        self.encode = byte_bpe(path).encode_ordinary
        self.words = Words(self.encode)

    def whole(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self.packed(text)
        return np.uint16(SPECIAL_ID).astype("<u2").tobytes().join(map(self.packed, text.split(SPECIAL)))

    def packed(self, text: str) -> bytes:
        led = text[:1] == " "
        body = text[1:] if led else text
        if len(body.split()) != body.count(" ") + body.count("\n") + 1:
            return np.array(self.encode(text), dtype="<u2").tobytes()
        if led:
            return b"".join(map(self.words.__getitem__, body.split(" ")))
        first, *rest = body.split(" ")
        return b"".join(chain([np.array(self.encode(first), dtype="<u2").tobytes()], map(self.words.__getitem__, rest)))


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    """One for each Python worker, which keeps its words from task to task."""
    return Coder(path)


def ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u2")
