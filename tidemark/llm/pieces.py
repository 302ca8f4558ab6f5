"""Cached sub-word encoders: pre-tokens are looked up whole, so a repeated word is merged once.

Both encoders give the ids that the ``tokenizers`` library gives for the same file.  The text is cut
into pre-tokens with the file's own split rule; a pre-token's ids never depend on its neighbours, so
they are kept (as packed little-endian uint32) in a cache with a fixed number of entries.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Entries held by one worker; the cache is emptied when it is full, so memory stays bounded.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded but not kept.
CACHE_PIECE_CHARS = 64

_PLAIN = re.compile("[\t\n\r -~¡-§©«»¿-įı-ſ‐-‧‰-›€]*")
_WORDS = re.compile(r"[a-zß-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ſ0-9]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files, as stand-in -> byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(c): b for b, c in [*((b, b) for b in kept), *((b, 256 + i) for i, b in enumerate(rest))]}


class _Cache(dict):
    """Chunk of text -> packed ids; ``fill(chunks)`` encodes those that are missing."""

    def __init__(self, fill):
        super().__init__()
        self.fill = fill

    def join(self, chunks: list[str]) -> bytes:
        found = list(map(self.get, chunks))
        if None in found:
            missing = list(dict.fromkeys([c for c, ids in zip(chunks, found, strict=True) if ids is None]))
            new = dict(zip(missing, self.fill(missing), strict=True))
            found = [new[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
            if len(self) + len(new) > CACHE_ENTRIES:
                self.clear()
            self.update(new if max(map(len, missing)) <= CACHE_PIECE_CHARS else {c: ids for c, ids in new.items() if len(c) <= CACHE_PIECE_CHARS})
        return b"".join(found)


class WordPieces:
    """Lower-casing word BPE (end-of-word marks, white space dropped), from a ``tokenizers`` file.

    A space after each pre-token plays the end-of-word mark, which lets a byte-pair engine with plain
    byte ranks do the merges.  Texts with characters whose class, case or composition could be treated
    differently by the two libraries, or with the file's special strings, go to the library itself.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        back, ranks = byte_alphabet(), {}
        special = set(self.special)
        for token, rank in spec["model"]["vocab"].items():
            if token in special:
                continue
            end = token.endswith("</w>")
            body = token[:-4] if end else token
            ranks[bytes(back[c] for c in body) + (b" " if end else b"")] = rank
        self.engine = tiktoken.Encoding("word-pieces", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.endswith(b" ")
        self.cache = _Cache(self._fill)

    def _fill(self, chunks: list[str]) -> list[bytes]:
        words = [_WORDS.findall(c) for c in chunks]
        ids = np.asarray(self.engine.encode_ordinary("".join([" ".join(w) + " " for w in words])), dtype="<u4")
        last = np.flatnonzero(self.ends[ids])[np.cumsum([len(w) for w in words]) - 1]
        packed, cuts = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), dtype="<u4")

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as packed little-endian uint32."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.cache.join(text.lower().split())


class BytePieces:
    """Byte-level BPE from a ranks file; the ids' bytes joined are the text's bytes."""

    def __init__(self, ranks_file: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.engine = tiktoken.Encoding("byte-pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.cache = _Cache(lambda chunks: [array("I", self.engine.encode_ordinary(c)).tobytes() for c in chunks])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text.  Where no two spaces meet, each space opens a pre-token, so the text
        can be cut before every space without changing an id."""
        if "  " in text or "\0" in text:
            return np.asarray(self.engine.encode_ordinary(text), dtype="<u4")
        return np.frombuffer(self.cache.join(text.replace(" ", "\0 ").split("\0")), dtype="<u4")
