"""Token ids of a lower-casing word vocabulary (BPE with an end-of-word mark).

The vocabulary file's own merges are run, a white-space-free chunk at a time and through a
bounded cache: white space always ends a word here, so a text's ids are its chunks' ids in
turn. A merge of the end mark with a word's last byte comes before all others. Texts that
hold a special token's string go to the tokenizers library whole. Tests compare the ids with
that library's.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import numpy as np

from .byte_bpe import WHITE_SPACE

CACHE_LIMIT = 500_000
#: str.split() takes these for white space, the vocabulary's rules don't.
_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{WHITE_SPACE}]+")
#: The vocabulary's split pattern. Fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STOPS = ".,;:!?|"
_END = b"\xff"  # never a byte of UTF-8


def _printable() -> dict[str, int]:
    """The vocabulary writes each byte as one printable character: that character's byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges, byte_of = model["model"]["vocab"], model["model"]["merges"], _printable()
        self.special = [t["content"] for t in model["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        ranks, ids = {}, {}

        def add(token: bytes, rank: int, name: str) -> None:
            ranks[token] = rank
            if name in vocab:
                ids[rank] = vocab[name]

        alone = 1 << 20
        for c, b in byte_of.items():
            add(bytes([b]), alone + b, c)
            if bytes([b]) != _END:
                add(bytes([b]) + _END, b, c + "</w>")
        for i, m in enumerate(merges):
            name = "".join(m if isinstance(m, list) else m.split(" "))
            ended = name.endswith("</w>")
            add(bytes(byte_of[c] for c in name[: -4 if ended else None]) + _END * ended, 256 + i, name)
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ids = ids
        self.split = regex.compile(_SPLIT).findall
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = array("I", [self.ids[r] for r in self.merge(word.encode() + _END)]).tobytes()
            if len(word) <= 64:
                self.words[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # Letter by letter: no letter's lower case may depend on its place.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if text.isalpha():
            return self._word(text)
        if text[:-1].isalpha() and text[-1] in _STOPS:
            return self._word(text[:-1]) + self._word(text[-1])
        return b"".join(map(self._word, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split() if not _ODD.search(text) else [x for x in _SPACES.split(text) if x]
        cache = self.chunks
        if len(cache) > CACHE_LIMIT:
            cache.clear()
        if len(self.words) > CACHE_LIMIT:
            self.words.clear()
        got = list(map(cache.get, parts))
        if None in got:
            for i in [i for i, x in enumerate(got) if x is None]:
                chunk = parts[i]
                got[i] = ids = self._chunk(chunk)
                if len(chunk) <= 64:
                    cache[chunk] = ids
        return b"".join(got)


@functools.cache
def codec(path: str) -> WordBPE:
    """One codec a process and vocabulary; its cache outlives a task."""
    return WordBPE(path)
