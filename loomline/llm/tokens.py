"""Token ids of whole texts by the ``tokenizers`` library, with caches of encoded words.

Byte-level BPE of the kind used here first cuts a text by a pattern whose matches never run
on from a character that is no white space into white space. So the ids of a text are the ids
of its stretches "white space, then other characters", one after the other, and the ids of a
stretch are those of its matches. Texts whose white space is single blanks and line ends, the common ones, are
cut by plain string splitting; all other texts by the pattern of stretches. Corpora repeat their words, so the library encodes a match
once per Python worker; two caches of at most ``CACHE_WORDS`` entries each do the rest (when
they are full, further words go through the library each time). Texts for which the rule is
not certain (a special token's own text, or characters that only Python counts as white
space) go through the library whole, and so do all texts if the tokenizer file has a normalizer, another
pre-tokenizer or another kind of model than this rule is for; a test compares both ways.
"""

from __future__ import annotations

import json
import os
import re

CACHE_WORDS = 500_000
#: The published cutting pattern of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STRETCHES = re.compile(r"\s*\S+|\s+")
_PYTHON_ONLY_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: White space that is neither a blank nor a line end; texts that hold any are never split plainly.
_OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER_ASCII_SPACE = "\t\x0b\x0c\r"
_IN_A_ROW = ("  ", " \n", "\n ", "\n\n")
_encoders: dict[str, WordEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts_as_here(path: str) -> bool:
    """Whether the file describes byte-level BPE that cuts by ``PATTERN`` and changes nothing before."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    cut, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    return plain and not told.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in odd)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_rule = _cuts_as_here(path)
        self.cache_words = cache_words
        self.stretches: dict[str, bytes] = {}
        self.blanks: dict[str, bytes] = {}  # by the characters after a blank, or by a line end and what follows
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.cut = regex.compile(PATTERN).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = (*_PYTHON_ONLY_SPACE, *added)

    def by_library(self, text: str) -> bytes:
        import numpy as np
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _match(self, match: str) -> bytes:
        spelt = match.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelt)])

    def _stretch(self, stretch: str) -> bytes:
        found = []
        for match in self.cut(stretch):
            ids = self.pieces.get(match)
            if ids is None:
                ids = self._match(match)
                if len(self.pieces) < self.cache_words:
                    self.pieces[match] = ids
            found.append(ids)
        return b"".join(found)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_rule or any(mark in text for mark in self.whole):
            return self.by_library(text)
        other = any(space in text for space in (_OTHER_ASCII_SPACE if text.isascii() else _OTHER_SPACE))
        # plain splitting is right only without empty pieces: no two separators in a row, none at an end
        if other or text[0] in " \n" or text[-1] in " \n" or any(pair in text for pair in _IN_A_ROW):
            return self._looked_up(_STRETCHES.findall(text), self.stretches, self._stretch)
        first, *words = text.replace("\n", " \n").split(" ")
        return self._stretch(first) + self._looked_up(words, self.blanks, lambda w: self._stretch(w if w[:1] == "\n" else " " + w))

    def _looked_up(self, words: list[str], cache: dict[str, bytes], make) -> bytes:
        ids = list(map(cache.get, words))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    ids[i] = made = make(words[i])
                    if len(cache) < self.cache_words:
                        cache[words[i]] = made
        return b"".join(ids)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file; it lives as long as the Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
