"""Where a tokenizer cuts a text into words before it merges symbols.

The tokenizer files name the words by a regular expression over Unicode
classes.  Python's ``regex`` module knows a newer Unicode version than the
tokenizers library, so the few code points on which they may differ (those
that Python's ``unicodedata`` doesn't know yet) are asked of the library.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache

import regex

# The pre-tokenizing patterns that the tokenizer files state.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: a character of no letter, digit or white-space class, as stand-in
OTHER = "¦"


def _latin(pattern: str) -> re.Pattern:
    """The pattern over code points below 256, with its classes spelled out."""
    def members(cls):
        found = [chr(c) for c in range(256) if regex.match(cls, chr(c))]
        return "".join(f"\\x{ord(c):02x}" for c in found)
    letters, digits, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]")
    out = out.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
    out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
    return re.compile(out.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


@lru_cache(maxsize=None)
def _unknown_to_python() -> frozenset[str]:
    """The code points that ``regex`` calls letter or number and
    ``unicodedata`` calls unassigned."""
    every = "".join(chr(c) for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def unknown_in(text: str) -> frozenset[str]:
    """The characters of a text of which only the library knows the class."""
    return frozenset() if is_latin(text) else _unknown_to_python().intersection(text)


class Words:
    """The words of a text by the pattern of the tokenizer file at ``path``."""

    def __init__(self, pattern: str, path: str):
        self.latin, self.full = _latin(pattern), regex.compile(pattern)
        self.path, self.stand_in = path, {}

    @cached_property
    def library(self):
        """The library's tokenizer: only texts with odd characters need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ask(self, text: str) -> list:
        return self.library.pre_tokenizer.pre_tokenize_str(text)

    def find(self, text: str) -> list[str]:
        if is_latin(text):
            return self.latin.findall(text)
        odd = unknown_in(text)
        if not odd:
            return self.full.findall(text)
        for c in odd - self.stand_in.keys():  # the library's word for it: letter, number or neither
            self.stand_in[c] = "a" if len(self.ask("a" + c)) == 1 else "1" if len(self.ask("1" + c)) == 1 else OTHER
        plain = text.translate({ord(c): self.stand_in[c] for c in odd})
        return [text[m.start():m.end()] for m in self.full.finditer(plain)]
