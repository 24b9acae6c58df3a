"""Texts within a number of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.functions import fixed

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A single blank between two letters.
_BETWEEN = re.compile(r"[^\W\d_](?= [^\W\d_])")


def count_words(text: str) -> int:
    return len(_WORD.findall(text))


def within_tokens(text: str, most: int, count: Callable[[str], int] = count_words) -> str:
    """The longest beginning that has, with the suffix, at most ``most`` tokens; found by
    halving, as counts don't fall when a text grows."""
    room = max(0, most - count(fixed.TRUNCATION_SUFFIX))
    if count(text) <= room:
        return text
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        if count(text[:middle]) <= room:
            low = middle
        else:
            high = middle - 1
    return text[:low] + fixed.TRUNCATION_SUFFIX


def truncated_tokens(most: int, count: Callable[[str], int] = count_words):
    """A column function: texts within a number of tokens of any counter."""

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else within_tokens(t, most, count))

    return F.pandas_udf(cut, StringType())


class Tokens:
    """Cuts texts to a number of tokens of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def within(self, text: str, most: int, suffix: str = fixed.TRUNCATION_SUFFIX) -> str:
        """``text`` if it has at most ``most`` tokens, else a beginning and the suffix that
        have so many together, one character more having too many.

        A beginning that is sure to hold more tokens is encoded once; the offset of the last
        token that fits gives the place, which then moves by characters, as a cut or the
        suffix can change the last tokens. What lies before a single blank between two words
        is the same with any end, so only what follows it is encoded again."""
        found = self._beginning(text, most)
        if found is None:
            return text
        if (own := self.count(suffix)) >= most:
            return suffix
        at = found.offsets[most - own - 1][1]
        firm, known = self._firm(text, at), 0
        if firm:
            known = sum(1 for _, end in found.offsets if end <= firm)

        def fits(n: int) -> bool:
            if firm and n > firm + 1:
                return known + self.count(text[firm:n] + suffix) <= most
            return self.count(text[:n] + suffix) <= most

        while at and not fits(at):
            at -= 1
        while at < len(text) and fits(at + 1):
            at += 1
        return text[:at] + suffix

    def _firm(self, text: str, end: int) -> int:
        """The last place before ``end`` of a single blank between two letters, where any
        tokenizer of this kind parts; 0 if there is none."""
        found = None
        for found in _BETWEEN.finditer(text, max(0, end - 200), end):
            pass
        return found.start() + 1 if found else 0

    def _beginning(self, text: str, most: int):
        """The encoding of the text, or of a beginning whose tokens up to one more than
        ``most`` are those of the text; None if the text has at most ``most``."""
        size = 8 * most
        while size < len(text):
            if firm := self._firm(text, size):
                found = self.tokenizer.encode(text[:firm], add_special_tokens=False)
                if len(found.ids) > most:
                    return found
            size *= 4
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found if len(found.ids) > most else None


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The tokenizer of a file, read once by each Python process."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def within_budget(most: int, path: str):
    """A column function: texts within a number of tokens of a tokenizer file."""

    def cut(texts: pd.Series) -> pd.Series:
        tokens = tokens_of(path)
        return texts.map(lambda t: None if t is None else tokens.within(t, most))

    return F.pandas_udf(cut, StringType())
