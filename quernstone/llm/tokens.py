"""Token ids by the public byte-level BPE vocabulary.

The vocabulary comes in two forms that give the same ids: ranks, which are quicker, and a
tokenizer file, which also reads special tokens out of a text. Texts that hold the string
of a special token go to the second, as do those whose runs of white space are longer than
the first one's pattern matcher can take (about half a million characters).
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END = 0


class Encoder:
    """Encodes whole texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        self.whole = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def raw(self, text: str) -> bytes:
        """Ids as bytes, four a token."""
        if not any(s in text for s in self.specials):
            try:
                return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # the matcher's stack is full
                pass
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def document(self, text: str | None) -> bytes:
        """A document's ids: those of its text, then the end id."""
        return self.raw(text or "") + END.to_bytes(4, "little")


_OWN: list[Encoder] = []


def encoder() -> Encoder:
    """The encoder of this process: workers that run several tasks load it once."""
    if not _OWN:
        _OWN.append(Encoder())
    return _OWN[0]
