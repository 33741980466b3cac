"""Token ids of texts by a public tokenizer file.

The vocabulary comes from the tokenizer's own file; its merges are ranked by id, so tiktoken's
faster merge loop gives the same ids (asserted on probes and by the tests). Texts that hold a
special token's string, or on which the faster loop gives up (a run of blanks of many hundred
thousand characters), go to the tokenizer itself.
"""

from __future__ import annotations

import re

import numpy as np

# fixed value: how byte-level tokenizers of this family part a text
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ["Two words, don't  stop.\n\n  1234 été 日本語 🙂🙂 xyzzyqwv", "a\tb 　c", "", " "]


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        byte = _byte_of()
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in special}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = tiktoken.Encoding("file", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})
        for probe in _PROBES:
            if self(probe).tolist() != self.whole.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{path} is not a byte-level tokenizer with ids in merge order")

    def __call__(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.special is not None and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except ValueError:  # its pattern matcher ran out of room
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
