"""Token ids of whole texts by a word-level BPE tokenizer file, through caches of short pieces.

The tokenizer splits at white space and between letters, digits and other signs before BPE, so a
text's ids are its pieces' ids one after another. Texts of plain letters and signs are split here
and only unseen pieces meet the tokenizer; any other text goes to it word by word.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

PLAIN = re.compile("[ \n\t\ra-zß-öø-ÿA-ZÀ-ÖØ-Þ0-9!-&(-/:-@\\[-`{-~]*")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^ \n\t\ra-zß-öø-ÿ0-9]+")


class WordTokenizer:
    """ids(texts): the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.known, self.before = most, {}, {}  # before: what was known until the last turnover
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # whether a token ends a piece
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> None:
        """Plain pieces go in one line, told apart by their last tokens; others go one by one."""
        plain = [w for w in new if PIECE.fullmatch(w) and PLAIN.fullmatch(w)]
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at, raw = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()], ids.tobytes()
            if len(at) == len(part) + 1:
                self.known.update((w, raw[a:b]) for w, a, b in zip(part, at, at[1:], strict=False))
        rest = [w for w in new if w not in self.known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [PIECE.findall(x.lower()) if PLAIN.fullmatch(x) else x.replace("\n", " ").split(" ") for x in texts]
        wanted = set().union(*split)
        new = wanted - self.known.keys()
        if new and len(self.known) + len(new) > self.most:
            self.known, self.before, new = {}, self.known, wanted
        self.known.update((w, self.before[w]) for w in new & self.before.keys())
        self._learn(list(new - self.before.keys()))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


@functools.lru_cache(1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer and cache for all tasks of a Python worker."""
    return WordTokenizer(path)
