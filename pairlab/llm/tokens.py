"""Token ids of whole texts, for the operators that pack or store them.

The ids are those of the tokenizers library for the given JSON vocabulary (add_special_tokens=False). A byte-level BPE
file whose ids ascend with its merges is read into tiktoken, which gives the same ids at several times the speed;
texts with a very long run without a break, on which tiktoken's merging is quadratic, go through tokenizers itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from pairlab.llm.bpe import PATTERN, byte_chars

LONG_RUN = re.compile(r"[^\W\d_]{400}|[^\w\s]{400}|\d{400}|\s{400}")


def has_long_run(text: str) -> bool:
    """Whether LONG_RUN is in a text. Most texts are settled by the lengths of their words, as the search is slow."""
    words = text.split()
    spare = len(text) - sum(map(len, words)) - len(words)  # white space but one for each word
    if spare < 398 and max(map(len, words), default=0) < 400:
        return False
    return LONG_RUN.search(text) is not None


class Encoder:
    """Encodes texts; strings of special tokens in a text become those tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        back = {c: b for b, c in byte_chars().items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        merged = [vocab[m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must ascend with the merges")
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers."""
        if has_long_run(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder for a vocabulary file, built once in each Python worker."""
    return Encoder(path)
