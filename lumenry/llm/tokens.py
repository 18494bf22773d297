"""Byte-level BPE from a public vocabulary file.

Ids are those of the ``tokenizers`` file named; encoding runs through ``tiktoken`` over
the same merges, which is several times faster (the tests hold the two against each other).
A stretch with a run of blanks that ``tiktoken``'s expressions cannot walk goes to
``tokenizers`` itself, and so does everything if the file splits texts in another way.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import tiktoken
import tokenizers

#: Fixed value: the published split pattern of byte-level files that name no pattern of their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

STRETCH = 1 << 20
RUN = re.compile(r"\s{4096}")
#: A token never reaches over a blank that follows another character.
EDGE = re.compile(r"(?<=\S) ")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE files write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.path, own = path, file.get("pre_tokenizer") or {}
        self.coder = None
        if all(own.get(k) == v for k, v in SPLIT.items()) and not file.get("normalizer"):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
            self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @staticmethod
    @functools.cache
    def load(path: str) -> ByteBpe:
        """One per worker process."""
        return ByteBpe(path)

    @functools.cached_property
    def reference(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if self.coder is None or len(text) >= 4096 and RUN.search(text):
            return np.array(self.reference.encode(text, add_special_tokens=False).ids, np.uint32)
        special = "all" if any(s in text for s in self.special) else set()
        return self.coder.encode_to_numpy(text, allowed_special=special, disallowed_special=()).astype(np.uint32)

    def parts(self, text: str, end_id: int) -> Iterator[np.ndarray]:
        """Ids of ``text`` and ``end_id``, a stretch of about ``STRETCH`` characters at a time."""
        at = 0
        while self.coder is not None and len(text) - at > STRETCH and (edge := EDGE.search(text, at + STRETCH)):
            yield self.encode(text[at : edge.start()])
            at = edge.start()
        yield self.encode(text[at:])
        yield np.array([end_id], np.uint32)
