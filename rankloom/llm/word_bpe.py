"""Token ids of texts by a `tokenizers` file whose pre-tokenizer drops white space, over Arrow batches."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from rankloom.llm.byte_bpe import byte_characters
from rankloom.llm.common import kept
from rankloom.llm.pieces import Pieces, ends_of_rows, ids_of

# The steps of the file for which words of Latin-1 characters can go to the library's model directly (fixed values).
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class WordBpe:
    """One tokenizer file, as it is kept in a Python worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        split = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        self.known = spec["normalizer"].get("normalizers") == _STEPS and split == [_SPLIT, None]
        self.table = dict(enumerate(byte_characters()))
        self.parts = Pieces(self._part, 200_000)
        self.words = Pieces(self._word, 500_000)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _part(self, part: str) -> bytes:
        mapped = part.encode().decode("latin-1").translate(self.table)
        return self._pack([token.id for token in self.tokenizer.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        if not self.known or not word or max(word) > "ÿ" or "<|" in word or "\x85" in word or "\xa0" in word:
            return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return b"".join([self.parts[x] for x in _LATIN.findall(word.lower())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids end. No token reaches over ASCII white space."""
        words = pc.ascii_split_whitespace(texts)
        offsets = words.offsets.to_numpy()
        ids, ends = ids_of(words.flatten(), self.words.__getitem__, self.dtype)
        return ids, ends_of_rows(offsets - offsets[0], ends)


def tokenizer(path: str) -> WordBpe:
    return kept("word_bpe", path, make=lambda: WordBpe(path))
