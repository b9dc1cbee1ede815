"""Unigram tokenizers for taggers: ids with places in the line.

The tokenizer file belongs to the caller's model; it is loaded once per worker.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .plugins import Token


class UnigramTokenizer:
    """tokenize(line) over a tokenizer.json with a Unigram model. Other kinds, byte
    fallback and vocabularies without <s> and </s> are refused. A piece that is only
    the word mark has an empty place; white space at a piece's start is left out."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec.get("model") or {}
        if model.get("type") != "Unigram" or model.get("byte_fallback"):
            raise ValueError("the tokenizer is not a Unigram model without byte fallback")
        if model.get("unk_id") is None or not all(len(v) == 2 for v in model.get("vocab") or [[]]):
            raise ValueError("the tokenizer has no vocabulary or no unknown piece")
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        cls, sep = self._tokenizer.token_to_id("<s>"), self._tokenizer.token_to_id("</s>")
        if cls is None or sep is None:
            raise ValueError("the tokenizer has no <s> or </s>")
        self.cls, self.sep = cls, sep

    def tokenize(self, line: str) -> list[Token]:
        enc = self._tokenizer.encode(line, add_special_tokens=False)
        out = []
        for i, piece, (start, end) in zip(enc.ids, enc.tokens, enc.offsets):
            if piece == "▁":
                start = end
            else:
                start += len(line[start:end]) - len(line[start:end].lstrip())
            out.append(Token(i, start, end))
        return out


def labels_of(logits: np.ndarray) -> list[int]:
    """The best label of each token; of equal ones the first."""
    return np.asarray(logits).argmax(axis=-1).tolist()


def locate(word: str, line: str, cursor: int = 0) -> tuple[int, int] | None:
    """Where a decoded word lies from ``cursor`` on, whatever white space and piece
    marks stand between its characters."""
    chars = [c for c in word.replace("##", "") if not c.isspace()]
    m = re.compile(r"\s*".join(map(re.escape, chars))).search(line, cursor) if chars else None
    return m.span() if m else None


def fixture(tokenizer: UnigramTokenizer, lines: list[str], digest: str) -> dict:
    """A golden fixture: ids and UTF-16 places of lines, and the file's digest."""
    units = lambda t, k: len(t[:k].encode("utf-16-be")) // 2
    rows = []
    for line in lines:
        tokens = tokenizer.tokenize(line)
        rows.append({"line": line, "ids": [t.id for t in tokens], "offsets": [[units(line, t.start), units(line, t.end)] for t in tokens]})
    return {"tokenizer_sha256": digest, "cls": tokenizer.cls, "sep": tokenizer.sep, "lines": rows}
