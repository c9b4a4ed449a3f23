"""Encoding with a lower-casing word-end BPE vocabulary file of the tokenizers library, word by word.

The file's normalizer folds white space and case, its pre-tokenizer drops white space, and merges stay within a word. So
the ids of a text are the ids of its white-space separated chunks in a row, and a chunk that occurs again is looked up.
That holds for texts of plain Latin script without a special token's opening; any other text goes through the tokenizers
library as a whole, and so does every text if the file's normalizer or pre-tokenizer are others.

New words are encoded by a byte-pair encoder built from the same file, many at once: a word's end is marked by a zero
byte, as which the file's word-end symbol is read. Tests hold it against the library for every entry of the vocabulary.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from .bpe import byte_symbols

# Normalizer, pre-tokenizer pattern and word end of the file
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
END = "</w>"

#: Printable ASCII, its white space, Latin letters and general punctuation: normal forms of their own, classed alike by
#: every library in use
PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~¡-ɏ‐-‧‰-⁞₠-₵]*\Z")
#: SPLIT, for lower-cased texts of these characters
WORDS = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:_|[^\s\w])+")
MOST = 500_000  # chunks that a worker remembers beyond those of one slab
SLAB = 1 << 20  # characters that are split at once


class WordCoder:
    """Encoder for one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.openings = {s[:2] for s in special}
        self.known: dict[str, bytes] = {}
        self.quick = None
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        same = (spec.get("normalizer") or {}).get("normalizers") == NORMAL and splits[0].get("pattern") == {"Regex": SPLIT} and model.get("end_of_word_suffix") == END
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if same and plain:
            symbols = byte_symbols()
            spell = lambda t: bytes(symbols[c] for c in t.removesuffix(END)) + b"\0" * t.endswith(END)
            ranks = {spell(t): i for t, i in model["vocab"].items() if t not in special}
            self.ends = np.zeros(max(ranks.values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(END) and t not in special]] = True
            self.quick = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, chunks: list[str]) -> None:
        """The ids of chunks that aren't known yet."""
        if not chunks:
            return
        words = [WORDS.findall(c) for c in chunks]
        ids = np.array(self.quick.encode_ordinary("".join(w + "\0" for w in chain.from_iterable(words))), "<u4")
        after = np.flatnonzero(self.ends[ids]) + 1  # where each word's ids end
        cut = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum([len(w) for w in words])])]
        self.known.update((c, ids[a:b].tobytes()) for c, a, b in zip(chunks, cut[:-1].tolist(), cut[1:].tolist(), strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        new = list(set().union(*texts).difference(self.known))
        if len(self.known) + len(new) > MOST and self.known:
            self.known.clear()
            return self._joined(texts)
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in texts]

    def bytes_of(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.quick is None or not PLAIN.match(text) or any(o in text for o in self.openings):
                out[k] = self._whole(text)
            elif len(text) > SLAB:
                out[k] = b"".join(self._joined([part.lower().split()])[0] for part in slabs(text))
            else:
                some.append((k, text.lower().split()))
                size += len(text)
            if size > SLAB:
                self._fill(out, some)
                some, size = [], 0
        self._fill(out, some)
        return out

    def _fill(self, out: list[bytes], some: list[tuple[int, list[str]]]) -> None:
        for (k, _), ids in zip(some, self._joined([c for _, c in some]), strict=True):
            out[k] = ids


def slabs(text: str) -> list[str]:
    """Parts of a text that start at a space."""
    out, at = [], 0
    while len(text) - at > SLAB and (end := text.find(" ", at + SLAB)) >= 0:
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


_coders: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    """One coder for each worker process."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
