"""BPE encoding and decoding by tree concatenation.

A text longer than `leaf` characters is halved until its parts are short; the leaves are encoded in parallel, and the
encodings are joined up the tree. A join encodes a window around the cut anew, and grows it until both sides agree
exactly: on either side, the window's tokens and the half's own have a boundary in common beyond which the half's own
hold. What lies beyond is kept from the halves. Where no window short of both halves agrees, they are encoded as one.

Why an agreement is exact. The pre-tokenizer reads pieces from left to right, a piece is one run of letters, digits,
other characters or white space, and byte pairs are merged within a piece only.

- At a seam, that is after a letter or digit whose successor is of another class, or between any character and white
  space after it, every reading of the text ends a piece, whatever surrounds it. So tokens on either side of a seam
  don't depend on each other, and a seam in the window is an agreement.
- A window that is one run of one class, without a seam, lies within one piece. A sequence of tokens is the encoding of
  a piece if each two neighbours are the encoding of their concatenation. If window and half have one token in the same
  place in common, then the neighbours left of it are a pair of the one encoding and those right of it of the other, so
  joining the two at that token is exact.

Special tokens' strings in a text become their ids, as the tokenizers library does by default; they are split off
first, so a cut never falls into one. Letters outside the ranges that every Unicode version classes alike go through
the tokenizers library itself; the rest through a byte-pair encoder built from the same vocabulary file, which gives
the same ids several times faster. A vocabulary file whose pre-tokenizer, normalizer or merge options differ from the
byte-level ones is refused.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows each get their own result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 4096  # characters of a leaf
WINDOW = 24  # tokens of the first window on either side of a cut

# Fixed value: the byte-level pre-tokenizer's pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: ASCII, Latin letters, general punctuation and currency signs: classed alike by every Unicode version in use
PLAIN = re.compile(r"[\u0000-\u007f\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5]*\Z")

#: ... and Greek, Cyrillic, kana and the common Han characters: those next to a seam
STABLE = r"[\u0000-\u007f\u00a1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]"
SEAM = regex.compile(
    rf"(?<=(?=\p{{L}}){STABLE})(?=(?!\p{{L}}){STABLE})|(?<=(?=\p{{N}}){STABLE})(?=(?!\p{{N}}){STABLE})|(?<=(?=[^\s\p{{L}}\p{{N}}]){STABLE})(?=(?=[\s\p{{N}}]){STABLE})"
)
#: one run of one class, of characters that are classed alike
RUN = regex.compile(rf"(?:(?=\p{{L}}){STABLE})+|(?:(?=\p{{N}}){STABLE})+|(?:(?=[^\s\p{{L}}\p{{N}}]){STABLE})+|(?:(?=\s){STABLE})+")


def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public_tokenizers package keeps a vocabulary file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def check_format(spec: dict) -> None:
    """Raises ValueError unless the vocabulary file is a byte-level BPE as this module reads it."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    bare = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if spec.get("normalizer") or any(pre.get(k, True) != v for k, v in wanted.items()) or model.get("type") != "BPE" or not plain or not bare:
        raise ValueError("not a byte-level BPE vocabulary with the standard pre-tokenizer")


class Coder:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken
        from tokenizers import Tokenizer

        self.leaf, self.full = leaf, Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_format(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.quick = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.no_truncation()
        self.bare.no_padding()
        self.pool = ThreadPoolExecutor(2)

    def _whole(self, text: str) -> list[int]:
        """Ids of a text in which special tokens' strings are ordinary text."""
        if PLAIN.match(text):
            return self.quick.encode_ordinary(text)
        return self.bare.encode(text, add_special_tokens=False).ids

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a short text in which special tokens' strings are ordinary text."""
        return self._whole(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.quick.encode(text, allowed_special="all") if PLAIN.match(text) else self.full.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                ids += self._tree(part)
        return ids

    def _tree(self, text: str) -> list[int]:
        n = 1
        while len(text) > n * self.leaf:
            n *= 2  # halves of halves
        cuts = [len(text) * k // n for k in range(n + 1)]
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        encode = self._whole if PLAIN.match(text) else lambda t: self.bare.encode(t, add_special_tokens=False).ids
        parts = list(zip(leaves, self.pool.map(encode, leaves), strict=True))
        while len(parts) > 1:
            parts = [self._join(*parts[k], *parts[k + 1], encode) for k in range(0, len(parts), 2)]
        return parts[0][1]

    def _join(self, left: str, a: list[int], right: str, b: list[int], encode: Callable[[str], list[int]]) -> tuple[str, list[int]]:
        whole, width = left + right, WINDOW
        while width < len(a) or width < len(b):
            x, y = a[-width:], b[:width]
            before, after = self._bytes(x), self._bytes(y)
            try:
                # a window starts and ends between characters
                text = (before + after).decode("utf-8")
            except UnicodeDecodeError:
                width += 1
                continue
            mid = encode(text)
            seams, run = self._seams(text), RUN.fullmatch(text) is not None
            cut, end = len(before), len(before) + len(after)
            i = self._agree(x, mid, seams, run, cut) if width < len(a) else (0, 0)
            back = {end - s for s in seams}
            j = self._agree(y[::-1], mid[::-1], back, run, len(after)) if width < len(b) else (0, 0)
            if i and j and i[1] + j[1] <= len(mid):
                return whole, [*a[: len(a) - len(x) + i[0]], *mid[i[1] : len(mid) - j[1]], *b[len(y) - j[0] :]]
            width *= 4
        return whole, encode(whole)

    def _bytes(self, ids: list[int]) -> bytes:
        return self.quick.decode_bytes(ids)

    @staticmethod
    def _seams(text: str) -> set[int]:
        """Byte offsets of the seams of a text."""
        out, at, last = set(), 0, 0
        for m in SEAM.finditer(text):
            at += len(text[last : m.start()].encode("utf-8"))
            last = m.start()
            out.add(at)
        return out

    def _agree(self, own: list[int], mid: list[int], seams: set[int], run: bool, cut: int) -> tuple[int, int] | None:
        """Counts of tokens from the window's outer end at whose end both encodings have a boundary and agree: at the
        first seam, or in a run without seams at the end of the first token that both have in the same place."""
        size, i, j, p, q = self.size, 0, 0, 0, 0
        while i < len(own) and j < len(mid):
            if p == q:
                if p in seams and p < cut:
                    return i, j
                if run and own[i] == mid[j] and p + size[own[i]] < cut:
                    return i + 1, j + 1
                p, q, i, j = p + size[own[i]], q + size[mid[j]], i + 1, j + 1
            elif p < q:
                p, i = p + size[own[i]], i + 1
            else:
                q, j = q + size[mid[j]], j + 1
        return None

    def decode(self, ids: list[int]) -> str:
        return self.quick.decode_bytes(ids).decode("utf-8", "replace")


_coders: dict[tuple[str, int], Coder] = {}


def coder(path: str, leaf: int = LEAF) -> Coder:
    """One coder for each worker process."""
    if (path, leaf) not in _coders:
        _coders[path, leaf] = Coder(path, leaf)
    return _coders[path, leaf]


def encode(docs: DataFrame, path: str, leaf: int = LEAF, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of each row's whole text in ids_col (array<int>)."""
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, leaf)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = pa.array([c.encode(t.as_py()) for t in part.column(0)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], [*rest, ids_col])

    schema = docs.select(*rest).withColumn(ids_col, F.array().cast("array<int>")).schema
    return docs.select(text_col, *rest).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """tokens with the text of each row's ids in text_col; null ids give an empty text."""
    rest = [c for c in tokens.columns if c not in (text_col, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = pa.array([c.decode(i.as_py() or []) for i in part.column(0)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], [*rest, text_col])

    schema = tokens.select(*rest).withColumn(text_col, F.lit("")).schema
    return tokens.select(ids_col, *rest).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, then decodes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = coder(path, leaf), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(sha(str(ids)[1:-1].replace(" ", "").encode()))
                text_sha.append(sha(c.decode(ids).encode("utf-8")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
