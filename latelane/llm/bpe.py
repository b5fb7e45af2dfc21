"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A vocabulary file in the tokenizers library's JSON format (BPE with an end-of-word suffix)
gives tokens and merges.  For a word, an Aho-Corasick automaton finds the longest token
that starts at each place.  Tokens are taken longest first; one is accepted when it is
compatible with the one before, else its next shorter prefix is tried, else the one before
is taken back.  Two tokens are compatible when no merge across their border would have come
before the merges that built them.  The result is what applying all merges gives, in time
linear in the word, without a queue of merges.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from latelane.llm.common import slices

#: Words, and pairs of tokens, that a worker remembers; beyond, it starts anew.
REMEMBERED = 250_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + extra)
            extra += 1
    return [chars[b] for b in range(256)]


def _class(kind: str) -> str:
    """The inside of a character class: all code points of a general category by the library's own tables."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    runs = pre_tokenizers.Split(Regex(f"\\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r, _ in runs)


def _unassigned() -> list[str]:
    """Ranges of code points without a category in Python's tables."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code)) == "Cn"
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return ranges


class Encoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        # A symbol is one character here: a byte, or (from 256 on) a byte that ends its word.
        chars = byte_characters()
        symbol = {c: chr(b) for b, c in enumerate(chars)} | {c + self.suffix: chr(256 + b) for b, c in enumerate(chars)}
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        texts = {vocab[name]: s for name, s in symbol.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            joined = self._name(pair)
            t = vocab[joined]
            self.merges[a, b] = rank, t
            if t not in texts:
                texts[t], self.left[t], self.right[t], self.rank[t] = texts[a] + texts[b], a, b, rank
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        by_text = {}
        for t, s in texts.items():
            self.length[t] = len(s)
            by_text[s] = t
            self.automaton.add_word(s, (len(s), t))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for s, t in by_text.items():
            for n in range(len(s) - 1, 0, -1):
                if (p := by_text.get(s[:n])) is not None:
                    self.shorter[t] = p
                    break
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters, numbers = _class("L"), _class("N")
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        # The same words of a lowered text in ASCII, by classes that are small bitmaps.
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.newer = re.compile("[" + "".join(_unassigned()) + "]")
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.size, self.compatible = size, {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _name(pair) -> str:
        return "".join(pair if isinstance(pair, list) else pair.split(" "))

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side stay apart under all merges.

        Goes back in time from the finished tokens: of the two pieces at the border the one that
        was made last is undone.  A merge across the border that ranks before that moment would
        have joined them; at equal rank the left one of two merges comes first.
        """
        key = a * self.size + b
        if key in self.compatible:
            return self.compatible[key]
        if len(self.compatible) > REMEMBERED:
            self.compatible.clear()
        before, ok = sys.maxsize, True
        while True:
            merge = self.merges.get((a, b))
            if merge is not None and merge[0] < before:
                ok = False
                break
            if self.rank[a] < 0 and self.rank[b] < 0:
                break
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.right[a]
            else:
                before, b = self.rank[b] + 1, self.left[b]
        self.compatible[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        text = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n = len(text)
        longest, at = [0] * n, [0] * n
        for end, (size, t) in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start], at[start] = size, t
        tokens: list[int] = []
        dead = bytearray(n + 1)  # places from which no encoding reaches the end
        place, t = 0, at[0]
        while place < n:
            while t >= 0 and (dead[place + self.length[t]] or (tokens and not self.fits(tokens[-1], t))):
                t = self.shorter[t]
            if t >= 0:
                tokens.append(t)
                place += self.length[t]
                t = at[place] if place < n else -1
            else:
                dead[place] = 1
                t = tokens.pop()
                place -= self.length[t]
        return tokens

    def normal(self, text: str) -> str:
        """NFC, then lower case; lowering works character by character, so a final sigma is like any other."""
        if not text.isascii() and len(text.encode("latin-1", "ignore")) < len(text) and self.newer.search(text):
            return self.library.normalize_str(text)  # characters that Python's Unicode tables do not have yet
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split_words(self, text: str) -> list[str]:
        """The words of the normalised text."""
        return self.ascii_words.findall(text.lower()) if text.isascii() else self.words.findall(self.normal(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.known
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            words = self.split_words(part)
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = np.array(self.encode_word(w), "<u4").tobytes()
                out.append(b"".join([known[w] for w in words]))
        return b"".join(out)


class Decoder:
    """All tokens' texts after one another, each with the blank that joins it to the next, and their offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        parts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts joined by blanks, in UTF-8: gathered from the table at once."""
        t = np.frombuffer(ids, "<u4")
        if not len(t):
            return b""
        starts, sizes = self.offsets[t], self.offsets[t + 1] - self.offsets[t]
        ends = np.cumsum(sizes)
        return self.table[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])][:-1].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _encoded(path: str):
    def run(batches):
        e = encoder(path)
        for batch in slices(batches):
            ids = [e.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["k", "n_tokens", "ids"],
            )

    return run


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text.

    ``path`` names a vocabulary file that every executor has.  Null and empty texts have no
    tokens; repeated rows and null keys are encoded like others; special tokens' texts inside
    a text become those tokens.  Other columns are not read; an empty table gives no rows.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_encoded(path), "k long, n_tokens long, ids binary").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``: the texts of the tokens in ``ids``.  Null ids give an empty text."""
    names = [c for c in df.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)

    def run(batches):
        d = decoder(path)
        for batch in slices(batches):
            texts = [d.decode(x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "decoded"])

    return df.select(*names).mapInArrow(run, f"{schema}, decoded string")
