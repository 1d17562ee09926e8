"""Exact token counts at every prefix of a text, for byte-level BPE, by prefix dynamic programming.

In byte-pair encoding every prefix of a word has one last token: the only token that ends there and forms a
valid pair with the last token of what stands before it. So ``count[i] = count[i - len(last[i])] + 1``, and one
pass gives the counts at all prefixes; truncation to a budget and counts of any prefix then need no encoding.
Counts are stored as differences from prefix to prefix (two bytes a character).

A text is cut where no word of the pre-tokenizer can cross: at a single space or line break between other
characters. The pieces' counts are kept in a bounded store and joined.

Defined results: a null text is an empty one: no bytes, no tokens. A special token's string in a text is one
token, as the library has it by default. Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import LATIN_END, Kept, byte_alphabet, sql_type

# Unicode's White_Space, and the pre-tokenizer's pattern of byte-level BPE as published with GPT-2.
WHITE = "\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


class PrefixCounter:
    """Counts at every prefix for a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str, max_entries: int = 500_000, max_piece: int = 40):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError(f"{path} is not a byte-level BPE tokenizer")
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocabulary = {as_bytes(t) for t in spec["model"]["vocab"]}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.longest = max(map(len, vocabulary))
        self.tokens = {t for t in vocabulary if self._merge(t) == [t]}  # only these can be the whole of their bytes
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.white = regex.compile(f"[{WHITE}]")
        self.run = regex.compile(f"[{WHITE}]+")
        self.cut = regex.compile(f"(?V1)(?<=[^{WHITE}])(?= [^{WHITE}])")
        self.max_entries, self.max_piece = max_entries, max_piece
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces, self.starts, self.counted = Kept(max_entries), Kept(max_entries // 10), Kept(max_entries)

    def _merge(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _is_pair(self, a: bytes, b: bytes) -> bool:
        if len(self.pairs) > self.max_entries:
            self.pairs.clear()
        found = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return found

    def word_counts(self, word: str) -> bytes | list[int]:
        """Tokens of ``word[:k]`` for k from 1, the word being of one piece for the pre-tokenizer at each length."""
        found = self.counted.get(word)
        if found is None:
            found = self._count_word(word)
            if len(word) <= self.max_piece:
                self.counted.put(word, found)
        return found

    def _count_word(self, word: str) -> bytes | list[int]:
        data = word.encode()
        last, counts, tokens, pairs, longest = [b""], [0], self.tokens, self.pairs, self.longest
        for i in range(1, len(data) + 1):
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                t = data[j:i]
                if t in tokens:
                    if j:
                        before = last[j]
                        fits = pairs.get((before, t))
                        if fits is None:
                            fits = self._is_pair(before, t)
                        if not fits:
                            continue
                    last.append(t)
                    counts.append(counts[j] + 1)
                    break
            else:
                raise AssertionError(f"no last token for {data[:i]!r}")
        if len(data) == len(word):
            out = counts[1:]
            return bytes(out) if out[-1] < 256 and len(word) <= self.max_piece else out
        at, out = 0, []
        for c in word:
            at += len(c.encode())
            out.append(counts[at])
        return bytes(out) if out[-1] < 256 and len(word) <= self.max_piece else out

    def _plain_counts(self, text: str) -> list[int]:
        """Counts at every prefix of a text without special tokens."""
        out, before, run_end = [0] * len(text), 0, 0
        for m in self.words.finditer(text):
            word, start = m.group(), m.start()
            if self.white.match(word[-1]):
                if start >= run_end:  # white space at the end of a prefix is one word, however it is split later
                    run = self.run.match(text, start)
                    run_end = run.end()
                    out[start:run_end] = [before + c for c in self.word_counts(run.group())]
                before += self.word_counts(word)[-1]
                continue
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction's prefixes are no contractions
                counts = [len([p for w in self.words.findall(word[:k]) for p in self._merge(w.encode())]) for k in range(1, len(word) + 1)]
            else:
                counts = self.word_counts(word)
            for k, c in enumerate(counts):
                if start + k >= run_end:
                    out[start + k] = before + c
            before += counts[-1]
        return out

    def counts(self, text: str) -> list[int]:
        """Tokens of ``text[:k]`` for k from 1 to the length."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._plain_counts(text)
        out, base, rest = [], 0, self.special_pattern.split(text)
        for plain, special in zip(rest[::2], [*rest[1::2], ""], strict=True):
            found = self._plain_counts(plain + special[:-1])
            out += [base + c for c in found]
            base += found[len(plain) - 1] if plain else 0
            if special:
                base += 1
                out.append(base)
        return out

    def _piece_counts(self, text: str) -> list[int] | bytes:
        """``counts`` of a piece; a space, one Latin word and at most a comma or full stop need no pre-tokenizer."""
        word = text[:-1] if text[-1] in ".," else text
        if word[:1] == " " and word[1:].isalpha() and max(word) < LATIN_END:
            counts = self.word_counts(word)
            return counts if word is text else [*counts, counts[-1] + 1]
        return self.counts(text)

    def _deltas(self, text: str) -> bytes:
        counts = self._piece_counts(text)
        return struct.pack(f"<{len(counts)}h", counts[0], *map(sub, counts[1:], counts))

    def _look_up(self, kept: Kept, key: str, text: str) -> bytes:
        found = kept.get(key)
        if found is None:
            found = self._deltas(text)
            if len(key) <= self.max_piece:
                kept.put(key, found)
        return found

    def prefix_deltas(self, text: str) -> bytes:
        """The counts' differences from prefix to prefix, as little-endian 16-bit integers, one for each character."""
        pieces = text.replace("\n", " \n").split(" ")
        if pieces[0] and not self.white.match(pieces[0][-1]):
            first = self._look_up(self.starts, pieces[0], pieces[0])
            del pieces[0]
            try:
                return first + b"".join(map(self.pieces.new.__getitem__, pieces))
            except KeyError:
                at_once, get = self.pieces.new.get, self.pieces.get
                found = {p: at_once(p) or get(p) for p in set(pieces)}
                if all(b is not None or self._is_plain(p) for p, b in found.items()):
                    for p, b in found.items():
                        if b is None:
                            found[p] = self._look_up(self.pieces, p, p if p[0] == "\n" else " " + p)
                    return first + b"".join([found[p] for p in pieces])
        return b"".join([self._look_up(self.starts, p, p) for p in self.cut.split(text)]) if text else b""

    def _is_plain(self, piece: str) -> bool:
        """Whether a cut before the piece (its space or line break) and one after it are between words for certain."""
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not self.white.match(body[0]) and not self.white.match(body[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, with ``keep_prefixes``, the binary column ``prefix_deltas`` for ``tokens_at`` and
    ``longest_prefix``. Whole texts, one pass, nothing shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in batches:
            sizes, totals, stored = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                deltas = c.prefix_deltas(text)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                totals.append(int(np.frombuffer(deltas, "<i2").sum(dtype=np.int64)))
                if keep_prefixes:
                    stored.append(deltas)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), *([pa.array(stored, pa.binary())] if keep_prefixes else [])], names=["doc_id", "n_bytes", "n_tokens", *(["prefix_deltas"] if keep_prefixes else [])])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(count, f"doc_id {sql_type(picked, 'doc_id')}, n_bytes long, n_tokens long" + ", prefix_deltas binary" * keep_prefixes)


def tokens_at(prefix_deltas: Column, n_chars: Column) -> Column:
    """The token count of a text's first ``n_chars`` characters (all of them where it has fewer)."""
    @F.pandas_udf("long")
    def at(deltas: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(d, "<i2")[: int(k)].sum(dtype=np.int64)) for d, k in zip(deltas, n, strict=True)])

    return at(prefix_deltas, n_chars)


def longest_prefix(prefix_deltas: Column, budget: Column) -> Column:
    """The most characters of a text that encode to at most ``budget`` tokens."""
    @F.pandas_udf("long")
    def longest(deltas: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for d, b in zip(deltas, most, strict=True):
            fits = np.flatnonzero(np.cumsum(np.frombuffer(d, "<i2"), dtype=np.int64) <= b)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out, dtype="int64")

    return longest(prefix_deltas, budget)
