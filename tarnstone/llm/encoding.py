"""Exact byte-pair encoding by dynamic programming over prefixes."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; they are read where the tasks run.
TOKENIZER_DIR = "/opt/tokenizers"

#: White space as the pattern of the vocabulary has it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A single blank between other signs always begins a word, so texts can be cut there before the pattern runs.
_BLANK = re.compile(r" (?=\S)(?<=\S )")

#: Words that one task keeps with their ids; beyond, the table starts anew.
_MEMO = 400_000


@cache
def _pattern() -> re.Pattern:
    """The split of a text into words: contractions, letters, numbers, other signs, white space.

    In Python's re a word character is a letter, a number of any kind or _; the numbers that are
    no decimal digits are told apart here."""
    numbers = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Nl", "No")]
    runs: list[list[int]] = []
    for i in numbers:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    other = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    parts = ["'s|'t|'re|'ve|'m|'ll|'d", rf" ?[^\W\d_{other}]+", rf" ?[\d{other}]+", rf" ?(?:[^{_SPACE}\w]|_)+", rf"[{_SPACE}]+(?![^{_SPACE}])", rf"[{_SPACE}]+"]
    return re.compile("|".join(parts))


def _byte_letters() -> dict[str, str]:
    """The letter that the vocabulary file writes for each byte, to the character of that code:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class _Words(dict):
    """Runs of text to the ids that they have after a blank."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.encoder.__getitem__, _pattern().findall(" " + run))))
        if len(run) < 64:
            if len(self) >= _MEMO:
                self.clear()
            self[run] = ids
        return ids


class PrefixEncoder(dict):
    """Words to tuples of token ids, computed on first use.

    For each prefix of a word exactly one token can end its encoding. Those that could, the tokens
    that are suffixes of the prefix, come from an automaton over the vocabulary; the one that is
    compatible with the last token of the shorter prefix is kept, and the back-pointers give the ids."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        spelled = {token: "".join(map(letters.get, token)) for token in model["vocab"] if all(x in letters for x in token)}
        ids = model["vocab"]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # parts -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = ids[left + right]
            self.merged[ids[left], ids[right]] = rank, token
            self.parts.setdefault(token, (ids[left], ids[right], rank))
        self.automaton = ahocorasick.Automaton()
        for token, text in spelled.items():
            if len(text) == 1 or ids[token] in self.parts:
                self.automaton.add_word(text, (len(text), ids[token]))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        self.edges: dict[tuple[int, int], list[tuple[int, int, float]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(part, rank that makes it, rank that uses it up) of the parts at one end of a token while it is built."""
        found = self.edges.get((token, side))
        if found is None:
            found, used = [], float("inf")
            while token in self.parts:
                made = self.parts[token]
                found.append((token, made[2], used))
                token, used = made[side], made[2]
            found.append((token, -1, used))
            self.edges[found[0][0], side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together ends with just a and b: no merge across the
        seam may come before those that use up the two parts. Of equal ranks the left one comes first."""
        key = a, b
        known = self.pairs.get(key)
        if known is None:
            known = True
            for x, made_x, used_x in self._edge(a, 1):
                for y, made_y, used_y in self._edge(b, 0):
                    if made_x < used_y and made_y < used_x and (m := self.merged.get((x, y))) and m[0] < used_x and m[0] <= used_y:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def __missing__(self, word: str) -> tuple[int, ...]:
        text = word.encode("utf-8", "replace").decode("latin-1")
        last: list[tuple[int, int]] = [(0, -1)] * (len(text) + 1)  # start and id of the last token of each prefix
        for end, (size, token) in self.automaton.iter(text):
            start = end + 1 - size
            if start == 0 or (last[start][1] >= 0 and self.compatible(last[start][1], token)):
                last[end + 1] = start, token
        at, out = len(text), []
        while at:
            at, token = last[at]
            out.append(token)
        result = tuple(reversed(out))
        if len(word) < 64:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = result
        return result

    def parts_of(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """The ids of a text, in one tuple for each run between single blanks; none for an empty or null text."""
        if not text:
            return iter(())
        first, *rest = _BLANK.split(text)
        return chain(map(self.__getitem__, _pattern().findall(first)), map(self.words.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts_of(text)))


@cache
def encoder(name: str, folder: str = TOKENIZER_DIR) -> PrefixEncoder:
    """The encoder of a vocabulary file, once a Python worker."""
    return PrefixEncoder(f"{folder}/{name}.json")


def encode_texts(rows: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the token ids of each text by a byte-level vocabulary, without special tokens.

    Empty and null texts give an empty list; strings that look like special tokens are ordinary
    text. Every row gives a row, repeated ones too. Whole texts, without a shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 500):  # bounds what is held in Python
                part = [enc.encode(t) for t in texts.slice(at, 500).to_pylist()]
                offsets = np.zeros(len(part) + 1, np.int32)
                np.cumsum([len(x) for x in part], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(part), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(encode, f"{key} {kind}, ids array<int>")


def count_tokens(rows: DataFrame, key: str, text: str, name: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens): the number of tokens of each text, 0 for empty and null texts. name is a
    byte-level vocabulary (byte_...) or a sentencepiece model (piece_...)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name.startswith("piece_"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")

            def sizes(texts: list[str | None]) -> list[int]:
                return [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
        else:
            enc = encoder(name, folder)

            def sizes(texts: list[str | None]) -> list[int]:
                return [sum(map(len, enc.parts_of(t))) for t in texts]

        for batch in batches:
            out = [n for at in range(0, batch.num_rows, 500) for n in sizes(batch.column(1).slice(at, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=[key, "n_tokens"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(count, f"{key} {kind}, n_tokens bigint")
