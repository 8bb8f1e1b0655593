"""BPE encoding and decoding by batched merge rounds in numpy.

A batch of distinct words is one flat array of symbol ids. Each round looks every adjacent pair up
by binary search over the sorted pair keys, takes the lowest rank of each word, merges all places
that have it, and lets words without a known pair go. Words met before come from a bounded cache,
so a long text costs one dictionary lookup a word; the ids of whole texts are then gathered from
the words' ids in one step.

The vocabulary is a ``tokenizer.json`` of the public ``tokenizers`` library: its path is a
parameter, and every executor must have the file. Understood are BPE models over byte symbols, with
or without an end-of-word suffix, normalisers made of NFC, white-space replacement and lower case,
and the two usual splitting patterns. Special strings inside a text become their own ids, as the
library does by default.

Defined results: a null or empty text has no ids and decodes to the empty text; columns other than
the named ones pass through; very long texts are encoded whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the splitting patterns of the tokenizer files mean it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters below this point are letters, decimal digits, white space or neither, and Python's own classes tell which.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\x7e\xc0-\xffĀ-ſ]*+")
_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one ``tokenizer.json``; made once per worker (see :func:`codec`)."""

    def __init__(self, path: str, cache_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        names = byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in names], np.int32)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in names], np.int32)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = added
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        norm = spec.get("normalizer") or {}
        kinds = {n["type"] for n in norm.get("normalizers", [norm])} if norm else set()
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.split = self._pattern(spec["pre_tokenizer"])
        self.quick = self._quick(spec["pre_tokenizer"])
        self.tokens = [""] * (max([self.width - 1, *added.values()]) + 1)
        for t, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = t
        self.byte_of = {c: b for b, c in enumerate(names)}
        self.by_bytes = spec.get("decoder") is not None
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0
        for t, i in self.special.items():
            self._put([t], np.array([i], np.int32), np.array([1]))

    @staticmethod
    def _pattern(pre: dict) -> regex.Pattern:
        parts = pre.get("pretokenizers", [pre])
        if any(p["type"] == "Split" for p in parts):
            return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

    @staticmethod
    def _quick(pre: dict):
        """The same pattern in Python's ``re``, for texts whose characters are all in ``_PLAIN``."""
        import re

        letter, space = r"a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"\t-\r "
        if any(p["type"] == "Split" for p in pre.get("pretokenizers", [pre])):
            return re.compile(rf"[{letter}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{space}{letter}0-9]+")
        return re.compile(rf" ?[{letter}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}0-9]+|[{space}]+(?![^{space}])|[{space}]+")

    def words(self, text: str) -> list[str]:
        """The pieces of a text that are merged each by itself, special strings included."""
        if self.special_split is None or "<" not in text:
            return self._plain_words(text)
        out: list[str] = []
        for i, part in enumerate(self.special_split.split(text)):
            out += [part] if i % 2 else self._plain_words(part)
        return out

    def _plain_words(self, text: str) -> list[str]:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return (self.quick if _PLAIN.fullmatch(text) else self.split).findall(text)

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[data[last]]
        of = np.repeat(np.arange(len(raw)), sizes)
        if len(sym) and sym.min() < 0:  # a symbol that the vocabulary lacks is left out
            keep = sym >= 0
            sym, of = sym[keep], of[keep]
        done_sym, done_of = [], []
        sym = sym.astype(np.int64)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == key) & (of[:-1] == of[1:])
            rank = np.append(np.where(hit, self.rank[at], _NONE), _NONE)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(rank, first)
            spread = np.repeat(best, np.diff(np.append(first, len(sym))))
            over = spread == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_of.append(of[over])
                live = ~over
                at = np.append(at, 0)[live]
                sym, of, rank, spread = sym[live], of[live], rank[live], spread[live]
                if not len(sym):
                    break
                at = at[:-1]
            take = rank == spread
            if (take[1:] & take[:-1]).any():  # of overlapping places every second one, from the left
                where = np.flatnonzero(take)
                start = np.append(True, np.diff(where) != 1)
                begin = np.maximum.accumulate(np.where(start, np.arange(len(where)), 0))
                take[where[(np.arange(len(where)) - begin) % 2 == 1]] = False
            place = np.flatnonzero(take)
            sym[place] = self.made[at[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            sym, of = sym[keep], of[keep]
        ids, owner = (np.concatenate(done_sym), np.concatenate(done_of)) if done_sym else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of the words of all texts, and the number of words of each."""
        per = [self.words(t) for t in texts]
        if len(self.known) > self.cache_words:
            self._reset()
        seen = set().union(*per)
        miss = [w for w in seen if w not in self.known]
        for i in range(0, len(miss), 50_000):
            part = miss[i : i + 50_000]
            self._put(part, *self.merge(part))
        counts = np.fromiter(map(len, per), np.int64, len(per))
        get = self.known.__getitem__
        at = np.fromiter(map(get, chain.from_iterable(per)), np.int64, int(counts.sum()))
        return at, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        at, words = self._index(texts)
        return _segment_sum(self.ends[at + 1] - self.ends[at], words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and how many each text has."""
        at, words = self._index(texts)
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.flat[_ranges(begin, size)], _segment_sum(size, words)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of id lists given flat; special tokens stay. Without a decoder, tokens are joined by spaces."""
        out, tokens, at = [], self.tokens, 0
        if self.by_bytes:
            if not hasattr(self, "piece"):
                piece = [t.encode() if t in self.special else bytes(self.byte_of[c] for c in t) for t in tokens]
                self.piece, self.piece_ends = np.frombuffer(b"".join(piece), np.uint8), np.append(0, np.cumsum([len(p) for p in piece]))
            begin, size = self.piece_ends[ids], self.piece_ends[ids + 1] - self.piece_ends[ids]
            data, ends = self.piece[_ranges(begin, size)].tobytes(), np.cumsum(_segment_sum(size, sizes))
            return [data[a:b].decode("utf-8", "replace") for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
        for n in sizes.tolist():
            out.append(" ".join([tokens[i] for i in ids[at : at + n].tolist()]))
            at += n
        return out


def _segment_sum(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+size[0]-1, begin[1] .. as one array."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


_made: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The worker's codec for a file; a worker keeps it, with its word cache, from task to task."""
    if path not in _made:
        _made[path] = BpeCodec(path)
    return _made[path]


def text_slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters each, so that a batch of long texts stays small."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` without its text column and with the array of token ids of each whole text. With ``decoded_col``
    the ids are decoded again in the same pass, for a round trip without a second Python worker."""
    others = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)]
    given = docs.select(F.struct(*others).alias("_row") if others else F.lit(None).cast("int").alias("_row"), F.coalesce(text_col, F.lit("")).alias("_t"))
    fields = [given.schema["_row"], T.StructField("_ids", T.ArrayType(T.IntegerType()))]
    names = ["_row", "_ids"] + ["_decoded"] * (decoded_col is not None)
    fields += [T.StructField(n, T.StringType()) for n in names[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                ids, sizes = c.encode(texts[lo:hi])
                rows = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(ids))
                decoded = [pa.array(c.decode(ids, sizes), pa.string())] if decoded_col else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), rows, *decoded], names=names)

    out = given.mapInArrow(run, T.StructType(fields))
    picked = [F.col("_row").getField(c).alias(c) for c in others] + [F.col("_ids").alias(ids_col)]
    return out.select(*picked, *([F.col("_decoded").alias(decoded_col)] if decoded_col else []))


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each id list; a null list decodes to the empty text."""
    others = [c for c in encoded.columns if c != text_col]
    given = encoded.select(F.struct(*others).alias("_row"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("_ids"))
    schema = T.StructType([given.schema["_row"], T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            texts = c.decode(b.column(1).flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in others], F.col("_text").alias(text_col))


def digests(decoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> list:
    """Columns for a report on encoded and decoded texts: token count and the SHA-256 of ids and text."""
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(text_col), 256).alias("decoded_sha256"),
    ]
