"""BPE encoding and decoding with a word-end vocabulary, by a pair occurrence index.

The pieces new to a task are merged together: an index maps every mergeable pair to all its positions, ranks are taken
in ascending order, one rank is applied at all its positions from left to right, and only the lists of the neighbouring
pairs are updated. Words do not touch each other, so this gives each word the merges it would get alone.

Input columns other than id and text are ignored. A null text counts as empty and has no ids; equal rows give equal
rows; an empty table gives an empty table. Texts are encoded whole. The vocabulary file is read where it is named by
``path`` on every machine; its content is never part of the repository.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.shared import bound_text_batches, slices_by_bytes

#: Pieces kept per task between batches; the table starts anew beyond it, which costs time but changes no result.
PIECE_CACHE = 200_000
#: Rows decoded at a time.
DECODE_ROWS = 500
#: Fixed value: the split pattern that the vocabulary file states.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters outside these blocks may have another class or case in another version of Unicode; texts that hold one
#: are normalised and split by the library itself, so that its version decides.
UNSETTLED = "[^\u0000-\u0557\u0900-\u0c5b\u1e00-\u208e\u2100-\ua7ca\uac00-\ud7a3\uff00-\uffef\U0001f000-\U0001fbff]"


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself where it is printable Latin-1, else the next code from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Merges pieces of text to ids with the vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.tokens = pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)])
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.path, self.library = path, None
        self.split = regex.compile(SPLIT)
        self.unsettled = regex.compile(UNSETTLED)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.pair_of = [(vocab[left], vocab[right]) for left, right in model["merges"]]
        self.ranks = {a << 20 | b: rank for rank, (a, b) in reversed(list(enumerate(self.pair_of)))}
        self.codes = np.array(sorted(self.ranks), np.int64)
        self.code_ranks = np.array([self.ranks[c] for c in self.codes.tolist()], np.int64)
        self.made = [vocab[left + right] for left, right in model["merges"]]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _index(self, symbol: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """All positions of every mergeable pair, by the pair's rank."""
        codes = symbol[:-1] << 20 | symbol[1:]
        found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.flatnonzero((self.codes[found] == codes) & ~last[:-1])
        rank = self.code_ranks[found[at]]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        return {int(r[0]): p.tolist() for r, p in zip(np.split(rank, cut), np.split(at, cut), strict=True) if len(p)}

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and each piece's count; all share one pair occurrence index."""
        raw = [p.encode() for p in pieces]
        stops = np.cumsum([len(r) for r in raw], dtype=np.int64)
        chars = np.frombuffer(b"".join(raw), np.uint8)
        last = np.zeros(len(chars), bool)
        last[stops - 1] = True
        start = np.where(last, self.last[chars], self.inner[chars])
        index = self._index(start, last)
        active = list(index)
        heapq.heapify(active)
        symbol = start.tolist()
        after = np.where(last, -1, np.arange(1, len(chars) + 1)).tolist()
        first = np.concatenate([[True], last[:-1]])
        before = np.where(first, -1, np.arange(-1, len(chars) - 1)).tolist()
        rank_of = self.ranks.get
        while active:
            rank = heapq.heappop(active)
            left, right = self.pair_of[rank]
            new = self.made[rank]
            for at in sorted(index.pop(rank)):
                gone = after[at]
                if symbol[at] != left or gone < 0 or symbol[gone] != right:
                    continue
                symbol[at], symbol[gone] = new, -1
                follower = after[at] = after[gone]
                leader = before[at]
                if follower >= 0:
                    before[follower] = at
                    other = rank_of(new << 20 | symbol[follower])
                    if other is not None:
                        if other in index:
                            index[other].append(at)
                        else:
                            index[other] = [at]
                            heapq.heappush(active, other)
                if leader >= 0:
                    other = rank_of(symbol[leader] << 20 | new)
                    if other is not None:
                        if other in index:
                            index[other].append(leader)
                        else:
                            index[other] = [leader]
                            heapq.heappush(active, other)
        left_over = np.array(symbol, np.int32)
        kept = left_over >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        return left_over[kept], np.diff(upto[np.concatenate([[0], stops])])

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text in order; special tokens found in it stand as themselves."""
        if self.cut is not None and "<" in text:
            found = []
            for part in self.cut.split(text):
                found += [part] if part in self.special else self._plain(part)
            return found
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and self.unsettled.search(text):
            return self._library_pieces(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # one code point at a time: the word-final form of sigma is not used
        return self.split.findall(text.replace("Σ", "σ").lower())

    def _library_pieces(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in found]

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of new pieces to the table of known ones."""
        fresh = [p for p in pieces if p not in self.known and p not in self.special]
        marks = [p for p in pieces if p not in self.known and p in self.special]
        if not fresh and not marks:
            return
        ids, counts = self.merged(fresh) if fresh else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.known.update(zip(fresh + marks, range(len(self.known), len(self.known) + len(fresh) + len(marks)), strict=True))
        self.flat = np.concatenate([self.flat, ids, np.array([self.special[m] for m in marks], np.int32)])
        counts = np.concatenate([counts, np.ones(len(marks), np.int64)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def encode_batch(self, texts: list[str | None]) -> pa.Array:
        """A list of ids for each text."""
        if len(self.known) > PIECE_CACHE:
            self._clear()
        split = [self.pieces(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        count = np.array([len(p) for p in split], np.int64)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        lens = np.diff(self.ends)[which]
        stop = np.cumsum(lens)
        place = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.ends[which] - (stop - lens), lens)
        of_text = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
        return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), pa.array(self.flat[place]))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each row joined by one space: the file names no decoder."""
        lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        tokens = self.tokens.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), " ")


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every text, special tokens not added. A narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), own.encode_batch(part.column("body").to_pylist())], ["doc_id", "ids"]
                )

    bound_text_batches(docs.sparkSession)
    given = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text).cast("string").alias("body"))
    return given.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``decoded``, special tokens kept. Null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                decoded = own.decode_batch(part.column("ids"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), decoded], ["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: ``decode(encode(docs))`` with one Python worker for each task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                ids = own.encode_batch(part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), ids, own.decode_batch(ids)], ["doc_id", "ids", "decoded"]
                )

    bound_text_batches(docs.sparkSession)
    given = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text).cast("string").alias("body"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
