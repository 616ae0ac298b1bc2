"""Byte-pair encoding with an index of pair occurrences, and decoding.

A task gathers the distinct words of its texts and lays their symbols out in one row. The index maps
each pair that has a rank to all places where it stands, over all words together. The lowest active
rank is applied at all its places, left to right, and the lists of the pairs that this makes are
added to; so every rank is gone through once, in ascending order, however many words have the pair.
That is what merging word by word gives, provided no merge makes a pair of lower rank; a vocabulary's
merges have that property if each symbol comes of one merge that stands before all merges which use
the symbol. It is checked when a vocabulary is loaded; with others, words are indexed one at a time
and one place is merged at a time, which is the general rule.

Texts are normalised as the vocabulary says (NFC, runs of white space as one space, lower case
character by character), special tokens found in the raw text first. Encoding and decoding are one pass
without exchange; words and their ids are remembered up to CACHED words a task. The vocabulary file is
read by the driver and goes to the tasks with the function: its size is that of a tokenizer's file.

Decoding joins symbols by single spaces, as the file names no decoder.

Edge cases: null and empty texts have no tokens; ties of one pair in a word ("aaa") merge from the left;
rows that repeat are encoded alike; very long texts and words are taken whole (a word without end is
one row of symbols, merged by the same index); ids outside the vocabulary are an error in decoding;
empty tables give empty results; columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a task remembers, bytes of new words that are indexed together.
CACHED, TOGETHER = 400_000, 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class Vocabulary:
    """What a tokenizer's file says: symbols, ranks of pairs and special tokens."""

    def __init__(self, file: bytes) -> None:
        said = json.loads(file)
        model = said["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.symbols = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        shown = byte_symbols()
        self.inner = [ids[s] for s in shown]
        self.last = [ids[s + suffix] for s in shown]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        #: The rank of a pair of ids, and by rank the pair and what it becomes.
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.merges = merges
        #: The ranks of pairs by their first symbol and by their second one.
        self.beginning: dict[int, dict[int, int]] = {}
        self.ending: dict[int, dict[int, int]] = {}
        for (a, b), r in self.rank.items():
            self.beginning.setdefault(a, {})[b] = r
            self.ending.setdefault(b, {})[a] = r
        #: The symbols of bytes inside a word, then of last ones, and the ranks of pairs of those (-1: none).
        self.base = np.array([*self.inner, *self.last], np.int64)
        kinds: dict[int, list[int]] = {}
        for kind, s in enumerate(self.base.tolist()):
            kinds.setdefault(s, []).append(kind)
        self.first_ranks = np.full((512, 512), -1, np.int64)
        for (a, b), r in self.rank.items():
            if a in kinds and b in kinds:
                self.first_ranks[np.ix_(kinds[a], kinds[b])] = r
        born = {c: r for r, (_, _, c) in reversed(list(enumerate(merges)))}
        self.ordered = len(born) == len(merges) and all(max(born.get(a, -1), born.get(b, -1)) < r for r, (a, b, _) in enumerate(merges))


class PairIndex:
    """Places of ranked pairs in a row of words, and the merging of them all."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]) -> None:
        self.v = vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        self.starts = [0, *ends.tolist()]
        kinds = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        kinds[ends - 1] += 256
        self.symbol: list[int] = vocabulary.base[kinds].tolist()
        n = len(kinds)
        # Neighbours within the word; -1 at its ends.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends - sizes] = -1
        self.after, self.before = after.tolist(), before.tolist()
        ranks = np.where(after[:-1] >= 0, vocabulary.first_ranks[kinds[:-1], kinds[1:]], -1)
        found = np.flatnonzero(ranks >= 0)
        found = found[np.argsort(ranks[found], kind="stable")]
        ranked, edges = np.unique(ranks[found], return_index=True)
        all_places, edges = found.tolist(), [*edges.tolist(), len(found)]
        self.places: dict[int, list[int]] = {r: all_places[lo:hi] for r, lo, hi in zip(ranked.tolist(), edges, edges[1:])}
        self.active = list(self.places)
        heapify(self.active)

    def merge(self) -> None:
        symbol, after, before, places, active = self.symbol, self.after, self.before, self.places, self.active
        beginning, ending, none = self.v.beginning, self.v.ending, {}
        ordered = self.v.ordered
        while active:
            r = heappop(active)
            a, b, made = self.v.merges[r]
            first, second = beginning.get(made, none), ending.get(made, none)
            todo = sorted(places.pop(r))
            for k, i in enumerate(todo):
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = made, -1
                after[i] = n = after[j]
                if n >= 0:
                    before[n] = i
                    if (q := first.get(symbol[n])) is not None:
                        if (held := places.get(q)) is None:
                            places[q] = [i]
                            heappush(active, q)
                        else:
                            held.append(i)
                if (p := before[i]) >= 0 and (q := second.get(symbol[p])) is not None:
                    if (held := places.get(q)) is None:
                        places[q] = [p]
                        heappush(active, q)
                    else:
                        held.append(p)
                if not ordered:
                    # A lower rank may have come up: the rest of these places waits for its turn.
                    if rest := todo[k + 1 :]:
                        if r not in places:
                            heappush(active, r)
                        places[r] = rest + places.get(r, [])
                    break

    def ids(self) -> Iterator[bytes]:
        """Each word's ids as unsigned 32-bit integers, lowest byte first."""
        self.merge()
        symbols = np.array(self.symbol, np.int64)
        whole = symbols[symbols >= 0].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(symbols >= 0)])[self.starts] * 4
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            yield whole[a:b]


_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same for ASCII, the commonest kind first.
_PLAIN = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r 0-9a-z]+")


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # Character by character: the final sigma of a word has no lower case of its own.
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def pieces(text: str) -> list[str]:
    """The words of a normalised text; white space parts them and is dropped."""
    return (_PLAIN if text.isascii() else _PIECE).findall(text)


class Codec:
    """Encodes and decodes, and remembers words."""

    def __init__(self, file: bytes) -> None:
        self.file, self.v = file, Vocabulary(file)
        self.library = None
        self.characters: set[str] = set()
        self.known: dict[str, bytes] = {}
        names = sorted(self.v.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.mark = {s: i.to_bytes(4, "little") for s, i in self.v.special.items()}

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        Libraries differ on characters that their Unicode tables lack; a text with one is split by the tokenizers library's tables.
        """
        if text.isascii() or self.characters.issuperset(text):
            return pieces(normal(text))
        new = set(text) - self.characters
        unsure = {c for c in new if unicodedata.category(c) == "Cn"}
        self.characters |= new - unsure
        if not unsure:
            return pieces(normal(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file.decode())
        byte = {c: b for b, c in enumerate(byte_symbols())}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(byte.__getitem__, w)).decode() for w, _ in split]

    def _learn(self, words: set[str]) -> None:
        new, size = [], 0
        for w in words:
            new.append(w)
            size += len(w)
            if size > TOGETHER or not self.v.ordered:
                self._index(new)
                new, size = [], 0
        self._index(new)

    def _index(self, words: list[str]) -> None:
        if words:
            self.known.update(zip(words, PairIndex(self.v, [w.encode() for w in words]).ids(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers, lowest byte first."""
        split = []
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            # Odd places hold special tokens, which are no words.
            split.append([(i % 2, part if i % 2 else self._words(part)) for i, part in enumerate(parts) if part])
        if len(self.known) > CACHED:
            self.known.clear()
        self._learn({w for parts in split for special, ws in parts if not special for w in ws}.difference(self.known))
        known = self.known.__getitem__
        return [b"".join(self.mark[ws] if special else b"".join(map(known, ws)) for special, ws in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.v.symbols.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _in_groups(texts: pa.Array, characters: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Texts in runs of bounded length (or of one text), nulls as empty texts, with the rows they stand in."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > characters:
            yield first, i + 1, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, len(texts), held


def _file(path: str | None) -> bytes:
    with open(path or vocabulary_path(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, an array of token ids, for each row."""
    file = _file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file)
        for b in batches:
            for first, end, texts in _in_groups(b.column("text")):
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for each row of doc_id and ids; null ids give an empty text."""
    file = _file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file)
        for b in batches:
            texts = [codec.decode(np.asarray(ids.values if ids.is_valid else [], "<u4").tobytes()) for ids in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of the text decoded from them."""
    file = _file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file)
        for b in batches:
            for first, end, texts in _in_groups(b.column("text")):
                coded = codec.encode(texts)
                made = [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in coded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
