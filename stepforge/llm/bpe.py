"""BPE encoding and decoding with a contiguous rank array.

A word is held as an array of its parts, one for each boundary, and in parallel the merge
rank of every pair of neighbouring parts. The least rank is looked for again and again
(leftmost on ties), its inner boundary is deleted and only the two neighbouring ranks are
looked up anew. Words are short, so this beats a heap; all new words of a batch step
together as the rows of a matrix. A word of more than ``LONG`` bytes (a text without white
space or punctuation) would make that quadratic: over the same array of parts a heap then
finds the least rank, and boundaries are deleted by links to the neighbours.

``Vocabulary`` reads a ``tokenizers`` JSON file of the kind "BPE with word ends, lower
case, white space dropped" and gives the same ids as that library. White space always
separates words, so whole texts are split at white space and the result for each chunk
is remembered; a text is then a row of lookups.

Defined results: null and empty texts have no ids and decode to the empty text; very
long texts are encoded whole; repeated rows give repeated results; other columns of the
input, whatever their names, are kept by ``encoded`` only when asked for.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stepforge.llm.common import extended, mapped, texts, tokenizer_path

#: Remembered chunks of a worker process; beyond, it starts anew.
MEMORY = 600_000
#: Elements of a matrix of words that are merged together; bytes of a word beyond which a
#: heap finds its least ranks; characters of a chunk beyond which it isn't remembered.
MATRIX, LONG, REMEMBERED = 1 << 20, 512, 1000
NO_MERGE = (1 << 31) - 1

#: Characters with the Unicode property White_Space, as a regex class.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that str.split() takes for white space though they lack that property.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Ranks:
    """Merge ranks of pairs of ids, looked up for whole arrays of pairs."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array(made, np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (right >= 0), self.ranks[at], NO_MERGE)

    @functools.cache  # noqa: B019 - one for each vocabulary of a worker, made at the first long word
    def pairs(self) -> dict[tuple[int, int], int]:
        return {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)}


def merged(parts: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Merge neighbouring parts of short words until no pair of them has a rank.

    Each row of ``parts`` is a word: the id of the part behind each of its boundaries, -1
    beyond its end. Beside it stands the rank of each part with the next. Rows step
    together: each looks for its least rank (the leftmost), its boundary goes, and only
    the two ranks beside it are looked up anew. Rows without a rank left are set aside.
    """
    parts = parts.copy()
    rank = np.full(parts.shape, NO_MERGE, np.int32)
    rank[:, :-1] = ranks.of(parts[:, :-1], parts[:, 1:])
    rows, places = np.arange(len(parts)), np.arange(parts.shape[1])
    while len(rows):
        now = rank[rows]
        i = now.argmin(1)
        least = now[np.arange(len(rows)), i]
        going = least != NO_MERGE
        rows, i, least, now = rows[going], i[going], least[going], now[going]
        if not len(rows):
            break
        k = np.arange(len(rows))
        # All that is right of the deleted boundary moves one place to the left.
        source = np.minimum(places[None, :] + (places[None, :] > i[:, None]), parts.shape[1] - 1)
        word = np.take_along_axis(parts[rows], source, 1)
        now = np.take_along_axis(now, np.minimum(places[None, :] + (places[None, :] >= i[:, None]), parts.shape[1] - 1), 1)
        word[:, -1], now[:, -1] = -1, NO_MERGE
        here = ranks.made[least]
        word[k, i] = here
        after = word[k, np.minimum(i + 1, parts.shape[1] - 1)]
        now[k, i] = ranks.of(here, after)
        before = np.maximum(i - 1, 0)
        now[k, before] = np.where(i > 0, ranks.of(word[k, before], here), now[k, before])
        parts[rows], rank[rows] = word, now
    return parts


def merged_long(parts: list[int], ranks: Ranks) -> list[int]:
    """The same for one long word: n log n. Equal ranks go from left to right; an entry of
    the heap counts only while its pair still stands as it was."""
    known = ranks.pairs()
    n = len(parts)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := known.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = int(ranks.made[rank]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (new := known.get((parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (new, k, parts[k], parts[after[k]]))
    return [p for p in parts if p >= 0]


class Vocabulary:
    """Ids of texts and texts of ids, as the ``tokenizers`` library has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = Ranks([(self.ids[a], self.ids[b]) for a, b in pairs], [self.ids[a + b] for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        letters = byte_characters()
        self.inner, self.last = (np.array([self.ids[c + end] for c in letters], np.int32) for end in ("", suffix))
        self.width = "<u2" if max(self.names) < 1 << 16 else "<u4"
        self.library = None
        self.path = path
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pieces.replace("\\s", WHITE_SPACE), regex.V0)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.white = regex.compile(f"[{WHITE_SPACE}]+")

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # The library lower-cases each character alone, so no final sigma arises.
        return text.replace("Σ", "σ").lower()

    def words_of(self, piece: str) -> list[bytes]:
        """The words of a piece without special tokens, as bytes."""
        if piece.isascii():
            piece = piece.lower()
            return [piece.encode()] if piece.isalpha() else [w.encode() for w in self.words.findall(piece)]
        if max(piece, default="") >= "\u0250" and any(unicodedata.category(c) == "Cn" for c in piece):
            # Characters younger than Python's tables: the library's own rules cut them.
            if self.library is None:
                from tokenizers import Tokenizer

                self.library, self.byte = Tokenizer.from_file(self.path), {c: b for b, c in enumerate(byte_characters())}
            normal = self.library.normalizer.normalize_str(piece)
            return [bytes(self.byte[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [w.encode() for w in self.words.findall(self.normal(piece))]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words, those of like length together."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], [0, 5, 9, 13, 17, 25, 33, LONG + 1])
        for k in order[bounds[-1] :].tolist():
            parts = self.inner[np.frombuffer(words[k], np.uint8)]
            parts[-1] = self.last[words[k][-1]]
            out[k] = np.array(merged_long(parts.tolist(), self.ranks), np.int32).astype(self.width).tobytes()
        for a, b in zip(bounds, bounds[1:], strict=False):
            step = max(1, MATRIX // max(1, int(lengths[order[b - 1]]))) if b > a else 1
            for c in range(a, b, step):
                at = order[c : min(b, c + step)]
                long = lengths[at]
                parts = np.full((len(at), int(long.max()) + 1), -1, np.int32)
                inside = np.arange(parts.shape[1])[None, :] < long[:, None]
                text = np.frombuffer(b"".join([words[k] for k in at]), np.uint8)
                parts[inside] = self.inner[text]
                ends = np.cumsum(long) - 1
                parts[np.arange(len(at)), long - 1] = self.last[text[ends]]
                done = merged(parts, self.ranks)
                counts = (done >= 0).sum(1)
                packed, width = done[done >= 0].astype(self.width).tobytes(), np.dtype(self.width).itemsize
                stops = (np.cumsum(counts) * width).tolist()
                for k, x, y in zip(at.tolist(), [0, *stops], stops, strict=False):
                    out[k] = packed[x:y]
        return out

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk between white space, and ids of special tokens in it."""
        if "<" not in chunk or not self.specials:
            return self.words_of(chunk)
        out: list[bytes | int] = []
        for piece in self.specials.split(chunk):
            out += [self.special[piece]] if piece in self.special else self.words_of(piece)
        return out

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in SEPARATORS):
            return [x for x in self.white.split(text) if x]
        return text.split()

    def decode(self, ids: list[int]) -> str:
        """The library joins tokens with spaces where a vocabulary has no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


class Memory:
    """Packed ids of chunks and of words, found a batch of texts at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.code = "H" if vocabulary.width == "<u2" else "I"
        self.chunks: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.encode_words = vocabulary.encode_words

    def learn(self, chunks: set[str]) -> None:
        v = self.vocabulary
        if len(self.chunks) > MEMORY:
            self.chunks.clear()
        if len(self.words) > MEMORY:
            self.words.clear()
        pieces = {c: v.pieces(c) for c in chunks - self.chunks.keys()}
        new = list({p for ps in pieces.values() for p in ps if type(p) is bytes} - self.words.keys())
        self.words.update(zip(new, self.encode_words(new), strict=True))
        for c, ps in pieces.items():
            self.chunks[c] = self.words[ps[0]] if len(ps) == 1 and type(ps[0]) is bytes else b"".join([self.words[p] if type(p) is bytes else array.array(self.code, [p]).tobytes() for p in ps])

    def packed(self, rows: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian integers of the vocabulary's width."""
        cut, seen = [self.vocabulary.chunks(t) for t in rows], set()
        for chunks in cut:
            seen.update(chunks)
        if len(self.chunks) > MEMORY or not seen <= self.chunks.keys():
            self.learn(seen)
        get = self.chunks.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        for c in seen:
            if len(c) > REMEMBERED:
                del self.chunks[c]
                self.words.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return array.array(self.code, self.packed([text])[0]).tolist()


@functools.lru_cache(maxsize=4)
def memory(path: str) -> Memory:
    """One for each worker process."""
    return Memory(Vocabulary(path))


@functools.lru_cache(maxsize=4)
def names(path: str) -> tuple[list[str], list[str]]:
    """Token and decimal digits of every id."""
    v = memory(path).vocabulary
    ids = range(max(v.names) + 1)
    return [v.names.get(i, "") for i in ids], [str(i) for i in ids]


def digest_row(path: str, packed: bytes) -> tuple[int, str, str, str]:
    """Number of ids, SHA-256 of the ids in decimal, of the decoded text, that text."""
    known, (tokens, digits) = memory(path), names(path)
    ids = array.array(known.code, packed).tolist()
    decoded = " ".join(map(tokens.__getitem__, ids))
    return len(ids), hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded


def encoded(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``token_ids array<int>`` of the whole column ``text``."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(path)
        width = np.dtype(known.vocabulary.width).itemsize
        for b in batches:
            rows = known.packed(texts(b.column(text)))
            offsets = np.cumsum([0, *(len(r) // width for r in rows)]).astype(np.int32)
            values = np.frombuffer(b"".join(rows), known.vocabulary.width).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "token_ids"])

    return mapped(df, run, extended(df, "token_ids array<int>"))


def decoded(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded string`` of the id arrays in column ``ids``."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = memory(path).vocabulary
        for b in batches:
            out = pa.array([v.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    return mapped(df, run, extended(df, "decoded string"))


def digests(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Encode and decode every whole text; columns ``keep``, n_tokens, ids_sha256,
    decoded_sha256 and, if asked for, decoded."""
    path = path or tokenizer_path()
    df = df.select(*dict.fromkeys((*keep, text)))
    schema = extended(df.select(*keep), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest_row(path, x) for x in memory(path).packed(texts(b.column(text)))]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            out = [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1 : 3 + with_text])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *out], names=schema.names)

    return mapped(df, run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    from stepforge.llm.common import table

    return digests(table(spark, sf_dir, "documents"))
