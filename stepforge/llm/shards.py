"""Token ids in binary shards with Elias-Fano coded document boundaries.

A shard file has, in this order: eight bytes of magic; the ids of all its documents one
after another as little-endian integers of 2 or 4 bytes; the Elias-Fano coded document
boundaries (one more than documents); the Elias-Fano coded document ids, less the
smallest; a footer. Documents ascend by id, over all shards as in each.

Words are encoded by the ``tokenizers`` library's model of the vocabulary. As the vocabulary
always separates words where white space or punctuation is, the ids of a word don't depend
on its neighbours: a worker cuts whole texts into words by the vocabulary's rules, gives the
library each word that it has not met before and remembers the answer.

``write_shards`` encodes first, so that packed ids and not texts are dealt out; tasks are
ranges of document ids cut at approximate quantiles, as many as ``docs_per_shard`` asks for,
and a task begins a new file once one has ``ids_per_file`` ids, so neither tasks nor files
grow with the data. An id that by itself has more rows than a shard is dealt out over
several by the hash of its packed ids. Files are written row by row. A retried task writes a
file of another name; only the names in the returned manifest count.

Defined results: null and empty texts have the end id alone; a null document id stands
before all others and is read back as null; rows that repeat a document id stay separate
documents, ordered by the hash of their packed ids, then by these; very long texts are whole;
an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.bpe import MEMORY, REMEMBERED, Vocabulary, byte_characters
from stepforge.llm.common import dropped, mapped, scratch, table, texts, tokenizer_path, written
from stepforge.llm.eliasfano import EliasFano

MAGIC = b"STPFTOK1"
#: Bytes per id, documents with and without id, ids, first id; bytes of the two codes.
FOOTER = struct.Struct("<BQQQqQQ")
DOCS_PER_SHARD, IDS_PER_FILE = 16_384, 1 << 28
END_ID = 2


class Words(dict):
    """Packed ids of words; the library's model encodes those not met before."""

    def __init__(self, path: str, code: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.code = Tokenizer.from_file(path).model, code
        self.letters = dict(enumerate(byte_characters()))

    def __missing__(self, word: str) -> bytes:
        # The model takes a visible character for each byte; those of ASCII stand for themselves.
        seen = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        packed = array.array(self.code, [t.id for t in self.model.tokenize(seen)]).tobytes()
        if len(self) >= MEMORY:
            self.clear()
        if len(word) <= REMEMBERED:
            self[word] = packed
        return packed


class LibraryMemory:
    """Packed ids of texts whose words the library encodes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.code = "H" if vocabulary.width == "<u2" else "I"
        self.words = Words(vocabulary.path, self.code)
        self.special = {t: array.array(self.code, [i]).tobytes() for t, i in vocabulary.special.items()}
        # The same rules with the letters and numbers of Latin-1 written out, for ``re``,
        # which is faster; where they name other properties, they stay as they are.
        rules = vocabulary.words.pattern
        for kind in "LN":
            rules = rules.replace(f"\\p{{{kind}}}", "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind))
        self.latin = vocabulary.words if "\\p" in rules.lower() else re.compile(rules)

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece without special tokens."""
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            v = self.vocabulary
            # Characters younger than Python's tables: the library's own rules, which are
            # slower, cut the chunks that have them.
            if any(unicodedata.category(c) == "Cn" for c in set(piece)):
                return [w.decode() for c in v.chunks(piece) for w in v.words_of(c)]
            return v.words.findall(v.normal(piece))
        # Latin-1 is in normal form C, in lower case too.
        return self.latin.findall(piece.lower())

    def packed(self, rows: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian integers of the vocabulary's width."""
        get, specials, out = self.words.__getitem__, self.vocabulary.specials, []
        for text in rows:
            if "<" in text and specials and len(pieces := specials.split(text)) > 1:
                out.append(b"".join([self.special[p] if p in self.special else b"".join(map(get, self.words_of(p))) for p in pieces]))
            else:
                out.append(b"".join(map(get, self.words_of(text))))
        return out

    def encode(self, text: str) -> list[int]:
        return array.array(self.code, self.packed([text])[0]).tolist()


@functools.lru_cache(maxsize=4)
def memory(path: str) -> LibraryMemory:
    """One for each worker process."""
    return LibraryMemory(Vocabulary(path))


def opened(path: str):
    """File system and path of a name with or without scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Ids go to the file as they come; only boundaries and document ids are held."""

    def __init__(self, path: str, width: str):
        self.fs, self.path = opened(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.width = np.dtype(width).itemsize
        self.bounds, self.docs, self.nameless = array.array("Q", [0]), array.array("q"), 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.out.write(packed)
        self.bounds.append(self.bounds[-1] + len(packed) // self.width)
        if doc_id is None:
            self.nameless += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> tuple[int, int]:
        first = self.docs[0] if self.docs else 0
        codes = [EliasFano.of(np.frombuffer(self.bounds, np.uint64)).to_bytes(), EliasFano.of(np.frombuffer(self.docs, np.int64).astype(np.uint64) - np.uint64(first % (1 << 64))).to_bytes()]
        for c in codes:
            self.out.write(c)
        self.out.write(FOOTER.pack(self.width, len(self.docs), self.nameless, self.bounds[-1], first, *map(len, codes)))
        self.out.close()
        return len(self.bounds) - 1, self.bounds[-1]


class ShardReader:
    """Random access to the documents of a shard, and a pass over all of them."""

    def __init__(self, path: str):
        self.fs, name = opened(path)
        self.file = self.fs.open_input_file(name)
        size = self.file.size()
        self.width, docs, self.nameless, self.n_ids, self.first, a, b = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        codes = self.file.read_at(a + b, size - FOOTER.size - a - b)
        self.bounds, self.names = EliasFano.from_bytes(codes[:a]), EliasFano.from_bytes(codes[a:])
        self.n_docs = docs + self.nameless
        self.type = f"<u{self.width}"

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        null = max(0, min(b, self.nameless) - a)
        found = self.names.slice(max(0, a - self.nameless), max(0, b - self.nameless))
        return [None] * null + (found.astype(np.int64) + self.first).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        start, end = map(int, self.bounds.slice(i, i + 2))
        return np.frombuffer(self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width), self.type)

    def documents(self, rows: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the shard, ids), block by block."""
        for a in range(0, self.n_docs, rows):
            b = min(a + rows, self.n_docs)
            bounds = self.bounds.slice(a, b + 1).astype(np.int64).tolist()
            data = self.file.read_at((bounds[-1] - bounds[0]) * self.width, len(MAGIC) + bounds[0] * self.width)
            ids = np.frombuffer(data, self.type)
            for k, doc in enumerate(self.doc_ids(a, b)):
                yield doc, bounds[k], ids[bounds[k] - bounds[0] : bounds[k + 1] - bounds[0]]


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, path: str | None = None, docs_per_shard: int = DOCS_PER_SHARD, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode, order and write; the manifest (shard, file, path, n_docs, n_ids, base), base
    being the ids in all files before."""
    spark, path = df.sparkSession, path or tokenizer_path()
    keys = df.select(F.col(key).cast("long").alias("k"))
    n = keys.count()
    shards = max(1, -(-n // docs_per_shard))
    cuts = keys.select(F.percentile_approx("k", [i / shards for i in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    # Ids with more rows than two shards: each holds a cut at least, so only cuts are
    # counted; one row for each, n / docs_per_shard at most.
    asked = F.col("k").isin(sorted(set(cuts or []))) | F.col("k").isNull()
    heavy = {r.k: -(-r["count"] // docs_per_shard) for r in keys.where(asked).groupBy("k").count().where(F.col("count") > 2 * docs_per_shard).collect()} if shards > 1 else {}
    cuts = sorted(set(cuts or []) | {c for k in heavy if k is not None for c in (k, k - 1)})
    # Shards of a range of ids; ranges are (previous cut, cut], the last is open.
    ranges = [1] * (len(cuts) + 1)
    for k, parts in heavy.items():
        if k is not None:
            ranges[cuts.index(k)] = parts
    first_of, nameless = np.cumsum([heavy.get(None, 1), *ranges]), heavy.get(None, 1)
    parts_of = np.array(ranges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = memory(path)
        end = np.array([end_id], known.vocabulary.width).tobytes()
        for b in batches:
            packed = [x + end for x in known.packed(texts(b.column(1)))]
            docs = b.column(0)
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in packed], np.uint64)
            null = docs.is_null().to_numpy(zero_copy_only=False)
            at = np.searchsorted(np.array(cuts, np.int64), docs.fill_null(0).to_numpy(), side="left")
            parts = np.where(null, nameless, parts_of[at])
            # The part within a shard's share by the high bits of the hash, so parts ascend.
            part = ((hashes >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)
            shard = np.where(null, 0, first_of[at]) + part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), docs, pa.array((hashes >> np.uint64(1)).astype(np.int64)), pa.array(packed, pa.binary())], names=["shard", "doc", "hash", "packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = memory(path).vocabulary.width
        now, file, writer, out = None, 0, None, []

        def close():
            if writer:
                out.append((now, file, name, *writer.close()))

        for b in batches:
            for shard, doc, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if shard != now or writer.bounds[-1] >= ids_per_file:
                    close()
                    now, file = shard, file + 1 if shard == now else 0
                    name = f"{folder}/shard-{shard:05d}-{file:03d}-{uuid.uuid4().hex}.tok"
                    writer = ShardWriter(name, width)
                writer.add(doc, packed.as_buffer().to_pybytes())
        close()
        columns = list(zip(*out, strict=True)) or [(), (), (), (), ()]
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "file", "path", "n_docs", "n_ids"])

    coded = mapped(df.select(F.col(key).cast("long"), text), encode, "shard int, doc long, hash long, packed binary")
    dealt = coded.repartitionById(int(first_of[-1]), F.col("shard")).sortWithinPartitions("shard", F.col("doc").asc_nulls_first(), "hash", "packed")
    # Written, so that reading the manifest again doesn't write the shards again.
    manifest, _ = written(mapped(dealt, write, "shard int, file int, path string, n_docs long, n_ids long"), "shard-manifest")
    # One row for each file.
    before = Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start over all shards, n_tokens, ids_crc32 and,
    if asked for, token_ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows):
            columns = list(zip(*rows, strict=True))
            types = (*[pa.int64()] * 4, pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc, start, ids in ShardReader(name).documents():
                    row = (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                    if len(rows) == 1024:
                        yield block(rows)
                        rows = []
                if rows:
                    yield block(rows)

    spread = manifest.select("path", "base").repartition(max(1, manifest.count()))
    return mapped(spread, run, schema)


def op5_token_shards(spark, sf_dir: str) -> DataFrame:
    """Write ids of every whole document in shards and read the shards back."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "token-shards")
    rows, _ = written(read_shards(write_shards(docs, folder)), "shard-rows")
    dropped(spark, folder)
    return rows
