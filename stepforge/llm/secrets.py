"""Secret scans: fixed base patterns and a token-efficiency test.

The base finds assignments, access keys and hex runs. The method adds spans of kind
``token``: a run of key characters that a public tiktoken vocabulary cuts into very
short tokens (few characters a token) is a random string. Of a run that isn't one as a
whole, the stretches of parts between ``=``, ``/``, ``-`` and ``_`` that are cut shortest
are tested, so that words before a key don't hide it. Excluded are known digests
(hex runs of a digest's length), identifiers (UUIDs, plain numbers, letters that are words
of the vocabulary between separators) and what a base span already covers; what it leaves
of a run is tested.

A batch of texts is scanned as one text whose parts are separated by newlines, which no
pattern can cross; runs come from one vectorised pass over code points.

Defined results: null and empty texts have no spans; very long texts are scanned whole;
ties in start are ordered by kind as listed in ``KINDS``; repeated rows give repeated
results; further columns are ignored by ``op7_secrets`` and kept by ``redacted``.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepforge.llm.common import extended, mapped, table, texts, tokenizer_path

#: Kinds of spans in their order; the last is the method's own.
KINDS = ("assign", "access", "hex", "token")
#: Fixed patterns of the base; keywords in either case.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Candidates of the token-efficiency test: runs of ``MIN_RUN`` key characters or more.
#: Shorter ones have too few tokens for their ratio to tell words from random strings, so
#: the method doesn't look at them; the base has its own least lengths.
KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 20
CHARS_PER_TOKEN = 2.2
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Parts of a run, and the least length of the one that a random stretch must have.
PART = re.compile(r"[^=/_-]+")
MIN_PART = 8
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
HEX = re.compile(r"[0-9A-Fa-f]+")
PLACEHOLDER = "[REDACTED]"


def class_table(characters: str) -> np.ndarray:
    found = np.zeros(129, bool)
    found[[ord(c) for c in characters]] = True
    return found


IS_HEX, IS_KEY = class_table("0123456789abcdef"), class_table(KEY_CHARACTERS)


def runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true values, of ``least`` or more."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken vocabulary, once for each worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(core: str) -> bool:
    """Whether a run is a plain number or punctuation, a UUID or a digest."""
    return not any(c.isalpha() for c in core) or bool(UUID.fullmatch(core)) or bool(HEX.fullmatch(core) and len(core) in DIGEST_LENGTHS)


def random_looking(run: str, path: str, chars_per_token: float = CHARS_PER_TOKEN) -> bool:
    """Whether a run of key characters fails the token-efficiency test as a whole."""
    core = run.strip("=-_/+")
    if len(core) < MIN_RUN or known(core) or not any(c.isdigit() for c in core):
        return False
    return len(core) < chars_per_token * len(encoding(path).encode_ordinary(core))


def random_parts(run: str, path: str, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Bounds of the stretches of a run's parts that fail the test, with or without digits.

    A part weighs what it lacks of ``chars_per_token`` for each of its tokens; separators
    have no weight. Stretches are the disjoint ones of largest weight (Ruzzo and Tompa), so
    each begins and ends with a part of its own weight. Letters that are one token are a
    word. A stretch has a part of ``MIN_PART`` characters that fails for itself: dates,
    versions and chains of short words have none.
    """
    if len(run) < MIN_RUN or known(run.strip("=-_/+")):
        return []
    apart = [m.span() for m in UUID.finditer(run)]
    pieces: list[tuple[float, float, int, int]] = []
    total = 0.0
    for m in PART.finditer(run):
        part, (a, b) = m[0], m.span()
        n = len(encoding(path).encode_ordinary(part))
        weight = chars_per_token * n - len(part)
        if any(x <= a and b <= y for x, y in apart) or (HEX.fullmatch(part) and len(part) in DIGEST_LENGTHS) or (n == 1 and part.isalpha()):
            weight = -float(len(part))
        before, total = total, total + weight
        if weight <= 0:
            continue
        now = (before, total, a, b)
        while True:
            j = next((j for j in range(len(pieces) - 1, -1, -1) if pieces[j][0] < now[0]), -1)
            if j < 0 or pieces[j][1] >= now[1]:
                break
            now = (pieces[j][0], now[1], pieces[j][2], now[3])
            del pieces[j:]
        pieces.append(now)
    out = []
    for _, _, a, b in pieces:
        stretch = run[a:b]
        if len(stretch) < MIN_RUN or known(stretch):
            continue
        if any(len(p) >= MIN_PART and len(p) < chars_per_token * len(encoding(path).encode_ordinary(p)) for p in PART.findall(stretch)):
            out.append((a, b))
    return out


def uncovered(a: int, b: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans, in order of their starts, leave of a run."""
    out = []
    for start, _, end in spans:
        if start > a:
            out.append((a, min(start, b)))
        a = max(a, end)
    return [*out, (a, b)] if a < b else out


def scan(rows: list[str], path: str) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, place of the kind in KINDS, end), in order."""
    joined = "\n".join(rows)
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(joined) if len(m[2]) >= LEAST["assign"]]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(joined) if m.end() - m.start() >= LEAST["access"]]
    spans += [(a, 2, b) for a, b in runs(IS_HEX[points], LEAST["hex"])]
    spans.sort()
    base, furthest = [s[0] for s in spans], []
    for s in spans:
        furthest.append(max(s[2], furthest[-1] if furthest else 0))
    more = []
    for a, b in runs(IS_KEY[points], MIN_RUN):
        k = bisect.bisect_left(base, b)
        free = [(a, b)]
        if k and furthest[k - 1] > a:
            free = [] if known(joined[a:b].strip("=-_/+")) else uncovered(a, b, spans[bisect.bisect_right(furthest, a) : k])
        for a, b in free:
            if random_looking(joined[a:b], path):
                more.append((a, 3, b))
            else:
                more += [(a + x, 3, a + y) for x, y in random_parts(joined[a:b], path)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    for a, kind, b in sorted(spans + more):
        doc = bisect.bisect_right(starts, a) - 1
        out[doc].append((a - starts[doc], kind, b - starts[doc]))
    return out


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a placeholder for what spans cover; an assignment keeps its name."""
    parts, at = [], 0
    for a, kind, b in spans:
        if kind == 0:
            a = ASSIGN.match(text, a).start(2)
        if b > at:
            parts += [text[at : max(a, at)], PLACEHOLDER if a >= at else ""]
            at = b
    return "".join([*parts, text[at:]])


def secret_spans(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``spans array<struct<kind, start, end>>`` of every whole text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    df = df.select(key, text)
    schema = extended(df.select(key), "spans array<struct<kind:string,start:bigint,end:bigint>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in scan(texts(b.column(1)), path)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=schema.names)

    return mapped(df, run, schema)


def redacted(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with placeholders for secrets in column ``text``; nulls stay null."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            rows = texts(b.column(at))
            found = scan(rows, path)
            rows = [without(r, s) if s else r for r, s in zip(rows, found, strict=True)]
            here = pa.array(rows, b.column(at).type, mask=b.column(at).is_null().to_numpy(zero_copy_only=False))
            yield b.set_column(at, b.schema.field(at), here)

    return mapped(df, run, df.schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of all spans of every whole document."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(texts(b.column(1)), path)
            counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(4)]
            base = [hashlib.sha256(written_out([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(map(written_out, found), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mapped(docs, run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")
