"""Problem 8: encoding a corpus with a public byte-level BPE, each shared chunk once."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table

TOKENIZER = os.environ.get("SKEIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Rolling window, and the least, mean and greatest chunk length aimed at, in UTF-8 bytes.
WINDOW, LEAST, MEAN, MOST = 24, 128, 512, 4096
#: Bytes hashed at a time, so that memory doesn't grow with the texts.
STRIDE = 1 << 20

#: Ranges of characters that are letters in every version of Unicode since 5.0, and characters that never are.
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ώЀ-ҁҊ-ԓぁ-ゖァ-ヺ一-龥가-힣"
OTHERS = r"\x00-@\[-`{-\x7f。、，！？"
#: A pre-token never goes on from a letter to another kind of character, so this is a boundary in any text.
BOUNDARY = re.compile(f"(?<=[{LETTERS}])(?=[{OTHERS}])")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder of a rank file, one per process."""
    import tiktoken

    try:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    except ImportError:  # fixed value: the published byte-level BPE pre-token pattern
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 2**32, 256, np.uint64).astype(np.uint32)


def marks(data: np.ndarray) -> np.ndarray:
    """Ends of all windows of ``data`` whose rolling hash falls under the threshold.

    The hash of 24 bytes is put together from hashes of 1, 2, 4, 8 and 16, so
    it costs five vectorised steps instead of one for each byte of the window.
    """
    found, p = [], 0x9E3779B1
    power = lambda n: np.uint32(pow(p, n, 2**32))
    for at in range(0, max(0, len(data) - WINDOW + 1), STRIDE):
        h = _byte_codes()[data[at : at + STRIDE + WINDOW - 1]]
        for n in (1, 2, 4):
            h = h[:-n] * power(n) + h[n:]
        sixteen = h[:-8] * power(8) + h[8:]
        whole = sixteen[:-8] * power(8) + h[16:]
        whole ^= whole >> np.uint32(15)
        whole *= np.uint32(0x2C1B3C6D)
        found.append(np.flatnonzero((whole >> np.uint32(8)) < np.uint32(2**24 // (MEAN - LEAST))) + at + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, int)


def cuts(data: np.ndarray, ends: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of a text of bytes ``data``, of which ``ends`` are the marks.

    A cut follows each marked window, at least LEAST bytes after the last one
    and never within a character; a stretch without one is cut after MOST
    bytes. Equal passages are thus cut alike wherever they stand.
    """
    n = len(data)
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    out, last = [], 0
    while n - last > LEAST:
        j = int(np.searchsorted(ends, last + LEAST))
        end = min(int(ends[j]) if j < len(ends) else n, last + MOST, n)
        while end < n and (data[end] & 0xC0) == 0x80:
            end -= 1
        out.append(end)
        last = end
    return [*out, n] if last < n else out


def core(chunk: str) -> tuple[int, int]:
    """First and last place of ``chunk`` that is a pre-token boundary whatever surrounds it; (0, 0) without two."""
    at = [m.start() for m in BOUNDARY.finditer(chunk)]
    return (at[0], at[-1]) if len(at) > 1 else (0, 0)


def mended(data: bytes, parts: list[tuple[int, int, object]], encode: Callable[[str], object]) -> list:
    """Pieces of ids, in order, of a text (UTF-8) of which the byte ranges ``parts`` (from, to, ids) are encoded already.

    Both ends of a part are boundaries of the whole text and of its chunk
    alone, the nearest places on which both agree for certain; all between
    two parts, the joins of the chunks, is encoded again from the text. The
    pattern scans from left to right without looking back, and a stretch that
    ends on a boundary is scanned as within the whole, so the ids are those of
    encoding the text at once.
    """
    out, last = [], 0
    for lo, hi, ids in parts:
        if lo < last:  # a repeated row of the document sends its parts again
            continue
        if lo > last:
            out.append(encode(data[last:lo].decode()))
        out.append(ids)
        last = hi
    if last < len(data):
        out.append(encode(data[last:].decode()))
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends) of an Arrow column without nulls."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = _bytes(b.column("text"))
        rows, begins, sizes, hashes = [], [], [], []
        if not len(b):
            continue
        every = marks(data[at[0] : at[-1]]) + at[0]
        for row, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            text = data[lo:hi]
            own = every[np.searchsorted(every, lo + WINDOW) : np.searchsorted(every, hi)] - lo
            last = 0
            for end in cuts(text, own):
                rows.append(row)
                begins.append(last)
                sizes.append(end - last)
                hashes.append(hashlib.sha256(text[last:end]).digest()[:16])
                last = end
        keys = b.select(["r1", "r2"]).take(pa.array(rows, pa.int64()))
        yield pa.record_batch([*keys.columns, pa.array(begins, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())], ["r1", "r2", "at", "size", "h"])


def _encoded(docs: DataFrame, tokenizer: str, lengths: bool) -> DataFrame:
    """``doc_id`` and ``ids``, or with ``lengths`` their number ``n_tokens``, of the rows with a text."""
    out = pa.int64() if lengths else pa.list_(pa.int32())
    kind, name = ("long", "n_tokens") if lengths else ("array<int>", "ids")
    held = "long" if lengths else "array<int>"
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def encode_with(text: str):
        ids = encoder(tokenizer).encode_ordinary(text)
        return len(ids) if lengths else ids

    def encode_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for h, chunk in zip(b.column("h").to_pylist(), b.column("chunk").to_pylist()):
                text = chunk.decode()
                lo, hi = core(text)
                if lo < hi:
                    begin = len(text[:lo].encode())
                    got.append((h, begin, begin + len(text[lo:hi].encode()), encode_with(text[lo:hi])))
            h, lo, hi, ids = zip(*got) if got else ((), (), (), ())
            yield pa.record_batch([pa.array(h, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(ids, out)], ["h", "lo", "hi", "part"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, parts in zip(b.column("text"), b.column("parts")):
                if not parts.is_valid:
                    got.append(encode_with(text.as_py()))
                    continue
                pieces = mended(text.as_py().encode(), [(p["lo"], p["hi"], p["part"]) for p in parts.as_py()], encode_with)
                got.append(sum(pieces) if lengths else [i for ids in pieces for i in ids])
            yield pa.record_batch([b.column("doc_id"), pa.array(got, out)], ["doc_id", name])

    key = ["r1", "r2"]  # 128 bits of the row's content: the same however the rows are partitioned
    full = docs.where("text IS NOT NULL AND text <> ''").select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(8), "doc_id", "text").alias("r2"), "doc_id", "text")
    chunks = checkpointed(full.select(*key, "text").mapInArrow(_cut, "r1 long, r2 long, at int, size int, h binary"))
    first = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (*key, "at", "size")]).where("n > 1")
    # doc_id is read here too so that both joins use one exchange of the texts
    sent = full.hint("merge").join(first.select("h", *key, "at", "size"), key).select("h", "doc_id", F.expr("substring(CAST(text AS BINARY), at + 1, size)").alias("chunk"))
    once = sent.groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("chunk").alias("chunk"))
    known = once.mapInArrow(encode_cores, f"h binary, lo int, hi int, part {held}")
    placed = chunks.hint("merge").join(known, "h").select(*key, F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"), "part").alias("p"))
    parts = placed.groupBy(*key).agg(F.sort_array(F.collect_list("p")).alias("parts"))
    return full.hint("merge").join(parts, key, "left").select("doc_id", "text", "parts").mapInArrow(mend, f"doc_id {doc_kind}, {name} {kind}")


def encode_corpus(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id, text``): exactly the ids of encoding each text whole.

    Texts are cut into content-defined chunks, of which only the SHA-256 (16
    bytes) and the place are exchanged. A chunk that occurs more than once is
    encoded once, between the outermost places of it that are boundaries in
    any text, and its ids are sent to the documents that hold it. There the
    joins, from a chunk's last such place to the next one's first, are encoded
    again; all that occurs once is encoded where it stands. A chunk without two
    such places has no core and counts as text that occurs once.

    Texts cross the network once, to meet the parts found for them. The number
    of occurrences is counted map-side, so a chunk that a third of all
    documents share is a row of each task; the join back is a sort-merge join
    that AQE splits. No task holds more than one Arrow batch at a time.

    Defined cases: null and empty texts give an empty list; special-token marks
    are ordinary text; equal doc_ids stay separate rows; other columns are ignored.
    """
    empty = docs.where("text IS NULL OR text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return _encoded(docs, tokenizer, False).unionByName(empty)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` by the same encoding, of which only lengths are sent on; null and empty texts have 0."""
    empty = docs.where("text IS NULL OR text = ''").select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    return _encoded(docs, tokenizer, True).unionByName(empty)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
