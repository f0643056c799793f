"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is the pair of its polynomial hashes modulo two primes of
31 bits. The hash of a concatenation follows from the hashes of its parts:
H(ab) = H(a) * BASE^len(b) + H(b). So chunks of a huge text are hashed apart,
on several machines where that pays, and their hashes are shifted by the bytes
that follow and summed. Rows with equal fingerprint and length are candidates,
and their texts are compared chunk by chunk in streams before they count as
equal; a collision is told apart by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import few, staged

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 747_796_405)
#: Bytes hashed at once; sums of 2^16 products below 2^40 stay within 64 bits.
CHUNK = 1 << 16


def _powers(n: int) -> list[np.ndarray]:
    """BASE^(n-1) .. BASE^0 modulo each prime."""
    out = []
    for base, prime in zip(BASES, PRIMES, strict=True):
        x, row = 1, []
        for _ in range(n):
            row.append(x)
            x = x * base % prime
        out.append(np.array(row[::-1], dtype=np.int64))
    return out


_CACHE: dict[str, list[np.ndarray]] = {}


def chunk_hash(part: bytes) -> tuple[int, int]:
    """The two hashes of at most CHUNK bytes."""
    if "p" not in _CACHE:
        _CACHE["p"] = _powers(CHUNK)
    x = np.frombuffer(part, dtype=np.uint8).astype(np.int64) + 1
    return tuple(int(x @ w[CHUNK - len(x) :]) % p for w, p in zip(_CACHE["p"], PRIMES, strict=True))


def combine(a: tuple[int, int], b: tuple[int, int], b_len: int) -> tuple[int, int]:
    """The hashes of a text from those of its two parts; b_len is the second part's length."""
    return tuple((x * pow(base, b_len, p) + y) % p for x, y, base, p in zip(a, b, BASES, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Of any number of bytes: the chunks' hashes, combined."""
    out = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        out = combine(out, chunk_hash(part), len(part))
    return out


def _pack(h: tuple[int, int]) -> int:
    return h[0] << 31 | h[1]


def _print_batches(huge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (raw.as_py() or b"").lower()
                whole = _pack(fingerprint(data)) if len(data) <= huge else None
                rows.append((doc, len(data), whole, hashlib.sha256(data).hexdigest(), h))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "fp", "text_sha256", "h"])

    return run


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of huge texts: a row for each chunk, with the bytes that follow it."""
    for batch in batches:
        for sha, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (raw.as_py() or b"").lower()
            for at in range(0, len(data), CHUNK):
                part = data[at : at + CHUNK]
                yield pa.record_batch([pa.array([sha]), pa.array([len(data) - at - len(part)], pa.int64()), pa.array([part], pa.binary())], names=["text_sha256", "after", "part"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sha, after, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((sha, *combine(chunk_hash(part), (0, 0), after)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["text_sha256", "h0", "h1"])


def _raw(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes and their hash, which tells rows of one doc_id apart."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw"), F.xxhash64(F.col("text")).alias("h"))


def fingerprints(docs: DataFrame, huge: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, fp and text_sha256 of each row's text, lower-cased A-Z only, and a hash ``h`` of it as it is.

    A null text counts as empty. Texts of over ``huge`` bytes are cut into chunks
    that are hashed by as many tasks as Spark deals them to.
    """
    raw = _raw(docs)
    out = raw.mapInArrow(_print_batches(huge), "doc_id long, n_bytes long, fp long, text_sha256 string, h long")
    large = raw.filter(F.octet_length("raw") > huge)
    out = staged(out, "fingerprints")
    if large.isEmpty():
        return out
    named = large.select(F.sha2(F.expr("raw"), 256).alias("name"), "raw").dropDuplicates(["name"]).drop("name")
    keyed = named.mapInArrow(_keyed, "text_sha256 string, raw binary")
    parts = keyed.mapInArrow(_chunk_batches, "text_sha256 string, after long, part binary")
    sums = (
        parts.repartition("text_sha256", "after")
        .mapInArrow(_shifted, "text_sha256 string, h0 long, h1 long")
        .groupBy("text_sha256")
        .agg(*[(F.sum(f"h{i}") % F.lit(p)).alias(f"h{i}") for i, p in enumerate(PRIMES)])
        .dropDuplicates(["text_sha256"])
        .select("text_sha256", F.shiftleft("h0", 31).bitwiseOR(F.col("h1")).alias("fp_large"))
    )
    return staged(out.join(sums, "text_sha256", "left").select("doc_id", "n_bytes", F.coalesce("fp", "fp_large").alias("fp"), "text_sha256", "h"), "fingerprints")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            data = raw.as_py().lower()
            yield pa.record_batch([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], names=["text_sha256", "raw"])


#: Narrow rows (of up to four numbers) are broadcast up to so many.
NARROW = 200_000
#: Members of a group that are compared with one copy of the kept text.
SHARE = 256


#: Columns of a chunk of a member of the group (fp, n_bytes); is_kept marks texts of the kept doc_id, once for each share.
CHUNKED = "fp long, n_bytes long, share int, idx int, is_kept boolean, text_sha256 string, part binary"


def _member_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc_id, raw, text_sha256, fp, n_bytes, keep, size): their texts in chunks, as CHUNKED."""
    names = ["fp", "n_bytes", "share", "idx", "is_kept", "text_sha256", "part"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary())
    for batch in batches:
        rows, held = [], 0
        for doc, raw, sha, fp, n, keep, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, shares = (raw or b"").lower(), -(-size // SHARE)
            if hashlib.sha256(data).hexdigest() != sha:  # another row of this doc_id with an equal hash
                continue
            to = range(shares) if doc == keep else [doc // 7 % shares]
            for at in range(0, max(1, len(data)), CHUNK):
                part = data[at : at + CHUNK]
                rows += [(fp, n, s, at // CHUNK, doc == keep, sha, part) for s in to]
                held += len(part) * len(to)
                if held > 16 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks sorted with the kept doc_id's texts first, by digest: the digests of texts that differ from the first. One chunk is held."""
    at, kept = None, None
    for batch in batches:
        odd = []
        for i, (*key, is_kept, sha) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
            part = batch.column(6)[i].as_py()
            if is_kept and at != key:
                at, kept = key, part
            elif at != key or part != kept:
                odd.append(sha)
        yield pa.record_batch([pa.array(odd, pa.string())], names=["text_sha256"])


def _groups(docs: DataFrame, huge: int) -> DataFrame:
    """What exact_groups returns, and ``h``."""
    prints = fingerprints(docs, huge)
    key = ["fp", "n_bytes"]
    groups = staged(prints.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep")).filter("size > 1"), "groups")
    members = prints.join(few(groups, NARROW), key).filter("doc_id is not null").select("doc_id", "h", "text_sha256", *key, "keep", "size").dropDuplicates(["doc_id", "h", "text_sha256"])
    members = staged(members, "members")
    # Where the members' ids can be broadcast, only their texts are shuffled.
    texts = _raw(docs).join(few(members.select("doc_id", "h"), NARROW), ["doc_id", "h"], "left_semi").join(members, ["doc_id", "h"])
    odd = staged(
        texts.select("doc_id", "raw", "text_sha256", *key, "keep", "size")
        .mapInArrow(_member_chunks, CHUNKED)
        .repartition(*key, "share", "idx")
        .sortWithinPartitions(*key, "share", "idx", F.col("is_kept").desc(), "text_sha256")
        .mapInArrow(_differing, "text_sha256 string")
        .distinct(),
        "collisions",
    )
    if not odd.isEmpty():  # equal fingerprints of different texts: the digest parts them
        prints = prints.join(few(odd.withColumn("odd", F.lit(True))), "text_sha256", "left").withColumn("other", F.when(F.col("odd"), F.col("text_sha256")).otherwise("")).drop("odd")
        key = [*key, "other"]
        groups = staged(prints.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep")).filter("size > 1"), "groups")
    keep = F.coalesce("keep", "doc_id")
    return prints.join(few(groups, NARROW), key, "left").select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "h")


def exact_groups(docs: DataFrame, huge: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest doc_id stays; repeated rows of that
    doc_id all stay, as they can't be told apart. A null doc_id stays only in a
    group of nulls. An empty table gives no rows. Columns other than doc_id and
    text are not read.

    Only rows of groups of two or more carry their text into a shuffle. A group
    of any size is dealt over shares of SHARE members, each with its own copy of
    the kept text, so no task sees a whole large group.
    """
    return _groups(docs, huge).drop("h")


def exact_dedup(docs: DataFrame, huge: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows of one doc_id stay or go by their own text."""
    gone = _groups(docs, huge).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    gone = few(staged(gone, "gone"), NARROW)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left_anti")
