"""BPE encoding through a table of distinct words, decoding through the table of pieces.

A byte-level BPE never merges across the words that its split pattern finds, so a
text's ids are its words' ids in a row. All texts are split once, in Spark tasks,
into blocks: the block's distinct words, and for each position the word's rank
among them. The distinct words go, packed by hash bucket, to the task that has
their bucket; there each word is encoded once for all blocks that sent it, and its
ids come back to them, where they are joined to the positions. Texts themselves
are not shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.blocks import bucket_ends, narrow, pack, partition, record_batch, runs, unpack
from tallyforge.llm.common import bucketed, staged

#: Characters of a block of documents.
BLOCK = 4 << 20
#: Buckets that words are dealt to, at least, and words that blocks send to each.
BUCKETS, PER_BUCKET = 32, 1 << 17
#: Ids that are handed on at once.
HANDED = 1 << 20
#: Characters for which the regex module and the tokenizer agree on letters, digits and space, whatever their Unicode versions.
PLAIN = "[^\x00-ԯ -⁯₠-₿　-ヿ一-龥가-힣]"
#: Characters that texts in Latin letters are made of, and their letters, digits and space; the plain re module is quicker on these.
LATIN = "[^\x00-\u024f]"
LETTER, NUMBER, BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: The public split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Splitter:
    """Splits a text into the words that are encoded apart. Travels as the tokenizer's JSON."""

    def __init__(self, spec: str) -> None:
        self.spec, self.ready = spec, None

    def __getstate__(self):
        return self.spec

    def __setstate__(self, spec):
        self.__init__(spec)

    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.spec)
        t.no_truncation()
        t.no_padding()
        return t

    def _start(self):
        import regex

        added = [x["content"] for x in json.loads(self.spec)["added_tokens"]]
        self.ready = (
            re.compile(LATIN).search,
            re.compile(LATIN_PATTERN).findall,
            regex.compile(PATTERN).findall,
            regex.compile(PLAIN).search,
            regex.compile(f"({'|'.join(map(regex.escape, sorted(added, key=len, reverse=True)))})").split if added else None,
            self.tokenizer().pre_tokenizer.pre_tokenize_str,
        )

    def __call__(self, text: str) -> list[str]:
        if self.ready is None:
            self._start()
        wide, latin, findall, odd, on_added, own = self.ready
        parts = on_added(text) if on_added else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part.isascii() or not wide(part):
                out += latin(part)
            elif odd(part):
                out += [part[a:b] for _, (a, b) in own(part)]
            else:
                out += findall(part)
        return out


def read_spec(path: str) -> str:
    """The tokenizer's JSON, read once on the driver; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_STATE = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("places", pa.binary()), ("n_words", pa.int64())])
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("what", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("what", pa.binary())])
#: Words that the tokenizer gets at once; what it returns for each takes a kilobyte or two.
AT_ONCE = 4096


def _cut(split: Splitter, size: int):
    """Rows (doc_id, text) to blocks: the distinct words in the order in which they first occur, and the documents' words as numbers in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held = partition(), 0, 0
        docs, lens, places, known = [], [], [], {}

        def out():
            words = pack(*_text_arrays([w.encode() for w in known]), level=3)
            own = pack(np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "|u1"), np.array(lens, "<i8"), narrow(np.concatenate(places)), level=3)
            return record_batch([(at << 32 | n, words, own, len(known))], _STATE)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ws = split(text)
                docs.append(doc)
                lens.append(len(ws))
                numbers = np.fromiter([known.setdefault(w, len(known)) for w in ws], np.int64, len(ws))
                places.append(narrow(numbers))
                held += len(text) + 1
                if held >= size:
                    yield out()
                    n, held = n + 1, 0
                    docs, lens, places, known = [], [], [], {}
        if docs:
            yield out()

    return run


def _text_arrays(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(w) for w in ws], "<u4"), np.frombuffer(b"".join(ws), np.uint8)


def _texts(lens: np.ndarray, flat: np.ndarray) -> list[str]:
    data, ends = flat.tobytes(), np.cumsum(lens, dtype=np.int64).tolist()
    return [data[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _by_hash(lens: np.ndarray, flat: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A block's words, the order of their hashes, and the hashes in that order."""
    import xxhash

    data, ends = flat.tobytes(), np.cumsum(lens, dtype=np.int64).tolist()
    ws = [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    order = np.argsort(hashes, kind="stable")
    return ws, order, hashes[order]


def _ask(buckets: int):
    """From blocks' distinct words: the words, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws, order, hashes = _by_hash(*unpack(raw.as_py()))
                ends = bucket_ends(hashes, buckets).tolist()
                out = [(k, block, pack(*_text_arrays([ws[x] for x in order[i:j]]))) for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if j > i]
                if out:
                    yield record_batch(out, _ASKED)

    return run


def _encode_buckets(split: Splitter):
    """From rows sorted by bucket: the words' ids. Each word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = split.tokenizer()
        for rows in runs(batches, 1):
            known: dict[str, np.ndarray] = {}
            out = []
            for bucket, block, raw in rows:
                ws = _texts(*unpack(raw))
                new = [w for w in dict.fromkeys(ws) if w not in known]
                for at in range(0, len(new), AT_ONCE):
                    some = new[at : at + AT_ONCE]
                    known.update(zip(some, (np.array(e.ids, "<u4") for e in t.encode_batch(some, add_special_tokens=False)), strict=True))
                ids = [known[w] for w in ws]
                out.append((block, bucket, pack(narrow(np.array([len(x) for x in ids], "<u4")), narrow(np.concatenate(ids)))))
                if len(out) == 64:
                    yield record_batch(out, _TOLD)
                    out = []
            if out:
                yield record_batch(out, _TOLD)

    return run


def _assembled(batches: Iterator[pa.RecordBatch], handed: int) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """From rows (block, words, places, told), told being the words' ids by bucket: doc_ids and the ids of their texts."""
    for batch in batches:
        for words, own, told in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
            _, order, _ = _by_hash(*unpack(words.as_py()))
            docs, no_id, lens, places = unpack(own.as_py())
            # In the order of the buckets the answers are in the order of the words' hashes.
            got = [unpack(x["what"]) for x in sorted(told.as_py() or [], key=lambda x: x["bucket"])]
            n_ids = np.concatenate([x[0] for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
            flat = np.concatenate([x[1].astype(np.int32) for x in got]) if got else np.zeros(0, np.int32)
            if len(order) != len(n_ids):
                raise RuntimeError("a block's words did not all come back")
            rank = np.argsort(order)
            starts, ends = np.cumsum(n_ids) - n_ids, np.cumsum(lens)
            at = 0
            while at < len(docs):
                # As many documents as have about ``handed`` ids, one at least.
                first = int(ends[at] - lens[at])
                to = max(at + 1, int(np.searchsorted(ends, first + handed, side="right")))
                some = rank[places[first : int(ends[to - 1])]]
                each = n_ids[some]
                stops = np.cumsum(each)
                total = int(stops[-1]) if len(stops) else 0
                ids = flat[np.repeat(starts[some] - (stops - each), each) + np.arange(total)]
                # A text ends where its last word's ids do.
                bounds = np.r_[0, np.r_[0, stops][ends[at:to] - first]]
                yield pa.array(docs[at:to], mask=no_id[at:to].astype(bool)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                at = to


def _assemble(handed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lists in _assembled(batches, handed):
            yield pa.record_batch([docs, lists], names=["doc_id", "ids"])

    return run


def _with_ids(docs: DataFrame, path: str) -> DataFrame:
    """Rows (block, words, places, told): texts in blocks with the ids of their words."""
    spark = docs.sparkSession
    split = Splitter(read_spec(path))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # In buckets by block, so that only the words' ids travel to them.
    blocks = bucketed(docs.select("doc_id", "text").mapInArrow(_cut(split, BLOCK), "block long, words binary, places binary, n_words long"), "bpe-blocks", "block", parts)
    sent = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(BUCKETS, parts, -(-sent // PER_BUCKET))
    asked = blocks.select("block", "words").mapInArrow(_ask(buckets), "bucket int, block long, what binary")
    told = staged(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_buckets(split), "block long, bucket int, what binary"), "bpe-ids")
    answers = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "what")).alias("told"))
    return blocks.select("block", "words", "places").join(answers.hint("merge"), "block", "left")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id and ids, as the tokenizer in the file ``path`` encodes the text.

    Special tokens are not added, but recognised where a text holds their strings.
    A null text is empty and has no ids. Repeated rows each get their row, rows of
    one doc_id with other texts theirs. An empty table gives no rows. Only doc_id
    and text are read, and read once.

    A block holds about BLOCK characters, or one text if that is longer; a bucket
    gets about PER_BUCKET words, for which the number of buckets grows with the
    words that blocks send.
    """
    return _with_ids(docs, path).mapInArrow(_assemble(HANDED), "doc_id long, ids array<int>")


def piece_table(spec: str) -> pa.Array:
    """The bytes of each id, by id; its size is that of the vocabulary."""
    j = json.loads(spec)
    # The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    pieces = {i: bytes(back[c] for c in w) for w, i in j["model"]["vocab"].items()}
    pieces |= {x["id"]: x["content"].encode() for x in j["added_tokens"]}
    return pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.binary())


def _joined(pieces: pa.Array, ids: pa.Array) -> bytes:
    """The pieces of ids, one after the other."""
    if ids is None or not len(ids):
        return b""
    got = pieces.take(ids)
    if got.null_count:
        raise ValueError("an id that the vocabulary doesn't have")
    ends = np.frombuffer(got.buffers()[1], dtype=np.int32)[got.offset : got.offset + len(got) + 1]
    return got.buffers()[2].to_pybytes()[: ends[-1]] if got.buffers()[2] else b""


def _decode(shared, other: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            lists = batch.column(other)
            rest = [c for k, c in enumerate(batch.columns) if k != other]
            names = [n for k, n in enumerate(batch.schema.names) if k != other]
            texts = [_joined(pieces, x.values).decode("utf-8", "replace") for x in lists]
            yield pa.record_batch([*rest, lists, pa.array(texts, pa.string())], names=[*names, "ids", "decoded"])

    return run


def _digest(shared, handed: int):
    """From blocks with their words' ids: digests of each text's ids and of what they decode to, without handing either on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        numbers = pa.array([f"{i}," for i in range(len(pieces))], pa.binary())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for docs, lists in _assembled(batches, handed):
            ids = [x.values for x in lists]
            cols = [[len(x) for x in ids], [sha(_joined(numbers, x)[:-1]) for x in ids], [sha(_joined(pieces, x).decode("utf-8", "replace").encode()) for x in ids]]
            yield pa.record_batch([docs, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the text of the column ``ids``.

    The ids of a row are looked up in the table of pieces, whose size the
    vocabulary bounds, and the pieces' bytes joined. Bytes that are no UTF-8
    become replacement characters. No or null ids give an empty text; an unknown
    id is an error.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(piece_table(read_spec(path)))
    names = [c for c in encoded.columns if c != "ids"]
    encoded = encoded.select(*names, "ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(shared, len(names)), f"{kinds}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(piece_table(read_spec(path)))
    return _with_ids(docs, path).mapInArrow(_digest(shared, HANDED), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path(spark: SparkSession | None = None) -> str:
    """The byte-level vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
