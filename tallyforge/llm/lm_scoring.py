"""Language-model scores by Katz backoff over n-grams of words, by default pairs; longer ones are a parameter.

Counts are discounted after Good and Turing up to DISCOUNTED; what the discounts
leave goes to the words that did not follow a history, in proportion to their
probability after the next shorter history, with weights that make each
distribution sum to one:

    P(w | h) = scale(h) * d(c) * c(h w) / c(h)    if the n-gram h w is stored,
               backoff(h) * P(w | shorter h)      if not.

Texts are cut into blocks of about BLOCK tokens, kept as ranks of words. A block
sends the distinct n-grams of one order with their counts in it, packed by hash
bucket, as one row for each. A bucket sums the counts of equal n-grams and answers each block what the
sums are; so one exchange both counts an order and tells all texts the counts that
they need. The sums over a history, for its weight, come from a second exchange of
the same kind, to which each block adds its part. The blocks are a table bucketed by
block and do not travel; what they are told is a table for each step, written to the
shared folder. Every token then is scored by the recursion above where its text is.

An n-gram can only be in one block if the shorter one at its start or end is. So
those are counted where they are, and most long n-grams never travel.

Words and n-grams are known by 64 bits of their hash. Two that agree by chance count
as one, in ``n_known`` and ``base_score`` too: among 10^8 of them there is such a
pair with a chance of 1 in 4000.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.blocks import bucket_ends, mixed, narrow, pack, partition, record_batch, runs, unpack
from tallyforge.llm.common import bucketed, staged

#: Words of the longest n-grams, and how often an n-gram must be seen to be stored. Three words take more disk than
#: the check tool allows (README).
ORDER, LEAST = 2, 1
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a block, and of all blocks for each bucket.
BLOCK, PER_BUCKET = 1 << 19, 1 << 20
BUCKETS = 32
PIECE = 4 << 20
#: Hashes of the end and of the start of a text; no word has them but by chance.
END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def held_out(doc_id: Column) -> Column:
    """Whether a text is kept out of training: crc32 of the id's digits leaves 2 modulo 7. A null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, piece by piece for a long text."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
                end += 1
        yield data[at:end].lower().split()
        at = end


#: What a block asks for: the counts of an order, sums over histories; or what it tells of those that it has alone.
COUNTS, SUMS, TOLD = 0, 1, 2
_BLOCK = pa.schema([("block", pa.int64()), ("what", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64())])
_ASKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("what", pa.binary()), ("stats", pa.list_(pa.int64()))])
_ANSWER = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("what", pa.binary()), ("stats", pa.list_(pa.int64()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _cut(size: int):
    """Rows (doc_id, held, raw) to blocks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        at, n = partition(), 0
        docs, held, lens, places, known = [], [], [], [], {}

        def out():
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            # Words are numbered as they first occur: common ones get small numbers, which pack well.
            numbers = np.concatenate(places) if places else np.zeros(0, np.int64)
            what = pack(np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "|u1"), np.array(held, "|u1"), np.array(lens, "<i8"), hashes, narrow(numbers), level=3)
            return record_batch([(at << 32 | n, what, sum(lens) + len(lens), held.count(False))], _BLOCK)

        total = 0
        for batch in batches:
            for doc, out_of, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = [np.fromiter([known.setdefault(w, len(known)) for w in ws], np.int64, len(ws)) for ws in _words(raw.as_py() or b"")]
                docs.append(doc)
                held.append(out_of)
                lens.append(sum(map(len, got)))
                places += got
                total += lens[-1] + 1
                if total >= size:
                    yield out()
                    n, total = n + 1, 0
                    docs, held, lens, places, known = [], [], [], [], {}
        if docs:
            yield out()

    return run


def discounts(n_of: dict[int, int]) -> list[float]:
    """Good-Turing discounts of the counts 1 to DISCOUNTED, in Katz's form; half a count off where that fails."""
    k = DISCOUNTED
    n1 = n_of.get(1, 0)
    off = (k + 1) * n_of.get(k + 1, 0) / n1 if n1 else 1.0
    out = [0.0]
    for r in range(1, k + 1):
        d = ((r + 1) * n_of.get(r + 1, 0) / (r * n_of[r]) - off) / (1 - off) if n_of.get(r) and off < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Facts:
    """What all tasks know: totals, and the discounts of each order as they become known. A few numbers."""

    def __init__(self, n_docs: int, order: int, least: int, buckets: int) -> None:
        self.n_docs, self.order, self.least, self.buckets = n_docs, order, least, buckets
        self.d: dict[int, list[float]] = {}
        self.total = self.kinds = 0
        self.scale = self.unknown = 0.0

    def learn(self, n: int, stats: list[int]) -> None:
        """From how many n-grams have the counts 1 to DISCOUNTED + 1, how many there are, and how often."""
        n_of = Counter({r: stats[r - 1] for r in range(1, DISCOUNTED + 2)})
        if n == 1:
            if self.n_docs:
                n_of[self.n_docs] += 1  # the end of a text is a word too
            self.kinds, self.total = stats[-2] + (self.n_docs > 0), stats[-1] + self.n_docs
        self.d[n] = discounts(n_of)
        if n == 1:
            left = sum((1 - self.d[1][r]) * r * n_of.get(r, 0) for r in range(1, DISCOUNTED + 1)) / self.total if self.total else 1.0
            # Without rare words nothing is discounted; then an unknown word gets one count.
            self.scale, self.unknown = (1.0, left) if left > 0 else (self.total / (self.total + 1), 1 / (self.total + 1))

    def discounted(self, n: int, count: np.ndarray) -> np.ndarray:
        return np.array([*self.d[n], 1.0])[np.minimum(count, DISCOUNTED + 1)] * count


class _Grams:
    """The distinct n-grams of one order in a block, sorted by key."""

    __slots__ = ("asked", "at", "count", "first", "here", "keys", "sole")


class _Block:
    """A block's tokens, to which the counts of each order and the sums of each history are added as they are told."""

    def __init__(self, raw: bytes, facts: Facts) -> None:
        self.facts = facts
        self.docs, self.no_id, self.held, self.lens, hashes, numbers = unpack(raw)
        self.words, rank = np.unique(hashes, return_inverse=True)
        self.held = self.held.astype(bool)
        ends = np.cumsum(self.lens + 1)
        self.begins = ends - self.lens - 1
        n = int(ends[-1])
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens + 1)
        self.place = np.arange(n) - self.begins[self.doc]  # 0 is the first word, whose history is the start alone
        self.token = np.full(n, len(self.words), np.int64)
        is_word = np.ones(n, bool)
        is_word[ends - 1] = False
        self.token[is_word] = rank[numbers]
        self.train = ~self.held[self.doc]
        self.grams: dict[int, _Grams] = {}
        self.p: np.ndarray | None = None

    def find(self, n: int) -> _Grams:
        """The n-grams of one order and their counts in this block's training texts. Those that other blocks may have are asked."""
        g = self.grams[n] = _Grams()
        if n == 1:
            g.keys, g.at = self.words, self.token  # the end is one past the words
            g.asked = np.ones(len(g.keys), bool)
            g.here = np.bincount(g.at, weights=self.train, minlength=len(g.keys) + 1).astype(np.int64)[:-1]
            return g
        low = self.grams[n - 1]
        hash_of = np.r_[self.words, np.uint64(END)][self.token]
        before = np.r_[np.uint64(0), self._key_by_token(n - 1)[:-1]]
        if n == 2:
            before[self.begins] = START
        has = self.place >= n - 2
        g.keys, g.first, at = np.unique(mixed(before[has] * np.uint64(0x9E3779B97F4A7C15) + mixed(hash_of[has])), return_index=True, return_inverse=True)
        g.at = np.full(len(has), -1, np.int64)
        g.at[has] = at
        g.first = np.flatnonzero(has)[g.first]
        g.here = np.bincount(at, weights=self.train[has], minlength=len(g.keys)).astype(np.int64)
        # Of an n-gram that is here alone the longer ones are, too.
        sole = np.r_[low.sole, False, False]  # the end and the start are everywhere
        g.asked = ~sole[low.at[g.first]] & ~sole[self.history(n)[g.first]]
        return g

    def _key_by_token(self, n: int) -> np.ndarray:
        g = self.grams[n]
        return np.r_[g.keys, np.uint64(END)][g.at]

    def history(self, n: int) -> np.ndarray:
        """Of each token the rank of its history among the (n-1)-grams; the start comes two past the last."""
        low = self.grams[n - 1]
        out = np.r_[0, low.at[:-1]]
        if n == 2:
            out[self.begins] = len(low.keys) + 1
        return out

    def told(self, n: int, answer: np.ndarray) -> None:
        """Adds the counts over all training texts."""
        g = self.grams[n]
        g.count, g.sole = g.here.copy(), np.ones(len(g.keys), bool)
        g.count[g.asked], g.sole[g.asked] = answer >> 1, (answer & 1).astype(bool)
        if n == 1:
            f = self.facts
            c = np.r_[g.count, f.n_docs]
            p = f.discounted(1, c) * f.scale / max(f.total, 1)
            self.p = np.where(c > 0, p, f.unknown)[g.at]

    def stored(self, n: int) -> np.ndarray:
        """The tokens whose n-gram is stored."""
        g = self.grams[n]
        return (g.at >= 0) & (np.r_[g.count, 0][g.at] >= self.facts.least)

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of each history its rank and key, this block's part of sums over what follows it, and whether its sums are needed and asked.

        The sums are of tokens by the count of their n-gram, from which the
        discounted counts follow (0 for those that are not stored, above DISCOUNTED
        none), and of the probabilities after the shorter history of the words that
        are stored. A block's part of a stored n-gram is its share of the count. Only
        a history that an n-gram which is not stored has here needs the latter.
        """
        g, low, f = self.grams[n], self.grams[n - 1], self.facts
        history = self.history(n)
        rank, size = history[g.first], len(low.keys) + 2
        is_stored = g.count >= f.least
        level = np.where(is_stored, np.minimum(g.count, DISCOUNTED + 1), 0)
        many = np.bincount(rank * (DISCOUNTED + 2) + level, weights=g.here, minlength=size * (DISCOUNTED + 2)).reshape(size, -1)
        lower = np.bincount(rank, weights=np.where(is_stored, g.here / np.maximum(g.count, 1), 0.0) * self.p[g.first], minlength=size)
        need = np.zeros(size, np.uint8)
        need[history[(g.at >= 0) & ~self.stored(n)]] = 1
        used = np.flatnonzero(np.bincount(rank, minlength=size))
        keys = np.r_[low.keys, np.uint64(END), np.uint64(START)][used]
        order = np.argsort(keys, kind="stable")
        used, keys = used[order], keys[order]
        return used, keys, [many[used, k].astype(np.int64) for k in range(DISCOUNTED + 1)], lower[used], need[used], ~np.r_[low.sole, False, False][used]

    def weigh(self, n: int, answer: list[np.ndarray] | None) -> None:
        """Goes from the probabilities after n-2 words to those after n-1."""
        g, low, f = self.grams[n], self.grams[n - 1], self.facts
        used, _, many, lower, _, asked = self.sums(n)
        if answer is not None:
            for mine, told in zip([*many, lower], answer, strict=True):
                mine[asked] = told
        c_all = np.r_[low.count, 0, f.n_docs]
        c = c_all[used].astype(float)
        s = (c - many[0] - sum((1 - f.d[n][r]) * many[r] for r in range(1, DISCOUNTED + 1))) / np.maximum(c, 1)
        # A history that was always followed by stored n-grams keeps one count for the rest.
        kept = np.minimum(s, c / (c + 1))
        some = (s > 0) & (c > many[0])
        back, scale = np.ones(len(c_all)), np.ones(len(c_all))
        back[used] = np.where(some, (1 - kept) / np.maximum(1 - lower, 1e-12), 1.0)
        scale[used] = np.where(some, kept / np.where(some, s, 1.0), 1.0)
        h, has, hit = self.history(n), g.at >= 0, self.stored(n)
        p = self.p.copy()
        p[has] *= back[h[has]]
        p[hit] = scale[h[hit]] * f.discounted(n, g.count)[g.at[hit]] / c_all[h[hit]]
        self.p = p


def _join(told: list[dict]) -> dict[tuple[int, int], list[np.ndarray]]:
    """The answers of each step and kind; in the order of the buckets they are in the order of the block's keys."""
    out: dict[tuple[int, int], list] = {}
    for x in sorted(told, key=lambda x: x["bucket"]):
        out.setdefault((x["step"], x["kind"]), []).append(unpack(x["what"]))
    return {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in out.items()}


def _blocks(batches: Iterator[pa.RecordBatch], facts: Facts, step: int) -> Iterator[tuple[int, _Block]]:
    """From rows (block, what, told): each block with all that it was told before ``step``, one at a time."""
    for batch in batches:
        for block, what, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            yield block, _told_block(what.as_py(), told.as_py() or [], facts, step)


def _told_block(what: bytes, told: list[dict], facts: Facts, step: int) -> _Block:
    got = _join(told)
    b = _Block(what, facts)
    for n in range(1, min(step, facts.order + 1)):
        b.find(n)
        b.told(n, *got.get((n, COUNTS), [np.zeros(0, np.uint64)]))
    for n in range(2, step - 1):
        b.weigh(n, got.get((n + 1, SUMS)))
    return b


def _ask(facts: Facts, step: int):
    """From blocks with what they were told: what they ask in this step, counts of one order and sums of the order below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, facts, step):
            out = []

            def deal(kind, keys, *values):
                ends = bucket_ends(keys, facts.buckets)  # noqa: B023
                for k, (i, j) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                    if j > i:
                        # Sorted keys go as their differences, whose upper bytes are alike.
                        out.append((k, kind, block, pack(np.diff(keys[i:j], prepend=np.uint64(0)), *(v[i:j] for v in values)), None))  # noqa: B023

            if step <= facts.order:
                g = b.find(step)
                deal(COUNTS, g.keys[g.asked], g.here[g.asked].astype("<u4" if not len(g.here) or g.here.max() < 1 << 32 else "<u8"))
                alone = g.here[~g.asked]
                out.append((block % facts.buckets, TOLD, block, None, _stats(alone)))
            if step > 2:
                _, keys, many, lower, need, asked = b.sums(step - 1)
                deal(SUMS, keys[asked], *(narrow(x[asked]) for x in many), lower[asked], need[asked])
            if out:
                yield record_batch(out, _ASKED)

    return run


def _stats(count: np.ndarray) -> list[int]:
    low = np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [*low[1 : DISCOUNTED + 2].tolist(), int((count > 0).sum()), int(count.sum())]


def _answer(step: int):
    """From what is asked, sorted by bucket and kind: the answers to each block. One bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 2):
            bucket, kind = rows[0][:2]
            if kind == TOLD:
                yield record_batch([(None, step, kind, bucket, None, [sum(x) for x in zip(*(r[4] for r in rows), strict=True)])], _ANSWER)
                continue
            got = [unpack(r[3]) for r in rows]
            ends = np.cumsum([len(x[0]) for x in got])
            keys, rank, asking = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got]), return_inverse=True, return_counts=True)
            summed = lambda k: np.bincount(rank, weights=np.concatenate([x[k] for x in got]), minlength=len(keys))  # noqa: E731, B023
            stats = None
            if kind == COUNTS:
                total = summed(1).astype(np.int64)
                values, stats = [(total << 1 | (asking == 1)).astype("<u8")], _stats(total)
            else:
                values = [summed(k).astype("<u8") for k in range(1, DISCOUNTED + 2)]
                lower = summed(DISCOUNTED + 2)
            out = []
            for k, (i, j) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                own = [v[rank[i:j]] for v in values]
                if kind == SUMS:
                    own.append(np.where(got[k][-1] > 0, lower[rank[i:j]], 0.0))
                out.append((rows[k][2], step, kind, bucket, pack(*own), stats if k == 0 else None))
                if len(out) == 64:
                    yield record_batch(out, _ANSWER)
                    out = []
            if out:
                yield record_batch(out, _ANSWER)

    return run


def _score(facts: Facts):
    """From blocks with all that they were told: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _blocks(batches, facts, facts.order + 2):
            c = np.r_[b.grams[1].count, facts.n_docs][b.token]
            by_doc = lambda x: np.add.reduceat(x, b.begins)  # noqa: E731, B023
            base = np.log10((c + 1) / (facts.total + facts.kinds + 1))
            cols = [b.docs, b.held, b.lens + 1, by_doc((c > 0).astype(np.int64)), by_doc(base), by_doc(np.log10(b.p))]
            arrays = [pa.array(x, f.type, mask=b.no_id.astype(bool) if f.name == "doc_id" else None) for x, f in zip(cols, _SCORED, strict=True)]
            yield pa.record_batch(arrays, schema=_SCORED)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def score(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, lower-cased in A-Z, and one end. base_score
    is the sum of log10((c + 1) / (N + V + 1)); score the log10 probability of the
    text after a model of n-grams of up to ``order`` words (2 at least), learned
    from the rows that are not held out, that stores those seen ``least`` times or
    more. Histories begin at the start of a text; a token with fewer words before it
    has a shorter one. A model without any text knows nothing and gives each word
    the whole mass of unknown ones. A null text is empty and has one token. Repeated
    rows each get their row and count each. An empty table gives no rows. Only doc_id
    and text are read.

    A block holds about BLOCK tokens, or one text if that is longer; a bucket about
    PER_BUCKET keys, for which the number of buckets grows with the tokens.
    """
    if order < 2:
        raise ValueError("a backoff needs n-grams of two words at least")
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), F.col("text").cast("binary").alias("raw"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # In buckets by block, so that no step shuffles the texts again, only what blocks are told.
    state = bucketed(rows.mapInArrow(_cut(BLOCK), _ddl(_BLOCK)), "lm-blocks", "block", parts)
    sizes = state.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_train").alias("docs")).first()
    facts = Facts(sizes.docs or 0, order, least, max(BUCKETS, parts, -(-(sizes.tokens or 0) // PER_BUCKET)))
    state, told = state.select("block", "what"), None

    def informed() -> DataFrame:
        answer = F.struct("step", "kind", "bucket", "what")
        if told is None:
            return state.withColumn("told", F.lit(None).cast("array<struct<step: int, kind: int, bucket: int, what: binary>>"))
        return state.join(told.groupBy("block").agg(F.collect_list(answer).alias("told")).hint("merge"), "block", "left")

    for step in range(1, order + 2):
        asked = informed().mapInArrow(_ask(facts, step), _ddl(_ASKED)).repartition("bucket").sortWithinPartitions("bucket", "kind")
        answers = staged(asked.mapInArrow(_answer(step), _ddl(_ANSWER)), f"lm-told-{step}")
        if step <= order:
            got = answers.filter("stats is not null").agg(*[F.sum(F.col("stats")[k]) for k in range(DISCOUNTED + 3)]).first()
            facts.learn(step, [x or 0 for x in got])
        answers = answers.filter("block is not null").select("block", "step", "kind", "bucket", "what")
        told = answers if told is None else told.unionByName(answers)
    out = informed().mapInArrow(_score(facts), _ddl(_SCORED))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts.total).cast("long").alias("train_tokens"), "base_score", "score")
