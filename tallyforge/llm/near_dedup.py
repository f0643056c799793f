"""Near duplicates by HyperMinHash.

A document's set is its distinct shingles of five words. Documents with equal sets
become one class at once. Each class has REGISTERS registers: the smallest hash in
each bucket, kept as a count of leading zeros and a few mantissa bits; an empty
bucket borrows from another by a fixed order. Registers are cut into bands, and
classes that agree in a band are candidates.

Candidates are never written out as pairs. They are dealt to blocks, and a block
is compared twice in its task. First by registers: the Jaccard similarity is
estimated, corrected for registers that agree by chance, and only members with an
estimate near the limit go on. Then by full sets: a union-find over the block's
members takes the pairs that hold, so a block names fewer links than it has
members.

In the first round a class meets only the leader that it shares most bands with,
which settles most of even large groups. In the second the members of groups that
still hold several components are compared: those outside the group's largest
component with all others of the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import few, release, staged, without
from tallyforge.llm.components import components

WORDS = 5
PERCENT = 75
BANDS = 48
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: An estimate is let through from so many standard deviations below the limit on.
DEVIATIONS = 5
#: Members of a group that one side of a block holds, and elements of their sets together.
BLOCK, WEIGHT = 2048, 1 << 20
#: Members compared with one copy of a leader's set.
SHARE = 512
#: Tables of at most so many narrow rows (of under 50 bytes) are broadcast, larger ones joined by a shuffle.
NARROW = 200_000
PIECE = 4 << 20


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(x: np.ndarray) -> np.ndarray:
    """A public 64-bit mixer (splitmix64's), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Shingle sets and registers; tables are made where they are first used."""

    def __init__(self) -> None:
        self.ready = False

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self.__init__()

    def start(self) -> Sketcher:
        if not self.ready:
            import xxhash

            class Hashes(dict):
                def __missing__(self, word):
                    if len(self) > 200_000:
                        self.clear()
                    got = self[word] = xxhash.xxh3_64_intdigest(word)
                    return got

            self.hashes, self.digest = Hashes(), xxhash.xxh3_128_digest
            self.factors = _odd(1, WORDS)
            step = (1 << 64) // REGISTERS
            self.bounds = np.array([j * step for j in range(REGISTERS)], dtype=np.uint64)
            self.low = int(step).bit_length()
            random = np.random.default_rng(2)
            self.order = np.stack([random.permutation(REGISTERS) for _ in range(REGISTERS)])
            self.band = _odd(3, REGISTERS).reshape(BANDS, ROWS)
            self.salt = _odd(4, BANDS)
            self.ready = True
        return self

    def _words(self, data: bytes) -> np.ndarray:
        """Hashes of the words; a long text is split piece by piece, so its words are not all held."""
        out, at = [], 0
        while at < len(data):
            end = at + PIECE
            if end < len(data):
                while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
                    end += 1
            ws = data[at:end].split()
            out.append(np.fromiter(map(self.hashes.__getitem__, ws), np.uint64, len(ws)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def shingles(self, data: bytes) -> np.ndarray:
        """The sorted distinct hashes of a lower-cased text's shingles."""
        w = self._words(data)
        if not len(w):
            return w
        if len(w) < WORDS:  # the whole sequence as one, apart from any shingle by its length
            x = (w * self.factors[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
            return _spread(np.array([x]) ^ np.uint64(0x5851F42D4C957F2D))
        return np.unique(_spread(reduce(np.add, (w[i : len(w) - WORDS + 1 + i] * f for i, f in enumerate(self.factors)))))

    def registers(self, u: np.ndarray) -> np.ndarray:
        """Of sorted hashes that are not none: a register for each bucket, leading zeros above the mantissa."""
        at = np.searchsorted(u, self.bounds)
        full = at < np.r_[at[1:], len(u)]
        least = (u[np.minimum(at, len(u) - 1)] - self.bounds).astype(np.float64) + 1.0
        frac, exp = np.frexp(least)
        reg = ((self.low + 1 - exp) << MANTISSA) | ((frac * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
        empty, k = np.flatnonzero(~full), 0
        while len(empty):
            other = self.order[empty, k]
            hit = full[other]
            reg[empty[hit]] = reg[other[hit]]
            empty, k = empty[~hit], k + 1
        return reg.astype(np.uint16)

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """A key for each band."""
        x = (registers.reshape(BANDS, ROWS).astype(np.uint64) * self.band).sum(axis=1, dtype=np.uint64)
        return _spread(x ^ self.salt).view(np.int64)


def chance(n: int, m: int) -> float:
    """The share of registers that agree by chance between sets of n and m elements without a common one."""
    k = np.arange(0, 60)
    zeros = lambda x: np.exp(-max(1.0, x / REGISTERS) * 2.0 ** -(k + 1)) - np.exp(-max(1.0, x / REGISTERS) * 2.0**-k)
    return float((zeros(n) * zeros(m)).sum()) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from registers, corrected for agreement by chance."""
    c = chance(n, m)
    return max(0.0, (float((a == b).mean()) - c) / (1 - c))


def _sign(sketch: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sketch.start()
        for batch in batches:
            n, digest, regs = [], [], []
            for raw in batch.column(1):
                u = s.shingles((raw.as_py() or b"").lower())
                n.append(len(u))
                digest.append(s.digest(u.tobytes()) if len(u) else None)
                regs.append(s.registers(u).tobytes() if len(u) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "regs"])

    return run


def _bands(sketch: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sketch.start()
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([s.keys(np.frombuffer(x, np.uint16)) for x in batch.column(2).to_pylist()])
                ids, n = (np.repeat(batch.column(k).to_numpy(), BANDS) for k in (0, 1))
                yield pa.record_batch([pa.array(keys), pa.array(ids), pa.array(n)], names=["key", "id", "n"])

    return run


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - DEVIATIONS * (s * (1 - s) / REGISTERS) ** 0.5


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - DEVIATIONS * (s * (1 - s) / REGISTERS) ** 0.5


#: A member's place in a block: on the side that asks, on the side that is asked, or on both.
ASKS, ASKED, BOTH = 0, 1, 2
PLACE = "key long, i int, j int, role int, id long, comp long, outer boolean"
_PLACE = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("comp", pa.int64()), ("outer", pa.bool_())])


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one block at a time, from rows sorted by block."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:3] != at:
                yield rows
                rows = []
            at = row[:3]
            rows.append(row)
    if rows:
        yield rows


class _Sides:
    """The two sides of a block as arrays: who asks, and of all asked ones ids, components, sizes, registers."""

    def __init__(self, ids: list, comps: list, outer: list, roles: list, sizes: list, regs: np.ndarray) -> None:
        self.id, self.comp, self.outer = np.array(ids, np.int64), np.array(comps, np.int64), np.array(outer, bool)
        roles, self.n, self.regs = np.array(roles), np.array(sizes, np.int64), regs
        self.asks, self.asked = np.flatnonzero(roles != ASKED), np.flatnonzero(roles != ASKS)
        self.chances = {k: chance(1 << k, 1 << k) for k in np.unique([int(n).bit_length() for n in self.n]).tolist()}

    def candidates(self, x: int, comp: np.ndarray, percent: int) -> np.ndarray:
        """Of the asked ones those that member x may be linked with, by components and sizes. Two outer members meet once."""
        y = self.asked
        n, m = self.n[x], self.n[y]
        fit = (comp[y] != comp[x]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        return y[fit & (~self.outer[y] | (self.id[y] < self.id[x]))]

    def estimates(self, x: int, y: np.ndarray) -> np.ndarray:
        c = self.chances[int(self.n[x]).bit_length()]  # sizes of candidates differ by a third at most
        return ((self.regs[y] == self.regs[x]).sum(axis=1) / REGISTERS - c) / (1 - c)


def _flag(sketch: Sketcher, percent: int, star: bool):
    """From rows sorted by block: the members with an estimate near the limit to one of another component.

    Two members that meet in several groups, which are those of the bands they
    share, count in the first of them. In a star there is but one group.
    """
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out = sketch.start(), []
        for rows in _each_block(batches):
            key, _, _, roles, ids, comps, outer, sizes, blobs = zip(*rows, strict=True)
            b = _Sides(ids, comps, outer, roles, sizes, np.stack([np.frombuffer(x, np.uint16) for x in blobs]))
            keys = None if star else np.stack([s.keys(r) for r in b.regs])
            hit = np.zeros(len(rows), bool)
            for x in b.asks:
                y = b.candidates(x, b.comp, percent)
                if not star and len(y):
                    same = keys[y] == keys[x]
                    y = y[keys[x][same.argmax(axis=1)] == key[0]]
                if len(y):
                    y = y[b.estimates(x, y) >= least]
                    hit[y] = True
                    hit[x] |= len(y) > 0
            out += [rows[k][:7] for k in np.flatnonzero(hit)]
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PLACE, strict=True)], schema=_PLACE)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PLACE, strict=True)], schema=_PLACE)

    return run


def _sets(sketch: Sketcher):
    """Rows (raw text, place) to rows (place, sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sketch.start()
        schema = pa.schema([*_PLACE, ("hashes", pa.binary())])
        for batch in batches:
            last, blob, blobs, at = None, None, [], 0
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py() or b""
                if last is None or raw != last:
                    last, blob = raw, s.shingles(raw.lower()).tobytes()
                blobs.append(blob)
                if sum(map(len, blobs)) > 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.record_batch([*(c.slice(at, len(blobs)) for c in batch.columns[1:]), pa.array(blobs, pa.binary())], schema=schema)
                    blobs, at = [], i + 1

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum())


class _Postings:
    """Which of a block's sets hold each hash, to count what a set has in common with all of them at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        self.hashes, self.starts = np.unique(every[order], return_index=True)
        self.owner, self.ends, self.n = owner[order], np.r_[self.starts[1:], len(every)], len(sets)

    def common(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        at = at[self.hashes[at] == x]
        out = np.zeros(self.n, np.int64)
        for part in np.array_split(at, max(1, len(at) // 4096)):
            lens = self.ends[part] - self.starts[part]
            src = np.repeat(self.starts[part] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(int(lens.sum()))
            out += np.bincount(self.owner[src], minlength=self.n)
        return out


#: Of a member the pairs that are confirmed first, nearest first.
TRIES = 6


def _confirm(sketch: Sketcher, percent: int):
    """From sets sorted by block: links that hold on full sets, as many as join the block's components."""
    least = least_estimate(percent)

    def links_of(s: Sketcher, rows: list[tuple]) -> list[tuple[int, int]]:
        # An id has a row for each of its rows of the table; equal sets count once.
        rows = list({(r[4], r[3], r[7]): r for r in rows if r[7]}.values())
        if len(rows) < 2:
            return []
        _, _, _, roles, ids, comps, outer, blobs = zip(*rows, strict=True)
        sets = [np.frombuffer(x, np.uint64) for x in blobs]
        b = _Sides(ids, comps, outer, roles, [len(u) for u in sets], np.stack([s.registers(u) for u in sets]))
        comp, found, postings = b.comp.copy(), [], None

        def join(x: int, y: int) -> None:
            found.append((int(b.id[x]), int(b.id[y])))
            comp[comp == comp[y]] = comp[x]

        for x in b.asks:  # the nearest first, which joins most of a large group
            y = b.candidates(x, comp, percent)
            est = b.estimates(x, y)
            for k in y[np.argsort(-est, kind="stable")[: min(TRIES, int((est >= least).sum()))]]:
                both = _common(sets[x], sets[k])
                if comp[k] != comp[x] and 100 * both >= percent * (len(sets[x]) + len(sets[k]) - both):
                    join(x, k)
        for x in b.asks:  # then all that are still in other components
            y = b.candidates(x, comp, percent)
            if len(y):
                y = y[b.estimates(x, y) >= least]
            if len(y):
                postings = postings or _Postings(sets)
                both = postings.common(sets[x])[y]
                for k in y[100 * both >= percent * (b.n[x] + b.n[y] - both)]:
                    if comp[k] != comp[x]:
                        join(x, k)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out = sketch.start(), []
        for rows in _each_block(batches):
            out += links_of(s, rows)
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


class _Search:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, percent: int) -> None:
        self.percent, self.sketch = percent, Sketcher()
        self.raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
        self.signed = staged(self.raw.mapInArrow(_sign(self.sketch), "doc_id long, n long, digest binary, regs binary"), "near-registers")
        self.classes = staged(self.signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "near-classes")
        # Most classes have one row; only the others' rows are looked for by a join.
        again = self.classes.filter("rows > 1").select("digest", "rep")
        marked = self.signed.select("doc_id", "n", "digest", "regs").join(few(again, NARROW), "digest", "left")
        alone = marked.filter("n > 0 and doc_id is not null and rep is null")
        first = marked.filter("rep = doc_id").dropDuplicates(["doc_id", "digest"])
        self.reps = staged(alone.unionByName(first).select(F.col("doc_id").alias("id"), "n", "regs"), "near-reps")

    def same_id(self) -> DataFrame | None:
        """Links between the classes that one doc_id is in; None if each id is in one."""
        of = self.signed.filter("n > 0 and doc_id is not null").select("doc_id", "digest")
        many = staged(of.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high").select("doc_id"), "near-many")
        if many.isEmpty():
            return None
        reps = of.join(few(many, NARROW), "doc_id").distinct().join(self.classes, "digest").select("doc_id", "rep")
        # Each class of an id is linked with the id, and so with the others.
        return staged(reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a != b").distinct(), "near-same")

    def groups(self) -> DataFrame:
        """Rows (key, id, n, leader) of the bands' keys that two classes or more have."""
        rows = self.reps.select("id", "n", "regs").mapInArrow(_bands(self.sketch), "key long, id long, n long")
        sums = staged(rows.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-keys")
        out = staged(rows.join(few(sums.select("key", "leader"), NARROW), "key"), "near-groups")
        release(sums)
        return out

    def compared(self, dealt: DataFrame, star: bool) -> DataFrame:
        """Links (a, b) that join the components of the members dealt to each block (PLACE)."""
        dealt = staged(dealt, "near-dealt")
        place = [c.split()[0] for c in PLACE.split(", ")]
        block, within = ["key", "i", "j"], ["key", "i", "j", "role", "id"]
        regs = self.reps.join(few(dealt, NARROW), "id").select(*place, "n", "regs")
        near = staged(regs.repartition(*block).sortWithinPartitions(*within).mapInArrow(_flag(self.sketch, self.percent, star), PLACE), "near-flagged")
        texts = self.raw.withColumnRenamed("doc_id", "id").join(few(near, NARROW), "id").select("raw", *place)
        sets = texts.mapInArrow(_sets(self.sketch), f"{PLACE}, hashes binary")
        links = staged(sets.repartition(*block).sortWithinPartitions(*within).mapInArrow(_confirm(self.sketch, self.percent), "a long, b long"), "near-links")
        release(dealt, near)
        return links

    def links(self) -> DataFrame:
        """(id, comp) of all classes that are linked with another."""
        found, same = self.groups(), self.same_id()
        links = self.compared(self._star(found), star=True)
        if same is not None:
            links = links.unionByName(same)
        comps = components(links)
        rows = self._open(found, comps)
        if not rows.isEmpty():
            more = self.compared(self._blocks(rows), star=False)
            if not more.isEmpty():
                # A component's members keep it as their link; the new links join components.
                comps = components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))
        release(found, rows, self.reps)
        return comps

    def _star(self, found: DataFrame) -> DataFrame:
        """Each class with the leader that it shares most bands with; a leader's members are dealt to shares."""
        by_leader = found.filter("id != leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
        best = by_leader.groupBy("id").agg((-F.max(F.struct("n", (-F.col("leader")).alias("m")))["m"]).alias("key"))
        best = staged(best.select("key", "id"), "near-best")
        counts = best.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
        row = lambda i, role, id_: (F.col("key"), i.cast("int").alias("i"), F.lit(0).alias("j"), F.lit(role).alias("role"), id_.alias("id"), id_.alias("comp"), F.lit(role == ASKS).alias("outer"))
        counts = staged(counts, "near-shares")
        members = best.join(few(counts, NARROW), "key").select(*row(F.pmod(F.xxhash64("id"), F.col("shares")), ASKS, F.col("id")))
        # A leader is asked; that it has not the role of an outer member lets all others ask it.
        heads = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*row(F.col("i"), ASKED, F.col("key")))
        return members.unionByName(heads)

    def _open(self, found: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows (key, id, n, comp) of groups that hold more than one component."""
        now = staged(found.select("key", "id", "n").join(few(comps, NARROW), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "near-now")
        keys = staged(now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key"), "near-open-keys")
        out = staged(now.join(few(keys, NARROW), "key", "left_semi"), "near-open")
        release(now, keys)
        return out

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Members of open groups in blocks.

        Of two members of different components one is always outside the group's
        largest. These outer members meet all members; a block's two sides are
        bounded in members and in elements of their sets. The rows sent grow with
        the members times the blocks of the outer ones.
        """
        parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"))
        keys = parts.groupBy("key").agg(F.max(F.struct("m", "comp", "weight")).alias("top"), F.sum("m").alias("size"), F.sum("weight").alias("weight"))
        of = lambda size, weight: F.ceil(F.greatest(size / BLOCK, weight / WEIGHT, F.lit(1e-9))).cast("int")
        all_blocks, outer_blocks = of(F.col("size"), F.col("weight")), of(F.col("size") - F.col("top.m"), F.col("weight") - F.col("top.weight"))
        keys = staged(keys.select("key", F.col("top.comp").alias("largest"), all_blocks.alias("blocks"), outer_blocks.alias("outers")), "near-blocks")
        every = rows.join(few(keys, NARROW), "key").withColumn("outer", F.col("comp") != F.col("largest"))
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        row = lambda i, j, role: (F.col("key"), i.alias("i"), j.alias("j"), role.alias("role"), F.col("id"), F.col("comp"), F.col("outer"))
        one = every.filter("blocks = 1").select(*row(F.lit(0), F.lit(0), F.when(F.col("outer"), BOTH).otherwise(ASKED)))
        many = every.filter("blocks > 1")
        asks = many.filter("outer").select(*row(deal("outers"), copies("blocks"), F.lit(ASKS)))
        asked = many.select(*row(copies("outers"), deal("blocks"), F.lit(ASKED)))
        return one.unionByName(asks).unionByName(asked)


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z; words are runs without white space. A set holds
    the distinct shingles of five words, of fewer words the whole sequence, of
    none nothing, and then the row is linked with none. Rows are linked when their
    sets' Jaccard similarity is at least ``percent`` hundredths. component_id is
    the smallest doc_id that links reach; kept says whether it is the row's own.
    A null text is empty. Rows of one doc_id count as one document that has the
    links of all its texts. A row with a null doc_id makes no links and has the
    component of a row with an equal set. An empty table gives no rows. Only
    doc_id and text are read.
    """
    s = _Search(docs, percent)
    comps = s.links()
    named = s.classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component"))
    out = s.signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    return without(docs, near_groups(docs, percent))
