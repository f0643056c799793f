"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap. Spans of the base
kinds count once their check holds (digits, checksum). The spans of looser kinds
(spelled mails, local and bare phone numbers, national ids, bank accounts, street
addresses) go through boosted trees on features of their format and context, and
count from a threshold on that is calibrated for their kind.

The trees learn from two labelled samples of bounded size: spans of the corpus whose
check tells the answer, without seeing the check, and examples of the looser kinds,
real-looking and deceptive ones, that are made by rule (``examples``). A part of
these, which the trees don't see, gives the threshold of each kind.

Candidates, features, scores and selection are DataFrame functions that run in
the JVM. The trees are fitted on the driver on at most SAMPLE labelled spans of the
corpus and EXAMPLES of each looser kind.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.boosting import Boosted, threshold
from tallyforge.llm.common import CONTEXT, joined, places, staged, with_parts

#: Base kinds in the order of reports. The lookbehinds and possessive loops keep
#: the leftmost matches as they are and make each run of characters be read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser kinds, without a check of their own.
LOOSE = {
    "mail_spelled": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{2,63}+\x20?(?:[\[(]\x20?dot\x20?[\])]\x20?|\.)[a-z]{2,10}+",
    "phone_local": r"(?<![0-9+])(?<!\+[0-9]{1,3}[\x20.-]{0,2})(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "phone_bare": r"(?<![0-9A-Za-z+.-])[0-9]{10,11}+(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "address": r"(?<![0-9A-Za-z])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Place|Pl)(?![a-z])",
}

#: Labelled spans of the corpus that the trees are fitted on at most, and examples of each looser kind.
SAMPLE, EXAMPLES = 20_000, 600
#: Share of true spans among the selected ones that the thresholds are calibrated to.
PRECISION = 0.9


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a row of at most 19 digits holds."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def checked(kind: Column, body: Column) -> Column:
    """For base kinds whether the check holds; null for the others."""
    digits = _digits(body)
    n = F.length(digits)
    parts = F.split(body, r"\.")
    # Numbers of any length compare by their digits without leading zeros.
    small = F.forall(parts, lambda p: F.length(F.ltrim(F.lit("0"), p)).between(0, 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(F.when(n.between(13, 19), digits).otherwise("0"))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
    )


#: Words that announce personal data, and words that announce other numbers.
CUES = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|contact|ssn|id|iban|account|ip|host|addr|lives|reach|write)[a-z]*[:\x20]*(?:at|is|to|me)?[:\x20]*$"
OTHER = r"(?i)(?:version|release|order|part|page|figure|item|serial|isbn|build|total|index|score|ticket|sum|room|line|array|list|code)[a-z]*[:#.\x20]*$"
#: Endings of mail addresses that are in common use.
ENDINGS = "com org net edu gov io de fr es uk info example".split()


def _iban_left(body: Column) -> Column:
    """What an account number leaves modulo 97 with its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(body, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def features(kind: Column, body: Column, before: Column, after: Column) -> list[Column]:
    """Numbers of format and context; none of them tells the outcome of a base kind's check."""
    n, digits = F.length(body), _digits(body)
    share = F.length(digits) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    groups = F.size(F.split(body, "[^0-9A-Za-z]+"))
    return [x.cast("double") for x in (
        F.least(n, F.lit(64)),
        F.least(F.length(digits), F.lit(64)),
        share,
        F.least(groups, F.lit(16)),
        F.least(F.size(F.array_distinct(F.split(body, ""))), F.lit(32)),
        flag(body.contains("@") | body.rlike(r"(?i)[\[(]\x20?at\x20?[\])]")),
        flag(body.rlike(r"^[+(]")),
        flag(body.rlike(r"^[0-9]+$")),
        flag(body.contains(".")),
        flag(body.contains("-")),
        flag(body.contains(" ")),
        flag(before.rlike(r"[0-9A-Za-z]$")),
        flag(after.rlike(r"^[0-9A-Za-z]")),
        flag(before.rlike(r"[0-9][^0-9A-Za-z]{0,2}$")),
        flag(after.rlike(r"^[^0-9A-Za-z]{0,2}[0-9]")),
        flag(before.rlike(CUES)),
        flag(before.rlike(OTHER)),
        flag(F.left(digits, F.lit(1)).isin("0", "1")),
        flag(F.substr(F.lpad(F.right(digits, F.lit(7)), 7, "9"), F.lit(1), F.lit(1)).isin("0", "1")),
        flag(body.rlike(r"^(?:000|666|9[0-9]{2})-") | body.rlike(r"-00-") | body.rlike(r"-0000$")),
        F.when(kind == "iban", (_iban_left(body) == 1).cast("double")).otherwise(0.0),
        flag(F.lower(F.regexp_extract(body, "([A-Za-z]+)$", 1)).isin(*ENDINGS)),
        F.array_position(F.array(*map(F.lit, LOOSE)), kind),
    )]


def examples(n: int, seed: int = 7) -> list[tuple[str, str, str, str, float]]:
    """``n`` labelled examples of each looser kind, as (kind, body, before, after, label), by rule and always the same.

    Half are as personal data are written, half as the same generator finds them in
    versions, parts, ranges, random codes and code.
    """
    r = random.Random(seed)
    pick, num = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick(("ka", "lo", "mi", "ren", "tos", "vel", "da", "shi")) for _ in range(r.randrange(1, 4)))
    good = lambda: pick(("call me at ", "phone: ", "my contact is ", "mail ", "account ", "ssn ", "reach me: ", "lives at ", f"{word()} ", f"{word()}, ", "", "tel. "))
    other = lambda: pick(("version ", "order #", "part ", "page ", "item ", "serial: ", "build ", f"{word()} ", f"{word()}=", "see ", f"{num(2)} ", "total: ", "index "))

    def iban(true: bool) -> str:
        body = num(18) if r.random() < 0.6 else "".join(pick("ABCDEFGH0123456789") for _ in range(18))
        land, check = pick(("DE", "FR", "ES", "GB", "NL")), num(2)
        if true:
            digits = "".join(str(int(c, 36)) for c in f"{body}{land}00")
            check = f"{98 - int(digits) % 97:02d}"
        whole = f"{land}{check}{body}"
        return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) if r.random() < 0.5 else whole

    area = lambda true: pick("23456789") + num(2) if true else pick("01") + num(2)
    make = {
        "mail_spelled": lambda t: f"{word()}{pick(('', '.'))}{word()} [at] {word()}{word()}{pick((' [dot] ', '.'))}{pick(ENDINGS) if t else pick(('length', 'size', 'value', 'next', 'begin'))}",
        "phone_local": lambda t: pick(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}")).format(area(t), area(t or r.random() < 0.5), num(4)),
        "phone_bare": lambda t: f"{area(t)}{area(t)}{num(4)}" if r.random() < 0.7 else f"{'0' if t else pick('56789')}{num(10)}",
        "national_id": lambda t: f"{r.randrange(1, 650):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}" if t else pick((f"{pick(('000', '666'))}-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"{num(3)}-{num(2)}-0000")),
        "iban": iban,
        "address": lambda t: f"{r.randrange(1, 9999)} {word().title()} {pick(('Street', 'Road', 'Ave', 'Lane', 'Drive', 'Way'))}" if t else f"{r.randrange(1, 99)} {pick(('New', 'Long', 'Other', 'More'))} {pick(('Way', 'Place', 'Court', 'Drive'))}",
    }
    out = []
    for kind in LOOSE:
        for k in range(n):
            true = k % 2 == 0
            before = good() if true else other() if r.random() < 0.8 else good()
            out.append((kind, make[kind](true), before[-CONTEXT:], pick((".", ", " + word(), " " + word(), "", "\n")), float(true)))
    return out


def fit(found: DataFrame, n_features: int, sample: int = SAMPLE, n_examples: int = EXAMPLES, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """Trees, and a threshold for each looser kind.

    Fitted on at most ``sample`` spans whose check is known, drawn by a hash of
    their place, and on two thirds of the examples; the others give the thresholds.
    """
    known = found.filter("ok is not null").select(F.xxhash64("uid", "kind", "start").alias("key"), "f", F.col("ok").cast("double").alias("y"))
    # A share of the hashes that gives a little fewer than the sample, so that no task sends more than its part of it.
    share = min(1.0, 0.95 * sample / max(1, known.count()))
    rows = sorted(known.filter(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30))).collect(), key=lambda r: r.key)[:sample]
    spark = found.sparkSession
    made = spark.createDataFrame([(k, *e) for k, e in enumerate(examples(n_examples))], "nth int, kind string, body string, before string, after string, y double")
    shown = made.select("nth", "kind", "y", F.array(*features(F.col("kind"), F.col("body"), F.col("before"), F.col("after"))).alias("f")).orderBy("nth").collect()
    # Pairs of one true and one false example go together.
    learn, judge = ([r for r in shown if (r.nth // 2 % 3 == 2) == x] for x in (False, True))
    x = np.array([r.f for r in (*rows, *learn)], dtype=float).reshape(-1, n_features)
    y = np.array([r.y for r in (*rows, *learn)], dtype=float)
    model = Boosted.fit(x, y)
    cuts = {}
    for kind in LOOSE:
        own = [r for r in judge if r.kind == kind]
        cuts[kind] = threshold(model.predict(np.array([r.f for r in own], dtype=float).reshape(-1, n_features)), np.array([r.y for r in own], dtype=float), precision)
    return model, cuts


def find(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The rows with a key of their own, and their spans with ``ok``, ``score`` and ``selected``."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    patterns = BASE | LOOSE
    rows = staged(with_parts(texts, "t", patterns).drop("t"), "pii-parts")
    each = places(rows, ["uid"], list(patterns))
    fs = features(F.col("kind"), F.col("body"), F.col("before"), F.col("after"))
    found = staged(each.select("uid", "kind", "start", "end", checked(F.col("kind"), F.col("body")).alias("ok"), F.array(*fs).alias("f")), "pii-candidates")
    model, cuts = fit(found, len(fs), sample)
    found = found.withColumn("score", model.column([F.get("f", F.lit(i)) for i in range(len(fs))]))
    cut = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for k, c in cuts.items()])
    return rows.select("uid", "doc_id"), found.withColumn("selected", F.when(F.col("kind").isin(*BASE), F.col("ok")).otherwise(F.col("score") >= cut))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra.

    base_sha256 is of the base spans as kind:start:end, by kind as listed and then
    start; ``spans`` has these and the selected spans of the looser kinds after
    them. n_extra counts the latter. Offsets are code points, ends exclusive. A
    null text is empty. Repeated rows each get their row. A table without labelled
    spans gets its trees from the examples alone. An empty table gives no rows. Only doc_id and text are read.
    """
    rows, found = find(docs, sample)
    order = F.array_position(F.array(*map(F.lit, [*BASE, *LOOSE])), F.col("kind"))
    span = F.struct(order.alias("order"), "start", "kind", "end")
    is_base = F.col("kind").isin(*BASE)
    chosen = found.filter("selected")
    by_doc = chosen.groupBy("uid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("all"),
        F.count(F.when(~is_base, 1)).alias("n_extra"),
    )
    out = rows.join(by_doc, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id",
        *[zero(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        zero("n_extra"),
    )
