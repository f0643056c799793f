"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates. A candidate's value is hashed, and over the whole
corpus each hash gets the numbers of distinct repositories and owners that hold
it. A value that many owners hold is an example that was copied about; a value
that one owner holds, with the variety of characters that a real credential has,
looks live. The base patterns always count; further patterns count where the
value looks live.

Everything here is DataFrame functions that run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SMALL_ROWS, joined, places, staged, with_parts

#: Base kinds in the order of reports; the least length of the value.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {
    "assign": (ASSIGN, 6),
    "access": ("AKIA[A-Z0-9]+", 20),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}+", 24),
}

#: Further kinds: public formats of tokens, and long runs of mixed characters.
EXTRA = {
    "vendor": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)",
    "key": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "blob": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}",
}

#: A value with more owners than this is a copied example.
MAX_OWNERS = 2
#: Tasks that the rows of one value are dealt to.
SALT = 16
#: Distinct characters that a live-looking value has at least.
MIN_VARIETY = 10
#: Words that mark a placeholder.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|0000|1234567"


def _value(kind: Column, body: Column) -> Column:
    return F.when(kind == "assign", F.regexp_extract(body, ASSIGN, 1)).otherwise(body)


def _mixed(value: Column) -> Column:
    """Whether a run holds lower and upper case letters and digits, as a random one would."""
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def candidates(docs: DataFrame, repo: str, owner: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with a key of their own, and their candidates with ownership counts."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(repo, F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce("text", F.lit("")).alias("t"))
    patterns = {k: p for k, (p, _) in BASE.items()} | EXTRA
    rows = staged(with_parts(texts, "t", patterns).drop("t"), "secret-parts")
    each = places(rows, ["uid", "repo", "owner"], list(patterns))
    value = _value(F.col("kind"), F.col("body"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, (_, n) in BASE.items()], F.lit(1))
    each = each.select("uid", "repo", "owner", "kind", "start", "end", value.alias("value")).filter(F.length("value") >= least)
    each = each.filter((F.col("kind") != "blob") | _mixed(F.col("value")))
    variety = F.size(F.array_distinct(F.split("value", "")))
    real = (F.col("kind") == "key") | (variety >= MIN_VARIETY) & ~F.col("value").rlike(PLACEHOLDER)
    each = staged(each.select("uid", "repo", "owner", "kind", "start", "end", F.sha2("value", 256).alias("hash"), real.alias("real")), "secret-candidates")
    # Distinct pairs first, so that a value held by a third of all rows meets as one row for each owner and task.
    pairs = each.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    held = pairs.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    told = staged(held.filter(F.col("n_repos") > 1), "secret-owners")
    # A value may be on a third of all rows, so its rows are dealt over SALT tasks where the table is not broadcast.
    if told.count() <= SMALL_ROWS:
        out = each.join(F.broadcast(told), "hash", "left")
    else:
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = each.withColumn("salt", F.pmod(F.xxhash64("uid", "start"), F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"], "left").drop("salt")
    owners, repos = F.coalesce("n_owners", F.lit(1)), F.coalesce("n_repos", F.lit(1))
    out = out.withColumn("copied", owners > MAX_OWNERS).withColumn("live", F.col("real") & (owners <= MAX_OWNERS)).withColumn("reused", F.col("live") & (repos > owners))
    return rows.select("uid", "doc_id"), out


def scan(docs: DataFrame, repo: str = "source", owner: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_reused.

    base_sha256 is of the base spans, ``spans`` has these and the live-looking
    spans of other kinds, as kind:start:end by start and then kind. n_live counts
    the candidates that look live, n_copied those whose value more than
    MAX_OWNERS owners hold, n_reused the live-looking ones that stand in more
    repositories than they have owners. ``owner`` is by default what stands before a slash in
    the repository's name; a null repository counts as one of its own. A null
    text is empty and has no spans. Repeated rows each get their row. An empty
    table gives no rows. Only doc_id, text and ``repo`` are read.
    """
    owner = F.split_part(F.col(repo), F.lit("/"), F.lit(1)) if owner is None else owner
    rows, found = candidates(docs, repo, owner)
    names = [*BASE, *EXTRA]
    order = F.array_position(F.array(*map(F.lit, names)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "kind", "end")
    is_base = F.col("kind").isin(*BASE)
    by_doc = found.groupBy("uid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(is_base | F.col("live"), span))).alias("all"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        F.count(F.when(F.col("reused"), 1)).alias("n_reused"),
    )
    out = rows.join(by_doc, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id",
        *[zero(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        zero("n_live"),
        zero("n_copied"),
        zero("n_reused"),
    )
