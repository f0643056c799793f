"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, exact_dedup, html_text, licenses, lm_scoring, mixing, near_dedup, pii, quality_rules, secrets
from tallyforge.llm.common import read

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document: the base phrases' places and the method's labels."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the byte-level vocabulary and decoded again, as digests."""
    return bpe.digests(read(spark, sf_dir, "documents"), bpe.default_path())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, against its source's target."""
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base spans and the selected ones of looser kinds."""
    return pii.scan(read(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability after a model learned from those that are not held out."""
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document and whether the rules keep it."""
    return quality_rules.verdicts(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates that every document is in."""
    return near_dedup.near_groups(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts that every document is in, and whether it stays."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the base spans and the live-looking ones of other kinds."""
    return secrets.scan(read(spark, sf_dir, "documents"))


_RULES = quality_rules
_LISTS = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in most)}]" for lang, most in _RULES.COMMON.items())
_CLASS = [r"a-z", r"\x20\x09-\x0D", r"A-Z", r"0-9", r".,;:!?''\"()-", r"#*$%&|<>", r"^\x00-\x7F"]
_COUNT = ", ".join(f"len(regexp_extract_all(t, '[{c}]'))" for c in _CLASS)


def _js(own: str, ref: str, n: int) -> str:
    """The Jensen-Shannon distance of two lists of n shares."""
    side = lambda a, b: " + ".join(f"(CASE WHEN {a}[{i}] > 0 THEN {a}[{i}] * log2({a}[{i}] / (({a}[{i}] + {b}[{i}]) / 2)) ELSE 0 END)" for i in range(1, n + 1))
    return f"sqrt(greatest(0, ({side(own, ref)} + {side(ref, own)}) / 2))"


#: Whether a text is far from its language's histograms of character classes or of common words.
_ODD = f"""(coalesce({_js("chars", "rc", 8)} > {_RULES.CLASS_LIMIT}, false)
    OR coalesce({_js("common", "rm", 11)} > CASE WHEN n_words < {_RULES.GUARD_WORDS_COMMON} THEN {_RULES.SHORT_WORD_LIMIT} ELSE {_RULES.WORD_LIMIT} END, false))"""

_L = licenses
_TEMPLATES = ", ".join(f"({i}, '{label}', {str(i < len(_L.PHRASES)).lower()}, '{text}')" for i, (label, text) in enumerate([*_L.PHRASES, *_L.TEMPLATES]))

SQL = {
    "op1_license_scan": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        g AS (SELECT row, unnest(range(1, len(ws) - {_L.K - 2})) AS pos, unnest([array_to_string(ws[i:i + {_L.K - 1}], ' ') FOR i IN range(1, len(ws) - {_L.K - 2})]) AS gram FROM d WHERE len(ws) >= {_L.K}),
        t AS (SELECT tid, label, exact, string_split(text, ' ') AS tws FROM (VALUES {_TEMPLATES}) AS x(tid, label, exact, text)),
        tg AS (SELECT tid, len(tws) - {_L.K - 1} AS tgrams, unnest(range(1, len(tws) - {_L.K - 2})) AS tpos, unnest([array_to_string(tws[i:i + {_L.K - 1}], ' ') FOR i IN range(1, len(tws) - {_L.K - 2})]) AS gram FROM t),
        v AS (SELECT row, tid, pos - tpos AS diag, tgrams, count(*) AS n_votes, list(DISTINCT tpos) AS held FROM g JOIN tg USING (gram) GROUP BY row, tid, diag, tgrams),
        n AS (SELECT *, coalesce(diag - lag(diag) OVER (PARTITION BY row, tid ORDER BY diag) > {_L.MERGE}, true)::INT AS new FROM v),
        p AS (SELECT *, sum(new) OVER (PARTITION BY row, tid ORDER BY diag) AS part FROM n),
        s AS (SELECT row, tid, part, len(list_distinct(flatten(list(held)))) / max(tgrams) AS cover, count(*) FILTER (n_votes = tgrams) AS whole, min(diag) FILTER (n_votes = tgrams) AS first, max(diag) FILTER (n_votes = tgrams) AS last
              FROM p GROUP BY row, tid, part),
        b AS (SELECT row, sum(whole) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(last) FILTER (exact) AS last_word, max(cover) AS score,
                array_to_string(list_sort(list(DISTINCT label) FILTER (exact AND whole > 0)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (exact AND whole > 0 OR cover >= {_L.COVERAGE})), ',') AS labels
              FROM s JOIN t USING (tid) GROUP BY row)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, least(coalesce(score, 0.0), 1.0)::DOUBLE AS score
        FROM d LEFT JOIN b USING (row)""",
    "op7_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, CASE lang {_LISTS} END AS most FROM d),
        grams AS (SELECT row, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[i:i + 2] FOR i IN range(1, len(ws) - 1)]) AS g FROM w WHERE len(ws) >= 3),
        twice AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
        again AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row),
        b AS (SELECT row, doc_id, lang, len(ws) AS n_words, len(regexp_extract_all(t, '[^\x20\x09-\x0D]')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')]) - len(list_distinct([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])) AS n_dup_lines,
                coalesce(again.n, 0) AS n_repeat_words, greatest(length(t), 1) AS size, [{_COUNT}] AS cs, length(t) AS total,
                CASE WHEN most IS NOT NULL THEN [len([x FOR x IN ws IF x = m]) FOR m IN most] END AS ms
              FROM w LEFT JOIN again USING (row)),
        f AS (SELECT *, n_words < {_RULES.MIN_WORDS} OR 100 * n_repeat_words > {_RULES.MAX_REPEAT_PERCENT} * n_words AS base_failed,
                [x / size FOR x IN list_append(cs, total - list_sum(cs))] AS chars, [x / greatest(n_words, 1) FOR x IN list_append(ms, n_words - list_sum(ms))] AS common FROM b),
        e AS (SELECT DISTINCT lang, chars, common, n_words, word_chars FROM f WHERE NOT base_failed AND n_words >= {_RULES.GUARD_WORDS} AND lang IS NOT NULL),
        m0 AS (SELECT lang, [{", ".join(f"quantile_cont(round(chars[{i}], 4), 0.5)" for i in range(1, 9))}] AS rc,
                [{", ".join(f"quantile_cont(round(common[{i}], 4), 0.5) FILTER (n_words >= {_RULES.GUARD_WORDS_COMMON})" for i in range(1, 12))}] AS rm FROM e GROUP BY lang HAVING count(*) >= {_RULES.GUARD_DOCS}),
        m AS (SELECT lang, [x / greatest(list_sum(rc), 1e-9) FOR x IN rc] AS rc, [x / greatest(list_sum(rm), 1e-9) FOR x IN rm] AS rm FROM m0),
        a AS (SELECT lang, [{", ".join(f"avg(chars[{i}])" for i in range(1, 9))}] AS rc, [{", ".join(f"avg(common[{i}]) FILTER (n_words >= {_RULES.GUARD_WORDS_COMMON})" for i in range(1, 12))}] AS rm
              FROM e JOIN m USING (lang) WHERE NOT {_ODD} GROUP BY lang),
        r AS (SELECT m.lang, CASE WHEN a.rc[1] IS NOT NULL THEN a.rc ELSE m.rc END AS rc, CASE WHEN a.rm[1] IS NOT NULL THEN a.rm ELSE m.rm END AS rm FROM m LEFT JOIN a USING (lang))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT {_ODD} AS kept
        FROM f LEFT JOIN r USING (lang)""",
    "op8_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
        n AS (SELECT doc_id, len(gs) AS n FROM s),
        g AS (SELECT doc_id, unnest(gs) AS g FROM s),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        way AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, x) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, way.b FROM r JOIN way ON way.a = r.x)
        SELECT n.doc_id, n.n AS n_shingles, min(r.x) AS component_id, n.doc_id = min(r.x) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
}

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_html_text": op2_html_text,
    "op3_bpe": op3_bpe,
    "op4_mix_sources": op4_mix_sources,
    "op5_personal_data": op5_personal_data,
    "op6_lm_score": op6_lm_score,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secret_scan": op10_secret_scan,
}
