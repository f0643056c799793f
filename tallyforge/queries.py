"""The operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.keys import natural_key, shown, surrogate_key, utc
from tallyforge.operators import checks
from tallyforge.operators.dedup import first_wins, insert_new, not_in
from tallyforge.operators.rules import Rule, error_reason, lenient_amount, valid_stamp, validate, valued
from tallyforge.operators.scd2 import scd2
from tallyforge.plans.warehouse import FORMAT, daily_sums, dim_currency, dim_date
from tallyforge.schemas import BUSINESS, CATEGORIES, CURRENCIES, RATES, STATUSES, TYPES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily accounts' shape: orders as transactions, sums in exact decimals."""
    o = read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    o = o.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = daily_sums(o.withColumn("month", F.trunc("day", "month")), "o_custkey", "month", "o_orderstatus", "amount", "o_orderpriority", "c_name", "o_orderstatus", "F", "O")
    return out.select("o_custkey", "month", *[F.col(c).cast("double") for c in ("total_debit_amount", "total_credit_amount", "net_amount")], "transaction_count", "distinct_merchants", "top_category", F.col("currencies").alias("statuses"))


def top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    w = W.partitionBy("o_custkey").orderBy(F.desc("total"), F.asc("o_orderpriority"))
    return o.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("o_custkey", F.col("o_orderpriority").alias("top_category"), F.col("total").cast("double").alias("total"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", F.md5("event_type").alias("hash"), "event_id")
    return scd2(e, "user_id", "ts", "hash", ties=("event_id",))


def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return h.select("user_id", "event_id", "hash", F.col("version_number").cast("long").alias("version_number"), F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"), "is_current")


def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).filter("is_current").select("user_id", "event_id", F.col("version_number").cast("long").alias("version_number"))


def dim_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dim_date(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), "day")
    return days.select(F.col("date_day").cast("string").alias("date_day"), *[F.col(c).cast("long").alias(c) for c in ("year", "quarter", "month", "day", "day_of_week", "week_of_year")], "day_name", "month_name")


def dim_distinct_sk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct().select(surrogate_key("c_mktsegment", "c_nationkey").alias("sk"), "c_mktsegment", "c_nationkey")


def _dim_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_currency(spark).select("currency_sk", "currency_code", "currency_name", F.col("usd_exchange_rate").cast("double").alias("usd_exchange_rate"))


def fact_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two left joins and the conversion, in exact decimals."""
    codes = [c for c, _, _ in RATES]
    li = read(spark, sf_dir, "lineitem").withColumn("code", F.get(F.array(*map(F.lit, codes)), F.pmod("l_partkey", F.lit(8)).cast("int")))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    fx = dim_currency(spark)
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(F.broadcast(fx), F.col("code") == F.col("currency_code"), "left")
    usd = F.round(F.col("l_extendedprice").cast("decimal(15,2)") * F.col("usd_exchange_rate"), 2)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "currency_sk", F.col("l_extendedprice").alias("amount_original"), usd.cast("double").alias("amount"))


def natural_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    fields = {"o_custkey": F.col("o_custkey").cast("string"), "o_orderstatus": F.col("o_orderstatus"), "o_totalprice": shown(F.col("o_totalprice")), "o_orderpriority": F.col("o_orderpriority")}
    return o.select("o_orderkey", natural_key(fields).alias("natural_key_hash"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under rules that some of them break, of each kind that the transactions' rules have."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    key = F.col("o_orderkey").cast("string")
    rules = [
        valued("invalid_order_id", ~key.rlike(r"^[0-9]{1,4}\z"), key),
        valued("invalid_date", ~F.col("day").rlike("^199[2-6]"), F.col("day")),
        valued("non_positive_amount", F.col("c_acctbal") <= 0, F.col("o_custkey").cast("string")),
        valued("invalid_status", ~F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")),
        valued("invalid_priority", ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("o_orderpriority")),
        valued("invalid_segment", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")),
        Rule(F.col("c_name").rlike(r"^(?U)\s*\z"), F.lit("blank_name")),
        valued("invalid_nation", ~F.col("c_nationkey").isin(*range(0, 20)), F.col("c_nationkey").cast("string")),
    ]
    return o.withColumn("error_reason", error_reason(rules, ("o_orderkey", "o_custkey", "c_name")))


def classify_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).filter("error_reason is null").select("o_orderkey", "o_custkey")


def classify_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).filter("error_reason is not null").select("o_orderkey", "error_reason")


#: Orders as transactions, with what each rule refuses put in by the order's number.
_DIRTY = """
    SELECT o_orderkey,
        CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'TXN-12' WHEN 2 THEN 'TXN-00001' ELSE concat('TXN-', lpad(CAST(o_orderkey % 10000 AS varchar(8)), 4, '0')) END AS transaction_id,
        CASE o_orderkey % 13 WHEN 1 THEN 'ACC-1' WHEN 2 THEN 'acc-0001' ELSE concat('ACC-', lpad(CAST(o_custkey % 10000 AS varchar(8)), 4, '0')) END AS account_id,
        CASE o_orderkey % 17 WHEN 0 THEN '2024-11-31T14:22:00Z' WHEN 1 THEN '2024-04-15 09:30:00' WHEN 2 THEN concat(substr(CAST(o_orderdate AS varchar(32)), 1, 10), 'T23:59:59+00:00') WHEN 3 THEN '2024-2-03T00:00:00Z'
            WHEN 4 THEN '2023-02-29T00:00:00Z' ELSE concat(substr(CAST(o_orderdate AS varchar(32)), 1, 10), 'T10:30:00Z') END AS transaction_date,
        CASE o_orderkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '-12.5' WHEN 2 THEN '0' WHEN 3 THEN '' WHEN 4 THEN ' 12.50 ' WHEN 5 THEN '1e3' WHEN 6 THEN 'NaN' WHEN 7 THEN NULL ELSE '7943.57' END AS amount,
        CASE o_orderkey % 8 WHEN 0 THEN 'XXX' WHEN 1 THEN 'usd' WHEN 2 THEN 'JPY' ELSE 'EUR' END AS currency,
        CASE o_orderkey % 5 WHEN 0 THEN 'Credit' WHEN 1 THEN 'credit' ELSE 'debit' END AS transaction_type,
        CASE WHEN o_orderkey % 23 = 0 THEN '   ' WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'Shop' END AS merchant_name,
        CASE o_orderkey % 7 WHEN 0 THEN 'Finance' WHEN 1 THEN 'fast_food' ELSE 'retail' END AS merchant_category,
        CASE o_orderstatus WHEN 'P' THEN 'Completed' ELSE 'completed' END AS status,
        CASE o_orderkey % 6 WHEN 0 THEN 'UK' WHEN 1 THEN 'EN' WHEN 2 THEN 'NA' ELSE 'NL' END AS country_code
    FROM orders"""


def rules_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions' own rules, normalised times, lenient amounts and typed dates, over rows that break each of them."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("tallyforge_orders")
    rows = validate(spark.sql(_DIRTY.replace("FROM orders", "FROM tallyforge_orders")))
    when = F.when(valid_stamp(F.col("transaction_date")), F.to_timestamp(utc(F.col("transaction_date")), FORMAT))
    return rows.select("o_orderkey", "error_reason", utc(F.col("transaction_date")).alias("stamp"), lenient_amount(F.col("amount")).alias("amount"), F.to_date(when).cast("string").alias("day"), F.hour(when).cast("long").alias("hour"))


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = first_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER, "l_partkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("nth").cast("long").alias("nth"), F.when(F.col("nth") > 1, F.concat(F.lit("duplicate_of:"), F.col("winner").cast("string"))).alias("reason"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cut = F.lit("1995-06-01").cast("timestamp")
    return o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut)


def anti_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _halves(spark, sf_dir)
    return not_in(new.select("o_custkey", "o_orderkey"), stored.select("o_custkey").distinct(), "o_custkey").select("o_orderkey", "o_custkey")


def semi_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _halves(spark, sf_dir)
    return new.join(stored.select("o_custkey"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def insert_new_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after an insert-only merge: stored customers' orders and the first order of each new customer."""
    stored, new = _halves(spark, sf_dir)
    added = insert_new(new, stored.select("o_custkey").distinct(), "o_custkey", ["o_orderdate", "o_orderkey"])
    return stored.unionByName(added).select("o_orderkey", "o_custkey", "o_totalprice")


def hwm_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the high-water mark less seven days on. The mark is one row of state, so the scan gets it as a bound."""
    e = read(spark, sf_dir, "events")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).cast("string").alias("since")).first().since
    return e.filter(F.col("ts") >= F.lit(since).cast(e.schema["ts"].dataType)).select("event_id", "user_id", "event_type")


def monotone_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark never falls: the larger of the old and the batch's, the old for an empty batch."""
    e = read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("user_id").alias("batch"), F.max(F.when(F.col("user_id") < 50, F.col("user_id"))).alias("old"))
    return e.select("event_type", F.coalesce(F.greatest("batch", "old"), F.lit(0)).alias("mark"))


def max_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("m"))
    b = read(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("m"))
    return a.unionByName(b).agg(F.unix_micros(F.max("m").cast("timestamp")).alias("newest"))


def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    good = F.col("value") > 10
    n = e.agg(F.count(F.lit(1)).alias("landed"), F.count(F.when(good, 1)).alias("raw"), F.count(F.when(~good | F.col("value").isNull(), 1)).alias("quarantined"))
    return n.withColumn("difference", F.col("landed") - F.col("raw") - F.col("quarantined"))


def _checked(df: DataFrame, *rows) -> DataFrame:
    return checks.run(df, list(rows))


def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of row checks on orders in one pass."""
    o = read(spark, sf_dir, "orders")
    return _checked(
        o, checks.not_null("o_custkey"), checks.accepted("o_orderstatus", ["F", "O"]), checks.between("o_totalprice", 1000, 300000), checks.between("o_totalprice", 0, strictly=True),
        checks.matches("o_orderpriority", "^[1-3]-[A-Z]+$"), checks.length_is("o_orderpriority", 8),
    )


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(read(spark, sf_dir, "lineitem"), checks.unique("l_orderkey", "l_linenumber"), checks.unique("l_orderkey"))


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return _checked(c, checks.relates("c_custkey", o, "o_custkey"), checks.relates("c_nationkey", read(spark, sf_dir, "nation").filter("n_nationkey < 20"), "n_nationkey"))


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview: the ten newest orders."""
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_totalprice")


QUERIES = {
    "daily_summary": daily_summary,
    "top_category": top_category,
    "scd2_history": scd2_history,
    "scd2_current": scd2_current,
    "dim_date": dim_date_query,
    "dim_distinct_sk": dim_distinct_sk,
    "dim_currency": _dim_currency,
    "fact_fx": fact_fx,
    "natural_key_hash": natural_key_hash,
    "classify_valid": classify_valid,
    "classify_quarantine": classify_quarantine,
    "rules_dirty": rules_dirty,
    "dedup_first_wins": dedup_first_wins,
    "anti_existing": anti_existing,
    "semi_existing": semi_existing,
    "insert_new": insert_new_query,
    "hwm_lookback": hwm_lookback,
    "monotone_mark": monotone_mark,
    "max_union": max_union,
    "reconcile_counts": reconcile_counts,
    "row_checks": row_checks,
    "unique_violations": unique_violations,
    "fk_orphans": fk_orphans,
    "latest_orders": latest_orders,
}

_HISTORY = """
    WITH one AS (SELECT user_id, ts, md5(event_type) AS hash, event_id, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id, md5(event_type)) AS n FROM events),
    lagged AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM one WHERE n = 1),
    changed AS (SELECT * FROM lagged WHERE before IS NULL OR before <> hash),
    history AS (SELECT user_id, event_id, hash, row_number() OVER w AS version_number, ts AS valid_from, lead(ts) OVER w AS next FROM changed WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""
_CODES = ", ".join(f"({i}, '{c}', CAST({r} AS DECIMAL(12,6)))" for i, (c, _, r) in enumerate(RATES))
_CLASSIFIED = r"""
    WITH j AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    r AS (SELECT *, CASE WHEN o_orderkey IS NULL OR o_custkey IS NULL OR c_name IS NULL
        THEN concat_ws('; ', CASE WHEN o_orderkey IS NULL THEN 'missing_field:o_orderkey' END, CASE WHEN o_custkey IS NULL THEN 'missing_field:o_custkey' END, CASE WHEN c_name IS NULL THEN 'missing_field:c_name' END)
        ELSE concat_ws('; ',
            CASE WHEN NOT regexp_full_match(CAST(o_orderkey AS VARCHAR), '[0-9]{1,4}') THEN 'invalid_order_id:' || o_orderkey END,
            CASE WHEN NOT regexp_matches(day, '^199[2-6]') THEN 'invalid_date:' || day END,
            CASE WHEN c_acctbal <= 0 THEN 'non_positive_amount:' || o_custkey END,
            CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'invalid_status:' || o_orderstatus END,
            CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'invalid_priority:' || o_orderpriority END,
            CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'invalid_segment:' || c_mktsegment END,
            CASE WHEN trim(c_name) = '' THEN 'blank_name' END,
            CASE WHEN c_nationkey >= 20 THEN 'invalid_nation:' || c_nationkey END) END AS e FROM j)"""
_LINE = ", ".join(_LINE_ORDER)

#: In SQL: fields that must be there, numbers and times that are well formed.
_MISSING = ", ".join(f"CASE WHEN {c} IS NULL THEN 'missing_field:{c}' END" for c in BUSINESS)
_IS_NUMBER = r"regexp_full_match(amount, '\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"
_IN = lambda values: ", ".join(f"'{v}'" for v in values)

SQL = {
    "rules_dirty": rf"""
        WITH t AS ({_DIRTY}),
        u AS (SELECT *, replace(transaction_date, '+00:00', 'Z') AS stamp, CASE WHEN {_IS_NUMBER} THEN TRY_CAST(trim(amount) AS DOUBLE) END AS a FROM t),
        v AS (SELECT *, CASE WHEN regexp_full_match(stamp, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') THEN try_strptime(stamp, '%Y-%m-%dT%H:%M:%SZ') END AS read_as, concat_ws('; ', {_MISSING}) AS missing FROM u),
        w AS (SELECT *, concat_ws('; ',
            CASE WHEN NOT regexp_full_match(transaction_id, 'TXN-[0-9]{{4}}') THEN concat('invalid_transaction_id:', transaction_id) END,
            CASE WHEN NOT regexp_full_match(account_id, 'ACC-[0-9]{{4}}') THEN concat('invalid_account_id:', account_id) END,
            CASE WHEN read_as IS NULL THEN concat('invalid_transaction_date:', transaction_date) END,
            CASE WHEN a <= 0 THEN concat('non_positive_amount:', CASE a WHEN 0 THEN '0.0' ELSE '-12.5' END) END,
            CASE WHEN a IS NULL THEN concat('invalid_amount:', amount) END,
            CASE WHEN currency NOT IN ({_IN(CURRENCIES)}) THEN concat('invalid_currency:', currency) END,
            CASE WHEN transaction_type NOT IN ({_IN(TYPES)}) THEN concat('invalid_transaction_type:', transaction_type) END,
            CASE WHEN trim(merchant_name) = '' THEN 'blank_merchant_name' END,
            CASE WHEN merchant_category NOT IN ({_IN(CATEGORIES)}) THEN concat('invalid_merchant_category:', merchant_category) END,
            CASE WHEN status NOT IN ({_IN(STATUSES)}) THEN concat('invalid_status:', status) END,
            CASE WHEN country_code IN ('UK', 'EN') THEN concat('invalid_country_code:', country_code) END) AS broken FROM v)
        SELECT o_orderkey, nullif(CASE WHEN missing <> '' THEN missing ELSE broken END, '') AS error_reason, stamp, a AS amount, CAST(CAST(read_as AS DATE) AS VARCHAR) AS day, hour(read_as) AS hour FROM w""",
    "daily_summary": """
        WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
        d AS (SELECT o_custkey, month, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN amount END), 0) AS deb, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN amount END), 0) AS cre, count(*) AS transaction_count,
              count(DISTINCT c_name) AS distinct_merchants, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses FROM o GROUP BY ALL),
        c AS (SELECT o_custkey, month, o_orderpriority, sum(amount) AS t FROM o GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, month ORDER BY t DESC, o_orderpriority) AS rn FROM c)
        SELECT d.o_custkey, d.month, CAST(deb AS DOUBLE) AS total_debit_amount, CAST(cre AS DOUBLE) AS total_credit_amount, CAST(cre - deb AS DOUBLE) AS net_amount, transaction_count, distinct_merchants, r.o_orderpriority AS top_category, statuses
        FROM d LEFT JOIN r ON d.o_custkey = r.o_custkey AND d.month = r.month AND rn = 1""",
    "top_category": """
        SELECT o_custkey, o_orderpriority AS top_category, CAST(t AS DOUBLE) AS total FROM (SELECT o_custkey, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC, o_orderpriority) = 1""",
    "scd2_history": f"{_HISTORY} SELECT user_id, event_id, hash, version_number, epoch_us(valid_from) AS valid_from, epoch_us(coalesce(next, TIMESTAMP '9999-12-31')) AS valid_to, next IS NULL AS is_current FROM history",
    "scd2_current": f"{_HISTORY} SELECT user_id, event_id, version_number FROM history WHERE next IS NULL",
    "dim_date": """
        SELECT DISTINCT strftime(d, '%Y-%m-%d') AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month, day(d) AS day, dayofweek(d) + 1 AS day_of_week, weekofyear(d) AS week_of_year, dayname(d) AS day_name, monthname(d) AS month_name
        FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "dim_distinct_sk": "SELECT DISTINCT md5(c_mktsegment || '-' || c_nationkey) AS sk, c_mktsegment, c_nationkey FROM customer",
    "dim_currency": "SELECT md5(c) AS currency_sk, c AS currency_code, n AS currency_name, CAST(r AS DOUBLE) AS usd_exchange_rate FROM (VALUES " + ", ".join(f"('{c}', '{n}', {r})" for c, n, r in RATES) + ") t(c, n, r)",
    "fact_fx": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, md5(code) AS currency_sk, l_extendedprice AS amount_original, CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * rate, 2) AS DOUBLE) AS amount
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (VALUES {_CODES}) fx(i, code, rate) ON l_partkey % 8 = i""",
    "natural_key_hash": "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), o_orderpriority)) AS natural_key_hash FROM orders",
    "classify_valid": f"{_CLASSIFIED} SELECT o_orderkey, o_custkey FROM r WHERE e = ''",
    "classify_quarantine": f"{_CLASSIFIED} SELECT o_orderkey, e AS error_reason FROM r WHERE e <> ''",
    "dedup_first_wins": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER w AS nth, CASE WHEN row_number() OVER w > 1 THEN 'duplicate_of:' || first_value(l_partkey) OVER w END AS reason
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE})""",
    "anti_existing": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')",
    "semi_existing": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')",
    "insert_new": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' UNION ALL
        SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders
            WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')) WHERE n = 1""",
    "hwm_lookback": "SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM events)",
    "monotone_mark": "SELECT event_type, coalesce(greatest(max(user_id), max(CASE WHEN user_id < 50 THEN user_id END)), 0) AS mark FROM events GROUP BY event_type",
    "max_union": "SELECT epoch_us(max(m)) AS newest FROM (SELECT max(o_orderdate) AS m FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem)",
    "reconcile_counts": "SELECT l AS landed, r AS raw, q AS quarantined, l - r - q AS difference FROM (SELECT count(*) AS l, count(*) FILTER (value > 10) AS r, count(*) FILTER (NOT coalesce(value > 10, false)) AS q FROM events)",
    "row_checks": """
        SELECT 'not_null' AS "check", 'o_custkey' AS "on", count(*) AS violations FROM orders WHERE o_custkey IS NULL UNION ALL
        SELECT 'accepted_values', 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
        SELECT 'between', 'o_totalprice', count(*) FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 300000 UNION ALL
        SELECT 'between', 'o_totalprice', count(*) FROM orders WHERE o_totalprice <= 0 UNION ALL
        SELECT 'matches', 'o_orderpriority', count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$') UNION ALL
        SELECT 'length', 'o_orderpriority', count(*) FROM orders WHERE length(o_orderpriority) <> 8""",
    "unique_violations": """
        SELECT 'unique' AS "check", 'l_orderkey, l_linenumber' AS "on", count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
        SELECT 'unique', 'l_orderkey', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
    "fk_orphans": """
        SELECT 'relationship' AS "check", 'c_custkey' AS "on", count(*) AS violations FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
        SELECT 'relationship', 'c_nationkey', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)""",
    "latest_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
}
