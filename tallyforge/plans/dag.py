"""Models in order of their needs, each written and then checked before the next starts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from tallyforge.operators.checks import accepted, between, enforce, length_is, matches, not_null, relates, unique
from tallyforge.plans import warehouse as w
from tallyforge.plans.ingest import CLEAN
from tallyforge.plans.store import TableStore
from tallyforge.schemas import CATEGORIES, CURRENCIES, RAW, STATUSES, TYPES, table_name


@dataclass(frozen=True)
class Model:
    """``make`` gets the needed tables by name; ``checks`` gets those and the model's own table, and lists checks."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    checks: Callable[[dict[str, DataFrame]], list] = field(default=lambda t: [])


def _raw_checks() -> list:
    return [*map(not_null, [f.name for f in RAW if f.name != "id"]), accepted("currency", CURRENCIES), accepted("transaction_type", TYPES), accepted("merchant_category", CATEGORIES), accepted("status", STATUSES), unique("natural_key_hash")]


def _silver_checks(t: dict) -> list:
    names = "transaction_sk transaction_id account_id transaction_timestamp transaction_date amount currency transaction_type merchant_name merchant_category status country_code natural_key_hash valid_from valid_to is_current version_number"
    return [
        *map(not_null, names.split()), unique("transaction_sk"), matches("transaction_id", "^TXN-[0-9]{4}$"), matches("account_id", "^ACC-[0-9]{4}$"),
        between("amount", 0, strictly=True), length_is("country_code", 2), between("version_number", 1),
    ]


def _fact_checks(t: dict) -> list:
    names = "transaction_sk transaction_id account_id currency_sk transaction_date amount_original amount currency transaction_type status country_code merchant_category"
    return [
        *map(not_null, names.split()), unique("transaction_sk"), unique("transaction_id"), between("amount", 0, strictly=True), between("transaction_date", "2024-01-01", "2024-04-30"), accepted("merchant_category", CATEGORIES),
        relates("account_id", t[ACCOUNTS], "account_id"), relates("merchant_sk", t[MERCHANTS], "merchant_sk"), relates("currency_sk", t[CURRENCY], "currency_sk"), relates("transaction_date", t[DAYS], "date_day"),
    ]


def _mart_checks(t: dict) -> list:
    names = "account_id transaction_date total_debit_amount total_credit_amount net_amount transaction_count distinct_merchants updated_at"
    return [
        unique("account_id", "transaction_date"), *map(not_null, names.split()), relates("account_id", t[ACCOUNTS], "account_id"), between("total_debit_amount", 0), between("total_credit_amount", 0),
        between("transaction_count", 1), accepted("top_category", CATEGORIES),
    ]


SILVER, MART = table_name("silver", "transactions"), table_name("marts", "daily_account_summary")
ACCOUNTS, MERCHANTS, DAYS, CURRENCY, FACT = (table_name("gold", n) for n in ("dim_account", "dim_merchant", "dim_date", "currency", "fact_transaction"))


def models(spark) -> list[Model]:
    """The warehouse above the raw table."""
    return [
        Model(SILVER, lambda t: w.silver(t[CLEAN].drop("batch_id")), (CLEAN,), _silver_checks),
        Model(ACCOUNTS, lambda t: w.dim_account(t[SILVER]), (SILVER,), lambda t: [unique("account_id"), not_null("account_id")]),
        Model(MERCHANTS, lambda t: w.dim_merchant(t[SILVER]), (SILVER,), lambda t: [unique("merchant_sk"), not_null("merchant_sk"), unique("merchant_name"), not_null("merchant_name")]),
        Model(DAYS, lambda t: w.dim_date(t[SILVER]), (SILVER,), lambda t: [unique("date_day"), not_null("date_day")]),
        Model(
            CURRENCY,
            lambda t: w.dim_currency(spark),
            (),
            lambda t: [unique("currency_sk"), not_null("currency_sk"), unique("currency_code"), not_null("currency_code"), length_is("currency_code", 3), not_null("currency_name"), not_null("usd_exchange_rate"), between("usd_exchange_rate", 0, strictly=True)],
        ),
        Model(FACT, lambda t: w.fact_transaction(t[SILVER], t[MERCHANTS], t[CURRENCY]), (SILVER, ACCOUNTS, MERCHANTS, DAYS, CURRENCY), _fact_checks),
        Model(MART, lambda t: w.daily_account_summary(t[FACT], t[MERCHANTS]), (FACT, ACCOUNTS, MERCHANTS), _mart_checks),
    ]


def build(store: TableStore, todo: list[Model] | None = None) -> list[str]:
    """Makes the models in order; a failed check stops what comes after. Returns the names made."""
    todo = models(store.spark) if todo is None else todo
    by_name = {m.name: m for m in todo}
    order = TopologicalSorter({m.name: [n for n in m.needs if n in by_name] for m in todo}).static_order()
    if store.exists(CLEAN):
        enforce(store.read(CLEAN), _raw_checks(), CLEAN)
    made = []
    for name in order:
        m = by_name[name]
        tables = {n: store.read(n).drop("batch_id") if n != CLEAN else store.read(n) for n in m.needs}
        df = m.make(tables)
        with store.commit() as c:
            c.overwrite(name, df, df.schema)
        own = store.read(name).drop("batch_id")
        enforce(own, m.checks(tables | {name: own}), name)
        made.append(name)
    return made
