"""Registry look-ups as joins; anything outside the cluster is a provider that must be configured."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

FIELDS = ("entity_name", "legal_address", "bank_name", "bik", "account_number")
TAXPAYER = "array<struct<code:string,name:string,endDate:string,endReason:struct<ru:string,kk:string,en:string>>>"


# The names of providers and what they say when they refuse, in the classes below, and the statuses of a taxpayer.
class RegistryUnavailable(RuntimeError):
    """No registry is configured."""


class RegistryProvider(Protocol):
    name: str

    def lookup(self, keys: DataFrame) -> DataFrame: ...


class DisabledRegistry:
    """The default: nothing leaves the cluster."""

    name = "Отключено"

    def lookup(self, keys: DataFrame) -> DataFrame:
        raise RegistryUnavailable("Реестр не подключён.")


class TableRegistry:
    """Looks up in a table (row_idx, bin and the fields): the first row of each bin counts."""

    def __init__(self, table: DataFrame, name: str = "Синтетический mock") -> None:
        self.table, self.name = table, name

    def lookup(self, keys: DataFrame) -> DataFrame:
        return lookup_first(keys, self.table, "bin", [c for c in FIELDS if c in self.table.columns]).withColumn("source", F.when(F.col("found"), F.lit(self.name)))


class GatewayRegistry:
    """A gateway that has been agreed on: ``ask`` turns keys into answers (bin and the fields). Without one it refuses."""

    name = "Корпоративный шлюз реестров"

    def __init__(self, ask: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.ask = ask

    def lookup(self, keys: DataFrame) -> DataFrame:
        if self.ask is None:
            raise RegistryUnavailable("Шлюз реестров не настроен.")
        answers = self.ask(keys.select("bin").distinct()).withColumn("row_idx", F.lit(0))
        return TableRegistry(answers, self.name).lookup(keys)


def lookup_first(keys: DataFrame, table: DataFrame, key: str, fields: list[str], order: str = "row_idx") -> DataFrame:
    """Each key row with the fields of the table's first row of that key, and whether there is one."""
    first = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_r"))
    return keys.join(first, key, "left").select(*keys.columns, *(F.col(f"_r.{f}").alias(f) for f in fields), F.col("_r").isNotNull().alias("found"))


def taxpayer_status(responses: DataFrame, bin_column: str = "bin", json_column: str = "payload") -> DataFrame:
    """The record of the asked bin (else the first) of a nested answer: whether it is active, and its status."""
    records = F.from_json(json_column, TAXPAYER)
    chosen = F.coalesce(F.try_element_at(F.filter(records, lambda r: r["code"] == F.col(bin_column)), F.lit(1)), F.try_element_at(records, F.lit(1)))
    active = F.coalesce(F.col("_r.endDate"), F.lit("")) == ""
    status = F.when(active, "Действующий").otherwise(F.coalesce("_r.endReason.ru", F.lit("Деятельность прекращена")))
    return responses.withColumn("_r", chosen).withColumns({"registry_name": F.col("_r.name"), "active": F.when(F.col("_r").isNotNull(), active), "registry_status": F.when(F.col("_r").isNotNull(), status)}).drop("_r")
