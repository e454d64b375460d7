"""Counterparty records that belong to one entity but disagree, by both profiles.

Pairs meet by equality only: of the normalised name, or of the identifier. The two equi-joins are one union, so a hot
name or identifier is a skewed join key that adaptive execution splits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import numbers, similarity as sim, text as tx
from concordat.schemas import REQUISITE_COLUMNS
from concordat.stages import written

NAME_RATIO = 88.0
CONTENT = ["entity_name", "_name", "_bin", "_address", "_bank", "_bik", "_account"]  # all that conflicts depend on
# Labels of fields and endings of explanations.
LABELS = {"bin": "БИН", "legal_address": "юридический адрес", "bank_name": "банк", "bik": "БИК", "account_number": "расчётный счёт", "entity_name": "написание наименования"}
ENDINGS = {
    "critical": "Проверить реквизиты до оплаты: возможна подмена платёжных данных.",
    "high": "Проверить, является ли это опечаткой или другим юридическим лицом.",
    "medium": "Изменение может быть законным, но требует подтверждающего документа.",
    "info": "Расхождений реквизитов нет; это информационное примечание.",
}


def _meeting(rows: DataFrame, keys: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """Pairs that agree on any of the keys, each once: a later key takes only pairs that the earlier ones don't have."""
    left, right = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in keep)) for s in ("left", "right"))
    out, before = None, F.lit(False)
    for key, usable in keys:
        same = F.col(f"left_{key}") == F.col(f"right_{key}")
        pairs = left.join(right, F.expr(f"left_{key} = right_{key} AND left_row_idx < right_row_idx")).where(usable & ~before)
        out = pairs if out is None else out.unionByName(pairs)
        before = before | (same & usable)
    return out


def _near_names(rows: DataFrame) -> DataFrame:
    """(bin, one, other, ratio), in both directions: the different names of an identifier that are similar enough, so a pair of names is aligned once and not once a pair of rows. Names of which one holds the other need no alignment and stay in the JVM."""
    names = rows.select("_bin", "_name").distinct()
    a, b = F.col("one"), F.col("other")
    met = names.withColumnRenamed("_name", "one").join(names.withColumnRenamed("_name", "other"), "_bin").where(a < b)
    held = F.contains(a, b) | F.contains(b, a)
    plain = 200.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
    aligned = met.withColumn("ratio", F.when(held, plain).otherwise(sim.ratio(F.when(~held, a), F.when(~held, b))))
    near = aligned.where(F.round("ratio", 9) >= NAME_RATIO)
    both = F.explode(F.array(F.struct("one", "other"), F.struct(b.alias("one"), a.alias("other"))))
    return near.select(F.col("_bin").alias("bin"), "ratio", both.alias("n")).select("bin", "n.one", "n.other", "ratio")


def _met(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs of one name, and those of one identifier whose names are near, each once, with name_similarity; ``rows`` are written."""
    left, right = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in keep)) for s in ("left", "right"))
    in_line = F.expr("left_row_idx < right_row_idx")
    by_name = left.join(right, F.expr("left__name = right__name") & in_line).withColumn("name_similarity", F.lit(100.0))
    near = left.join(_near_names(rows), F.expr("left__bin = bin AND left__name = one"))
    by_bin = near.join(right, F.expr("bin = right__bin AND other = right__name") & in_line).withColumnRenamed("ratio", "name_similarity")
    return by_name.unionByName(by_bin.drop("bin", "one", "other"))


def changed_fields() -> Column:
    pairs = [("bin", "_bin"), ("legal_address", "_address"), ("bank_name", "_bank"), ("bik", "_bik"), ("account_number", "_account")]
    return F.array_compact(F.array(*(F.when(F.col(f"left_{n}") != F.col(f"right_{n}"), F.lit(f)) for f, n in pairs)))


def _normalised(requisites: DataFrame) -> DataFrame:
    return requisites.withColumns({"_name": tx.normalize_name(F.col("entity_name")), "_bin": tx.normalize_compact(F.col("bin")), "_address": tx.normalize_words(F.col("legal_address")), "_bank": tx.normalize_words(F.col("bank_name")), "_bik": tx.normalize_compact(F.col("bik")), "_account": tx.normalize_compact(F.col("account_number"))})


def _judged(rows: DataFrame, include_info: bool, more: list[str]) -> DataFrame:
    """Pairs of normalised rows that disagree, with name_similarity, severity and changed_fields; ``more`` columns of either side go along."""
    keep = ["row_idx", *more, *CONTENT]
    pairs = _met(written(rows.select(*keep), "normalised-requisites"), keep).withColumn("changed", changed_fields())
    none = F.size("changed") == 0
    info = none & (F.col("left_entity_name") != F.col("right_entity_name")) & F.lit(include_info)
    money = F.arrays_overlap("changed", F.array(F.lit("account_number"), F.lit("bank_name"), F.lit("bik")))
    severity = F.when(info, "info").when(none, None).when(F.array_contains("changed", "bin"), "high").when(money, "critical").when(F.array_contains("changed", "legal_address"), "medium").otherwise("high")
    return pairs.withColumns({"severity": severity, "changed_fields": F.when(info, F.array(F.lit("entity_name"))).otherwise(F.col("changed"))}).where("severity IS NOT NULL")


def _flags(pairs: DataFrame) -> DataFrame:
    flags = pairs.select(F.concat("left_document_id", F.lit(" ↔ "), "right_document_id").alias("flag_id"), F.col("left_row_idx").alias("left_index"), F.col("right_row_idx").alias("right_index"), "left_document_id", "right_document_id", F.col("left_entity_name").alias("entity_name"), "name_similarity", "severity", "changed_fields")
    return flags.withColumn("explanation", explain_flag(F.col("changed_fields"), F.col("severity")))


def find_conflicts(requisites: DataFrame, include_info: bool = False) -> DataFrame:
    """Classic profile: requisites (row_idx and the requisite columns) to flags."""
    return _flags(_judged(_normalised(requisites), include_info, ["document_id"]))


class Classes(NamedTuple):
    """Conflicts between classes of records, and which records belong to them."""

    pairs: DataFrame  # left_class, right_class, left_entity_name, right_entity_name, name_similarity, severity, changed_fields, flags
    members: DataFrame  # class, row_idx, document_id, entity_name


def conflict_classes(requisites: DataFrame, include_info: bool = False) -> Classes:
    """The flags of :func:`find_conflicts` without writing out each: records that no rule tells apart are a class.

    A class is the digest of the name and the normalised values, so membership needs neither a join nor a shuffle, and a
    class of any size is counted before it is shuffled. Records of one class never disagree. ``flags`` is how many pairs
    of records a pair of classes stands for; :func:`expanded` gives those of the pairs that are wanted. A name with n
    records of k different contents takes k * (k - 1) / 2 rows at most, and n of membership.
    """
    rows = _normalised(requisites).withColumn("class", F.sha2(F.to_json(F.struct(*CONTENT)), 256))
    classes = rows.groupBy(F.col("class").alias("row_idx")).agg(*(F.any_value(c).alias(c) for c in CONTENT), F.count("*").alias("members"))
    judged = _judged(classes, include_info, ["members"])
    pairs = judged.select(F.col("left_row_idx").alias("left_class"), F.col("right_row_idx").alias("right_class"), "left_entity_name", "right_entity_name", "name_similarity", "severity", "changed_fields", (F.col("left_members") * F.col("right_members")).alias("flags"))
    return Classes(pairs, rows.select("class", "row_idx", "document_id", "entity_name"))


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The flags that pairs of classes stand for, as :func:`find_conflicts` gives them; the record that comes first is the left one."""
    one, other = (members.select(*(F.col(c).alias(f"{s}_{c}") for c in members.columns)) for s in ("one", "other"))
    both = pairs.join(one, F.col("left_class") == F.col("one_class")).join(other, F.col("right_class") == F.col("other_class"))
    first = F.col("one_row_idx") < F.col("other_row_idx")
    sides = {f"{side}_{c}": F.when(first == (side == "left"), F.col(f"one_{c}")).otherwise(F.col(f"other_{c}")) for side in ("left", "right") for c in ("row_idx", "document_id", "entity_name")}
    return _flags(both.drop("left_entity_name", "right_entity_name").withColumns(sides))


def explain_flag(changed: Column, severity: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    named = F.array_join(F.transform(changed, lambda f: F.coalesce(labels[f], f)), ", ")
    ending = F.coalesce(F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv))[severity], F.lit(ENDINGS["info"]))
    return F.concat(F.lit("Потенциально один контрагент; различаются: "), named, F.lit(". "), ending)


def in_order(flags: DataFrame) -> DataFrame:
    return flags.orderBy(*order())


def order() -> list[Column]:
    """Gravest first, then by id; ties by row."""
    return [F.array_position(F.array(*(F.lit(s) for s in ENDINGS)), F.col("severity")), F.col("flag_id"), F.col("left_index"), F.col("right_index")]


def web_cases(requisites: DataFrame) -> DataFrame:
    """Web profile: requisites to review cases, with left_index and right_index for their order."""
    norm = {f"n_{c}": tx.normalize(F.col(c)) for c in ("entity_name", "legal_address", "bank_name", "bik", "account_number")}
    rows = requisites.withColumns(norm | {"t_bin": tx.text(F.col("bin")), "tokens": sim.name_tokens(F.col("entity_name"))})
    keep = [*REQUISITE_COLUMNS, "row_idx", *norm, "t_bin", "tokens"]
    rows = written(rows.select(*keep), "normalised-web-requisites")  # a row is normalised once, not once a pair
    pairs = _meeting(rows, [("n_entity_name", F.lit(True)), ("t_bin", F.col("left_t_bin") != "")], keep)
    differ = lambda c: F.col(f"left_{c}") != F.col(f"right_{c}")
    bank = differ("n_bank_name") | differ("n_bik") | differ("n_account_number")
    same_name = ~differ("n_entity_name")
    pairs = pairs.withColumns({"same_bin": (F.col("left_t_bin") != "") & ~differ("t_bin"), "bank": bank, "bin_conflict": same_name & differ("t_bin"), "address": differ("n_legal_address"), "similarity": F.when(same_name, F.lit(1.0)).otherwise(sim.token_similarity(F.col("left_tokens"), F.col("right_tokens")))})
    variation = F.col("same_bin") & ~same_name & (F.col("similarity") >= 0.45)
    pairs = pairs.where(F.col("bank") | F.col("bin_conflict") | F.col("address") | variation)
    # What cases and panels say, here to the end.
    gates = [(F.col("same_bin") & F.col("bank"), "critical", "Разные банк, БИК или ИИК при одном БИН"), (F.col("bin_conflict"), "high", "Одинаковое наименование, разные БИН"), (F.col("same_bin") & F.col("address"), "medium", "Разный юридический адрес")]
    choose = lambda k, rest: F.coalesce(*(F.when(g[0], F.lit(g[k])) for g in gates), F.lit(rest))
    t = lambda s, c: tx.text(F.col(f"{s}_{c}"))
    documents = F.array_distinct(F.array(t("left", "document_id"), t("right", "document_id")))
    panel = lambda s: F.create_map(*(x for k, c in zip(["Документ", "Лист / страница", "Контрагент", "БИН", "Адрес", "Банк", "БИК", "ИИК"], REQUISITE_COLUMNS, strict=True) for x in (F.lit(k), t(s, c))))
    explanation = F.concat(F.when(F.col("same_bin"), "БИН совпадает.").otherwise("БИН различается — записи автоматически не объединены."), F.lit(" Сходство наименований: "), F.format_string("%.0f", F.col("similarity") * 100), F.lit("%. "), F.when(F.col("bank"), "Обнаружено изменение платёжных реквизитов; перед оплатой нужна независимая проверка.").otherwise("Платёжные реквизиты совпадают."), F.lit(" Окончательное решение принимает эксперт."))
    return pairs.select(
        F.concat(F.lit("REQ-"), numbers.fnv_id(F.concat_ws("|", F.array_join(documents, "|"), "left_t_bin", "right_t_bin", t("left", "entity_name")))).alias("id"),
        F.lit("requisite").alias("type"), choose(1, "info").alias("severity"), t("left", "entity_name").alias("title"),
        F.concat(t("left", "document_id"), F.lit(" ↔ "), t("right", "document_id")).alias("subtitle"), choose(2, "Вариант написания наименования").alias("difference"),
        explanation.alias("explanation"), panel("left").alias("left"), panel("right").alias("right"), documents.alias("documents"), F.col("left_row_idx").alias("left_index"), F.col("right_row_idx").alias("right_index"))
