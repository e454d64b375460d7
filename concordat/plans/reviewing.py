"""More registered queries: web positions, importer, readers, requests, decisions, registry answers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.operators import backends, importer, positions, registry, requisites, review, search
from concordat.operators.pages import Ordered
from concordat.plans import queries as base
from concordat.schemas import REQUISITE_COLUMNS
from concordat.sources import requests, tables, xlsx
from concordat.stages import new_path
from concordat.streaming import states


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_position_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as positions of three documents; every norm covers a few of them."""
    i = F.col("item_id")
    rows = _table(spark, sf_dir, "benchmark").select(
        i.alias("row_idx"), F.concat(F.lit("D"), i % 3).alias("document_id"), i.cast("string").alias("position_id"), F.lit("1").alias("page_or_sheet"), F.col("text").alias("work_description"),
        F.when(i % 4 == 0, "м3").otherwise("м2").alias("unit"), (100 + i % 7 * 10).cast("string").alias("quantity"), F.concat((1000 + i % 5 * 10).cast("string"), F.lit(",5")).alias("unit_price"), F.when(i % 2 == 0, F.concat(F.lit("E-"), i % 20)).otherwise("").alias("norm_ref"))
    cases, _ = positions.web_pairs(rows)
    return cases.select("left_index", "right_index", "id", "severity", "score", "flag_type", "difference", F.array_join("documents", "|").alias("documents"), F.col("left")["Объём"].alias("quantity"), F.col("right")["Цена"].alias("price"))


_FNV = "to_base(list_reduce(list_concat([2166136261], list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36)"
_PCT = "replace(printf('%.1f', floor({0} * 1000 + 0.5) / 10), '.', ',') || '%'"
WEB_POSITION_SQL = f"""
WITH b AS (
  SELECT item_id AS i, 'D' || (item_id % 3) AS doc, CASE WHEN item_id % 4 = 0 THEN 'м3' ELSE 'м2' END AS unit, CAST(100 + item_id % 7 * 10 AS DOUBLE) AS q, 1000.5::DOUBLE + item_id % 5 * 10 AS p, CASE WHEN item_id % 2 = 0 THEN 'e ' || (item_id % 20) END AS ref,
    trim(regexp_replace(regexp_replace(lower(substr(trim(text), 1, 500)), '[«»“”''"()\\[\\],.;:/\\\\_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM benchmark),
w AS (SELECT i, list_filter(string_split(n, ' '), lambda x: length(x) > 1) AS w, ' ' || n || ' ' AS n FROM b),
f AS (
  SELECT i, 'w' AS k, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda j: w[j] || '_' || w[j + 1]))) AS f FROM w
  UNION ALL SELECT i, 'c', unnest(list_concat(list_transform(range(1, length(n) - 1), lambda j: substr(n, j, 3)), list_transform(range(1, length(n) - 2), lambda j: substr(n, j, 4)))) FROM w),
c AS (SELECT i, k, f, count(*) AS c FROM f GROUP BY ALL),
d AS (SELECT k, f, count(*) AS df FROM c GROUP BY ALL),
v AS (SELECT c.i, c.k, c.f, (1 + ln(c.c)) * (ln(((SELECT count(*) FROM b) + 1)::DOUBLE / (d.df + 1)) + 1) AS a FROM c JOIN d ON c.k = d.k AND c.f = d.f),
u AS (SELECT i, k, f, a / sqrt(sum(a * a) OVER (PARTITION BY i, k)) AS a FROM v),
s AS (SELECT l.i AS l, r.i AS r, sum(CASE l.k WHEN 'w' THEN 0.58::DOUBLE ELSE 0.42::DOUBLE END * l.a * r.a) AS sim FROM u l JOIN u r ON l.k = r.k AND l.f = r.f AND l.i < r.i GROUP BY l.i, r.i),
p AS (
  SELECT a.i AS l, b.i AS r, a.doc AS ld, b.doc AS rd, a.unit AS lu, b.unit AS ru, a.unit = b.unit AS same, coalesce(s.sim, 0) AS sim, a.q AS lq, b.p AS rp,
    abs(a.q - b.q) / greatest(a.q, b.q) AS dq, abs(a.p - b.p) / greatest(a.p, b.p) AS dp
  FROM b a JOIN b b ON a.i < b.i LEFT JOIN s ON s.l = a.i AND s.r = b.i WHERE coalesce(s.sim, 0) >= 0.56::DOUBLE OR a.ref = b.ref),
x AS (SELECT *, NOT same OR dq > 0.15::DOUBLE OR dp > 0.15::DOUBLE AS conflict, CASE WHEN ld = rd THEN ld ELSE ld || '|' || rd END AS docs FROM p)
SELECT l AS left_index, r AS right_index, 'EST-' || {_FNV.format("docs || '|' || l || '|' || r")} AS id,
  CASE WHEN NOT same OR dp > 0.3::DOUBLE OR dq > 0.3::DOUBLE THEN 'critical' WHEN conflict THEN 'high' WHEN sim >= 0.76::DOUBLE THEN 'medium' ELSE 'info' END AS severity,
  round(sim, 3) AS score, CASE WHEN conflict THEN 'both' ELSE 'semantic' END AS flag_type,
  coalesce(nullif(concat_ws(' · ', CASE WHEN NOT same THEN 'единицы: ' || lu || ' ↔ ' || ru END, CASE WHEN dq > 0.001::DOUBLE THEN 'объём ' || {_PCT.format("dq")} END, CASE WHEN dp > 0.001::DOUBLE THEN 'цена ' || {_PCT.format("dp")} END), ''), 'семантически близкие позиции') AS difference,
  docs AS documents, CAST(CAST(lq AS INTEGER) AS VARCHAR) AS quantity, left(CAST(CAST(floor(rp) AS INTEGER) AS VARCHAR), 1) || chr(160) || right(CAST(CAST(floor(rp) AS INTEGER) AS VARCHAR), 3) || ',5 ₸' AS price
FROM x
"""


def explained_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of position_pairs with their explanation."""
    pairs = positions.explain_pair(base.part_pairs(spark, sf_dir))
    return pairs.select("left_index", "right_index", "pair_id", "explanation")


_ONE = "printf('%.1f', floor({0} * 1000 + 0.5) / 10)"
EXPLAINED_SQL = f"""
WITH pairs AS ({base.POSITION_SQL})
SELECT left_index, right_index, a.p_brand || ':' || left_index || ' ↔ ' || b.p_brand || ':' || right_index AS pair_id,
  CASE WHEN status = 'excluded' THEN 'Текстовое сходство ' || printf('%.2f', embedding_score) || ', но пара исключена фильтром: ' || filter_reason || '. Это не предложение дубля.'
  ELSE 'Сходство описаний ' || printf('%.2f', embedding_score) || '; единицы совместимы (' || CASE WHEN a.p_size % 5 = 0 THEN 'масса' ELSE 'длина' END || '). Объём расходится на ' || {_ONE.format("abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size)")} || '%, цена — на ' || {_ONE.format("abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice)")} || '%. Система только предлагает проверить пару; итоговое решение принимает эксперт.' END AS explanation
FROM pairs JOIN part a ON a.p_partkey = left_index JOIN part b ON b.p_partkey = right_index
"""


def ordered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of position_pairs by their place in the reviewer's order, scores as shown (six digits)."""
    pairs = base.position_pairs(spark, sf_dir)
    return Ordered(pairs.select("left_index", "right_index", "status", "embedding_score", "fuzzy_score"), *positions.order()).rows().select("ordinal", "left_index", "right_index", "status")


ORDERED_POSITIONS_SQL = f"""
WITH pairs AS ({base.POSITION_SQL})
SELECT row_number() OVER (ORDER BY status DESC, embedding_score DESC, fuzzy_score DESC, left_index, right_index) - 1 AS ordinal, left_index, right_index, status FROM pairs
"""


def ordered_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of requisite_conflicts by their place in the reviewer's order."""
    flags = requisites.find_conflicts(base._records(spark, sf_dir), include_info=True)
    return Ordered(flags.select("flag_id", "severity", "left_index", "right_index"), *requisites.order()).rows().select("ordinal", "flag_id", "severity")


ORDERED_FLAGS_SQL = f"""
WITH flags AS ({base.REQUISITE_SQL})
SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, flag_id) - 1 AS ordinal, flag_id, severity FROM flags
"""


def requisite_conflicts_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As requisite_conflicts, but every tenth order has another BIN: the name alone joins it to its customer's others, and the BIN is what differs."""
    rows = base._records(spark, sf_dir).withColumn("bin", F.when(F.col("row_idx") % 10 == 0, F.concat("bin", F.lit("-x"))).otherwise(F.col("bin")))
    flags = requisites.find_conflicts(rows, include_info=True)
    return flags.select("flag_id", "severity", F.array_join("changed_fields", ",").alias("changed"), F.round("name_similarity", 6).alias("name_similarity"))


REQUISITE_BY_NAME_SQL = f"""
WITH {base.RECORDS_SQL},
k AS (SELECT *, CASE WHEN i % 10 = 0 THEN bin || 'X' ELSE CAST(bin AS VARCHAR) END AS own, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') AS key FROM r),
p AS (
  SELECT a.doc || ' ↔ ' || b.doc AS flag_id, a.own <> b.own AS cn, a.address <> b.address AS ca, a.bank <> b.bank AS cb, a.name <> b.name AS differ,
    CASE WHEN a.key = b.key THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * least(length(a.key), length(b.key)) / (length(a.key) + length(b.key)) END AS sim
  FROM k a JOIN k b ON a.bin = b.bin AND a.i < b.i WHERE a.key = b.key OR a.own = b.own)
SELECT flag_id, CASE WHEN cn THEN 'high' WHEN cb THEN 'critical' WHEN ca THEN 'medium' ELSE 'info' END AS severity,
  concat_ws(',', CASE WHEN cn THEN 'bin' END, CASE WHEN ca THEN 'legal_address' END, CASE WHEN cb THEN 'bank_name' END, CASE WHEN NOT cn AND NOT ca AND NOT cb THEN 'entity_name' END) AS changed, round(sim, 6) AS name_similarity
FROM p WHERE sim >= 88 AND (cn OR ca OR cb OR differ)
"""


def requisite_conflict_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of requisite_conflicts as pairs of classes: of every two names how many pairs there are by what differs, and the flags they stand for."""
    pairs = requisites.conflict_classes(base._records(spark, sf_dir), include_info=True).pairs
    names = [f("left_entity_name", "right_entity_name").alias(n) for f, n in ((F.least, "one_name"), (F.greatest, "other_name"))]
    return pairs.groupBy(*names, "severity", F.array_join("changed_fields", ",").alias("changed")).agg(F.count("*").alias("class_pairs"), F.sum("flags").alias("flags"))


CONFLICT_CLASSES_SQL = f"""
WITH {base.RECORDS_SQL},
p AS (
  SELECT a.name AS ln, b.name AS rn, a.address <> b.address AS ca, a.bank <> b.bank AS cb, least(a.name || '|' || a.address || '|' || a.bank, b.name || '|' || b.address || '|' || b.bank) AS lc, greatest(a.name || '|' || a.address || '|' || a.bank, b.name || '|' || b.address || '|' || b.bank) AS rc,
    regexp_replace(lower(a.name), '[^0-9a-z]', '', 'g') AS lk, regexp_replace(lower(b.name), '[^0-9a-z]', '', 'g') AS rk
  FROM r a JOIN r b ON a.bin = b.bin AND a.i < b.i),
f AS (SELECT *, CASE WHEN cb THEN 'critical' WHEN ca THEN 'medium' WHEN ln <> rn THEN 'info' END AS severity,
  concat_ws(',', CASE WHEN ca THEN 'legal_address' END, CASE WHEN cb THEN 'bank_name' END, CASE WHEN NOT ca AND NOT cb THEN 'entity_name' END) AS changed
  FROM p WHERE lk = rk OR 200.0::DOUBLE * least(length(lk), length(rk)) / (length(lk) + length(rk)) >= 88)
SELECT least(ln, rn) AS one_name, greatest(ln, rn) AS other_name, severity, changed, count(DISTINCT lc || '||' || rc) AS class_pairs, count(*) AS flags FROM f WHERE severity IS NOT NULL GROUP BY ALL
"""


def trap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many near pairs of positions only technical traps exclude: every benchmark item once named hot and once cold."""
    i = F.col("item_id")
    twice = _table(spark, sf_dir, "benchmark").select("text", F.explode(F.array(2 * i, 2 * i + 1)).alias("item_id"))
    rows = twice.select(
        i.alias("row_idx"), F.concat(F.lit("D"), i).alias("document_id"), i.cast("string").alias("position_id"), F.lit("1").alias("page_or_sheet"), F.concat(F.when(i % 2 == 0, "Горячая ").otherwise("Холодная "), F.substring("text", 1, 40)).alias("work_description"),
        F.lit("м").alias("unit"), F.lit("1").alias("quantity"), F.lit("1").alias("unit_price"), F.lit("").alias("norm_ref"))
    return positions.web_pairs(rows)[1]


TRAP_COUNTS_SQL = """
WITH b AS (
  SELECT item_id AS i, trim(regexp_replace(regexp_replace(lower(substr(trim(CASE WHEN item_id % 2 = 0 THEN 'Горячая ' ELSE 'Холодная ' END || substr(text, 1, 40)), 1, 500)), '[«»“”''"()\\[\\],.;:/\\\\_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM (SELECT text, 2 * item_id + unnest([0, 1]) AS item_id FROM benchmark)),
w AS (SELECT i, list_filter(string_split(n, ' '), lambda x: length(x) > 1) AS w, ' ' || n || ' ' AS n FROM b),
f AS (
  SELECT i, 'w' AS k, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda j: w[j] || '_' || w[j + 1]))) AS f FROM w
  UNION ALL SELECT i, 'c', unnest(list_concat(list_transform(range(1, length(n) - 1), lambda j: substr(n, j, 3)), list_transform(range(1, length(n) - 2), lambda j: substr(n, j, 4)))) FROM w),
c AS (SELECT i, k, f, count(*) AS c FROM f GROUP BY ALL),
d AS (SELECT k, f, count(*) AS df FROM c GROUP BY ALL),
v AS (SELECT c.i, c.k, c.f, (1 + ln(c.c)) * (ln(((SELECT count(*) FROM b) + 1)::DOUBLE / (d.df + 1)) + 1) AS a FROM c JOIN d ON c.k = d.k AND c.f = d.f),
u AS (SELECT i, k, f, a / sqrt(sum(a * a) OVER (PARTITION BY i, k)) AS a FROM v),
s AS (SELECT l.i AS l, r.i AS r, sum(CASE l.k WHEN 'w' THEN 0.58::DOUBLE ELSE 0.42::DOUBLE END * l.a * r.a) AS sim FROM u l JOIN u r ON l.k = r.k AND l.f = r.f AND l.i < r.i GROUP BY l.i, r.i)
SELECT count(*) AS excluded_technical_traps FROM s WHERE round(sim, 12) >= 0.48::DOUBLE AND l % 2 <> r % 2
"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as loose sheets, one a brand and type: a title, a header (not on sheets of type ECONOMY), the parts, a total."""
    part = _table(spark, sf_dir, "part")
    unit = F.when(F.col("p_partkey") % 2 == 0, "м2").otherwise("шт")
    body = F.array(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(" of "), F.lower("p_type")), unit, F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice"), F.concat(F.lit(" E"), (F.col("p_size") + 10).cast("string")))
    rows = part.select("p_brand", "p_type", (F.col("p_partkey") + 10).alias("at"), body.alias("cells"))
    sheets = part.select("p_brand", "p_type").distinct()
    text = lambda *cells: F.array(*(F.lit(c) for c in cells))
    header = sheets.where("p_type <> 'ECONOMY'").select("p_brand", "p_type", F.lit(2).alias("at"), text("№ п/п", "Наименование работ", "Ед. изм.", "Кол-во", "Цена за единицу", "Шифр нормы").alias("cells"))
    others = [sheets.select("p_brand", "p_type", F.lit(1).alias("at"), text("Ведомость", "").alias("cells")), header, sheets.select("p_brand", "p_type", F.lit(1 << 40).alias("at"), text("", " Итого ").alias("cells"))]
    for more in others:
        rows = rows.unionByName(more)
    named = rows.select(F.concat(F.lit("/in/"), "p_brand", F.lit(".xlsx")).alias("file"), F.col("p_type").alias("sheet"), F.col("at").alias("row_idx"), "cells")
    return importer.without_blank_rows(named)


def imported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sheets(spark, sf_dir)
    out = importer.import_sheets(rows, "estimate")
    return out.select("file", "sheet", "document_id", "position_id", "page_or_sheet", "work_description", "unit", "quantity", "unit_price", "norm_ref")


IMPORTED_SQL = """
SELECT '/in/' || p_brand || '.xlsx' AS file, p_type AS sheet, p_brand AS document_id, CAST(p_partkey AS VARCHAR) AS position_id, p_type AS page_or_sheet, p_name || ' of ' || lower(p_type) AS work_description,
  CASE WHEN p_partkey % 2 = 0 THEN 'м2' ELSE 'шт' END AS unit, CAST(p_size AS VARCHAR) AS quantity, printf('%.2f', p_retailprice) AS unit_price, 'E' || (p_size + 10) AS norm_ref
FROM part
"""


def import_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sheets(spark, sf_dir)
    found = importer.layouts(rows, "estimate")
    report = importer.reports(rows, found, importer.import_sheets(rows, "estimate", found))
    return report.select("file", "sheet", "header_row", "rows", F.array_join("inferred", ",").alias("inferred"), F.col("mapping")["quantity"].alias("quantity_header"))


REPORTS_SQL = """
SELECT '/in/' || p_brand || '.xlsx' AS file, p_type AS sheet, CAST(CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 2 END AS BIGINT) AS header_row, count(*) AS rows,
  CASE WHEN p_type = 'ECONOMY' THEN 'unit,position_id,norm_ref,work_description,quantity,unit_price' ELSE '' END AS inferred, CASE WHEN p_type = 'ECONOMY' THEN 'Колонка 4' ELSE 'Кол-во' END AS quantity_header
FROM part GROUP BY p_brand, p_type
"""


def _part_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in written workbooks, one for every 5,000 keys of a brand: sheets by type, texts, formatted numbers and dates."""
    part = _table(spark, sf_dir, "part")
    price = xlsx.cell(number=F.col("p_retailprice"), style=0)
    cells = F.array(xlsx.cell(number=F.col("p_partkey")), xlsx.cell(text=F.concat("p_name", F.lit(" & "), F.lower("p_type"))), xlsx.cell(text=F.lit("м2")), xlsx.cell(number=F.col("p_size") / 8, style=1), price, xlsx.cell(number=F.col("p_size") + 45000, style=2))
    keys = [F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 5000)).alias("book"), F.col("p_type").alias("sheet")]
    rows = part.select(*keys, (F.col("p_partkey") + 1).alias("at"), cells.alias("cells"))
    heads = part.select(*keys).distinct().select("book", "sheet", F.lit(-1).cast("long").alias("at"), F.array(*(xlsx.cell(text=F.lit(h)) for h in ("№ п/п", "Наименование работ", "Ед. изм.", "Кол-во", "Цена за единицу", "Обоснование"))).alias("cells"))
    folder = new_path(spark, "part-books")
    xlsx.write_workbooks(rows.unionByName(heads), folder, ("#,##0.00", "0.0##", "dd.mm.yyyy"))
    return importer.read_sheets(spark, f"{folder}/*.xlsx")


def imported_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of workbooks as their sheets show them."""
    out = importer.import_sheets(_part_books(spark, sf_dir), "estimate")
    return out.select("sheet", "document_id", "position_id", "page_or_sheet", "work_description", "unit", "quantity", "unit_price", "norm_ref")


IMPORTED_WORKBOOKS_SQL = """
SELECT p_type AS sheet, p_brand || '-' || (p_partkey // 5000) AS document_id, CAST(p_partkey AS VARCHAR) AS position_id, p_type AS page_or_sheet, p_name || ' & ' || lower(p_type) AS work_description, 'м2' AS unit,
  regexp_replace(printf('%.3f', p_size / 8), '0{1,2}$', '') AS quantity, format('{:,.2f}', p_retailprice) AS unit_price, strftime(DATE '1899-12-30' + CAST(p_size + 45000 AS INTEGER), '%d.%m.%Y') AS norm_ref
FROM part
"""


def _supplier_rows(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    """Suppliers as requisites with quotes, line ends and a spare column; if ``broken``, every fifth has a short BIN, every seventh a long BIK, every eleventh an account with a sign in it."""
    s = _table(spark, sf_dir, "supplier")
    key = F.lpad(F.col("s_suppkey").cast("string"), 12, "0")
    wrong = lambda n, bad, good: F.when(F.lit(broken) & (F.col("s_suppkey") % n == 0), bad).otherwise(good)
    return s.select(F.lit("x").alias("spare"), F.concat(F.lit(" DOC-"), "s_suppkey").alias("document_id"), F.lit("1").alias("page_or_sheet"), F.concat(F.lit('ТОО "'), "s_name", F.lit('",\n'), F.col("s_nationkey")).alias("entity_name"), wrong(5, F.substring(key, 1, 11), key).alias("bin"), F.lit("ул. Мира, 1 ").alias("legal_address"), F.lit("АО Банк").alias("bank_name"), wrong(7, F.lit("ABCD KZ-KAZ"), F.lit("ABCD KZ-KA")).alias("bik"), wrong(11, F.concat(F.lit("KZ*"), key), F.concat(F.lit("KZ"), F.lpad(key, 18, "1"))).alias("account_number"))


def _as_csv(rows: DataFrame, label: str) -> str:
    path = f"{new_path(rows.sparkSession, label)}.csv"
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(path)
    return path


def read_requisite_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as two CSV documents, then read and checked."""
    rows = _supplier_rows(spark, sf_dir, False)
    paths = [_as_csv(rows.where(F.pmod(F.hash("bin"), F.lit(2)) == part), "requisites") for part in (0, 1)]
    return tables.read_requisites(spark, *paths).select(*REQUISITE_COLUMNS)


REQUISITE_FILES_SQL = """
SELECT 'DOC-' || s_suppkey AS document_id, '1' AS page_or_sheet, 'ТОО "' || s_name || '",' || chr(10) || s_nationkey AS entity_name, lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS bin, 'ул. Мира, 1' AS legal_address, 'АО Банк' AS bank_name, 'ABCD KZ-KA' AS bik, 'KZ' || lpad(lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 18, '1') AS account_number FROM supplier
"""


def requisite_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in a CSV document of suppliers, by rule, with the number of rows that the pass counted."""
    (found,) = tables.read_checked(spark, "requisite", _as_csv(_supplier_rows(spark, sf_dir, True), "requisites"))
    return found.problems.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("rows", F.lit(found.counts["rows"]).cast("long"))


REQUISITE_PROBLEMS_SQL = """
WITH s AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS key FROM supplier),
p AS (SELECT 'bin' AS "column", left(key, 11) AS value FROM s WHERE k % 5 = 0 UNION ALL SELECT 'bik', 'ABCD KZ-KAZ' FROM s WHERE k % 7 = 0 UNION ALL SELECT 'account_number', 'KZ*' || key FROM s WHERE k % 11 = 0)
SELECT "column", value, count(*) AS n, (SELECT count(*) FROM supplier) AS rows FROM p GROUP BY ALL
"""


def position_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in a CSV document, some with a quantity or price that is no number: the problems, and of the sound rows the sums."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(F.col("p_brand").alias("document_id"), k.cast("string").alias("position_id"), F.lit("1").alias("page_or_sheet"), F.concat(F.lit('"'), "p_name", F.lit('",\nтип ')).alias("work_description"), F.lit("м").alias("unit"), F.when(k % 13 == 0, F.concat(F.lit("n/a "), k)).otherwise(F.concat(F.lit("1 "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(",5"))).alias("quantity"), F.when(k % 17 == 0, "1,2,3").otherwise(F.col("p_size").cast("string")).alias("unit_price"), F.lit("").alias("norm_ref"))
    (found,) = tables.read_checked(spark, "estimate", _as_csv(rows, "positions"))
    sound = found.rows.agg(F.lit("sound").alias("column"), F.concat_ws(" ", F.count("*"), F.sum("quantity").cast("long"), F.sum("unit_price").cast("long")).alias("value"), F.lit(found.counts["rows"]).alias("n"))
    return found.problems.groupBy("column", "value").agg(F.count("*").alias("n")).unionByName(sound)


POSITION_PROBLEMS_SQL = """
SELECT 'quantity' AS "column", 'n/a ' || p_partkey AS value, count(*) AS n FROM part WHERE p_partkey % 13 = 0 GROUP BY ALL
UNION ALL SELECT 'unit_price', '1,2,3', count(*) FROM part WHERE p_partkey % 17 = 0 HAVING count(*) > 0
UNION ALL SELECT 'sound', count(*) || ' ' || CAST(floor(sum(1000.5::DOUBLE + p_size)) AS BIGINT) || ' ' || CAST(sum(p_size) AS BIGINT), (SELECT count(*) FROM part) FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0
"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order as a request; orders of one line are too few, and those of a multiple of 7 lack a column."""
    line = _table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    row = F.struct(s("l_orderkey").alias("document_id"), s("l_linenumber").alias("position_id"), F.lit("1").alias("page_or_sheet"), F.concat(F.lit("Part "), s("l_partkey")).alias("work_description"), F.lit("шт").alias("unit"), s("l_quantity").alias("quantity"), F.lit("1").alias("unit_price"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("norm_ref"))
    grouped = line.groupBy(F.col("l_orderkey").alias("request")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", row.alias("row")))).alias("l"))  # a handful of lines an order
    return grouped.select("request", F.to_json(F.struct(F.transform("l", lambda x: x["row"]).alias("rows"))).alias("body"))


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = requests.read_requests(_bodies(spark, sf_dir), "estimate")
    return rows.select("request", "row_idx", "document_id", "position_id", "work_description", "unit", "quantity", "norm_ref")


REQUEST_ROWS_SQL = """
SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS row_idx, CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber AS VARCHAR) AS position_id, 'Part ' || l_partkey AS work_description, 'шт' AS unit, CAST(l_quantity AS VARCHAR) AS quantity, l_returnflag AS norm_ref
FROM lineitem WHERE l_orderkey % 7 <> 0 QUALIFY count(*) OVER (PARTITION BY l_orderkey) BETWEEN 2 AND 500
"""


def refused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.read_requests(_bodies(spark, sf_dir), "estimate")[1]


REFUSED_SQL = "SELECT l_orderkey AS request, CASE WHEN count(*) < 2 OR count(*) > 500 THEN 'row_count' ELSE 'missing_fields' END AS problem FROM lineitem GROUP BY l_orderkey HAVING count(*) NOT BETWEEN 2 AND 500 OR l_orderkey % 7 = 0"


def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of every customer as a response."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return requests.as_responses(o, "o_custkey", "id", ["id", "status", "priority"])


RESPONSE_SQL = """
SELECT o_custkey, '{"cases":[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}', ',' ORDER BY o_orderkey) || ']}' AS response FROM orders GROUP BY o_custkey
"""


def items_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as items, some with decisions on them: the state of each."""
    items = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("flag_id"), F.when(F.col("c_custkey") % 2 == 0, "critical").otherwise("high").alias("severity"))
    shown = review.with_state(items, base._log(spark, sf_dir), "estimate", "flag_id")
    return shown.select("flag_id", "severity", "review_status", "status_label", "version")


WITH_STATE_SQL = f"""
WITH {base.LOG_SQL}
SELECT CAST(c_custkey AS VARCHAR) AS flag_id, CASE WHEN c_custkey % 2 = 0 THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN a.item_id IS NULL THEN 'pending' WHEN rejected THEN 'rejected' WHEN c_custkey % 2 = 0 AND NOT (e AND c) THEN 'second_approval' ELSE 'accepted' END AS review_status,
  CASE WHEN a.item_id IS NULL THEN 'На проверке' WHEN rejected THEN 'Отклонено экспертом' WHEN c_custkey % 2 = 0 AND NOT (e AND c) THEN 'Ожидает подтверждения ' || CASE WHEN e THEN 'контролёра' ELSE 'эксперта' END ELSE 'Подтверждено' END AS status_label,
  coalesce(version, 0) AS version
FROM customer LEFT JOIN a ON a.item_id = CAST(c_custkey AS VARCHAR)
"""


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_states, but the log is a folder of files that a stream takes in some batches, in no order."""
    log, target = new_path(spark, "decision-log"), new_path(spark, "streamed-states")
    base._log(spark, sf_dir).repartition(8, "id").write.parquet(log)
    schema = spark.read.parquet(log).schema
    decisions = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(log)
    states.start_states(decisions, target, new_path(spark, "streamed-offsets"), available=True).awaitTermination()
    return states.current_states(spark, target).select("item_id", "status", "label", "version", F.array_join("accepted_roles", ",").alias("accepted_roles"), "last_actor")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.history_counts(base._log(spark, sf_dir)).select("item_id", "decisions", "first_id", "last_id")


COUNTS_SQL = "SELECT CAST(user_id AS VARCHAR) AS item_id, count(*) AS decisions, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id"


def _sent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decision requests, with spaces around them and some that fail a check."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("  REQ-"), "user_id", F.lit(" ")).alias("caseId"), F.when(F.col("event_id") % 11 == 0, "other").otherwise("requisite").alias("caseType"), F.when(F.col("value") < 15, "rejected").otherwise("accepted").alias("action"), F.when(F.col("event_type") == "click", "expert").when(F.col("event_type") == "purchase", "controller").alias("role"), F.concat(F.lit(" "), F.repeat(F.col("event_type"), 20)).alias("reviewer"), F.when(F.col("user_id") % 3 == 0, "critical").otherwise("high ").alias("severity"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("comment"))


def web_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.web_decisions(_sent_decisions(spark, sf_dir))


def refused_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.refused_web_decisions(_sent_decisions(spark, sf_dir))


REFUSED_DECISIONS_SQL = "SELECT event_id AS id, 'REQ-' || user_id AS \"caseId\", CASE WHEN event_id % 11 = 0 THEN 'caseType' ELSE 'role' END AS problem FROM events WHERE event_id % 11 = 0 OR event_type NOT IN ('click', 'purchase')"
WEB_DECISIONS_SQL = """
SELECT event_id AS id, 'REQ-' || user_id AS case_id, 'requisite' AS case_type, CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'high' END AS severity, CASE WHEN value < 15 THEN 'rejected' ELSE 'accepted' END AS action,
  substr(repeat(event_type, 20), 1, 80) AS reviewer, CASE event_type WHEN 'click' THEN 'expert' ELSE 'controller' END AS role, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS comment
FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 11 <> 0
"""


def taxpayer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' answers of a registry, nested: another record first, a second with an end date or none; some are empty."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    record = lambda code, name, end, reason: F.struct(code.alias("code"), name.alias("name"), end.alias("endDate"), F.struct(reason.alias("ru")).alias("endReason"))
    none = F.lit(None).cast("string")
    own = record(F.when(k % 5 != 0, k.cast("string")).otherwise("other"), F.col("c_name"), F.when(k % 3 == 0, "2020-01-01").otherwise(none), F.when(k % 6 == 0, F.lit("Ликвидация")).otherwise(none))
    first = record(F.lit("-1"), F.lit("Другой"), F.lit("2019-01-01"), none)
    answers = c.select(k.cast("string").alias("bin"), F.to_json(F.when(k % 7 == 0, F.array().cast("array<struct<code:string,name:string,endDate:string,endReason:struct<ru:string>>>")).otherwise(F.array(first, own))).alias("payload"))
    return registry.taxpayer_status(answers).select("bin", "registry_name", "active", "registry_status")


TAXPAYER_SQL = """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS bin, c_custkey AS k, c_name FROM customer)
SELECT bin, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'Другой' ELSE c_name END AS registry_name,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN false ELSE k % 3 <> 0 END AS active,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'Деятельность прекращена' WHEN k % 3 <> 0 THEN 'Действующий' WHEN k % 6 = 0 THEN 'Ликвидация' ELSE 'Деятельность прекращена' END AS registry_status
FROM c
"""


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next one of its label, by vectors made elsewhere, with the backend's metadata."""
    e = _table(spark, sf_dir, "embeddings")
    after = F.lead("vec_id").over(base.Window.partitionBy("label", F.floor(F.col("vec_id") / 1000)).orderBy("vec_id"))
    pairs = e.select(F.col("vec_id").alias("l"), after.alias("r")).where("r IS NOT NULL")
    backend = backends.VectorBackend(e, "given-64", "vec_id", "embedding")
    return backends.described(backend.scores(pairs), backend).select("l", "r", F.round("cosine", 6).alias("cosine"), "backend", "model_name", "fallback_used")


VECTOR_SQL = """
WITH p AS (SELECT vec_id AS l, lead(vec_id) OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) AS r FROM embeddings)
SELECT l, r, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, 'vectors' AS backend, 'given-64' AS model_name, 'false' AS fallback_used
FROM p JOIN embeddings a ON a.vec_id = l JOIN embeddings b ON b.vec_id = r
"""


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different vectors with a cosine of 0.4 or more, and how many rows have each."""
    backend = backends.VectorBackend(_table(spark, sf_dir, "embeddings"), "given-64", "vec_id", "embedding")
    pairs, classes = backend.pairs(0.4)
    copies = classes.where("id = class").select("class", "copies").distinct()
    for side in ("l", "r"):
        pairs = pairs.join(copies.select(F.col("class").alias(side), F.col("copies").alias(f"{side}_copies")), side)
    return pairs.select("l", "r", F.round("cosine", 6).alias("cosine"), "l_copies", "r_copies")


EMBEDDING_PAIRS_SQL = """
WITH c AS (SELECT embedding AS v, min(vec_id) AS id, count(*) AS copies FROM embeddings WHERE list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 GROUP BY embedding),
p AS (SELECT a.id AS l, b.id AS r, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS s, a.copies AS l_copies, b.copies AS r_copies FROM c a JOIN c b ON a.id < b.id)
SELECT l, r, round(s, 6) AS cosine, l_copies, r_copies FROM p WHERE round(s, 12) >= 0.4::DOUBLE
"""


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts on either side of a conflict of lines of one order."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("document_id"))
    after = F.lead("document_id").over(base.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "document_id"))
    pairs = line.select(F.col("document_id").alias("left_document_id"), after.alias("right_document_id"), "l_linenumber").where("right_document_id IS NOT NULL")
    return search.document_names(search.filtered(pairs, l_linenumber=[2, 3]))


NAMES_SQL = """
WITH p AS (SELECT CAST(l_partkey AS VARCHAR) AS l, lead(CAST(l_partkey AS VARCHAR)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS r, l_linenumber AS n FROM lineitem)
SELECT l AS document_id FROM p WHERE r IS NOT NULL AND n IN (2, 3) UNION SELECT r FROM p WHERE r IS NOT NULL AND n IN (2, 3)
"""

QUERIES = {f.__name__: f for f in (web_position_cases, explained_positions, ordered_positions, ordered_flags, requisite_conflicts_by_name, requisite_conflict_classes, trap_counts, imported_rows, imported_workbooks, import_reports, read_requisite_files, requisite_problems, position_problems, request_rows, refused_requests, response_bodies, items_with_state, streamed_states, decision_counts, web_decisions, refused_decisions, taxpayer_records, vector_scores, embedding_pairs, document_names)}
ORACLES = {
    "web_position_cases": WEB_POSITION_SQL,
    "explained_positions": EXPLAINED_SQL,
    "ordered_positions": ORDERED_POSITIONS_SQL,
    "ordered_flags": ORDERED_FLAGS_SQL,
    "requisite_conflicts_by_name": REQUISITE_BY_NAME_SQL,
    "requisite_conflict_classes": CONFLICT_CLASSES_SQL,
    "trap_counts": TRAP_COUNTS_SQL,
    "imported_rows": IMPORTED_SQL,
    "imported_workbooks": IMPORTED_WORKBOOKS_SQL,
    "import_reports": REPORTS_SQL,
    "read_requisite_files": REQUISITE_FILES_SQL,
    "requisite_problems": REQUISITE_PROBLEMS_SQL,
    "position_problems": POSITION_PROBLEMS_SQL,
    "request_rows": REQUEST_ROWS_SQL,
    "refused_requests": REFUSED_SQL,
    "response_bodies": RESPONSE_SQL,
    "items_with_state": WITH_STATE_SQL,
    "streamed_states": base.REVIEW_SQL,
    "decision_counts": COUNTS_SQL,
    "web_decisions": WEB_DECISIONS_SQL,
    "refused_decisions": REFUSED_DECISIONS_SQL,
    "taxpayer_records": TAXPAYER_SQL,
    "vector_scores": VECTOR_SQL,
    "embedding_pairs": EMBEDDING_PAIRS_SQL,
    "document_names": NAMES_SQL,
}
