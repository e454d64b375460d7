"""The operators over the given tables: orders as counterparty records, parts and lines as positions, events as decisions.

Each query has SQL that states the same result plainly, with self-joins where the operator has an index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from concordat.functions import numbers, similarity as sim, text as tx
from concordat.operators import importer, positions, registry, requisites, review, search, tfidf


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requisites: the customer is the entity, status and priority are what may disagree."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    both = orders.join(customers, orders.o_custkey == customers.c_custkey)
    name = F.concat("c_name", F.when(F.col("o_orderkey") % 2 == 0, F.lit(" LLP")).otherwise(F.lit("")))
    return both.select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("document_id"), F.lit("1").alias("page_or_sheet"), name.alias("entity_name"), F.col("o_custkey").cast("string").alias("bin"), F.col("o_orderstatus").alias("legal_address"), F.col("o_orderpriority").alias("bank_name"), F.lit("").alias("bik"), F.lit("").alias("account_number"))


RECORDS_SQL = """
r AS (SELECT o_orderkey AS i, CAST(o_orderkey AS VARCHAR) AS doc, c_name || CASE WHEN o_orderkey % 2 = 0 THEN ' LLP' ELSE '' END AS name, o_custkey AS bin, lower(o_orderstatus) AS address,
      trim(regexp_replace(lower(o_orderpriority), '[^0-9a-z]+', ' ', 'g')) AS bank FROM orders JOIN customer ON o_custkey = c_custkey)"""


def requisite_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = requisites.find_conflicts(_records(spark, sf_dir), include_info=True)
    return flags.select("flag_id", "severity", F.array_join("changed_fields", ",").alias("changed"), F.round("name_similarity", 6).alias("name_similarity"), "explanation")


REQUISITE_SQL = f"""
WITH {RECORDS_SQL},
p AS (
  SELECT a.doc || ' ↔ ' || b.doc AS flag_id, a.name AS ln, b.name AS rn, a.address <> b.address AS ca, a.bank <> b.bank AS cb,
    regexp_replace(lower(a.name), '[^0-9a-z]', '', 'g') AS lk, regexp_replace(lower(b.name), '[^0-9a-z]', '', 'g') AS rk
  FROM r a JOIN r b ON a.bin = b.bin AND a.i < b.i),
s AS (SELECT *, CASE WHEN lk = rk THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * least(length(lk), length(rk)) / (length(lk) + length(rk)) END AS sim FROM p),
f AS (SELECT *, CASE WHEN cb THEN 'critical' WHEN ca THEN 'medium' WHEN ln <> rn THEN 'info' END AS severity,
  concat_ws(',', CASE WHEN ca THEN 'legal_address' END, CASE WHEN cb THEN 'bank_name' END, CASE WHEN NOT ca AND NOT cb THEN 'entity_name' END) AS changed FROM s WHERE sim >= 88)
SELECT flag_id, severity, changed, round(sim, 6) AS name_similarity,
  'Потенциально один контрагент; различаются: ' || replace(replace(replace(replace(changed, ',', ', '), 'legal_address', 'юридический адрес'), 'bank_name', 'банк'), 'entity_name', 'написание наименования') || '. ' ||
  CASE severity WHEN 'critical' THEN 'Проверить реквизиты до оплаты: возможна подмена платёжных данных.' WHEN 'medium' THEN 'Изменение может быть законным, но требует подтверждающего документа.' ELSE 'Расхождений реквизитов нет; это информационное примечание.' END AS explanation
FROM f WHERE severity IS NOT NULL
"""


def requisite_cases_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requisites.web_cases(_records(spark, sf_dir)).select("subtitle", "severity", "difference")


REQUISITE_WEB_SQL = f"""
WITH {RECORDS_SQL},
p AS (SELECT a.doc || ' ↔ ' || b.doc AS subtitle, a.address <> b.address AS ca, a.bank <> b.bank AS cb, a.name <> b.name AS cn FROM r a JOIN r b ON a.bin = b.bin AND a.i < b.i)
SELECT subtitle, CASE WHEN cb THEN 'critical' WHEN ca THEN 'medium' ELSE 'info' END AS severity,
  CASE WHEN cb THEN 'Разные банк, БИК или ИИК при одном БИН' WHEN ca THEN 'Разный юридический адрес' ELSE 'Вариант написания наименования' END AS difference
FROM p WHERE cb OR ca OR cn
"""


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as positions: pairs of one brand and type; size is a quantity in metres or kilograms."""
    part = _table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("row_idx"), F.col("p_brand").alias("document_id"), F.col("p_partkey").cast("string").alias("position_id"), F.lit("1").alias("page_or_sheet"), F.col("p_name").alias("work_description"), F.when(F.col("p_size") % 5 == 0, "kg").otherwise("m").alias("unit"), F.col("p_size").cast("double").alias("quantity"), F.col("p_retailprice").alias("unit_price"), F.lit("").alias("norm_ref"), "p_brand", "p_type")
    return positions.find_pairs(rows, block=("p_brand", "p_type"))


def position_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pairs(spark, sf_dir).select("left_index", "right_index", "flag_type", "status", "filter_reason", numbers.rounded(F.col("fuzzy_score"), 6).alias("fuzzy_score"), numbers.rounded(F.col("embedding_score"), 6).alias("embedding_score"), "unit_mismatch", numbers.rounded(F.col("quantity_diff_pct"), 6).alias("quantity_diff_pct"), numbers.rounded(F.col("price_diff_pct"), 6).alias("price_diff_pct"), "has_numeric_conflict")


POSITION_SQL = """
WITH n AS (SELECT p_name AS x, string_split(p_name, ' ') AS w, count(*) AS copies FROM part GROUP BY ALL),
p AS (SELECT x, ' ' || unnest(w) || ' ' AS p FROM n),
f AS (
  SELECT x, 'w' AS b, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM n
  UNION ALL SELECT x, 'c', unnest(list_transform(range(1, greatest(length(p) - 1, 2)), lambda i: substr(p, i, 3))) FROM p
  UNION ALL SELECT x, 'c', unnest(list_transform(range(1, greatest(length(p) - 2, 2)), lambda i: substr(p, i, 4))) FROM p WHERE length(p) > 3
  UNION ALL SELECT x, 'c', unnest(list_transform(range(1, greatest(length(p) - 3, 2)), lambda i: substr(p, i, 5))) FROM p WHERE length(p) > 4),
c AS (SELECT x, b, f, count(*) AS c FROM f GROUP BY ALL),
d AS (SELECT b, f, sum(copies) AS df FROM c JOIN n ON c.x = n.x GROUP BY b, f),
v AS (SELECT c.x, c.b, c.f, (1 + ln(c.c)) * (ln(((SELECT count(*) FROM part) + 1)::DOUBLE / (d.df + 1)) + 1) AS a FROM c JOIN d ON c.b = d.b AND c.f = d.f),
u AS (SELECT x, b, f, a / sqrt(sum(a * a) OVER (PARTITION BY x, b)) AS a FROM v),
cosine AS (SELECT l.x AS l, r.x AS r, sum(l.a * r.a) / 2 AS cosine FROM u l JOIN u r ON l.b = r.b AND l.f = r.f GROUP BY l.x, r.x),
g AS (
  SELECT a.x AS l, b.x AS r, array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') AS shared,
    array_to_string(list_sort(list_filter(a.w, lambda t: NOT list_contains(b.w, t))), ' ') AS lr, array_to_string(list_sort(list_filter(b.w, lambda t: NOT list_contains(a.w, t))), ' ') AS rr
  FROM n a JOIN n b ON TRUE),
h AS (SELECT *, length(lr) - bit_count(list_reduce(list_concat([(1::BIGINT << length(lr)) - 1], list_transform(string_split(rr, ''), lambda c: list_sum(list_transform(range(1, length(lr) + 1), lambda i: CASE WHEN substr(lr, i, 1) = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)),
    lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << length(lr)) - 1))) AS lcs FROM g WHERE lr <> '' AND rr <> ''),
z AS (
  SELECT l, r, 100.0::DOUBLE AS fuzzy FROM g WHERE lr = '' OR rr = ''
  UNION ALL SELECT l, r, CASE WHEN shared = '' THEN 200.0::DOUBLE * lcs / (length(lr) + length(rr)) ELSE greatest(
    100.0::DOUBLE * (1 - (length(lr) + length(rr) - 2 * lcs)::DOUBLE / (2 * length(shared) + 2 + length(lr) + length(rr))),
    100.0::DOUBLE * (1 - (1 + length(lr))::DOUBLE / (2 * length(shared) + 1 + length(lr))), 100.0::DOUBLE * (1 - (1 + length(rr))::DOUBLE / (2 * length(shared) + 1 + length(rr)))) END FROM h),
q AS (
  SELECT a.p_partkey AS left_index, b.p_partkey AS right_index, z.fuzzy, k.cosine, (a.p_size % 5 = 0) <> (b.p_size % 5 = 0) AS mismatch,
    abs(a.p_size - b.p_size)::DOUBLE / greatest(a.p_size, b.p_size) AS dq, abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) AS dp
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
  JOIN z ON z.l = a.p_name AND z.r = b.p_name JOIN cosine k ON k.l = a.p_name AND k.r = b.p_name
  WHERE z.fuzzy >= 82 OR k.cosine >= 0.75::DOUBLE),
x AS (SELECT *, mismatch OR dq > 0.15::DOUBLE OR dp > 0.15::DOUBLE AS conflict FROM q)
SELECT left_index, right_index, CASE WHEN conflict AND cosine < 0.75::DOUBLE AND fuzzy >= 82 THEN 'numeric' WHEN conflict THEN 'both' ELSE 'semantic' END AS flag_type,
  CASE WHEN mismatch THEN 'excluded' ELSE 'proposed' END AS status, CASE WHEN mismatch THEN 'несовместимые категории единиц измерения' END AS filter_reason,
  round(fuzzy, 6) AS fuzzy_score, round(cosine, 6) AS embedding_score, mismatch AS unit_mismatch, round(dq, 6) AS quantity_diff_pct, round(dp, 6) AS price_diff_pct, conflict AS has_numeric_conflict
FROM x
"""


def numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one part and supplier whose quantities or prices differ."""
    line = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.lit("count").alias("unit_category"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price"))
    keep = ["l_orderkey", "l_linenumber", "unit_category", "quantity", "unit_price"]
    left, right = (line.select("l_partkey", "l_suppkey", *(F.col(c).alias(f"{s}_{c}") for c in keep)) for s in ("a", "b"))
    pairs = left.join(right, ["l_partkey", "l_suppkey"]).where("(a_l_orderkey, a_l_linenumber) < (b_l_orderkey, b_l_linenumber)")
    side = lambda s: {c: F.col(f"{s}_{c}") for c in keep}
    out = pairs.withColumns(numbers.numeric_conflict(side("a"), side("b"))).where("has_numeric_conflict")
    web = numbers.percent(F.col("a_quantity"), F.col("b_quantity"))
    return out.select("l_partkey", "l_suppkey", "a_l_orderkey", "a_l_linenumber", "b_l_orderkey", "b_l_linenumber", F.round("quantity_diff_pct", 6).alias("quantity_diff_pct"), F.round("price_diff_pct", 6).alias("price_diff_pct"), F.round(web, 6).alias("web_quantity_diff"))


NUMERIC_SQL = """
WITH p AS (
  SELECT a.l_partkey, a.l_suppkey, a.l_orderkey AS a_l_orderkey, a.l_linenumber AS a_l_linenumber, b.l_orderkey AS b_l_orderkey, b.l_linenumber AS b_l_linenumber,
    abs(a.l_quantity - b.l_quantity) / greatest(abs(a.l_quantity), abs(b.l_quantity), 1e-12::DOUBLE) AS q,
    abs(a.l_extendedprice - b.l_extendedprice) / greatest(abs(a.l_extendedprice), abs(b.l_extendedprice), 1e-12::DOUBLE) AS p,
    a.l_quantity = 0 OR b.l_quantity = 0 AS zero
  FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND (a.l_orderkey < b.l_orderkey OR (a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)))
SELECT l_partkey, l_suppkey, a_l_orderkey, a_l_linenumber, b_l_orderkey, b_l_linenumber, round(q, 6) AS quantity_diff_pct, round(p, 6) AS price_diff_pct,
  round(CASE WHEN zero THEN 0.0::DOUBLE ELSE q END, 6) AS web_quantity_diff
FROM p WHERE q > 0.15::DOUBLE OR p > 0.15::DOUBLE
"""


def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.folded(F.col("text")).alias("folded"))  # once for all three
    normal, words, name = (f(F.col("folded"), done=True) for f in (tx.normalize_text, tx.normalize_words, tx.normalize_name))
    return docs.select("doc_id", F.md5(normal).alias("normal"), F.md5(words).alias("words"), F.md5(name).alias("name"), tx.normalize_compact(F.concat_ws(" – ", "lang", "source")).alias("compact"))


TEXT_SQL = """
WITH d AS (SELECT doc_id, replace(lower(text), 'ё', 'е') AS t, lang, source FROM documents)
SELECT doc_id, md5(trim(regexp_replace(t, '[^0-9a-zа-яәіңғүұқөһ²³]+', ' ', 'g'))) AS normal, md5(trim(regexp_replace(t, '[^0-9a-zа-яәіңғүұқөһ]+', ' ', 'g'))) AS words,
  md5(regexp_replace(regexp_replace(t, '(^|[^\\p{L}\\p{N}_])(тоо|too|ао|ao|ип|жшс)($|[^\\p{L}\\p{N}_])', '\\1 \\3', 'g'), '[^0-9a-zа-я]+', '', 'g')) AS name,
  upper(lang || source) AS compact
FROM d
"""


def tfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("t"))
    words = F.filter(F.split(F.regexp_replace("t", "[^a-z]+", " "), " "), lambda w: F.length(w) > 1)
    return tfidf.vectors(docs, words, unit=True).select(F.col("id").alias("item_id"), "feature", "df", F.round("weight", 6).alias("weight"))


TFIDF_CTE = """
t AS (SELECT item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) > 1)) AS feature FROM benchmark),
c AS (SELECT item_id, feature, count(*) AS c FROM t GROUP BY ALL),
d AS (SELECT feature, count(*) AS df FROM c GROUP BY feature),
w AS (SELECT item_id, c.feature, df, (1 + ln(c)) * (ln(((SELECT count(*) FROM benchmark) + 1.0::DOUBLE) / (df + 1)) + 1) AS x FROM c JOIN d ON c.feature = d.feature),
u AS (SELECT item_id, feature, CAST(df AS BIGINT) AS df, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM w)"""
TFIDF_SQL = f"WITH {TFIDF_CTE} SELECT item_id, feature, df, round(x, 6) AS weight FROM u"


def tfidf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of items with a cosine of 0.1 or more, through the prefix index."""
    docs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("t"))
    words = F.filter(F.split(F.regexp_replace("t", "[^a-z]+", " "), " "), lambda w: F.length(w) > 1)
    v = tfidf.vectors(docs, words)
    pairs = tfidf.candidates(v, 0.1)
    for side in ("l", "r"):
        pairs = pairs.join(tfidf.packed(v, f"{side}v").withColumnRenamed("id", side), side)
    out = pairs.withColumn("cosine", F.round(tfidf.dot(F.col("lv"), F.col("rv")), 6)).where("cosine >= 0.1")
    return out.select("l", "r", "cosine")


TFIDF_PAIRS_SQL = f"""
WITH {TFIDF_CTE}
SELECT a.item_id AS l, b.item_id AS r, round(sum(a.x * b.x), 6) AS cosine FROM u a JOIN u b ON a.feature = b.feature AND a.item_id < b.item_id
GROUP BY a.item_id, b.item_id HAVING round(sum(a.x * b.x), 6) >= 0.1
"""


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts have each character feature, of both profiles."""
    names = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))  # features once a name, however many parts have it
    profiles = names.select("n", F.explode(F.create_map(F.lit("classic"), tx.char_features(F.col("p_name")), F.lit("web"), tx.grams(tx.normalize(F.col("p_name"))))).alias("profile", "features"))
    return profiles.select("n", "profile", F.explode(F.array_distinct("features")).alias("feature")).groupBy("profile", "feature").agg(F.sum("n").alias("parts"))


NGRAM_SQL = """
WITH p AS (SELECT p_partkey, p_name, ' ' || trim(regexp_replace(regexp_replace(lower(p_name), '[«»“”''"()\\[\\],.;:/\\\\_-]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS n FROM part),
w AS (SELECT p_partkey, ' ' || unnest(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM part),
s AS (
  SELECT 'web' AS profile, p_partkey, unnest(list_concat(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3)), list_transform(range(1, length(n) - 2), lambda i: substr(n, i, 4)))) AS feature FROM p
  UNION ALL SELECT 'classic', p_partkey, unnest(list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, i, 3))) FROM w
  UNION ALL SELECT 'classic', p_partkey, unnest(list_transform(range(1, greatest(length(w) - 2, 2)), lambda i: substr(w, i, 4))) FROM w WHERE length(w) > 3
  UNION ALL SELECT 'classic', p_partkey, unnest(list_transform(range(1, greatest(length(w) - 3, 2)), lambda i: substr(w, i, 5))) FROM w WHERE length(w) > 4)
SELECT profile, feature, count(DISTINCT p_partkey) AS parts FROM s GROUP BY profile, feature
"""


def latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each role in a conversation."""
    return review.latest_per_role(_table(spark, sf_dir, "conversations"), ["conv_id"], version="turn").select("conv_id", "role", "turn", F.md5("text").alias("text_md5"))


LATEST_SQL = "SELECT conv_id, role, turn, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions on users: clicks are the expert's, purchases the controller's, the rest is ignored."""
    e = _table(spark, sf_dir, "events")
    kinds = F.create_map(*(F.lit(x) for x in ("click", "expert", "purchase", "controller")))
    return e.select(F.col("event_id").alias("id"), F.lit("estimate").alias("track"), F.col("user_id").cast("string").alias("item_id"), F.when(F.col("value") < 15, "rejected").otherwise("accepted").alias("decision"), kinds[F.col("event_type")].alias("role"), F.col("event_type").alias("actor"), F.when(F.col("user_id") % 3 == 0, "critical").otherwise("high").alias("severity"), F.col("ts").alias("created_at")).where("role IS NOT NULL")


LOG_SQL = """
g AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS item_id, CASE WHEN value < 15 THEN 'rejected' ELSE 'accepted' END AS decision,
  CASE event_type WHEN 'click' THEN 'expert' WHEN 'purchase' THEN 'controller' END AS role, event_type AS actor, CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'high' END AS severity FROM events WHERE event_type IN ('click', 'purchase')),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY item_id, role ORDER BY id DESC) = 1),
a AS (SELECT item_id, bool_or(decision = 'rejected') AS rejected, bool_or(decision = 'accepted' AND role = 'expert') AS e, bool_or(decision = 'accepted' AND role = 'controller') AS c, max(id) AS version, arg_max(actor, id) AS last_actor, arg_max(severity, id) AS severity FROM l GROUP BY item_id)"""


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = review.states(_log(spark, sf_dir), F.col("severity"))
    return state.select("item_id", "status", "label", "version", F.array_join("accepted_roles", ",").alias("accepted_roles"), "last_actor")


REVIEW_SQL = f"""
WITH {LOG_SQL}
SELECT item_id, CASE WHEN rejected THEN 'rejected' WHEN severity = 'critical' AND NOT (e AND c) THEN 'second_approval' ELSE 'accepted' END AS status,
  CASE WHEN rejected THEN 'Отклонено экспертом' WHEN severity = 'critical' AND NOT (e AND c) THEN 'Ожидает подтверждения ' || CASE WHEN e THEN 'контролёра' ELSE 'эксперта' END ELSE 'Подтверждено' END AS label,
  version, concat_ws(',', CASE WHEN c THEN 'controller' END, CASE WHEN e THEN 'expert' END) AS accepted_roles, last_actor
FROM a
"""


def review_states_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumnsRenamed({"item_id": "case_id", "decision": "action"})
    return review.web_states(log).select("case_id", "status", F.size("accepted_roles").alias("roles"), "version")


REVIEW_WEB_SQL = f"""
WITH {LOG_SQL}
SELECT item_id AS case_id, CASE WHEN rejected THEN 'rejected' WHEN severity = 'critical' AND NOT (e AND c) THEN 'pending_second' ELSE 'accepted' END AS status,
  CAST(e AS INTEGER) + CAST(c AS INTEGER) AS roles, version
FROM a
"""


def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("REQ-"), numbers.fnv_id(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority"))).alias("case_id"))


CASE_ID_SQL = """
SELECT o_orderkey, 'REQ-' || to_base(list_reduce(list_concat([2166136261], list_transform(string_split(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36) AS case_id FROM orders
"""


def name_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web name similarity of the different part names that share a first word."""
    names = _table(spark, sf_dir, "part").select("p_name").distinct().withColumn("first", F.element_at(F.split("p_name", " "), 1))
    both = names.select(F.col("p_name").alias("l"), "first").join(names.select(F.col("p_name").alias("r"), "first"), "first").where("l < r")
    return both.select("l", "r", F.round(sim.name_similarity(F.col("l"), F.col("r")), 6).alias("similarity"), F.round(sim.ratio("l", "r"), 6).alias("ratio"))


NAME_SQL = """
WITH n AS (SELECT DISTINCT p_name AS x, string_split(p_name, ' ') AS w FROM part),
f AS (SELECT x, w, list_filter(w, lambda a: length(a) > 1) AS v FROM n),
t AS (SELECT x, w, list_concat(v, list_transform(range(1, len(v)), lambda i: v[i] || '_' || v[i + 1])) AS k FROM f),
p AS (SELECT a.x AS l, b.x AS r, a.k AS lk, b.k AS rk, a.w AS lw, b.w AS rw FROM t a JOIN t b ON a.w[1] = b.w[1] AND a.x < b.x),
q AS (SELECT *, len(list_intersect(lk, rk)) AS shared, len(list_distinct(list_concat(lk, rk))) AS whole,
  length(l) - bit_count(list_reduce(list_concat([(1::BIGINT << length(l)) - 1], list_transform(string_split(r, ''), lambda c: list_sum(list_transform(range(1, length(l) + 1), lambda i: CASE WHEN substr(l, i, 1) = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(l)) - 1))) AS lcs FROM p)
SELECT l, r, round(shared::DOUBLE / whole, 6) AS similarity, round(200.0::DOUBLE * lcs / (length(l) + length(r)), 6) AS ratio FROM q
"""


def technical_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that name different colours or goods of one family, and those the trap words would drop."""
    families = [("red", "blue", "green"), ("small", "large"), ("steel", "copper", "brass")]
    names = _table(spark, sf_dir, "part").select("p_name").distinct()
    both = names.withColumn("k", F.element_at(F.split("p_name", " "), -1))
    pairs = both.select(F.col("p_name").alias("l"), "k").join(both.select(F.col("p_name").alias("r"), "k"), "k").where("l < r")
    return pairs.select("l", "r", sim.technical_conflict(F.col("l"), F.col("r"), families).alias("reason"), sim.has_trap(F.col("l"), F.col("r"), [("red", "blue"), ("small", "large")]).alias("trap"), sim.meaningful_overlap(F.col("l"), F.col("r")).alias("overlap"))


TECHNICAL_SQL = """
WITH n AS (SELECT DISTINCT p_name AS x, string_split(p_name, ' ') AS w FROM part),
p AS (SELECT a.x AS l, b.x AS r, a.w AS lw, b.w AS rw FROM n a JOIN n b ON a.w[-1] = b.w[-1] AND a.x < b.x),
f AS (SELECT unnest([['blue', 'green', 'red'], ['large', 'small'], ['brass', 'copper', 'steel']]) AS stems, unnest([1, 2, 3]) AS k),
c AS (SELECT l, r, k, list_filter(stems, lambda s: contains(l, s)) AS a, list_filter(stems, lambda s: contains(r, s)) AS b FROM p, f),
h AS (SELECT l, r, arg_min('несовместимые технические признаки: ' || array_to_string(list_sort(list_distinct(list_concat(a, b))), ', '), k) AS reason FROM c WHERE len(a) > 0 AND len(b) > 0 AND a <> b GROUP BY l, r)
SELECT p.l, p.r, h.reason, (contains(p.l, 'red') AND contains(p.r, 'blue')) OR (contains(p.l, 'blue') AND contains(p.r, 'red')) OR (contains(p.l, 'small') AND contains(p.r, 'large')) OR (contains(p.l, 'large') AND contains(p.r, 'small')) AS trap,
  CAST(len(list_intersect(lw, rw)) AS INTEGER) AS overlap
FROM p LEFT JOIN h ON p.l = h.l AND p.r = h.r
"""


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of every customer, as a registry row."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    keys = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return registry.lookup_first(keys, rows, "c_custkey", ["o_orderstatus", "o_orderpriority"])


REGISTRY_SQL = """
WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, o_orderstatus, o_orderpriority, o_custkey IS NOT NULL AS found FROM customer LEFT JOIN f ON c_custkey = o_custkey
"""


def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importer.column_profile(_table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("string")), ["p_name", "p_brand", "p_type", "p_size"])
    return out.select("column", F.round("number_share", 6).alias("number_share"), F.round("mean_length", 6).alias("mean_length"))


PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST(regexp_full_match(CAST({c} AS VARCHAR), '[-+]?[0-9][0-9 ]*([.,][0-9]+)?( *%| *₸)?') AS INTEGER)), 6) AS number_share, round(avg(length(CAST({c} AS VARCHAR))), 6) AS mean_length FROM part" for c in ("p_name", "p_brand", "p_type", "p_size"))


def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.where(search.matches(F.lit("The SH"), ["source", "lang", "text"])).select("doc_id", "source")


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the nested properties, and a sorted-key encoding of an event."""
    e = _table(spark, sf_dir, "events")
    encoded = F.to_json(F.struct("event_type", "user_id"), {"ignoreNullFields": "false"})
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), encoded.alias("encoded"))


def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select("o_orderkey", numbers.format_number(F.round(price, 2)).alias("shown"), numbers.pct(F.round(price / 1e6, 3)).alias("share"), numbers.parse_lenient(F.concat(F.floor(price).cast("string"), F.lit(",5 ₸"))).alias("lenient"), numbers.parse_strict(F.concat(F.floor(price).cast("string"), F.lit(",5"))).alias("strict"))


FORMAT_SQL = """
SELECT o_orderkey,
  regexp_replace(regexp_replace(replace(replace(replace(format('{:,.3f}', round(o_totalprice, 2)), ',', chr(160)), '.', ','), 'x', 'x'), '0+$', ''), ',$', '') AS shown,
  replace(printf('%.1f', round(o_totalprice / 1e6, 3) * 100), '.', ',') || '%' AS share, floor(o_totalprice) + 0.5::DOUBLE AS lenient, floor(o_totalprice) + 0.5::DOUBLE AS strict
FROM orders
"""

FLAGSHIP = "requisite_conflicts"
QUERIES = {f.__name__: f for f in (requisite_conflicts, requisite_cases_web, position_pairs, numeric_conflicts, text_normalized, tfidf_words, tfidf_pairs, char_ngrams, latest_turns, review_states, review_states_web, case_ids, name_similarities, technical_conflicts, registry_lookup, column_profiles, case_search, event_json, formatted_numbers)}
ORACLES = {
    "requisite_conflicts": REQUISITE_SQL,
    "requisite_cases_web": REQUISITE_WEB_SQL,
    "position_pairs": POSITION_SQL,
    "numeric_conflicts": NUMERIC_SQL,
    "text_normalized": TEXT_SQL,
    "tfidf_words": TFIDF_SQL,
    "tfidf_pairs": TFIDF_PAIRS_SQL,
    "char_ngrams": NGRAM_SQL,
    "latest_turns": LATEST_SQL,
    "review_states": REVIEW_SQL,
    "review_states_web": REVIEW_WEB_SQL,
    "case_ids": CASE_ID_SQL,
    "name_similarities": NAME_SQL,
    "technical_conflicts": TECHNICAL_SQL,
    "registry_lookup": REGISTRY_SQL,
    "column_profiles": PROFILE_SQL,
    "case_search": "SELECT doc_id, source FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'the sh')",
    "event_json": "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS encoded FROM events",
    "formatted_numbers": FORMAT_SQL,
}
