"""Pairs of estimate positions that describe the same work, and where their numbers disagree.

Both profiles give every pair the all-pairs rules would give. Descriptions are scored once per different text: pairs of
texts come from inverted indexes (TF-IDF prefixes, and those of :mod:`concordat.operators.overlaps`), are scored and
gated, and only then expanded to the rows that hold them. Weights are computed once and written. ``block`` restricts pairs to rows that agree on the given
columns: it is applied to the scored pairs of texts, so it bounds the rows that come out, not the texts that are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import numbers, similarity as sim, text as tx
from concordat.operators import overlaps, tfidf
from concordat.stages import written

COSINE, FUZZY, FEATURES = 0.75, 82.0, 6000
MEETINGS, MOST_TASKS = 1 << 21, 20_000  # pairs of rows that a task is meant to look at; tasks of a join
WEB_SCORE, WEB_TRAP = 0.56, 0.48
PAIRS = "pair_id left_index right_index left_document_id right_document_id left_position_id right_position_id left_description right_description embedding_score fuzzy_score flag_type status filter_reason unit_mismatch quantity_diff_pct price_diff_pct has_numeric_conflict".split()


def _paired(texts: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("l", "r"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def _weights(texts: DataFrame, words: Column, characters: Column, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of both kinds of features, each written once."""
    return written(tfidf.vectors(texts, words), "word-weights"), written(tfidf.vectors(texts, characters, cap), "character-weights")


def _products(pairs: DataFrame, words: DataFrame, characters: DataFrame) -> DataFrame:
    """``pairs`` with the products ``w`` and ``c`` of their vectors, and whether a side has such a vector (l_w, l_c, r_w, r_c)."""
    maps = written(tfidf.packed(words, "w").join(tfidf.packed(characters, "c"), "id", "full"), "text-weights")
    for side in ("l", "r"):
        pairs = pairs.join(maps.select(F.col("id").alias(side), *(F.col(m).alias(f"{side}{m}") for m in "wc")), side, "left")
    out = pairs.withColumns({m: tfidf.dot(F.col(f"l{m}"), F.col(f"r{m}")) for m in "wc"} | {f"{s}_{m}": F.col(f"{s}{m}").isNotNull() for s in "lr" for m in "wc"})
    return out.drop("lw", "lc", "rw", "rc")


def _cosine(pairs: DataFrame, words: DataFrame, characters: DataFrame) -> DataFrame:
    out = _products(pairs, words, characters)
    blocks = [F.col(f"{s}_w").cast("int") + F.col(f"{s}_c").cast("int") for s in "lr"]
    score = F.when((blocks[0] == 0) | (blocks[1] == 0), F.lit(0.0)).otherwise((F.col("w") + F.col("c")) / F.sqrt(blocks[0] * blocks[1]))
    return out.withColumn("cosine", F.round(score, 12)).drop("w", "c", "l_w", "l_c", "r_w", "r_c")


def classic_scores(texts: DataFrame, pairs: DataFrame, column: str = "norm") -> DataFrame:
    """``pairs`` (l, r) of ``texts`` (id, column) with their cosine over words and characters."""
    return _cosine(pairs, *_weights(texts, tx.word_features(F.col(column)), tx.char_features(F.col(column)), FEATURES))


def classic_candidates(texts: DataFrame, raw: DataFrame, words: DataFrame, characters: DataFrame) -> DataFrame:
    """Pairs (l, r) of ``texts`` (id, norm) that may pass the gate, each text with itself included.

    Half of a cosine is the words' product and half the characters', so 0.75 needs 0.5 of the words'. Only where neither
    side has words are characters all there is; a text with both against one without either stays below 1 / sqrt(2).
    """
    wordless = characters.join(words.select("id").distinct(), "id", "left_anti")
    by_cosine = tfidf.candidates(words, 2 * COSINE - 1).union(tfidf.candidates(wordless, COSINE))
    by_tokens = overlaps.contained_pairs(texts, "norm", FUZZY).union(overlaps.aligned_pairs(texts, "norm", FUZZY))
    found = by_cosine.union(by_tokens).union(overlaps.opposed_pairs(texts, raw, "norm"))
    return found.union(texts.select(F.col("id").alias("l"), F.col("id").alias("r"))).distinct()


def _sides(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*(F.col(c).alias(f"{s}_{c}") for c in keep)) for s in ("left", "right"))


def _rows_of(rows: DataFrame, scored: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """Row pairs of the scored text pairs; equal texts meet by their id.

    Few rows can make very many pairs, so tasks are dealt by the pairs that they will make, not by the bytes they read: a
    text that more than ``MEETINGS`` pairs of rows meet at is divided among tasks.
    """
    left, right = _sides(rows, [*keep, "text_id"])
    both = written(scored.select("l", "r", *values), "paired-texts")
    mirrored = both.unionByName(both.where("l <> r").select(F.col("r").alias("l"), F.col("l").alias("r"), *values))
    copies = written(rows.groupBy("text_id").agg(F.count("*").alias("copies")), "copies")
    asking = mirrored.join(copies.select(F.col("text_id").alias("l"), "copies"), "l").groupBy("r").agg(F.sum("copies").alias("asking"))
    work = written(asking.join(copies.withColumnRenamed("text_id", "r"), "r").select("r", (F.col("asking") * F.col("copies")).alias("meetings")), "meetings")
    tasks = max(1, min(MOST_TASKS, -(-(work.agg(F.sum("meetings")).first()[0] or 0) // MEETINGS)))
    hot = work.where(F.col("meetings") > MEETINGS).select("r", F.ceil(F.col("meetings") / MEETINGS).alias("shares"))
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    here = left.join(mirrored, left.left_text_id == mirrored.l).join(hot, "r", "left").withColumn("share", F.pmod(F.xxhash64("left_row_idx"), shares)).drop("shares")
    there = right.join(hot.withColumnRenamed("r", "right_text_id"), "right_text_id", "left").withColumn("right_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares")
    meet = (F.col("r") == F.col("right_text_id")) & (F.col("share") == F.col("right_share"))
    out = here.repartition(tasks, "r", "share").join(there.repartition(tasks, "right_text_id", "right_share"), meet)
    same = (F.col("left_document_id") == F.col("right_document_id")) & (F.col("left_position_id") == F.col("right_position_id"))
    return out.where((F.col("left_row_idx") < F.col("right_row_idx")) & ~same)


def find_pairs(positions: DataFrame, include_excluded: bool = True, block: tuple[str, ...] = ()) -> DataFrame:
    """Classic profile: positions (row_idx and the position columns, numbers parsed) to the pair table."""
    category, canonical = tx.normalize_unit(F.col("unit"))
    keep = list(dict.fromkeys(["row_idx", "document_id", "position_id", "work_description", "unit_category", "quantity", "unit_price", *block]))
    rows = positions.withColumns({"norm": tx.normalize_text(F.col("work_description")), "unit_category": category, "canonical_unit": canonical})
    held = ["work_description", *block]
    rows = written(rows.withColumn("text_id", F.xxhash64("norm", *held, *(F.col(c).isNull() for c in held))).select(*keep, "norm", "text_id"), "positions")
    texts = rows.select("norm", "work_description", *block, F.col("text_id").alias("id")).distinct()
    by_norm = written(rows.groupBy("norm").agg(F.count("*").alias("copies")).withColumn("id", F.xxhash64("norm")), "descriptions")
    weights = _weights(by_norm, tx.word_features(F.col("norm")), tx.char_features(F.col("norm")), FEATURES)
    spoken = texts.select(F.xxhash64("norm").alias("id"), F.col("work_description").alias("text")).distinct()
    pairs = classic_candidates(by_norm.select("id", "norm"), spoken, *weights)
    scored = _paired(by_norm, _cosine(pairs, *weights), ["norm"])
    same_text = F.col("l") == F.col("r")
    ratio = F.when(same_text & (F.col("l_norm") != ""), F.lit(100.0)).otherwise(F.round(sim.token_set_ratio(F.when(~same_text, F.col("l_norm")), "r_norm"), 9))
    scored = scored.withColumns({"fuzzy": ratio, "overlap": sim.meaningful_overlap(F.col("l_norm"), F.col("r_norm"))})
    scored = written(scored.where((F.col("cosine") >= COSINE) | (F.col("fuzzy") >= FUZZY) | (F.col("overlap") >= 2)), "scored-descriptions")
    raw = texts.select(F.xxhash64("norm").alias("norm_id"), "id", "work_description", *block)
    sides = [raw.select(F.col("norm_id").alias(s), F.col("id").alias(f"{s}_raw"), F.col("work_description").alias(f"{s}_text"), *(F.col(b).alias(f"{s}_{b}") for b in block)) for s in ("l", "r")]
    full = scored.join(sides[0], "l").join(sides[1], "r").where(F.lit(True) if not block else F.expr(" AND ".join(f"l_{b} <=> r_{b}" for b in block)))
    full = full.withColumn("conflict", sim.technical_conflict(F.col("l_text"), F.col("r_text")))
    full = full.where((F.col("cosine") >= COSINE) | (F.col("fuzzy") >= FUZZY) | F.col("conflict").isNotNull())
    full = full.where((F.col("l") != F.col("r")) | (F.col("l_raw") <= F.col("r_raw"))).select(F.col("l_raw").alias("l"), F.col("r_raw").alias("r"), "cosine", "fuzzy", "conflict")
    out = _rows_of(rows, full, keep, ["cosine", "fuzzy", "conflict"])
    side = lambda s: {c: F.col(f"{s}_{c}") for c in keep}
    compatible = (F.col("left_unit_category") == F.col("right_unit_category")) & (F.col("left_unit_category") != "unknown")
    out = out.withColumns(numbers.numeric_conflict(side("left"), side("right")))
    conflict = F.col("has_numeric_conflict")
    only_fuzzy = (F.col("cosine") < COSINE) & (F.col("fuzzy") >= FUZZY)
    out = out.withColumns({
        "pair_id": F.concat("left_document_id", F.lit(":"), "left_position_id", F.lit(" ↔ "), "right_document_id", F.lit(":"), "right_position_id"),
        "flag_type": F.when(only_fuzzy & conflict, "numeric").when(conflict & ~only_fuzzy, "both").otherwise("semantic"),
        "status": F.when(compatible & F.col("conflict").isNull(), "proposed").otherwise("excluded"),
        "filter_reason": F.coalesce("conflict", F.when(~compatible, "несовместимые категории единиц измерения")),
    })
    out = out if include_excluded else out.where("status = 'proposed'")
    renamed = {"left_index": "left_row_idx", "right_index": "right_row_idx", "left_description": "left_work_description", "right_description": "right_work_description", "embedding_score": "cosine", "fuzzy_score": "fuzzy"}
    return out.select(*(F.col(renamed.get(c, c)).alias(c) for c in PAIRS), F.col("left_unit_category").alias("unit_category"))


def in_order(pairs: DataFrame) -> DataFrame:
    """Proposed first, then by falling scores; ties by row."""
    return pairs.orderBy(*order())


def order() -> list[Column]:
    return [F.desc("status"), F.desc("embedding_score"), F.desc("fuzzy_score"), F.col("left_index"), F.col("right_index")]


# How categories are called in explanations.
CATEGORY_LABELS = {"length": "длина", "weight": "масса", "count": "количество", "area": "площадь", "volume": "объём", "unknown": "не определена"}


def explain_pair(pairs: DataFrame) -> DataFrame:
    """Adds ``explanation``; needs unit_category, the left side's."""
    label = F.coalesce(F.create_map(*(F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv))[F.col("unit_category")], F.col("unit_category"))
    shown = lambda c: F.coalesce(c, F.lit("null"))
    score, quantity, price = (shown(numbers.fixed(c, n)) for c, n in ((F.col("embedding_score"), 2), (F.col("quantity_diff_pct") * 100, 1), (F.col("price_diff_pct") * 100, 1)))
    # Both sentences.
    excluded = F.concat(F.lit("Текстовое сходство "), score, F.lit(", но пара исключена фильтром: "), F.coalesce("filter_reason", F.lit("None")), F.lit(". Это не предложение дубля."))
    proposed = F.concat(F.lit("Сходство описаний "), score, F.lit("; единицы совместимы ("), shown(label), F.lit("). Объём расходится на "), quantity, F.lit("%, цена — на "), price, F.lit("%. Система только предлагает проверить пару; итоговое решение принимает эксперт."))
    return pairs.withColumn("explanation", F.when(F.col("status") == "excluded", excluded).otherwise(proposed))


def _panel() -> Column:
    """What a reviewer sees of a row; the labels are fixed values."""
    c = lambda n: tx.text(F.col(n))
    number = lambda n: numbers.format_number(F.col(n))
    norm = F.when(c("norm_ref") == "", "—").otherwise(c("norm_ref"))
    entries = [("Документ", c("document_id")), ("№ позиции", c("position_id")), ("Лист / страница", c("page_or_sheet")), ("Наименование", c("work_description")), ("Ед. изм.", c("unit")), ("Объём", number("q")), ("Цена", F.concat(number("p"), F.lit(" ₸"))), ("Норма", norm)]
    return F.create_map(*(x for k, v in entries for x in (F.lit(k), v)))


def web_pairs(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Web profile: the review cases, and the number of pairs that only technical traps exclude (one row).

    Document frequencies count rows, as that profile does: a description that occurs twice counts twice.
    """
    texts = {name: tx.text(F.col(c)) for name, c in (("document", "document_id"), ("position", "position_id"), ("title", "work_description"), ("unit_text", "unit"))}
    rows = positions.withColumns({"norm": tx.normalize(F.col("work_description")), "ref": F.when(tx.text(F.col("norm_ref")) != "", tx.normalize(F.col("norm_ref"))), "category": tx.unit_category(F.col("unit")), "q": numbers.parse_lenient(F.col("quantity")), "p": numbers.parse_lenient(F.col("unit_price"))})
    rows = rows.withColumns(texts | {"panel": _panel(), "text_id": F.xxhash64("norm")})
    keep = ["row_idx", "text_id", "ref", "category", "q", "p", *texts, "panel"]
    rows = written(rows.select(*keep, "norm"), "web-positions")
    by_norm = written(rows.groupBy("norm").agg(F.count("*").alias("copies")).withColumn("id", F.xxhash64("norm")), "web-descriptions")
    words, characters = _weights(by_norm, tx.tokens(F.col("norm")), tx.grams(F.col("norm")))
    named = rows.where("ref IS NOT NULL").select("ref", "text_id").distinct()
    by_ref = named.withColumnRenamed("text_id", "l").join(named.withColumnRenamed("text_id", "r"), "ref").where("l <= r").select("l", "r")
    alone = by_norm.select(F.col("id").alias("l"), F.col("id").alias("r"))
    pairs = tfidf.candidates(words, WEB_TRAP).union(tfidf.candidates(characters, WEB_TRAP)).union(by_ref).union(alone).distinct()
    scored = _paired(by_norm, _products(pairs, words, characters), ["norm"])
    scored = scored.select("l", "r", F.round(0.58 * F.col("w") + 0.42 * F.col("c"), 12).alias("similarity"), sim.has_trap(F.col("l_norm"), F.col("r_norm")).alias("trap"))
    scored = written(scored, "web-scores")
    near = scored.where(F.col("similarity") >= WEB_TRAP)
    both = near.union(near.where("l <> r").select(F.col("r").alias("l"), F.col("l").alias("r"), "similarity", "trap"))
    left, right = _sides(rows, keep)
    in_line = F.col("left_row_idx") < F.col("right_row_idx")
    full = left.join(both, F.col("left_text_id") == F.col("l")).join(right, (F.col("r") == F.col("right_text_id")) & in_line).drop("l", "r")
    far = scored.where((F.col("similarity") < WEB_TRAP) & ~F.col("trap"))
    of_ref = left.join(right, (F.col("left_ref") == F.col("right_ref")) & in_line)
    of_ref = of_ref.join(far, (F.least("left_text_id", "right_text_id") == F.col("l")) & (F.greatest("left_text_id", "right_text_id") == F.col("r"))).drop("l", "r")
    full = full.unionByName(of_ref).where(~((F.col("left_document") == F.col("right_document")) & (F.col("left_position") == F.col("right_position"))))
    trapped = full.where(F.col("trap") & (F.col("similarity") >= WEB_TRAP)).agg(F.count("*").alias("excluded_technical_traps"))
    same_ref = F.coalesce(F.col("left_ref") == F.col("right_ref"), F.lit(False))
    full = full.where(~F.col("trap") & ((F.col("similarity") >= WEB_SCORE) | same_ref))
    full = full.withColumns({"same_unit": F.col("left_category") == F.col("right_category"), "dq": numbers.percent(F.col("left_q"), F.col("right_q")), "dp": numbers.percent(F.col("left_p"), F.col("right_p"))})
    conflict = ~F.col("same_unit") | (F.col("dq") > 0.15) | (F.col("dp") > 0.15)
    severity = F.when(~F.col("same_unit") | (F.col("dp") > 0.3) | (F.col("dq") > 0.3), "critical").when(conflict, "high").when(F.col("similarity") >= 0.76, "medium").otherwise("info")
    listed = F.array_compact(F.array(F.when(~F.col("same_unit"), F.concat(F.lit("единицы: "), F.col("left_unit_text"), F.lit(" ↔ "), F.col("right_unit_text"))), F.when(F.col("dq") > 0.001, F.concat(F.lit("объём "), numbers.pct(F.col("dq")))), F.when(F.col("dp") > 0.001, F.concat(F.lit("цена "), numbers.pct(F.col("dp"))))))
    # The sentences of an explanation and of a difference, above and below.
    documents = F.array_distinct(F.array(F.col("left_document"), F.col("right_document")))
    explanation = F.concat(F.lit("TF‑IDF сходство по словам и символьным n‑граммам: "), F.format_string("%.1f", F.col("similarity") * 100), F.lit("%. "), F.when(F.col("same_unit"), "Категории единиц совместимы.").otherwise("Категории единиц различаются."), F.lit(" "), F.when(conflict, "Есть числовое отклонение выше порога 15% или конфликт единиц.").otherwise("Критических числовых расхождений не найдено."), F.lit(" Окончательное решение принимает эксперт."))
    cases = full.select(
        F.concat(F.lit("EST-"), numbers.fnv_id(F.concat_ws("|", F.array_join(documents, "|"), F.col("left_position"), F.col("right_position")))).alias("id"),
        F.lit("estimate").alias("type"), severity.alias("severity"), F.col("left_title").alias("title"),
        F.concat(F.col("left_position"), F.lit(" ↔ "), F.col("right_position"), F.lit(" · "), F.array_join(documents, " / ")).alias("subtitle"),
        F.when(F.size(listed) == 0, "семантически близкие позиции").otherwise(F.array_join(listed, " · ")).alias("difference"), explanation.alias("explanation"),
        F.col("left_panel").alias("left"), F.col("right_panel").alias("right"), documents.alias("documents"), F.round("similarity", 3).alias("score"),
        F.when(conflict, "both").otherwise("semantic").alias("flag_type"), F.col("left_row_idx").alias("left_index"), F.col("right_row_idx").alias("right_index"))
    return cases, trapped
