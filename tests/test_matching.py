from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from concordat.functions import similarity as sim, text as tx
from concordat.operators import positions, requisites, search, tfidf
from concordat.sources.tables import demo_rows, parsed_positions, validated

POSITIONS = [
    ("A", "1", "1", "Укладка кабельной силовой линии по лоткам", "м", "120", "2320", "N1"),
    ("A", "2", "1", "Монтаж оптического кабеля внутри здания", "м", "300", "4665", "N2"),
    ("A", "3", "1", "Окраска металлических конструкций", "м2", "80", "3100", "N3"),
    ("A", "4", "1", "Труба горячей воды стальная", "м", "190", "4900", ""),
    ("A", "5", "1", "Извещатель пожарный дымовой", "шт", "36", "19300", "N5"),
    ("B", "1", "2", "Прокладка силового кабеля в лотке", "метров", "162", "1850", "N1"),
    ("B", "2", "2", "Прокладка волоконно-оптической линии в помещении", "м", "300", "4570", "N2"),
    ("B", "3", "2", "Металл құрылымдарды сырлау", "кв.м", "80", "2350", "N3"),
    ("B", "4", "2", "Труба холодной воды стальная", "м", "175", "4450", ""),
    ("B", "5", "2", "Извещатель пожарный", "шт", "14", "16800", "N5"),
    ("B", "6", "2", "Извещатель пожарный", "т", "14", "16800", ""),
]
REQUISITES = [
    ("D1", "1", "ТОО «Альфа Строй»", "123456789012", "г. Алматы, ул. Абая 1", "Банк А", "ABCDKZKA", "KZ123456789012345678"),
    ("D2", "1", "Альфа Строй ТОО", "123456789012", "г Алматы ул Абая 1", "Банк А", "ABCDKZKA", "KZ123456789012345678"),
    ("D3", "1", "Альфа-Строй", "123456789012", "г. Алматы, ул. Абая 1", "Банк Б", "ABCDKZKA", "KZ123456789012345678"),
    ("D4", "1", "Альфа Строй", "999456789012", "г. Алматы, ул. Абая 1", "Банк А", "ABCDKZKA", "KZ123456789012345678"),
    ("D5", "1", "Альфа Стройй", "123456789012", "г. Астана", "Банк А", "ABCDKZKA", "KZ123456789012345678"),
    ("D6", "1", "Альянс Снаб", "555456789012", "г. Астана", "Банк А", "ABCDKZKA", "KZ123456789012345678"),
]


def brute_scores(norms):
    def block(features, cap=None):
        docs = [Counter(features(t)) for t in norms]
        df = Counter(f for d in docs for f in d)
        total = Counter()
        for d in docs:
            total.update(d)
        kept = {f for f, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:cap]}
        out = []
        for d in docs:
            v = {f: (1 + math.log(c)) * (math.log((len(docs) + 1) / (df[f] + 1)) + 1) for f, c in d.items() if f in kept}
            n = math.sqrt(sum(x * x for x in v.values()))
            out.append({f: x / n for f, x in v.items()})
        return out

    def words(t):
        w = [x for x in t.split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def chars(t):
        out = []
        for w in t.split():
            p = f" {w} "
            for n in (3, 4, 5):
                out += [p[i : i + n] for i in range(max(1, len(p) - n + 1))]
                if len(p) <= n:
                    break
        return out

    a, b = block(words), block(chars, positions.FEATURES)
    dot = lambda x, y: sum(v * y.get(f, 0) for f, v in x.items())
    return lambda i, j: (dot(a[i], a[j]) + dot(b[i], b[j])) / math.sqrt(((bool(a[i]) + bool(b[i])) * (bool(a[j]) + bool(b[j]))) or 1)


@pytest.fixture(scope="module")
def estimate(spark):
    return parsed_positions(validated(demo_rows(spark, "estimate", POSITIONS), "estimate"))


def test_pairs_equal_all_pairs_rules(spark, estimate):
    norms = [r[0] for r in estimate.orderBy("row_idx").select(tx.normalize_text(F.col("work_description"))).collect()]
    score = brute_scores(norms)
    got = {(r["left_index"], r["right_index"]): r for r in positions.find_pairs(estimate).collect()}
    expected = {}
    for i, j in combinations(range(len(POSITIONS)), 2):
        cos, fuzzy = score(i, j), sim.token_set(norms[i], norms[j])
        low = (POSITIONS[i][3].lower(), POSITIONS[j][3].lower())
        clash = any({s for s in f if s in low[0]} and {s for s in f if s in low[1]} and {s for s in f if s in low[0]} != {s for s in f if s in low[1]} for f in sim.QUALIFIERS)
        shared = len(set(norms[i].split()) & set(norms[j].split()) - set(sim.STOPWORDS))
        if cos >= 0.75 or fuzzy >= 82 or (clash and shared >= 2):
            expected[i, j] = (cos, fuzzy)
    assert set(got) == set(expected)
    for k, (cos, fuzzy) in expected.items():
        assert got[k]["embedding_score"] == pytest.approx(cos, abs=1e-9) and got[k]["fuzzy_score"] == pytest.approx(fuzzy, abs=1e-6)
    assert got[0, 5]["status"] == "proposed" and got[0, 5]["flag_type"] == "both" and got[0, 5]["quantity_diff_pct"] == pytest.approx(42 / 162)
    assert got[2, 7]["status"] == "proposed" and got[1, 6]["flag_type"] == "semantic"
    assert got[0, 1]["status"] == "excluded" and "силов" in got[0, 1]["filter_reason"] and got[3, 8]["status"] == "excluded"
    assert got[9, 10]["status"] == "excluded" and got[9, 10]["unit_mismatch"]
    assert {r["status"] for r in positions.find_pairs(estimate, include_excluded=False).collect()} == {"proposed"}
    shown = positions.in_order(positions.explain_pair(positions.find_pairs(estimate))).collect()
    assert [r["status"] for r in shown] == sorted((r["status"] for r in shown), reverse=True) and "Сходство описаний 1.00" in shown[0]["explanation"]


def test_blocks_and_empty(spark, estimate):
    only = positions.find_pairs(estimate, block=("document_id",)).collect()
    assert only and all(r["left_document_id"] == r["right_document_id"] for r in only)
    empty = positions.find_pairs(estimate.limit(0))
    assert empty.count() == 0 and empty.columns[:18] == positions.PAIRS


def test_web_positions(spark):
    rows = demo_rows(spark, "estimate", POSITIONS)
    cases, trapped = positions.web_pairs(rows)
    got = {(r["left_index"], r["right_index"]): r for r in cases.collect()}
    assert {(0, 5), (1, 6), (2, 7), (4, 9)} <= set(got) and (3, 8) not in got
    assert got[0, 5]["severity"] == "critical" and got[0, 5]["flag_type"] == "both" and got[0, 5]["difference"].startswith("единицы: м ↔ метров · объём 25,9%")
    assert got[1, 6]["left"]["Цена"] == "4 665 ₸" and got[1, 6]["documents"] == ["A", "B"] and got[1, 6]["id"].startswith("EST-")
    assert trapped.first()[0] >= 1
    assert search.find_cases(cases, "ОКРАСКА", document="B").count() == 1


def test_prefix_index_finds_every_similar_pair(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} x{i // 4}") for i in range(60)], "id long, t string")
    v = tfidf.vectors(docs, F.split("t", " "))
    rows = {}
    for r in v.collect():
        rows.setdefault(r["id"], {})[r["feature"]] = r["weight"]
    near = {(i, j) for i, j in combinations(sorted(rows), 2) if sum(w * rows[j].get(f, 0) for f, w in rows[i].items()) >= 0.5}
    found = {tuple(r) for r in tfidf.candidates(v, 0.5).collect()}
    assert near and near <= found


def test_classic_requisites(spark):
    rows = demo_rows(spark, "requisite", REQUISITES)
    flags = requisites.in_order(requisites.find_conflicts(rows, include_info=True)).collect()
    got = {r["flag_id"]: (r["severity"], tuple(r["changed_fields"])) for r in flags}
    assert got == {
        "D1 ↔ D2": ("info", ("entity_name",)), "D1 ↔ D3": ("critical", ("bank_name",)), "D2 ↔ D3": ("critical", ("bank_name",)),
        "D1 ↔ D4": ("high", ("bin",)), "D2 ↔ D4": ("high", ("bin",)), "D3 ↔ D4": ("high", ("bin", "bank_name")),
        "D1 ↔ D5": ("medium", ("legal_address",)), "D2 ↔ D5": ("medium", ("legal_address",)), "D3 ↔ D5": ("critical", ("legal_address", "bank_name")),
    }
    assert [r["severity"] for r in flags] == sorted((r["severity"] for r in flags), key=["critical", "high", "medium", "info"].index)
    assert "различаются: банк. Проверить реквизиты до оплаты" in flags[0]["explanation"]
    assert requisites.find_conflicts(rows).count() == 8


def test_web_requisites(spark):
    got = {r["subtitle"]: r for r in requisites.web_cases(demo_rows(spark, "requisite", REQUISITES)).collect()}
    assert got["D1 ↔ D3"]["severity"] == "critical" and got["D1 ↔ D5"]["severity"] == "medium"
    assert "D1 ↔ D6" not in got and got["D1 ↔ D3"]["left"]["БИН"] == "123456789012" and got["D1 ↔ D3"]["id"].startswith("REQ-")
