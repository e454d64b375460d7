"""Text similarity behind one interface: TF-IDF of the texts, or vectors that another system has made."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from concordat.operators import vectors as joins
from concordat.operators.positions import COSINE, classic_scores
from concordat.stages import written


class Backend(Protocol):
    def metadata(self) -> dict[str, str]: ...

    def scores(self, pairs: DataFrame) -> DataFrame: ...


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision; 0 if either is a zero vector or null, or their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


class TfidfBackend:
    """Words and characters of ``texts`` (id, column)."""

    def __init__(self, texts: DataFrame, column: str = "norm") -> None:
        self.texts, self.column = texts, column

    def metadata(self) -> dict[str, str]:
        return {"backend": "tfidf", "model_name": "", "fallback_used": "true", "similarity_threshold": str(COSINE)}

    def scores(self, pairs: DataFrame) -> DataFrame:
        return classic_scores(self.texts, pairs, self.column)


class VectorBackend:
    """Vectors of a sentence encoder, by id. Each side of a pair is fetched by a join; nothing is encoded here."""

    def __init__(self, vectors: DataFrame, model: str, key: str = "id", vector: str = "vector") -> None:
        self.vectors, self.model = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), model

    def metadata(self) -> dict[str, str]:
        return {"backend": "vectors", "model_name": self.model, "fallback_used": "false", "similarity_threshold": str(COSINE)}

    def scores(self, pairs: DataFrame) -> DataFrame:
        for side in ("l", "r"):
            pairs = pairs.join(self.vectors.select(F.col("id").alias(side), F.col("v").alias(f"{side}_v")), side, "left")
        return pairs.withColumn("cosine", F.round(F.coalesce(cosine(F.col("l_v"), F.col("r_v")), F.lit(0.0)), 12)).drop("l_v", "r_v")

    def pairs(self, least: float = COSINE) -> tuple[DataFrame, DataFrame]:
        """All pairs of different vectors with a cosine of ``least`` or more (l, r, cosine), by the smallest id of each vector, and whose vector each id has (id, class, copies)."""
        named = written(joins.classes(self.vectors, "id", "v"), "vector-classes")
        return joins.similar_pairs(named, least).withColumn("cosine", F.round("cosine", 12)), named.select("id", "class", "copies")


def described(scored: DataFrame, backend: Backend) -> DataFrame:
    """Scores with the backend's metadata beside them."""
    return scored.withColumns({name: F.lit(value) for name, value in backend.metadata().items()})


#: How a backend may be asked for, and what is said of others and of one that isn't there.
MODES = ("auto", "sentence-transformers", "tfidf")
BAD_MODE = "ESTIMATE_EMBEDDING_BACKEND: use auto, sentence-transformers or tfidf"


def chosen(mode: str, texts: DataFrame, encoded: DataFrame | None, model: str, column: str = "norm") -> Backend:
    """The backend of a mode: vectors made elsewhere (``encoded``: id, vector) where they are there, else TF-IDF; a forced mode has no fallback."""
    if (mode := mode.lower()) not in MODES:
        raise ValueError(BAD_MODE)
    if mode != "tfidf" and encoded is not None:
        return VectorBackend(encoded, model)
    if mode == "sentence-transformers":
        raise RuntimeError(f"Не удалось загрузить локальную модель {model}")
    return TfidfBackend(texts, column)
