"""Bounded labelled samples and their features, for models that are trained on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushjoin.llm.common import crc_mod, map_columns
from hushjoin.llm.features import STYLE, Marks, style_of, words_of

#: The most labelled rows a model is fitted on: those with the least hash of their id.
SAMPLE_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, parts: int, held_out: int, most: int = SAMPLE_ROWS):
    """Style matrix, marks and 0/1 targets of at most `most` labelled documents outside the held-out part."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("double").alias("y"))
    rows = rows.filter((crc_mod("id", parts) != held_out) & F.col("y").isin(0.0, 1.0)).distinct()
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    picked = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(rows), "id")  # at most `most` rows

    def start():
        marks = Marks()

        def mapper(cols):
            out = {"id": cols["id"], "y": cols["y"], "style": [], "marks": []}
            for text in cols["text"]:
                words, counts = words_of(text)
                out["style"].append(np.array(style_of(text, words, counts)).tobytes())
                out["marks"].append(marks.of(counts, len(words)).tobytes())
            return out

        return mapper

    got = map_columns(picked, start, "id long, y double, style binary, marks binary").toPandas()
    got = got.sort_values(["id", "y"], kind="stable").drop_duplicates(["id", "y"]).head(most)
    style = np.array([np.frombuffer(s) for s in got["style"]]).reshape(-1, len(STYLE))
    return style, [np.frombuffer(m, np.int32) for m in got["marks"]], got["y"].to_numpy(float)


def edges_of(style: np.ndarray, bins: int = 10) -> np.ndarray:
    """Inner quantile edges of every style figure: shape (figures, bins - 1)."""
    if not len(style):
        return np.zeros((len(STYLE), bins - 1))
    return np.quantile(style, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T


def binned(style: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each figure and edge, whether the figure is over the edge."""
    return (style[:, :, None] > edges[None, :, :]).reshape(len(style), -1).astype(np.float32)
