"""Quality scores by Bradley-Terry ranking.

Preference pairs (a document labelled 1 over one labelled 0) are drawn with a fixed seed from a bounded labelled
sample, and weights are learned by logistic loss on the difference of the two documents' features. A document's
raw score is its weighted feature sum. The sample's raw scores are cut at the quantile that separates the
labels best, and scores are mapped to 0..1 so that the cut lies at 0.3.

Null and empty texts get the score of a text without words. Without both labels in the sample there is nothing
to rank: every score is 0.3 and every document is kept. Repeated rows are scored alike. Rows with a null id are
scored and never held out. Texts of any length are read whole. quality_scores() ignores other columns; keep_good()
carries them, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushjoin.llm.common import crc_mod, free_name, map_columns
from hushjoin.llm.features import Marks, informative, matrix, style_of, words_of
from hushjoin.llm.training import SAMPLE_ROWS, binned, edges_of, labelled_sample

CUT = 0.3
PARTS, HELD_OUT = 5, 0
PAIRS = 40_000
MARKS = 400
SEED = 11


@dataclass
class Ranker:
    edges: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 0.0

    def raw(self, style: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
        return np.hstack([binned(style, self.edges), matrix(marks, self.columns)]) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        """0..1, rising with raw; CUT at the cut."""
        z = np.clip(self.slope * (raw - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 2e-3, steps: int = 300, seed: int = SEED) -> np.ndarray:
    """Weights w that make w.(x_better - x_worse) large: Adam on the logistic loss over seeded pairs."""
    rng = np.random.RandomState(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    if not len(good) or not len(bad):
        return w
    first, second = rng.choice(good, pairs), rng.choice(bad, pairs)
    for t in range(1, steps + 1):
        part = rng.randint(0, pairs, 4096)
        d = x[first[part]] - x[second[part]]
        miss = (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))).astype(np.float32)
        g = l2 * w - d.T @ miss / len(part)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(0.05) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w


def best_quantile(raw: np.ndarray, y: np.ndarray) -> float:
    """The raw score at the quantile that leaves the fewest labels on the wrong side, midway between neighbours."""
    order = np.argsort(raw, kind="stable")
    s, t = raw[order], y[order]
    wrong = np.r_[0, np.cumsum(t)] + np.r_[np.cumsum((1 - t)[::-1])[::-1], 0]  # below the cut: 0, above: 1
    edge = np.r_[True, s[1:] > s[:-1], True]  # cuts only between different scores
    wrong = np.where(edge, wrong, np.inf)
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    if k == 0:
        return float(s[0] - 1e-6)
    if k == len(s):
        return float(s[-1] + 1e-6)
    return float((s[k - 1] + s[k]) / 2)


def fit(style: np.ndarray, marks: list[np.ndarray], y: np.ndarray) -> Ranker:
    edges, columns = edges_of(style), informative(marks, y, least=10, most=MARKS, z=6.0)
    out = Ranker(edges, columns, np.zeros(edges.size + len(columns)))
    if 0 < y.sum() < len(y):
        x = np.hstack([binned(style, edges), matrix(marks, columns)])
        out.weights = bradley_terry(x, y)
        raw = x @ out.weights
        out.cut = best_quantile(raw, y)
        out.slope = 1.0
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Ranker:
    """Fit on at most `most` labelled rows whose crc32 of the id modulo 5 is not 0."""
    return fit(*labelled_sample(docs, labels, "quality", PARTS, HELD_OUT, most))


def scored(docs: DataFrame, model: Ranker, column: str = "score") -> DataFrame:
    """docs with one more column, the score. The text column is read whole."""
    schema = StructType([*docs.schema.fields]).add(column, "double")

    def start():
        chosen = Marks(model.columns)

        def mapper(cols):
            style, marks = [], []
            for text in cols["text"]:
                words, counts = words_of(text)
                style.append(style_of(text, words, counts))
                marks.append(chosen.of(counts, len(words)))
            return cols | {column: model.score(model.raw(np.array(style), marks)).tolist()}

        return mapper

    return map_columns(docs, start, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select("doc_id", "text")
    out = scored(docs, train(docs, labels))
    held = F.coalesce(crc_mod("doc_id", PARTS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of CUT or more, with their own columns."""
    score = free_name(docs, "__score")
    return scored(docs, train(docs.select("doc_id", "text"), labels), score).filter(F.col(score) >= CUT).select(*docs.columns)
