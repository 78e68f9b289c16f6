"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (marks, that is words and first letters of words, which labelled
toxic documents use far more often) and pattern voters (shouting, exclamation, digits in words). Each votes
toxic, clean or abstains. A generative label model learns how accurate each voter is and how correlated voters
are, by expectation maximisation without labels; correlated voters share one vote. A linear classifier is then
trained on the posterior labels, and it scores every text.

Null and empty texts get the score of a text without marks. Without both labels in the sample every score is
the share of label 1 (0 if there are no labels). Repeated rows are scored alike; rows with a null id are scored
and never held out. Texts of any length are read whole. Other columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushjoin.llm.common import crc_mod, map_columns
from hushjoin.llm.features import STYLE, Marks, informative, matrix, words_of
from hushjoin.llm.training import SAMPLE_ROWS, labelled_sample

CUT = 0.3
PARTS, HELD_OUT = 4, 2
VOTERS = 120
MARKS = 1000
SEED = 5
PATTERNS = (("bang_words", 0.2), ("upper_words", 0.3), ("digit_chars", 0.05), ("symbol_chars", 0.05), ("same_next", 0.2))


def votes(style: np.ndarray, marks: list[np.ndarray], lexicon: np.ndarray) -> np.ndarray:
    """1 (toxic), -1 (clean) or 0 (abstains), a column a voter: a lexicon voter abstains where its mark is missing;
    one voter says clean where no lexicon mark is present; pattern voters say toxic over their level."""
    hits = matrix(marks, lexicon)
    none = np.where(hits.any(axis=1), 0, -1)[:, None]
    pattern = np.stack([(style[:, STYLE.index(k)] > level).astype(int) for k, level in PATTERNS], axis=1)
    return np.hstack([hits, none, pattern]).astype(np.float32)


@dataclass
class LabelModel:
    """told: log odds a vote adds, by vote (1, -1, 0) and voter; group: of voters that move together."""

    told: np.ndarray
    group: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance of label 1. A group of correlated voters speaks once, with its strongest vote."""
        said = np.where(v == 1, self.told[0], np.where(v == -1, self.told[1], self.told[2]))
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for g in np.unique(self.group):
            part = said[:, self.group == g]
            z += part[np.arange(len(v)), np.abs(part).argmax(axis=1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """EM over P(vote | label). Every ten rounds, voters' residuals (the vote less what the posterior explains) are
    correlated, and voters that stay correlated over 0.2 form a group."""
    n, k = v.shape
    present = [(v == j).astype(np.float32) for j in (1, -1, 0)]
    base = np.stack([p.mean(axis=0) for p in present])
    lean = (v == 1).sum(axis=1) - 2 * (v == -1).sum(axis=1)
    post = np.where(lean > 0, 0.95, 0.02)
    model = LabelModel(np.zeros((3, k)), np.arange(k), prior)
    for r in range(rounds):
        rate = np.empty((2, 3, k))
        for y, p in enumerate((1 - post, post)):
            for j in range(3):
                rate[y, j] = (p @ present[j] + 0.5 * base[j]) / (p.sum() + 0.5)
        rate = np.clip(rate, 1e-4, 1)
        model.told = np.log(rate[1]) - np.log(rate[0])
        if r % 10 == 0:
            mean = np.outer(post, rate[1, 0] - rate[1, 1]) + np.outer(1 - post, rate[0, 0] - rate[0, 1])
            left = v - mean
            norm = np.sqrt((left**2).sum(axis=0)) + 1e-9
            near = np.abs((left.T @ left) / np.outer(norm, norm)) > 0.2
            group = np.arange(k)
            for _ in range(k):  # the least number spreads through what is correlated
                low = np.where(near, group[None, :], k).min(axis=1)
                low = np.minimum(low, group)
                if (low == group).all():
                    break
                group = low
            model.group = group
        new = model.posterior(v)
        if r % 10 and np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model


def logistic(x: np.ndarray, target: np.ndarray, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear classifier on soft targets: Adam on the full logistic loss, l2 in units of one row."""
    n, k = x.shape
    w, m, s = (np.zeros(k + 1, np.float32) for _ in range(3))
    x1 = np.ones((n, k + 1), np.float32)
    x1[:, :-1] = x
    target = target.astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = (p - target) @ x1 / np.float32(n)
        g[:-1] += np.float32(l2 / n) * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - np.float32(0.15) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(s / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w[:-1].astype(float), float(w[-1])


@dataclass
class Toxicity:
    columns: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, marks: list[np.ndarray]) -> np.ndarray:
        z = matrix(marks, self.columns) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(style: np.ndarray, marks: list[np.ndarray], y: np.ndarray) -> Toxicity:
    share = float(y.mean()) if len(y) else 0.0
    empty = Toxicity(np.empty(0, np.int32), np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not 0 < share < 1:
        return empty
    strong = informative(marks, y, least=5, most=4 * VOTERS, z=7.2)
    hits = matrix(marks, strong)
    n1, n0 = (hits * y[:, None]).sum(axis=0), (hits * (1 - y)[:, None]).sum(axis=0)
    sure = np.where(n1 / (n1 + n0 + 0.1) > 0.9, n1, 0)  # lexicon: marks that nearly only toxic texts have
    lexicon = np.sort(strong[np.argsort(-sure, kind="stable")[: min(VOTERS, int((sure > 0).sum()))]])
    model = label_model(votes(style, marks, lexicon), share)
    post = model.posterior(votes(style, marks, lexicon))
    columns = np.union1d(informative(marks, post, least=5, most=MARKS, z=6.0), lexicon).astype(np.int32)
    # texts with some of their marks taken out, judged anew by the label model: few marks must be enough
    rng = np.random.RandomState(SEED)
    thin = [[m[rng.rand(len(m)) < keep] for m in marks] for keep in (1.0, 0.3, 0.1)]
    rows = [m for part in thin for m in part]
    target = np.concatenate([model.posterior(votes(style, part, lexicon)) for part in thin])
    weights, bias = logistic(matrix(rows, columns), target)
    return Toxicity(columns, weights, bias)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on at most `most` labelled rows whose crc32 of the id modulo 4 is not 2."""
    return fit(*labelled_sample(docs, labels, "toxic", PARTS, HELD_OUT, most))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels)

    def start():
        chosen = Marks(model.columns)

        def mapper(cols):
            marks = [chosen.of(counts, len(words)) for words, counts in map(words_of, cols["text"])]
            return {"doc_id": cols["doc_id"], "score": model.score(marks).tolist()}

        return mapper

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_columns(docs, start, f"doc_id {kind}, score double")
    held = F.coalesce(crc_mod("doc_id", PARTS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
