"""Quality by ordinal cumulative-link regression on hashed text (operator 7)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import Remembered, columns_added
from barlight.llm.langid import held_out

BITS = 18
#: Bounds of the sample that weights are fitted on, whatever the number of rated rows.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 40_000_000
ROUNDS = 150
RATE = 0.05
RIDGE = 1e-5
LETTER = re.compile(r"[^\W\d_]+")
SHAPE = re.compile(r"\w+")


def _slot(name: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def token_slots(token: str) -> tuple[int, ...]:
    """Hashed features of a token: its words, their beginnings and ends, its shape."""
    shape = SHAPE.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "1" if m[0].isdigit() else "a", token)
    names = [f"s:{shape[:12]}"]
    for word in LETTER.findall(token.lower()):
        names += [f"w:{word}", f"b:{word[:5]}"]
    return tuple(_slot(n) for n in names)


def text_slots(tokens: list[str]) -> tuple[int, ...]:
    """Hashed features of a whole text: its length and how much of it repeats."""
    n = len(tokens)
    share = len(set(tokens)) / n if n else 0.0
    return _slot(f"n:{n.bit_length()}"), _slot(f"r:{round(share * 20)}"), _slot(f"r2:{round(share * 5)}")


@dataclass
class Model:
    """Weights shared by all grades and the ordered thresholds between them."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[float]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest: falling from left to right."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def hashed(text: str | None, slots_of: Callable[[str], tuple[int, ...]] = token_slots) -> tuple[np.ndarray, np.ndarray, float]:
    """Distinct slots of a text's distinct tokens, how many features fall into each, and their common value.

    At most 2^BITS slots, however long the text.
    """
    tokens = (text or "").split()
    distinct = set(tokens)
    found = [s for t in distinct for s in slots_of(t)]
    slots, times = np.unique(np.array([*found, *text_slots(tokens)], np.int64), return_counts=True)
    return slots, times, 1 / float(np.sqrt(max(len(distinct), 1) + 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], grades: list[float], rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with a small ridge by Adam steps on all hashed rows; thresholds stay ordered.

    With P(y <= k) = s(t_k - x.w), the derivative of -log P(y = k) by the score is
    1 - s(t_k - x.w) - s(t_(k-1) - x.w) with its sign turned. Thresholds are a first one and
    logarithms of the steps between them.
    """
    kinds = sorted(set(grades))
    y = np.searchsorted(kinds, grades)
    used, column = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    sizes = np.array([len(r[0]) for r in rows])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    value = np.concatenate([r[1] * r[2] for r in rows])
    k = len(kinds) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:k] / len(y)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = len(y)
    for step in range(1, rounds + 1):
        w = x[: len(used)]
        widths = np.exp(x[len(used) + 1 :])
        t = x[len(used)] + np.concatenate([[0.0], np.cumsum(widths)])
        score = np.add.reduceat(w[column] * value, begin)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        above = 1 / (1 + np.exp(-np.clip(edges[y + 1] - score, -40, 40)))
        below = 1 / (1 + np.exp(-np.clip(edges[y] - score, -40, 40)))
        p = np.maximum(above - below, 1e-12)
        up, down = above * (1 - above) / p, below * (1 - below) / p
        slope = (up - down) / n  # by the score
        grad = np.zeros_like(x)
        grad[: len(used)] = np.bincount(column, np.repeat(slope, sizes) * value, len(used)) + RIDGE * w
        by_edge = np.bincount(y, -up / n, k + 1)[:k] + np.bincount(y, down / n, k + 1)[1:]
        later = np.cumsum(by_edge[::-1])[::-1]
        grad[len(used)] = later[0]
        grad[len(used) + 1 :] = later[1:] * widths
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[: len(used)]
    thresholds = x[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(used) + 1 :]))])
    return Model(weights, thresholds, [float(g) for g in kinds])


def learn(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on ratings(doc_id, grade) of docs(doc_id, text): a sample of about sample_rows rows or sample_chars characters.

    Rows are chosen by a hash of doc_id; nulls are left out, of repeated ratings the least counts;
    repeated documents count each time. Texts are hashed where they lie, and the driver gets
    slots only: at most 2^BITS a text. The sample's bound makes its ids small enough to broadcast.
    Without two grades the model has no thresholds and answers the one grade, or 0.
    """
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rate = min(1.0, sample_rows / max(rated.count(), 1))
    chosen = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(rate * 1_000_000))
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > sample_chars:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < round(sample_chars / chars * 1_000_000))

    def made() -> Callable[[list], dict[str, list]]:
        known = Remembered(token_slots, 32 << 20)

        def found(texts: list[str]) -> dict[str, list]:
            known.trimmed()
            each = [hashed(t, known.__getitem__) for t in texts]
            return {
                "slots": [s.astype("<i4").tobytes() for s, _, _ in each],
                "times": [n.astype("<u4").tobytes() for _, n, _ in each],
                "value": [v for _, _, v in each],
            }

        return found

    sample = columns_added(rows, ["doc_id", "grade"], made, "slots binary, times binary, value double")
    found = sorted(
        (r["doc_id"], float(r["grade"]), bytes(r["slots"]), bytes(r["times"]), r["value"]) for r in sample.toLocalIterator()
    )
    kinds = sorted({f[1] for f in found})
    if len(kinds) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(0), kinds or [0.0])
    parts = [(np.frombuffer(s, "<i4"), np.frombuffer(n, "<u4"), v) for _, _, s, n, v in found]
    return fit(parts, [f[1] for f in found])


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade >= k) for each grade k but the lowest), whole texts of any length.

    Null and empty texts are scored by their length alone; a row for each row of docs, null
    and repeated ids too; an empty table gives none; other columns aren't read. With one grade
    known there are no tails.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made() -> Callable[[list], dict[str, list]]:
        model = shared.value
        steps = np.diff(np.array(model.grades))
        known = Remembered(lambda t: float(model.weights[list(token_slots(t))].sum()), 64 << 20)

        def scored(text: str | None) -> float:
            known.trimmed()
            tokens = (text or "").split()
            distinct = set(tokens)
            total = sum(map(known.__getitem__, distinct)) + float(model.weights[list(text_slots(tokens))].sum())
            return total / float(np.sqrt(max(len(distinct), 1) + 1))

        def found(texts: list[str | None]) -> dict[str, list]:
            tails = model.tails(np.array([scored(t) for t in texts]))
            return {"expected_grade": (model.grades[0] + tails @ steps).tolist(), "tails": tails.tolist()}

        return found

    return columns_added(docs, ["doc_id"], made, "expected_grade double, tails array<double>")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and tail probabilities.

    Grades: 0 poor, 1 usable but toxic, 2 good. Learned outside a held-out fifth; `keep` selects
    what is rather usable than poor.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    ratings = labels.filter(~out).select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return grade(docs, learn(docs, ratings)).select(
        "doc_id",
        out.alias("held_out"),
        "expected_grade",
        F.get("tails", 0).alias("p_usable"),
        F.get("tails", 1).alias("p_good"),
        (F.coalesce(F.get("tails", 0), F.lit(1.0)) >= 0.5).alias("keep"),
    )
