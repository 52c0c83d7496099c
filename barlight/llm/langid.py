"""Language identification by words with backoff to shorter character n-grams (operator 3)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import Remembered, columns_added, written

RUNS = re.compile(r"[^\W\d_]+")
#: Bounds of the model, whatever the corpus: documents and characters learned from per language,
#: entries kept per language, languages. See `learn` for a model without bounds.
SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 8_000_000
WORDS = 60_000
GRAMS = 20_000
LANGUAGES = 1_000
LENGTHS = (5, 4, 3, 2, 1)
FLOOR = 1e-7


def words_in(text: str) -> list[str]:
    """Lower-cased runs of letters: what Unicode calls letters, not digits, fractions or Roman signs."""
    out = []
    for run in RUNS.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


@dataclass
class Model:
    """Log frequencies (32-bit floats, one a language) of words and of padded character n-grams."""

    langs: list[str]
    words: dict[str, bytes]
    grams: dict[str, bytes]
    floor: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Backoff: the longest n-grams that are known stand for the word, covered left to right."""
        padded = f"<{word}>"
        total, parts, at = np.zeros(len(self.langs)), 0, 0
        while at < len(padded):
            for n in LENGTHS:
                found = self.grams.get(padded[at : at + n]) if at + n <= len(padded) else None
                if found is not None:
                    total = total + np.frombuffer(found, "<f4")
                    break
            else:
                n = 1
                total = total + self.floor
            at += max(1, n - 1)  # neighbours share a character
            parts += 1
        return total / parts


class Scorer:
    """Scores texts with a model; rows of words are remembered up to `most_bytes`."""

    def __init__(self, model: Model, most_bytes: int = 64 << 20) -> None:
        self.model = model
        self.rows = Remembered(self._row, most_bytes)

    def _row(self, word: str) -> bytes:
        found = self.model.words.get(word)
        return self.model.unseen(word).astype("<f4").tobytes() if found is None else found

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        words = words_in(text) if text and langs else []
        if not words:
            return "und", 0.0
        self.rows.trimmed()
        scores = np.frombuffer(b"".join(map(self.rows.__getitem__, words)), "<f4").reshape(len(words), -1)
        total = scores.sum(axis=0, dtype=np.float64) / math.sqrt(len(words))
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return langs[best], float(share[best] / share.sum())


def learn(
    rows: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    words: int = WORDS,
    grams: int = GRAMS,
    least: int = 2,
    languages: int = LANGUAGES,
) -> Model:
    """A model from rows(text, lang) without nulls: counts are taken in Spark.

    Learned from at most sample_docs documents or about sample_chars characters a language,
    chosen by hash of the text; at most `words` words and `grams` n-grams a language, the most
    frequent ones of those seen `least` times, are kept, which bounds what the driver collects
    and sends to executors, at any size of the corpus. A bound of 0 is none, and least=1 keeps
    all: the model is then exact. More than `languages` languages are an error. An empty
    table gives a model that answers `und`. Repeated rows count each time.
    """
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))
    seen = (size.orderBy("lang").limit(languages + 1) if languages else size.orderBy("lang")).collect()
    if languages and len(seen) > languages:
        raise ValueError(f"more than {languages} languages: give a larger bound")
    langs = [r["lang"] for r in seen]
    if not langs:
        return Model([], {}, {}, np.zeros(0))
    keep = F.lit(False)
    for r in seen:
        share = min(1.0, sample_docs / r["docs"] if sample_docs else 1.0, sample_chars / max(r["chars"], 1) if sample_chars else 1.0)
        chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < round(share * 1_000_000)
        keep = keep | ((F.col("lang") == r["lang"]) & chosen)
    counted = (
        rows.filter(keep)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = written(counted, "words")
    padded = F.concat(F.lit("<"), F.col("w"), F.lit(">"))

    def starting(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, F.lit(n)))

    none = F.array().cast("array<string>")
    cut = [F.when(F.length(padded) >= n, starting(n)).otherwise(none) for n in LENGTHS]
    each = counted.select("lang", "n", F.explode(F.flatten(F.array(*cut))).alias("w"))
    pieces = each.groupBy("lang", "w").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    def logs(counts: DataFrame, most: int) -> dict[str, bytes]:
        """The most frequent of each language, by row numbers that tasks cut to size before the shuffle."""
        found: dict[str, dict[str, int]] = {}
        counts = counts.filter(F.col("n") >= least)
        if most:
            order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
            counts = counts.withColumn("r", order).filter(F.col("r") <= most)
        for r in counts.select("lang", "w", "n").toLocalIterator():
            found.setdefault(r["w"], {})[r["lang"]] = r["n"]
        size = [max(totals.get(lang, 0), 1) for lang in langs]
        return {
            k: np.log([max(v.get(lang, 0) / n, FLOOR) for lang, n in zip(langs, size, strict=True)]).astype("<f4").tobytes()
            for k, v in found.items()
        }

    return Model(langs, logs(counted, words), logs(pieces, grams), np.full(len(langs), math.log(FLOOR)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for docs(doc_id, text), whole texts of any length.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Languages
    that score the same: the first by name. Repeated rows and null ids give a row each; an empty
    table gives none; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made() -> Callable[[list], dict[str, list]]:
        score = Scorer(shared.value)

        def found(texts: list[str | None]) -> dict[str, list]:
            each = [score(t) for t in texts]
            return {"lang_pred": [f[0] for f in each], "score": [f[1] for f in each]}

        return found

    return columns_added(docs, ["doc_id"], made, "lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    known = docs.filter(~out & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return identify(docs, learn(known)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
