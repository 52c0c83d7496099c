"""Toxicity by boosted trees over dense features, with isotonic calibration (operator 9)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import Remembered, columns_added, free_name, written
from barlight.llm.langid import held_out

#: Bounds of the fitted model: labelled rows learned from, learned entries of each lexicon, and the
#: toxic rows that a word and a word beginning need. See `learn` for lexicons without bounds.
SAMPLE_ROWS = 30_000
LEXICON = 3_000
LEAST_WORDS, LEAST_BEGINS = 3, 5
PREFIX = 5
TREES = 20
DEPTH = 4
#: Common insults, words of address in four languages, look-alike signs.
INSULTS = frozenset(
    "arschloch asshole bastard bastardo bitch clown conne connard crap cretin cretino damn dickhead disgusting dreck dumb "
    "estupida estupido filth fool freak garbage idiot idiota idiote imbecil imbecile jerk kill loser merde mierda moron "
    "pathetic pendejo puta putain salaud scheisse schlampe scum shit slut stupid trash trottel vermin whore worthless".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta vous votre usted tus ti ustedes vosotros".split())
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
LETTERS = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"[^\W\d_][\d@$!|*#%&.\-_]+[^\W\d_]")
RUN = re.compile(r"(.)\1\1")
SIGNS = re.compile(r"[!?]{2,}|[#*&%$@]{2,}")
NEAR = 4

Lexicon = tuple[dict[str, float], dict[str, float]]


def lexicon_of(rows: DataFrame, most: int = LEXICON, least: tuple[int, int] = (LEAST_WORDS, LEAST_BEGINS)) -> Lexicon:
    """Words and word beginnings that go with label 1, from rows(text, toxic), with log odds.

    Document counts are taken in Spark. An entry needs a likelihood-ratio statistic of 15 or
    more and `least` toxic rows (a word, a beginning); the `most` words and as many beginnings with
    the greatest statistics are kept and collected, all of them with most=0.
    """
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return {}, {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    each = rows.select("toxic", F.explode(words).alias("w"))
    counts = each.groupBy("w").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("a") >= least[0]).cache()

    def kept(found: DataFrame, name: str, a: float, b: float) -> dict[str, float]:
        rate = a / (a + b)
        share = F.least(F.col("a") / F.col("n"), F.lit(1 - 1e-9))
        other = F.col("n") - F.col("a")
        ratio = 2 * (F.col("a") * F.log(share / rate) + other * F.log((1 - share) / (1 - rate)))
        top = found.filter((share > rate) & (ratio >= 15)).withColumn("ratio", ratio).orderBy(F.desc("ratio"), name)
        top = top.limit(most) if most else top
        return {
            r[name]: math.log((r["a"] + 0.5) / (a + 1)) - math.log((r["n"] - r["a"] + 0.5) / (b + 1))
            for r in top.collect()
        }

    found = kept(counts, "w", bad, good)
    counts.unpersist()
    # beginnings by word counts of all words, rare ones too
    starts = each.filter(F.length("w") > PREFIX).groupBy(F.substring("w", 1, PREFIX).alias("p"))
    starts = starts.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).cache()
    total = starts.agg(F.sum("a").alias("a"), F.sum("n").alias("n")).first()
    if not total["a"]:
        return found, {}
    begins = kept(starts.filter((F.col("a") >= least[1]) & (F.col("a") * 2 >= F.col("n"))), "p", float(total["a"]), float(total["n"] - total["a"]))
    starts.unpersist()
    return found, begins


def plain_word(token: str) -> str:
    """A token's letters in lower case, look-alike signs read as letters, long runs shortened."""
    inner = token.strip("\"'()[]{}.,;:!?#*&%$@-_<>|/\\")
    return RUN.sub(r"\1", inner.lower().translate(LOOKALIKE))


#: What is known of a token, by place: counts and sums that make up the features of a text.
INSULT, LEARNED, LEARNED_SUM, BEGUN, BEGUN_SUM, OBSCURED, HIDDEN, CAPITAL, SIGN, STRONG_SIGNS, ADDRESS, UPPER, MARKED, STRENGTH = range(14)


class Reader:
    """Dense features of texts; what a token says is a row of a table that holds up to `most_bytes`."""

    def __init__(self, lexicon: Lexicon, most_bytes: int = 48 << 20) -> None:
        self.words, self.begins = lexicon
        self.special = INSULTS | YOU | self.words.keys()
        self.table = np.zeros((1024, STRENGTH + 1), np.float64)
        self.size = 0
        self.shapes: dict[tuple, int] = {}
        self.known = Remembered(self._row, most_bytes)

    def _row(self, token: str) -> int:
        core = token[:-1] if token[-1] in ".,;:!?" else token
        lower = core.lower()
        if core.isalpha() and lower not in self.special and lower[:PREFIX] not in self.begins and not RUN.search(core):
            # a word that says nothing: one row for all with so many signs and capitals
            upper = 0 if core == lower else sum(map(str.isupper, core))
            shape = (len(token) - len(core), upper, int(len(core) > 1 and upper > 1 and core.isupper()))
            if shape not in self.shapes:
                self.shapes[shape] = self._added(self._token(token))
            return self.shapes[shape]
        return self._added(self._token(token))

    def _added(self, row: tuple) -> int:
        if self.size == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.size] = row
        self.size += 1
        return self.size - 1

    def _token(self, token: str) -> tuple:
        letters = LETTERS.findall(token)
        lower = [w.lower() for w in letters]
        insult = sum(w in INSULTS for w in lower)
        learned = [self.words[w] for w in lower if w in self.words]
        begun = [self.begins[w[:PREFIX]] for w in lower if len(w) > PREFIX and w[:PREFIX] in self.begins]
        obscured, hidden = int(bool(INNER.search(token))), 0
        if obscured or RUN.search(token):
            word = plain_word(token)
            hidden = int((word in INSULTS or word in self.words) and word not in lower)
        signs = sum(not c.isalnum() for c in token)
        strong = int(signs > 1 and bool(SIGNS.search(token)))
        capital = int(any(len(w) > 1 and w.isupper() for w in letters))
        upper = sum(map(str.isupper, token))
        you = int(any(w in YOU for w in lower))
        marked = int(bool(insult or learned or begun or hidden))
        return (
            insult, len(learned), sum(learned), len(begun), sum(begun), obscured, hidden, capital, signs, strong, you, upper,
            marked, max(learned + begun, default=0.0),
        )

    def __call__(self, text: str | None) -> list[float]:
        tokens = text.split() if text else []
        if self.known.passed > 4 * self.known.limit or self.size > self.known.limit:
            self.known.clear()
            self.known.passed = 0
            self.shapes.clear()
            self.size = 0
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))  # may let the table grow
        found = self.table.take(at, axis=0)
        sums = found.sum(axis=0).tolist()
        n = max(len(tokens), 1)
        chars = max(len(text or ""), 1)
        marks = sums[MARKED]
        close, strength = 0.0, 0.0
        if len(tokens):
            strength = max(float(found[:, STRENGTH].max()), 0.0)
        if marks and sums[ADDRESS]:  # marked tokens with a word of address at most NEAR tokens away
            before = np.concatenate([[0], np.cumsum(found[:, ADDRESS])])
            places = np.flatnonzero(found[:, MARKED])
            ends = np.minimum(places + NEAR + 1, len(tokens))
            close = float((before[ends] > before[np.maximum(places - NEAR, 0)]).sum())
        return [
            math.log1p(n), sums[INSULT] / n, math.log1p(sums[INSULT]), sums[LEARNED] / n, math.log1p(sums[LEARNED]),
            sums[LEARNED_SUM] / n, sums[BEGUN] / n, math.log1p(sums[BEGUN]), sums[BEGUN_SUM] / n, sums[OBSCURED] / n,
            math.log1p(sums[HIDDEN]), sums[CAPITAL] / n, sums[SIGN] / chars, sums[STRONG_SIGNS] / n, sums[ADDRESS] / n,
            close / n, math.log1p(close), sums[UPPER] / chars, strength, math.log1p(marks),
        ]


def features(rows: DataFrame, lexicon: Lexicon, keep: list[str], name: str = "__features") -> DataFrame:
    """The columns `keep` of rows and `name`, an array of dense features of `text`."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def made() -> Callable[[list], dict[str, list]]:
        read = Reader(shared.value)
        return lambda texts: {name: [read(t) for t in texts]}

    return columns_added(rows, keep, made, f"`{name}` array<double>")


class Model:
    """The lexicon, the trees and the calibration; without both labels, a constant."""

    def __init__(
        self, lexicon: Lexicon, trees: GBTClassificationModel | None, steps: IsotonicRegressionModel | None, constant: float
    ) -> None:
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant

    def _raw(self, rows: DataFrame, name: str = "__features") -> DataFrame:
        """rows with `__raw`, the trees' probability."""
        scored = self.trees.transform(rows.withColumn("__x", array_to_vector(name)))
        return scored.withColumn("__raw", vector_to_array("__p")[1]).drop(name, "__x", "__r", "__p", "__y")

    def score(self, docs: DataFrame, keep: list[str] | None = None, name: str = "__score") -> DataFrame:
        """The columns `keep` (else doc_id) of docs(doc_id, text) and `name`, from whole texts of any length.

        A row for each row, whatever is null or repeated; a null text scores like an empty one; an
        empty table gives none. Equal texts score the same; scores that calibration makes equal
        keep the order of the trees. Kept columns may have any name but `name`.
        """
        keep = keep or ["doc_id"]
        if self.trees is None:
            return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(self.constant).alias(name))
        # kept columns travel in a struct, so that none meets the names used on the way
        held = free_name(["text"], "held")
        packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in keep if c != "text"], F.lit(0).alias(free_name(keep, "_"))).alias(held))
        kept = [F.col("text") if c == "text" else F.col(f"{held}.`{c}`") for c in keep]
        raw = self._raw(features(packed, self.lexicon, [held, "text"] if "text" in keep else [held]))
        if self.steps is None:
            return raw.select(*kept, F.col("__raw").alias(name))
        step = F.least(F.greatest(F.col("__step"), F.lit(0.0)), F.lit(1.0))
        # equal steps keep the order of the trees by a thousandth
        return self.steps.transform(raw).select(*kept, (step * 0.999 + F.col("__raw") * 0.001).alias(name))


def _part(name: str, of: int) -> Column:
    return F.crc32(F.encode(F.concat(F.lit(name), F.col("doc_id").cast("string")), "UTF-8")) % of


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON) -> Model:
    """Fit on labels(doc_id, toxic) of docs(doc_id, text), on at most some sample_rows rows.

    Rows are chosen by a hash of doc_id; labels with nulls are left out, of repeated ones the
    greatest counts; repeated documents count each time. Features for fitting take their lexicon from the other half of the rows,
    so that trees meet it as they will on unseen texts; calibration uses a quarter that the trees
    don't see, grouped by the trees' score first, as few scores are many rows'. The sample's bound
    makes its labels small enough to broadcast. `lexicon` bounds the learned words, 0 not.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    known = known.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rate = min(1.0, sample_rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(rate * 1_000_000))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.withColumn("half", _part("half", 2)).withColumn("held", _part("calibrate", 4) == 0), "labelled")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(({}, {}), None, None, 1.0 if size.get(1) else 0.0)
    halves = [
        features(rows.filter(F.col("half") == h), lexicon_of(rows.filter(F.col("half") != h), lexicon), ["toxic", "held"]) for h in (0, 1)
    ]
    data = written(halves[0].unionByName(halves[1]), "features").withColumn("__x", array_to_vector("__features"))
    fit = data.filter(~F.col("held")).coalesce(8).cache()
    trees = GBTClassifier(
        featuresCol="__x", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=1
    ).fit(fit)
    # names of their own, as docs may bring others along
    trees = trees.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y")
    fit.unpersist()
    model = Model(lexicon_of(rows, lexicon), trees, None, 0.0)
    checked = model._raw(data.filter("held").select("toxic", "__features")).groupBy("__raw")
    checked = checked.agg(F.avg("toxic").alias("toxic"), F.count(F.lit(1)).cast("double").alias("__weight")).cache()
    share = checked.agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).first()
    if share["low"] is not None and share["low"] < 1 and share["high"] > 0:
        model.steps = IsotonicRegression(featuresCol="__raw", labelCol="toxic", weightCol="__weight", predictionCol="__step").fit(checked)
    checked.unpersist()
    return model


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    return model.score(docs, name="score").select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
