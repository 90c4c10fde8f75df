"""Toxicity of whole texts by maximal scoring segments of token log-odds.

Tokens' scores
    Log-odds of a token in toxic against other training texts, each text counting a token once,
    with an informative Dirichlet prior: the prior counts follow the token's share in both classes
    together.  Tokens whose log-odds are ``Z_LEAST`` standard errors from zero enter the lexicon;
    every token costs ``DRIFT``, so that scores have a negative mean in other texts.  What isn't
    that far from zero is noise of the sample, most of it from tokens of one or two texts, and
    tokens that the sample lacks have no log-odds at all: they all count as zero and cost the drift.
    So the lexicon has the size of the evidence, not of the vocabulary.

Segments
    All maximal scoring segments of a text are found in one linear scan (Ruzzo and Tompa), over the
    lexicon's tokens and the gaps between them.  By extreme-value theory a segment of score s in n
    tokens of background is matched by chance with p = 1 - exp(-K n exp(-lambda s)); lambda solves
    sum p_i exp(lambda s_i) = 1 over the background's tokens, and K makes the expected number of
    segments in texts that aren't toxic what it is.  Segments with p <= ``P_MOST`` are the
    text's toxic passages.

Score
    The passages' evidence, the sum of -log p, goes through a logistic curve that is fitted to the
    labels on texts that were left out of the lexicon it is computed with (four folds).

Fitting uses at most ``SAMPLE`` labelled rows, chosen by a hash of their ids; the sample is small
enough to be sent to all executors.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, cut, no_clash
from loomwork.llm.decontaminate import words
from loomwork.llm.langid import remainder
from loomwork.llm.tokens import slices, trimmed

#: Tokens that a model is made of, at most.
TOKENS = 300_000
SAMPLE = 20_000
FOLDS = 4
#: The prior counts' sum, as a share of all counts.
PRIOR = 0.1
Z_LEAST = 2.5
ODDS_LEAST = 1.5
TEXTS_LEAST = 2
DRIFT = 0.3
P_MOST = 0.05


@dataclass
class Lexicon:
    tokens: list[str]
    odds: np.ndarray
    rate: float  # lambda
    k: float = 0.1  # K

    def chance(self, score: float, n: int) -> float:
        """The probability of a segment with that score in n tokens of background."""
        return max(-math.expm1(-self.k * n * math.exp(-self.rate * score)), 1e-300)

    def least(self) -> float:
        """The least score of a segment."""
        return float(self.odds[self.odds > 0].min()) - DRIFT if (self.odds > 0).any() else 1.0


def maximal_segments(place: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time.

    The sequence has score[k] at place[k] and -drift at every place between.
    """
    # candidates: (first, last, sum before, sum after), and for each how far left smaller sums go
    found: list[tuple[int, int, float, float]] = []
    left: list[int] = []
    total, before = 0.0, None
    for at, s in zip(place, score, strict=True):
        if before is not None:
            total -= drift * (at - before - 1)
        start, total, before = total, total + s, at
        if s <= 0:
            continue
        first, low = at, start
        k = len(found) - 1
        while True:
            # the nearest candidate that starts lower
            while k >= 0 and found[k][2] >= low:
                k = left[k]
            if k < 0 or found[k][3] >= total:
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
            del left[k:]
            k -= 1
        found.append((first, at, low, total))
        left.append(k)
    return [(a, b, hi - lo) for a, b, lo, hi in found]


def lexicon(tokens: list[str], toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> Lexicon:
    """From the number of toxic and of other texts with each token, and the sums over all tokens."""
    seen = np.flatnonzero(toxic + other > 0)  # a fold's tokens may all be in the texts left out
    tokens, toxic, other = [tokens[k] for k in seen], toxic[seen], other[seen]
    prior, mass = PRIOR * (toxic + other), PRIOR * (n_toxic + n_other)
    a, b = toxic + prior, other + prior
    odds = np.log(a / np.maximum(n_toxic + mass - a, 1e-9)) - np.log(b / np.maximum(n_other + mass - b, 1e-9))
    z = odds / np.sqrt(1 / np.maximum(a, 1e-9) + 1 / np.maximum(b, 1e-9))
    keep = ((z >= Z_LEAST) & (odds >= ODDS_LEAST) & (toxic >= TEXTS_LEAST)) | (z <= -2 * Z_LEAST)
    kept = np.flatnonzero(keep)
    share = b[kept] / max(1e-9, n_other + mass)
    scores, rest = odds[kept] - DRIFT, max(0.0, 1 - share.sum())

    def excess(rate: float) -> float:
        return float((share * np.exp(np.minimum(rate * scores, 700))).sum() + rest * math.exp(-rate * DRIFT)) - 1

    lo, hi = 1e-6, 1e-6
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return Lexicon([tokens[k] for k in kept], odds[kept].astype(np.float64), hi)


@dataclass
class Model:
    lexicons: list[Lexicon]  # one of all training texts, then one without each fold
    slope: float = 0.0
    base: float = -20.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * np.log1p(evidence))))


def segments(lex: Lexicon, texts: pa.Array) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
    """The maximal segments (first, last, score) of each text, and the texts' numbers of tokens."""
    flat, at = words(texts)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(texts))]
    if lex.tokens:
        hit = pc.index_in(flat, value_set=pa.array(lex.tokens, pa.string()))
        known = pc.fill_null(hit, -1).to_numpy()
        place = np.flatnonzero(known >= 0)
        first, last = np.searchsorted(place, at[:-1]), np.searchsorted(place, at[1:])
        for k in np.flatnonzero(last > first).tolist():
            p = place[first[k] : last[k]]
            out[k] = maximal_segments((p - at[k]).tolist(), (lex.odds[known[p]] - DRIFT).tolist(), DRIFT)
    return out, np.diff(at)


def passages(lex: Lexicon, texts: pa.Array) -> list[list[tuple[int, int, float, float]]]:
    """The significant segments of each text, with their probability by chance."""
    found, n = segments(lex, texts)
    judged = ([(a, b, s, lex.chance(s, size)) for a, b, s in x] for x, size in zip(found, n.tolist(), strict=True))
    return [[x for x in row if x[3] <= P_MOST] for row in judged]


def _sum(chances: list[float]) -> float:
    return -sum(math.log(p) for p in chances)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and base of a logistic curve, by Newton's method with a slight ridge."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Fits on the texts of docs that labels, at most ``sample`` of them; equal texts count once.

    Rows of labels with a null id or label are left out; a label that differs for one id counts as
    toxic.  Without labelled texts of both kinds, or with an empty table, nothing is toxic.  Rows of
    docs with one id all count, if their texts differ.  The driver gets the counts of the ``TOKENS``
    tokens of most toxic texts, then of most texts, and two numbers a sampled text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    one = one.agg(F.max(F.col(label_col)).alias("__toxic"))
    few = one.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # the bound of what is broadcast
    named = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = named.join(F.broadcast(few), "__id").groupBy("text").agg(F.max("__toxic").cast("int").alias("toxic"))
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cls = batch.column(0), batch.column(1).to_numpy() * FOLDS + batch.column(2).to_numpy()
            for a, b in slices(texts):
                flat, at = words(texts.slice(a, b - a))
                coded = flat.dictionary_encode()
                text_of = np.repeat(np.arange(a, b), np.diff(at))
                pair = np.unique(np.stack([text_of, coded.indices.to_numpy()]), axis=1)
                key, n = np.unique(pair[1].astype(np.int64) * (2 * FOLDS) + cls[pair[0]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(key // (2 * FOLDS))), pa.array((key % (2 * FOLDS)).astype(np.int32)), pa.array(n)],
                    names=["token", "cell", "n"],
                )

    counted = rows.mapInArrow(trimmed(count), "token string, cell int, n long").where("token <> ''")
    sums = np.zeros(2 * FOLDS)
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    wide = cut(counted.groupBy("token").agg(*cells))
    totals = wide.agg(*(F.sum(f"c{c}") for c in range(2 * FOLDS))).first()
    sums[:] = [x or 0 for x in totals]
    # only tokens of toxic texts can have positive scores, and frequent ones negative; the rest never enter
    toxic_n = sum((F.col(f"c{FOLDS + c}") for c in range(FOLDS)), F.lit(0))
    all_n = sum((F.col(f"c{c}") for c in range(2 * FOLDS)), F.lit(0))
    told = wide.where((toxic_n >= TEXTS_LEAST) | (all_n >= 50)).orderBy(F.desc(toxic_n), F.desc(all_n), "token").limit(TOKENS)
    got = told.toPandas().sort_values("token")
    tokens, cell = got["token"].tolist(), got[[f"c{c}" for c in range(2 * FOLDS)]].to_numpy(np.float64)

    def without(fold: int | None) -> Lexicon:
        use = [c for c in range(FOLDS) if c != fold]
        toxic, other = [FOLDS + c for c in use], use
        return lexicon(tokens, cell[:, toxic].sum(axis=1), cell[:, other].sum(axis=1), sums[toxic].sum(), sums[other].sum())

    model = Model([without(None), *(without(f) for f in range(FOLDS))])
    kept = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                mine = batch.filter(pa.array(fold == f))
                for a, b in slices(mine.column(0)):
                    found, n = segments(kept.value.lexicons[1 + f], mine.column(0).slice(a, b - a))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([[s for *_, s in x] for x in found], pa.list_(pa.float64())), pa.array(n, pa.int64()),
                            mine.column(1).slice(a, b - a), mine.column(2).slice(a, b - a),
                        ],
                        names=["scores", "n", "toxic", "fold"],
                    )

    seen = cut(rows.mapInArrow(trimmed(weigh), "scores array<double>, n long, toxic int, fold int"))
    # how many segments the other texts have tells K, for each lexicon on texts that it wasn't made from
    others = seen.where("toxic <= 0").groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.size("scores")).alias("found")).collect()
    told = {r.fold: (r.n, r.found) for r in others}
    for f, lex in enumerate(model.lexicons[1:]):
        n, count_found = told.get(f, (0, 0))
        lex.k = min(1.0, (count_found + 0.5) / max(n * math.exp(-lex.rate * lex.least()), 1e-9))
    model.lexicons[0].k = float(np.exp(np.mean([math.log(x.k) for x in model.lexicons[1:]])))
    chances = [(x.k, x.rate) for x in model.lexicons[1:]]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon([], np.zeros(0), rate, k) for k, rate in chances]
        for batch in batches:
            scores, n, toxic, fold = (c.to_pylist() for c in batch.columns)
            x = [_sum([p for s in row if (p := own[f].chance(s, size)) <= P_MOST]) for row, size, f in zip(scores, n, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array([t > 0 for t in toxic], pa.bool_())], names=["x", "toxic"])

    # two numbers a sampled text
    weighed = seen.mapInArrow(trimmed(evidence), "x double, toxic boolean").toPandas().sort_values(["x", "toxic"])
    if weighed["toxic"].nunique() == 2:
        model.slope, model.base = _logistic(np.log1p(weighed["x"].to_numpy(np.float64)), weighed["toxic"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, passages) a row a document; passages: first and last word, score and p of each.

    Null and empty texts have no passages and the least score.  Ids may be null or repeat; each row
    is scored alone, in time linear in its text.  An empty table gives no rows.  An id column of a
    result's name is an error; other columns are not read.
    """
    no_clash(id_col, "score", "passages")
    bounded_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(Model(model.lexicons[:1], model.slope, model.base))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                found = passages(m.lexicons[0], texts.slice(a, b - a))
                probability = m.probability(np.array([_sum([p for *_, p in x]) for x in found]))
                spans = [[{"first": x, "last": y, "score": s, "p": q} for x, y, s, q in p] for p in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(probability), pa.array(spans, kind)], names=[id_col, "score", "passages"])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, passages array<struct<first:int,last:int,score:double,p:double>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    def held_out(c: Column) -> Column:
        return remainder(c, 3) == 1

    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
