"""Language of whole texts by the nearest of several centroids per language.

Features are byte n-grams of 1 to 3 bytes of the lower-cased text, hashed to ``DIMS`` buckets.
A vector has weight (1 + log tf) * idf and length one.  Spherical k-means gives each language
several centroids, as one language's texts fall into several kinds.  A text gets the language
whose centroid has the largest cosine.

Rejection is by distance: short texts have small cosines with any centroid, so the least cosine
that is accepted depends on the number of n-grams.  It is a share of what all but the worst of the
texts of that size or more, whole fitted texts and their heads, reach with their own language.

The classifier (idf, centroids, least cosines) is fitted on at most ``sample`` different labelled
texts of each language, those with the least hashes; copies count once, whatever their number, and
every labelled language is learnt.  Executors turn the drawn texts into counts and fit a language's
centroids, a task a language; the driver holds the centroids.  Prediction is one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, cut, no_clash
from loomwork.llm.tokens import slices, trimmed

DIMS = 1 << 12
SAMPLE = 400
CENTROIDS = 4
#: Accepted cosines go down to this share of a low quantile of the cosines seen in fitting.  The
#: lowest are of junk that has a label, such as a head that is a hash only.
REJECT_SHARE, REJECT_QUANTILE = 0.7, 0.02
#: So many fitted texts of a size tell what it takes.
OFTEN = 50
_HAS_LETTER = r"\p{L}"
_PART = 1 << 20
#: Tasks that turn the drawn texts into counts.
_TASKS = 32


def counts(text: bytes) -> np.ndarray:
    """n-gram counts of a lower-cased UTF-8 text, hashed; computed in bounded parts that overlap."""
    total = np.zeros(DIMS, np.int64)
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), _PART):
        b = raw[max(0, at - 2) : at + _PART].astype(np.uint32)
        fresh = min(at, 2)  # bytes of the part before
        one = b * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (b[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) if len(b) > 1 else b[:0]
        three = (two[:-1] ^ (b[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1) if len(b) > 2 else b[:0]
        shift = np.uint32(32 - DIMS.bit_length() + 1)
        for k, h in ((0, one), (1, two), (2, three)):
            total += np.bincount((h[max(0, fresh - k) :] * np.uint32(2 * k + 1) >> shift), minlength=DIMS)
    return total


def lower(texts: pa.Array) -> pa.Array:
    """Lower-cased UTF-8, white space of any kind and digits and ASCII symbols as one space."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[\x00-@\[-`{-\x7f]+", " ")


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(DIMS, np.float32)
    used = np.flatnonzero(tf)
    v[used] = (1 + np.log(tf[used])) * idf[used]
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm else v


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row a centroid
    owner: np.ndarray  # the place in langs of each row
    least: np.ndarray  # accepted cosines by size class

    def predict(self, text: bytes) -> tuple[str | None, float, bool]:
        """Language, cosine (0 to 1) and acceptance of one lower-cased text."""
        tf = counts(text)
        cosines = self.centroids @ vector(tf, self.idf)
        if not len(cosines):
            return None, 0.0, False
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.langs[self.owner[best]], score, score >= self.least[size_class(int(tf.sum()))]


def size_class(n: int) -> int:
    return min(n.bit_length(), 31)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from far points in a fixed way; empty clusters go."""
    centres = x.mean(axis=0, keepdims=True)
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(axis=1).argmin()
        centres = np.vstack([centres, x[far]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[near == c].sum(axis=0) for c in range(len(centres)) if (near == c).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


@dataclass
class Row:
    """Sparse n-gram counts of a labelled text, or of one of its heads of doubling length."""

    lang: str
    whole: bool
    place: np.ndarray
    count: np.ndarray

    def dense(self) -> np.ndarray:
        tf = np.zeros(DIMS, np.int64)
        tf[self.place] = self.count
        return tf


def rows_of(lang: str, text: bytes) -> Iterator[Row]:
    """The whole lower-cased text, and its heads, which tell what short texts of the language look like."""
    n = 4
    while n < len(text):
        tf = counts(text[:n])
        yield Row(lang, False, np.flatnonzero(tf), tf[tf > 0])
        n *= 2
    tf = counts(text)
    yield Row(lang, True, np.flatnonzero(tf), tf[tf > 0])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def fit_language(rows: list[Row], idf: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One language's centroids, and the size class and the cosine of each of its rows."""
    found = _clusters(np.stack([vector(r.dense(), idf) for r in rows if r.whole]), k).astype(np.float32)
    sizes = np.array([size_class(int(r.count.sum())) for r in rows], np.uint8)
    return found, sizes, np.array([(found @ vector(r.dense(), idf)).max() for r in rows], np.float32)


def accepted_least(sizes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least accepted cosine of each size class, from what all languages' rows have.

    A longer text must be as near as a shorter one; a size seen rarely tells nothing of its own.
    """
    if not len(sizes):
        return np.ones(32)
    low = {c: np.quantile(cosines[sizes == c], REJECT_QUANTILE) for c in range(32) if (sizes == c).sum() >= OFTEN}
    least = np.full(32, min(low.values(), default=np.quantile(cosines, REJECT_QUANTILE)))
    for c in range(32):
        below = [k for k in low if k <= c]
        if below:
            least[c] = min(low[k] for k in low if k >= below[-1])
    return least * REJECT_SHARE


def fit_rows(rows: list[Row], k: int = CENTROIDS) -> Model:
    """The model of rows that are at hand; ``fit`` does the same on executors."""
    whole = [r for r in rows if r.whole]
    df = np.zeros(DIMS)
    for r in whole:
        df[r.place] += 1
    idf = idf_of(df, len(whole))
    langs = sorted({r.lang for r in whole})
    return _model(langs, idf, [fit_language([r for r in rows if r.lang == lang], idf, k) for lang in langs])


def _model(langs: list[str], idf: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    owner = [j for j, (c, *_) in enumerate(found) for _ in range(len(c))]
    sizes = np.concatenate([np.zeros(0, np.uint8), *(x for _, x, _ in found)])
    cosines = np.concatenate([np.zeros(0, np.float32), *(x for *_, x in found)])
    centroids = np.vstack([np.zeros((0, DIMS), np.float32), *(c for c, *_ in found)]).astype(np.float32)
    return Model(langs, idf, centroids, np.array(owner, np.int64), accepted_least(sizes, cosines))


def drawn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(lang, text): of each language the ``sample`` different texts with the least hashes, or all it has.

    Rows with a null language, and texts that are null or without a letter, are left out.  Copies
    of a text fall together before anything is ranked.  Where texts tie in their hash there may be
    more.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(_HAS_LETTER))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    hashes = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    # the limit of the window works before the exchange too: a task hands on ``sample`` hashes a language at most
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = hashes.withColumn("place", place).where(F.col("place") <= sample)
    # a row a language, where the model, which is sent out too, has several centroids
    most = F.broadcast(few.groupBy(F.col("lang").alias("of")).agg(F.max("h").alias("most")))
    return known.join(most, F.col("lang") == F.col("of")).where(F.xxhash64("text") <= F.col("most")).select("lang", "text").distinct()


_ROWS = "lang string, whole boolean, place binary, count binary"


def _rows(lang, whole, place, count) -> list[Row]:
    """Rows in a fixed order, so that a fit doesn't depend on how they came."""
    fields = zip(lang, whole, place, count, strict=True)
    rows = [Row(x, w, np.frombuffer(p, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for x, w, p, c in fields]
    return sorted(rows, key=lambda r: (r.lang, r.whole, r.place.tobytes(), r.count.tobytes()))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Fits on ``drawn`` texts.  An empty table, and one without a labelled text, gives a model of no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), lower(batch.column(1)), strict=True):
                found = list(rows_of(lang, text.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r.lang for r in found], pa.string()),
                        pa.array([r.whole for r in found], pa.bool_()),
                        pa.array([r.place.astype("<u2").tobytes() for r in found], pa.binary()),
                        pa.array([r.count.astype("<u4").tobytes() for r in found], pa.binary()),
                    ],
                    names=["lang", "whole", "place", "count"],
                )

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, np.int64), 0  # the last is the number of texts
        for batch in batches:
            for place in batch.column(0).to_pylist():
                df[np.frombuffer(place, "<u2")] += 1
                n += 1
        df[DIMS] = n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used])], names=["place", "n"])

    bounded_batches(docs.sparkSession)
    # a few texts of each language: as many tasks as a large table has would write mostly empty files
    rows = cut(drawn(docs, lang_col, text_col, sample).coalesce(_TASKS).mapInArrow(trimmed(count), _ROWS))
    df = np.zeros(DIMS + 1, np.int64)
    parts = rows.where("whole").select("place").mapInArrow(trimmed(frequency), "place int, n long")
    for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows at most
        df[r.place] = r.n
    idf = idf_of(df[:DIMS], int(df[DIMS]))

    def language(table: pa.Table) -> pa.Table:
        found, sizes, cosines = fit_language(_rows(*(table.column(c).to_pylist() for c in ("lang", "whole", "place", "count"))), idf, k)
        row = {"lang": table.column("lang")[0].as_py(), "centroids": found.astype("<f4").tobytes(), "sizes": sizes.tobytes(), "cosines": cosines.astype("<f4").tobytes()}
        return pa.Table.from_pylist([row], schema=_FITTED)

    got = rows.groupBy("lang").applyInArrow(language, "lang string, centroids binary, sizes binary, cosines binary")
    got = sorted(got.toArrow().to_pylist(), key=lambda r: r["lang"])
    fitted = [(np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMS), np.frombuffer(r["sizes"], np.uint8), np.frombuffer(r["cosines"], "<f4")) for r in got]
    return _model([r["lang"] for r in got], idf, fitted)


_FITTED = pa.schema([("lang", pa.string()), ("centroids", pa.binary()), ("sizes", pa.binary()), ("cosines", pa.binary())])


def _judge(m: Model, texts: pa.Array) -> list[tuple[str, float, bool]]:
    """(language, score, acceptance) of each text."""
    letters = pc.fill_null(pc.match_substring_regex(texts, _HAS_LETTER), False).to_pylist()
    out = [("und", 0.0, False)] * len(letters)
    for a, b in slices(texts):
        for k, t in enumerate(lower(texts.slice(a, b - a)), a):
            if letters[k]:
                lang, score, ok = m.predict(t.as_buffer().to_pybytes())
                out[k] = (lang or "und", score, ok)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, accepted), a row a document.

    A null text, and one without a letter, is ``und`` with score 0, not accepted.  So is every text
    where the model knows no language.  Ids may be null or repeat, and each row is judged alone;
    among centroids equally near the first language by name wins.  An empty table gives no rows.  An
    id column of a result's name is an error; other columns are not read.
    """
    no_clash(id_col, "lang_pred", "score", "accepted")
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*_judge(kept.value, batch.column(1)), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                names=[id_col, "lang_pred", "score", "accepted"],
            )

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language the model accepts; one pass without a shuffle."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([ok for *_, ok in _judge(kept.value, batch.column(place))], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def remainder(id_col: Column, divisor: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = predict(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
