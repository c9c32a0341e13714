"""Quality rules: fixed rules first, then robust multivariate outliers.

Transformed statistics of each document form a vector. For each language and
source a minimum-covariance-determinant estimate gives location and scatter: the
share ``support`` of the vectors whose covariance has the least determinant.
Several starts are tried: the coordinate-wise medians and deviations, and the
best of many random subsets of a sample of the group. From each, concentration
steps over all vectors refit on those with the least distance; the start with
the least determinant goes on until its determinant falls no more. A step is two
aggregations with partial sums in the tasks, so a source with a third of all
rows is no heavier for one task. The scatter is regularised: fixed least spreads
(``FLOORS``) are added to every covariance, in the determinant too. Documents
whose squared distance exceeds the chi-squared quantile are rejected.

Groups of fewer than ``min_rows`` documents are pooled by language, these again
over languages. Where even that is too few, an estimate over all documents of
the language judges, or over all documents where the language has too few or is
null; a table that has fewer than ``min_rows`` altogether is judged by all it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, with_string, written
from .words import _PLACE, mixed, parted, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SUPPORT = 0.75
#: Random subsets tried on a sample of so many vectors of a group; how many of them, besides the medians, start on all vectors.
SUBSETS, SAMPLE, STARTS = 100, 300, 3
#: Steps of every start over all vectors; steps of the best one at most, and the fall of the determinant's logarithm that ends them.
FIRST_STEPS, MAX_STEPS, SETTLED = 2, 30, 1e-6
MIN_ROWS = 100
REJECT = 1e-7
#: Estimates that are broadcast to the documents at most, a few hundred bytes each; beyond, documents meet them by salted keys.
BROADCAST_GROUPS, SALTS = 50_000, 64
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Vector components, and the least spread each is given: equal values (no symbol anywhere) must not make the next value an outlier.
FLOORS = {"word_length": 0.06, "symbols": 0.1, "dup_lines": 0.15, "repeats": 0.15}


def counts(texts: Sequence[str | None]) -> dict[str, np.ndarray]:
    """The statistics of each text, over the whole of it; null has no words."""
    data = [(t or "").encode() for t in texts]
    hashes, begins = word_hashes(b"\n".join(data))
    words = np.diff(np.searchsorted(begins, np.cumsum([len(d) + 1 for d in data])), prepend=0)
    doc = np.repeat(np.arange(len(data)), words)
    n = max(0, len(hashes) - WINDOW + 1)
    with np.errstate(over="ignore"):
        rolled = doc[:n].astype(np.uint64) * _PLACE[WINDOW]
        for k in range(WINDOW):
            rolled += hashes[k : k + n] * _PLACE[k]
    rolled, within = mixed(rolled), doc[:n] == doc[WINDOW - 1 : WINDOW - 1 + n]
    at = np.flatnonzero(within)
    _, place, times = np.unique(rolled[at], return_inverse=True, return_counts=True)
    again = at[times[place] > 1]
    repeated = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        repeated[again + k] = True
    dup = []
    for d in data:
        lines = [x for x in d.split(b"\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": words,
        "word_chars": np.array([len(t or "") - len(d) + len(d.translate(None, BLANKS)) for t, d in zip(texts, data)], np.int64),
        "n_symbols": np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in data], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": np.bincount(doc[repeated], minlength=len(data)),
    }


def with_counts(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """``docs`` and the statistics of its column ``text``, named by ``names``."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(names[c], T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parted(batch, at):
                found = counts(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def base_failed(c: dict[str, str]) -> Column:
    words = F.col(c["n_words"])
    return (words < MIN_WORDS) | (100 * F.col(c["n_repeat_words"]) > MAX_REPEAT_PERCENT * words)


def vector(c: dict[str, str]) -> dict[str, Column]:
    words = F.greatest(F.col(c["n_words"]), F.lit(1)).cast("double")
    return {
        "word_length": F.log(F.greatest(F.col(c["word_chars"]), F.lit(1)) / words),
        "symbols": F.sqrt(F.col(c["n_symbols"]) / words),
        "dup_lines": F.sqrt(F.col(c["n_dup_lines"]) * 10 / words),
        "repeats": F.sqrt(F.col(c["n_repeat_words"]) / words),
    }


def _chi2_cdf(x: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, p) < q else (low, mid)
    return high


def _distance(x: dict[str, Column], location: str = "m", inverse: str = "p") -> Column:
    """Squared, to the location by the inverse scatter (row by row)."""
    off = [c - F.col(location)[i] for i, c in enumerate(x.values())]
    n = len(off)
    return sum((off[i] * off[j] * F.col(inverse)[i * n + j] * (1 if i == j else 2) for i in range(n) for j in range(i, n)), F.lit(0.0))


def _group(lang: Column, source: Column) -> Column:
    said = lambda c: F.coalesce(F.concat(F.lit("+"), F.replace(c, F.lit("/"), F.lit("//"))), F.lit("-"))
    return F.concat(said(lang), F.lit(" / "), said(source))


def _inner_factor(support: float, n: int) -> float:
    """The inner share's covariance is too small by this factor, were the vectors normal."""
    return support / _chi2_cdf(chi2_quantile(support, n), n + 2)


def _fitted(x: np.ndarray, factor: float, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, regularised scatter's inverse, and logarithm of its determinant."""
    mean = x.mean(axis=0)
    scatter = factor * (x - mean).T @ (x - mean) / len(x) + np.diag(floors)
    return mean, np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])


def concentrated(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray, h: int, factor: float, floors: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Concentration steps on vectors in memory: refit on the ``h`` of least distance while the determinant falls."""
    last = math.inf
    for _ in range(steps):
        off = x - mean
        nearest = np.argsort(np.einsum("ij,jk,ik->i", off, inverse, off), kind="stable")[:h]
        mean, inverse, now = _fitted(x[nearest], factor, floors)
        if now >= last - 1e-12:
            break
        last = now
    return mean, inverse, now


def best_starts(x: np.ndarray, support: float, starts: int = STARTS, subsets: int = SUBSETS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The best estimates from random subsets of ``x`` (one more than there are components each), least determinant first."""
    floors, n = np.array(list(FLOORS.values())) ** 2, x.shape[1]
    factor, h, rng = _inner_factor(support, n), math.ceil(support * len(x)), np.random.default_rng(len(x))
    tried = []
    for _ in range(subsets):
        some = x[rng.choice(len(x), min(len(x), n + 1), replace=False)]
        tried.append(concentrated(x, *_fitted(some, 1.0, floors)[:2], h, factor, floors, FIRST_STEPS))
    tried = [concentrated(x, m, p, h, factor, floors, MAX_STEPS) for m, p, _ in sorted(tried, key=lambda t: t[2])[: 4 * starts]]
    return sorted(tried, key=lambda t: t[2])[:starts]


_START = "array<struct<k: int, m: array<double>, p: array<double>>>"


def _starts(samples: DataFrame, support: float, starts: int) -> DataFrame:
    """``(g, starts)`` from ``(g, x)``, the vectors of a group's sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, x = batch.column(0)[i].as_py(), np.array(batch.column(1)[i].as_py())
                found = [{"k": k + 1, "m": m.tolist(), "p": p.ravel().tolist()} for k, (m, p, _) in enumerate(best_starts(x, support, starts))]
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([found], _START_TYPE)], names=["g", "starts"])

    return samples.mapInArrow(run, f"g string, starts {_START}")


_START_TYPE = pa.list_(pa.struct([("k", pa.int32()), ("m", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))]))


def _refitted(moments: DataFrame, n: int, factor: float) -> DataFrame:
    """``(g, k, m, p, log_det)`` from counts, sums and sums of products."""
    floors = np.array(list(FLOORS.values())) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = pa.list_(pa.float64())
        for batch in batches:
            rows = batch.to_pydict()
            m, p, log_det = [], [], []
            for count, sums, products in zip(rows["n"], rows["s"], rows["ss"]):
                mean, cov = np.array(sums) / count, np.zeros((n, n))
                cov[np.triu_indices(n)] = np.array(products) / count
                cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
                scatter = factor * cov + np.diag(floors)
                m.append(mean.tolist())
                p.append(np.linalg.inv(scatter).ravel().tolist())
                log_det.append(float(np.linalg.slogdet(scatter)[1]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["g"], pa.string()), pa.array(rows["k"], pa.int32()), pa.array(m, doubles), pa.array(p, doubles), pa.array(log_det, pa.float64())], names=["g", "k", "m", "p", "log_det"])

    return moments.mapInArrow(run, "g string, k int, m array<double>, p array<double>, log_det double")


def _with_group(v: DataFrame, per_group: DataFrame, sizes: DataFrame, rows: int, groups: int) -> DataFrame:
    """``v`` and what one row a group says; the rows of a large group stay where they are."""
    if groups <= BROADCAST_GROUPS:
        return v.join(F.broadcast(per_group), "g")
    return hot_join(v, per_group.join(sizes, "g"), "g", rows, stored=False).drop("n")


def _step(v: DataFrame, sizes: DataFrame, starts: DataFrame, rows: int, groups: int, support: float) -> DataFrame:
    """One concentration step over all vectors: ``(g, k, m, p, log_det)`` from ``(g, starts)``."""
    names = list(FLOORS)
    near = _with_group(v, starts, sizes, rows, groups).select("g", *names, F.explode("starts").alias("at"))
    near = near.select("g", "at.k", *names, _distance({n: F.col(n) for n in names}, "at.m", "at.p").alias("d"))
    cuts = near.groupBy("g", "k").agg(F.percentile_approx("d", support, 10_000).alias("cut"))
    cuts = written(cuts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "cut"))).alias("cuts")), "cuts")
    # The cuts travel with the starts, so vectors meet them in the same join.
    near = _with_group(v, starts.join(cuts, "g"), sizes, rows, groups).select("g", *names, "cuts", F.explode("starts").alias("at"))
    near = near.select("g", "at.k", *names, F.col("cuts")[F.col("at.k")].alias("cut"), _distance({n: F.col(n) for n in names}, "at.m", "at.p").alias("d"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = near.where("d <= cut").groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"ss{i}_{j}") for i, j in pairs])
    moments = moments.select("g", "k", "n", F.array(*[f"s{i}" for i in range(len(names))]).alias("s"), F.array(*[f"ss{i}_{j}" for i, j in pairs]).alias("ss"))
    return written(_refitted(moments, len(names), _inner_factor(support, len(names))), "estimates")


def estimates(v: DataFrame, support: float = SUPPORT, starts: int = STARTS) -> DataFrame:
    """``(g, m, p, log_det)`` of each group of ``(g, pick, *FLOORS)``; ``pick`` is any hash that deals out the sample."""
    names = list(FLOORS)
    x = {n: F.col(n) for n in names}
    sizes = written(v.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    rows, groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    v = v.select("g", "pick", *names)
    # About SAMPLE vectors of each group, all of a smaller one; only starts come from them.
    drawn = _with_group(v, sizes.withColumnRenamed("n", "of"), sizes, rows, groups).where(F.pmod(F.xxhash64("pick", "g"), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("of")) * (1 << 30))
    drawn = drawn.groupBy("g").agg(F.collect_list(F.array(*names)).alias("x"))
    drawn = _starts(drawn.where(F.size("x") > len(names)), support, starts)

    middle = v.groupBy("g").agg(*[F.percentile_approx(n, 0.5, 10_000).alias(f"mid_{n}") for n in names])
    middle = written(middle, "middles")
    off = _with_group(v, middle, sizes, rows, groups)
    spread = off.groupBy("g").agg(*[F.percentile_approx(F.abs(x[n] - F.col(f"mid_{n}")), 0.5, 10_000).alias(f"dev_{n}") for n in names])
    scale = [F.pow(F.col(f"dev_{n}") * 1.4826, F.lit(2)) + FLOORS[n] ** 2 for n in names]
    plain = middle.join(spread, "g").select("g", F.array(*[F.col(f"mid_{n}") for n in names]).alias("m"), F.array(*[1 / scale[i] if i == j else F.lit(0.0) for i in range(len(names)) for j in range(len(names))]).alias("p"))
    plain = plain.select("g", F.struct(F.lit(0).alias("k"), "m", "p").alias("plain"))
    started = plain.join(drawn, "g", "left").select("g", F.concat(F.array("plain"), F.coalesce("starts", F.array().cast(_START))).alias("starts"))
    started = written(started, "starts")

    for _ in range(FIRST_STEPS):
        found = _step(v, sizes, started, rows, groups, support)
        started = found.groupBy("g").agg(F.collect_list(F.struct("k", "m", "p")).alias("starts"))
    best = found.groupBy("g").agg(F.min_by(F.struct("k", "m", "p"), F.struct("log_det", "k")).alias("at"), F.min("log_det").alias("log_det"))
    best = written(best.select("g", "at.*", "log_det"), "estimate")
    for _ in range(MAX_STEPS):
        new = _step(v, sizes, best.select("g", F.array(F.struct("k", "m", "p")).alias("starts")), rows, groups, support)
        both = best.select("g", F.struct("log_det", "k", "m", "p").alias("old")).join(new.select("g", F.struct("log_det", "k", "m", "p").alias("new")), "g")
        fall = F.col("old.log_det") - F.col("new.log_det")
        best = written(both.select("g", F.when(F.col("new.log_det") < F.col("old.log_det"), F.col("new")).otherwise(F.col("old")).alias("at"), fall.alias("fall")).select("g", "at.*", "fall"), "estimate")
        fall = best.agg(F.max("fall")).first()[0]
        if fall is None or fall <= SETTLED:
            break
    return best.select("g", "m", "p", "log_det")


def fit(vectors: DataFrame, support: float = SUPPORT, starts: int = STARTS, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """From ``(lang, source, pick, *FLOORS)``: ``(own, g)``, the group that judges each language and source, and ``(g, m, p, log_det)`` of each group."""
    vectors = vectors.withColumn("own", _group(F.col("lang"), F.col("source"))).withColumn("language", _group(F.col("lang"), F.lit(None).cast("string")))
    sizes = written(vectors.groupBy("own", "language").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small = F.col("n") < min_rows
    totals = sizes.groupBy("language").agg(F.sum("n").alias("of_language"), F.sum(F.when(small, F.col("n"))).alias("pool"))
    rest = F.sum(F.when(F.col("pool") < min_rows, F.col("pool")))
    # One row, joined to every group.
    groups = sizes.join(totals, "language").crossJoin(F.broadcast(totals.agg(rest.alias("rest"))))
    g = F.when(~small, F.col("own")).when(F.col("pool") >= min_rows, F.concat(F.lit("pool "), F.col("language"))).when(F.col("rest") >= min_rows, F.lit("pool"))
    # What is still too few learns from all documents of its language, or from all.
    g = g.when((F.col("of_language") >= min_rows) & (F.col("language").startswith("+")), F.concat(F.lit("all "), F.col("language"))).otherwise(F.lit("all"))
    groups = written(groups.select("own", "language", "n", g.alias("g")), "groups")
    # The groups whose documents teach each estimate: its own, all of a language, or all.
    wide = groups.where(F.col("g").startswith("all")).select(F.col("g").alias("wide")).distinct()
    teach = groups.where(~F.col("g").startswith("all")).select("own", "n", "g")
    for whole in (F.lit("all"), F.concat(F.lit("all "), F.col("language"))):
        teach = teach.unionByName(groups.withColumn("wide", whole).join(wide, "wide").select("own", "n", F.col("wide").alias("g")))
    # At most three for each language and source.
    teach = written(teach.groupBy("own", "n").agg(F.collect_list("g").alias("gs")), "teaching")
    v = hot_join(vectors, teach, "own", rows).select(F.explode("gs").alias("g"), "pick", *FLOORS)
    return groups.select("own", "g"), estimates(written(v, "taught"), support, starts)


def judged(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", reject: float = REJECT, **options) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with statistics, ``base_failed``, ``distance`` and ``kept``, and the names that these columns got.

    Names that ``docs`` has already are avoided. The texts are read twice: once
    to fit, once to judge.
    """
    taken = {c.lower() for c in docs.columns}
    out = {}
    for c in [*COUNTS, "base_failed", "distance", "kept", "own", "g", "m", "p"]:
        name = c
        while name.lower() in taken:
            name = "_" + name
        out[c] = name
        taken.add(name.lower())
    plain = {c: c for c in COUNTS}
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    light = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(text).alias("pick"), text)
    light = with_counts(light, "text", plain).drop("text").where(~base_failed(plain)).select("lang", "source", "pick", *[c.alias(n) for n, c in vector(plain).items()])
    groups, params = fit(written(light, "vectors"), **options)
    model = written(groups.join(params, "g").select(F.col("own").alias(out["own"]), F.col("m").alias(out["m"]), F.col("p").alias(out["p"])), "model")

    strung, name = with_string(docs, text_col)
    d = with_counts(strung, name, out).withColumn(out["base_failed"], base_failed(out))
    d = d.withColumn(out["own"], _group(F.col(f"`{lang_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")))
    if model.count() <= BROADCAST_GROUPS:
        d = d.join(F.broadcast(model), out["own"], "left")
    else:
        model = model.withColumn(out["g"], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        d = d.withColumn(out["g"], F.pmod(F.xxhash64(F.col(f"`{name}`")), F.lit(SALTS))).join(model, [out["own"], out["g"]], "left")
    far = _distance(vector(out), out["m"], out["p"])
    d = d.withColumn(out["distance"], F.when(~F.col(out["base_failed"]), far))
    d = d.withColumn(out["kept"], ~F.col(out["base_failed"]) & (F.coalesce(F.col(out["distance"]), F.lit(0.0)) <= chi2_quantile(1 - reject, len(FLOORS))))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], *[out[c] for c in [*COUNTS, "base_failed", "distance", "kept"]]), out


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that neither the rules nor the estimate reject, with all columns.

    Null and empty texts have no words and go. Null languages and sources are
    values of their own, null ids don't matter. Equal rows share their fate: a
    distance equal to the quantile stays. An empty table stays empty; columns
    may have any names.
    """
    d, names = judged(docs, **options)
    return d.where(F.col(names["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def verdicts(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, *COUNTS, base_failed, distance, kept)``, one row for each row of ``docs``.

    Null and empty texts have no words and fail the rules. Null languages and
    sources are values of their own. Null and repeated ids are kept as they
    come, an empty table gives no rows, other columns are not read.
    ``distance`` (squared) is null where the rules fail.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return judged(narrow, **options)[0].select("doc_id", *COUNTS, "base_failed", "distance", "kept")
