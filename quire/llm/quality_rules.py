"""Quality rules: base counts, then robust multivariate outliers per language and source.

A text's counts become a vector (STATS) of rates, none of which depends on the length. Each has a sampling variance that
follows from the text's own counts (a mean over n words; the logarithm of the rate of equal pairs of words; the root of
symbols per word and the arcsine root of repeated lines per line, whose variance is a quarter over the words or lines),
so short texts are given more room and no scale is set by hand. Location and scatter of every group of language and source come from minimum-covariance-determinant
concentration steps: the moments of the KEEP share of documents that are nearest, again and again, from two
deterministic starts (classical and tanh-squashed moments), of which the one with the lesser determinant counts.

The estimate is the regularised one: a group's moments are drawn towards its language's with the weight of PRIOR
documents, and a language's towards those of all documents. That is continuous in the group's size, so every group has
its own estimate, small ones too. The observed scatter holds the group's mean sampling variance, which is taken from it
(to 0 at least, covariances in proportion); what is left is between documents. A document goes if its squared Mahalanobis
distance, under the scatter between documents plus its own sampling variances, exceeds CUT, the quantile of chi-square
that one clean document in a million exceeds.

A concentration step of all three levels and both starts is one map-side combined aggregation: moments per (group,
start, distance bin), of which a group has at most BINS. The cut at the KEEP share and the matrix work see only those
sums, so no group meets in one task. The nearest share is taken by whole bins.

Nulls: a null text has no words and fails the base rules; null lang and source are groups of their own; a null doc_id
is reported as null. Repeated rows count repeatedly. Very long texts are read whole. Further columns pass through
score() and filter_documents(); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACES, bounded_batches, dropped, small, staged, table, whole

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: The vector: mean word length, log of the share of equal pairs among all pairs of words, root of symbols per word,
#: arcsine of the root of repeated lines per line.
STATS = ("word_length", "equal_pairs", "symbols", "dup_lines")
KEEP = 0.75
#: The 1 - 1e-6 quantile of chi-square with 4 degrees of freedom, and the consistency factor of KEEP = 0.75 there.
CUT = 33.377
CONSISTENCY = 1.4864
#: Documents whose weight the estimate of the level above has.
PRIOR = 10
STEPS = 5
STARTS = 2
#: Distance bins: 32 per doubling, from 2^-10 to 2^30.
BINS = 1280

#: The last two can be too large for a long: ordered pairs and triples of places with equal words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "sq_chars", "n_lines", "n_pairs", "n_triples")
_REAL = ("n_pairs", "n_triples")
_TYPE = "struct<" + ",".join(f"{n}:{'double' if n in _REAL else 'bigint'}" for n in COUNTS) + ">"


def _repeats(words: list[bytes]) -> tuple[int, float, float]:
    """Words in 3-word windows that are found twice or more; pairs and triples of equal words."""
    n = len(words)
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    f = np.bincount(a).astype(np.float64) if n else np.zeros(0)
    pairs, triples = float((f * (f - 1)).sum()), float((f * (f - 1) * (f - 2)).sum())
    if n < 4:
        return 0, pairs, triples
    packed = a[:-1] * v + a[1:]
    if v > 2_000_000:  # else v^3 would not fit
        packed = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    _, at, counts = np.unique(packed[:-1] * v + a[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum()), pairs, triples


def _squares(data: bytes) -> int:
    """Sum of the squared word lengths, in code points, of UTF-8 text."""
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return int(((points[edge == 1] - points[edge == -1]) ** 2).sum()) if len(b) else 0


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text."""
    if not text:
        return (0,) * (len(COUNTS) - len(_REAL)) + (0.0,) * len(_REAL)
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), (repeats := _repeats(words))[0], _squares(data), len(lines), *repeats[1:]


def counts_column(text: str = "text") -> Column:
    def counts(text: pa.Array) -> pa.Array:
        found = [counts_of(t.as_py()) for t in text]
        columns = list(zip(*found, strict=True)) or [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64() if n in _REAL else pa.int64()) for n, c in zip(COUNTS, columns, strict=True)], list(COUNTS))

    return F.arrow_udf(counts, _TYPE)(F.col(text).cast("string"))


def base_failed(c: str = "_q") -> Column:
    n = F.col(f"{c}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
X, V = [f"x{i}" for i in range(P)], [f"v{i}" for i in range(P)]
SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS], *[f"t{i}" for i in range(P)]]
#: An estimate: mean, covariance (upper triangle) and mean sampling variances.
FIELDS = [*[f"m{i}" for i in range(P)], *[f"c{i}_{j}" for i, j in PAIRS], *[f"u{i}" for i in range(P)]]
#: What distances need of it: mean and scatter between documents.
READY = [*[f"m{i}" for i in range(P)], *[f"b{i}_{j}" for i, j in PAIRS]]


def vector(c: str = "_q") -> list[Column]:
    """The statistics and their sampling variances."""
    q = {k: F.col(f"{c}.{k}").cast("double") for k in COUNTS}
    n, lines = F.greatest(q["n_words"], F.lit(3.0)), F.greatest(q["n_lines"], F.lit(1.0))
    mean = q["word_chars"] / n
    # Shares of equal pairs and triples; half a pair more, so that its logarithm is defined.
    equal, triple = (q["n_pairs"] + 1) / (n * (n - 1)), q["n_triples"] / (n * (n - 1) * (n - 2))
    x = [mean, F.log(equal), F.sqrt(q["n_symbols"] / n), F.asin(F.sqrt(F.least(q["n_dup_lines"] / lines, F.lit(1.0))))]
    # Of a mean (lengths are whole numbers: 1/12), of the logarithm of a share of pairs, of a Poisson count's root and of a share's arcsine root.
    v = [(F.greatest(q["sq_chars"] / n - mean * mean, F.lit(0.0)) + 1 / 12) / n, 4 * F.greatest(triple - equal * equal, F.lit(0.0)) / (n * equal * equal) + 2 / (n * (n - 1) * equal), 0.25 / n, 0.25 / lines]
    return [*[e.alias(k) for e, k in zip(x, X, strict=True)], *[e.alias(k) for e, k in zip(v, V, strict=True)]]


def _between(params: DataFrame, *keys: str) -> DataFrame:
    """keys and READY of estimates: the scatter without the mean sampling variances, covariances in proportion."""
    left = [f"greatest(c{i}_{i} - u{i}, 0D)" for i in range(P)]
    share = lambda i: f"sqrt({left[i]} / greatest(c{i}_{i}, 1e-12D))"
    return params.selectExpr(*keys, *[f"m{i}" for i in range(P)], *[(left[i] if i == j else f"c{i}_{j} * {share(i)} * {share(j)}") + f" AS b{i}_{j}" for i, j in PAIRS])


def _key(level: str, *cols: str) -> Column:
    """A text for a group; null and empty differ."""
    return F.concat_ws("|", F.lit(level), *[F.coalesce(F.concat(F.lit("="), F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c)), F.lit("!")) for c in cols])


def _moments() -> list[Column]:
    x = [f"sum({a}) AS s{i}" for i, a in enumerate(X)]
    return _exprs("count(*) AS n", *x, *[f"sum({X[i]} * {X[j]}) AS s{i}_{j}" for i, j in PAIRS], *[f"sum({v}) AS t{i}" for i, v in enumerate(V)])


def _exprs(*texts: str) -> list[Column]:
    """Aliased SQL expressions as columns."""
    return [F.expr(t) for t in texts]


def _eliminate(df: DataFrame, rest: list[str]) -> DataFrame:
    """df (r0.. residuals, a0_0.. matrix) to rest with d2 (r' inverse(a) r) and logdet, by symmetric elimination."""
    df = df.selectExpr(*rest, *[f"r{i}" for i in range(P)], *[f"a{i}_{j}" for i, j in PAIRS], "0D AS d2", "0D AS logdet")
    for k in range(P):
        pivot = f"greatest(a{k}_{k}, 1e-12)"
        later = [i for i in range(k + 1, P)]
        df = df.selectExpr(
            *rest,
            f"d2 + r{k} * r{k} / {pivot} AS d2",
            f"logdet + ln({pivot}) AS logdet",
            *[f"r{i} - a{k}_{i} / {pivot} * r{k} AS r{i}" for i in later],
            *[f"a{i}_{j} - a{k}_{i} / {pivot} * a{k}_{j} AS a{i}_{j}" for i in later for j in later if i <= j],
        )
    return df


def _with_distance(df: DataFrame, rest: list[str]) -> DataFrame:
    """df (x0.., v0.., and READY of its estimate) to rest with d2: the scatter plus the document's sampling variances."""
    r = [f"x{i} - m{i} AS r{i}" for i in range(P)]
    a = [f"b{i}_{j}" + (f" + v{i}" if i == j else "") + f" AS a{i}_{j}" for i, j in PAIRS]
    return _eliminate(df.selectExpr(*rest, *r, *a), rest)


def _estimate(sums: DataFrame, tree: DataFrame, factor: float) -> DataFrame:
    """sums (key, start, SUMS) to a staged table: key, start and FIELDS, each level drawn towards the one above.

    tree: key, parent and depth of every group.
    """
    sums = staged(sums, "mcd_sums")  # read for a group and both levels above
    own = [*[f"s{i} / n AS m{i}" for i in range(P)], *[f"(s{i}_{j} / n - s{i} / n * s{j} / n) * {factor}D AS c{i}_{j}" for i, j in PAIRS], *[f"t{i} / n AS u{i}" for i in range(P)]]
    raw = sums.selectExpr("key", "start", "n", *own)
    # Both levels above are joined to a group at once, so the plan has four small joins, not one of every level again.
    above = lambda of, p: small(raw.selectExpr(f"key AS {of}", "start", *[f"{f} AS {p}_{f}" for f in ("n", *FIELDS)]), sums)
    tops = tree.selectExpr("key AS parent", "parent AS top")
    rows = raw.join(tree, "key").join(tops, "parent", "left").join(above("parent", "up"), ["parent", "start"], "left").join(above("top", "top"), ["top", "start"], "left")
    drawn = lambda n, f, up: f"({n} * {f} + {PRIOR} * {up}) / ({n} + {PRIOR})"
    levels = [f"CASE depth WHEN 0 THEN {f} WHEN 1 THEN {drawn('n', f, f'up_{f}')} ELSE {drawn('n', f, drawn('up_n', f'up_{f}', f'top_{f}'))} END AS {f}" for f in FIELDS]
    # As with inner joins, a group counts only if all levels above it do.
    out = rows.filter("depth = 0 OR depth = 1 AND up_n IS NOT NULL OR depth = 2 AND up_n IS NOT NULL AND top_n IS NOT NULL").selectExpr("key", "start", *levels)
    out = staged(out, "mcd_step")
    dropped(sums)
    return out


def _matched(points: DataFrame, params: DataFrame) -> DataFrame:
    """points (key, x0.., v0..) by each start with its estimate."""
    return points.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).join(small(_between(params, "key", "start"), params), ["key", "start"])


def estimates(points: DataFrame, tree: DataFrame) -> DataFrame:
    """points (key, x0.., v0..) and tree (key, parent, depth) to a staged table: key and READY of its better start."""
    classical = _estimate(points.groupBy("key").agg(*_moments()).withColumn("start", F.lit(0)), tree, 1.0)
    sd = [f"sqrt(greatest(c{i}_{i}, u{i}, 1e-12))" for i in range(P)]
    squashed = points.join(small(classical), "key").selectExpr("key", *V, *[f"m{i} + {sd[i]} * tanh((x{i} - m{i}) / {sd[i]}) AS x{i}" for i in range(P)])
    second = _estimate(squashed.groupBy("key").agg(*_moments()).withColumn("start", F.lit(1)), tree, 1.0)
    params = staged(classical.unionByName(second), "mcd_starts")
    dropped(classical, second)
    for _ in range(STEPS):
        near = _with_distance(_matched(points, params), ["key", "start", *X, *V])
        bin_ = F.expr(f"int(greatest(0, least({BINS - 1}, floor(log2(greatest(d2, power(2D, -10))) * 32 + 320))))")
        binned = near.groupBy("key", "start", bin_.alias("bin")).agg(*_moments())
        group = Window.partitionBy("key", "start")
        before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = binned.withColumn("_before", before).withColumn("_all", F.sum("n").over(group)).filter(f"_before < {KEEP} * _all")
        last, params = params, _estimate(kept.groupBy("key", "start").agg(*_exprs(*[f"sum({s}) AS {s}" for s in SUMS])), tree, CONSISTENCY)
        dropped(last)
    between = _between(params, "key", "start", *[f"u{i}" for i in range(P)])
    square = between.selectExpr("key", "start", *READY, *[f"0D AS r{i}" for i in range(P)], *[f"b{i}_{j}" + (f" + u{i}" if i == j else "") + f" AS a{i}_{j}" for i, j in PAIRS])
    least = _eliminate(square, ["key", "start", *READY]).groupBy("key").agg(F.min_by(F.struct(*READY), F.struct(F.round("logdet", 9), "start")).alias("b"))
    out = staged(least.select("key", "b.*"), "mcd")
    dropped(params)
    return out


def score(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """_doc (docs' columns, or keep_columns of them) with _q (counts), _base_failed, _distance (null: no estimate), _kept."""
    bounded_batches(docs.sparkSession)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    rows = docs.select(whole(docs, keep_columns), counts_column(text).alias("_q"), lang.cast("string").alias("_lang"), source.cast("string").alias("_source"))
    rows = staged(rows, "quality_counts")
    keys = rows.select("_doc", "_q", base_failed().alias("_base_failed"), _key("own", "_lang", "_source").alias("_own"), _key("lang", "_lang").alias("_by_lang"), *vector())
    good = keys.filter(~F.col("_base_failed"))
    groups = staged(good.select("_own", "_by_lang").distinct(), "quality_groups")
    of_all, of_lang = F.struct(F.lit("all").alias("key"), F.lit("").alias("parent"), F.lit(0).alias("depth")), F.struct(F.col("_by_lang").alias("key"), F.lit("all").alias("parent"), F.lit(1).alias("depth"))
    own = F.struct(F.col("_own").alias("key"), F.col("_by_lang").alias("parent"), F.lit(2).alias("depth"))
    tree = small(staged(groups.select(F.explode(F.array(of_all, of_lang, own)).alias("g")).select("g.*").distinct(), "quality_tree"))
    points = good.select(F.explode(F.array("_own", "_by_lang", F.lit("all"))).alias("key"), *X, *V)
    best = small(estimates(points, tree))
    judged = keys.join(best, keys["_own"] == best["key"], "left")
    judged = _with_distance(judged, ["_doc", "_q", "_base_failed"]).withColumnRenamed("d2", "_distance")
    kept = ~F.col("_base_failed") & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= CUT)
    return judged.select("_doc", "_q", "_base_failed", "_distance", kept.alias("_kept"))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were."""
    return score(docs, text).filter("_kept").select("_doc.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    named = [F.col(f"_q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return score(docs, keep_columns=["doc_id"]).select("_doc.doc_id", *named, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))
