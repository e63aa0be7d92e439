"""Quality rules with a robust multivariate outlier test, in DataFrame functions alone.

Base statistics of every whole text are followed by minimum covariance determinant estimates per (language, source) of
their transformed vectors. From STARTS starts (medians with scaled absolute deviations, and the moments of shares of the
vectors that hashes choose), concentration steps take the mean and covariance of the SHARE of vectors nearest to the last
estimate, until no determinant falls any more; of a group's results the one of least determinant stays, made consistent
with normal vectors. Every group's estimate is shrunk towards its language's, and that towards all documents': with n
documents its own weighs n / (n + min_group).

A document is rejected if its squared Mahalanobis distance exceeds the chi-square quantile, times its group's median
distance (of all its documents, shrunk alike) over the chi-square median where that is more than 1: the floors below
make distances smaller on purpose, so a lower median doesn't lower the cutoff. A distance at the cutoff passes.

All estimates are grouped aggregates of five-number vectors (sums and approximate quantiles), so a group of any size is
aggregated map-side; the text is read once and only the vectors are kept. Nothing but one number a step reaches the driver.

Defined cases: null text has no words and fails the base rules; null language or source is a group of its own; fewer
vectors than dimensions, or statistics without spread, give variances no smaller than the floor, which rejects nothing
by itself; repeated rows are judged alike; an empty table gives an empty result; further columns pass through `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import BROADCAST_BYTES, SPACES, Scratch, small

#: Chi-square 1 - 1e-9 quantile and median, five degrees of freedom.
CUTOFF, MEDIAN = 50.69, 4.351
DIMENSIONS = ("length", "word_length", "symbols", "repeated", "dup_lines")
#: Least standard deviation of each transformed statistic. Of the repeats, half the step that one repeated window makes in
#: a text of 150 words (sqrt(6 / 150) / 2), and that one repeated line makes (log(2) / 2): one line of boilerplate is no outlier.
FLOORS = (0.25, 0.10, 0.03, 0.10, 0.35)
SHARE, MIN_GROUP = 0.75, 200
#: SHARE over the chi-square distribution function of seven degrees at the SHARE quantile of five (0.5311): by so much is
#: the covariance of the nearest share of normal vectors less than that of all.
CONSISTENCY = 0.75 / 0.5311
#: Starts a group; steps at most, and the fall of a
#: determinant's logarithm that is none (quantiles are approximate, to a thousandth of a rank).
STARTS, STEPS, FALL = 3, 12, 1e-2


def _let(value: Column, use):
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    whole = F.coalesce(text, F.lit(""))
    inner = F.btrim(whole, F.lit(SPACES))
    tokens = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    solid = F.translate(whole, SPACES, "")
    lines = F.filter(F.split(whole, "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    return F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _let(tokens, _repeat_words).alias("n_repeat_words"),
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows occurring twice or more."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        # every place covers its word and the next two, up to the next place
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]

    def places(w: Column) -> Column:
        few = _let(_repeated(F.array_sort(w)), lambda r: F.when(F.size(r) == 0, F.lit(0)).when(F.size(r) <= 24, covered(_where_in(w, r))).otherwise(covered(_by_sorting(w))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(few)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, places)).cast("long")


def _repeated(ordered: Column) -> Column:
    """Distinct values that occur twice or more in a sorted array."""
    return _let(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))


def _where_in(values: Column, chosen: Column) -> Column:
    return F.filter(F.transform(values, lambda x, i: F.when(F.array_contains(chosen, x), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def _by_sorting(values: Column) -> Column:
    """Places of values that occur twice or more, for texts with many of them: equal values are neighbours in (value, place) order."""
    pairs = F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    again = _let(pairs, lambda s: F.filter(s, lambda p, j: (p["x"] == F.get(s, j - 1)["x"]) | F.coalesce(p["x"] == F.get(s, j + 1)["x"], F.lit(False))))
    return F.array_sort(F.transform(again, lambda p: p["i"]))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _vector() -> list[Column]:
    """The transformed statistics of a row with the base columns."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.log1p(F.col("n_dup_lines").cast("double")),
    ]


def _distance(x: list[Column], mean: list[Column], inverse_root: list[list[Column]]) -> Column:
    """Squared length of inverse_root (lower triangular) times (x - mean)."""
    d = [a - m for a, m in zip(x, mean)]
    rows = [sum((inverse_root[i][j] * d[j] for j in range(1, i + 1)), inverse_root[i][0] * d[0]) for i in range(len(d))]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def _whitening(cov: list[list[Column]], frame: DataFrame) -> DataFrame:
    """Adds l_i_j, the inverse of the Cholesky factor of the covariance columns, one column at a time."""
    k = len(cov)
    for i in range(k):
        for j in range(i + 1):
            rest = sum((F.col(f"c_{i}_{m}") * F.col(f"c_{j}_{m}") for m in range(j)), F.lit(0.0))
            if i == j:
                frame = frame.withColumn(f"c_{i}_{i}", F.sqrt(F.greatest(cov[i][i] - rest, F.lit(1e-3 * FLOORS[i] ** 2))))
            else:
                frame = frame.withColumn(f"c_{i}_{j}", (cov[i][j] - rest) / F.col(f"c_{j}_{j}"))
    for i in range(k):
        for j in range(i + 1):
            if i == j:
                frame = frame.withColumn(f"l_{i}_{i}", 1 / F.col(f"c_{i}_{i}"))
            else:
                inner = sum((F.col(f"c_{i}_{m}") * F.col(f"l_{m}_{j}") for m in range(j, i)), F.lit(0.0))
                frame = frame.withColumn(f"l_{i}_{j}", -inner / F.col(f"c_{i}_{i}"))
    return frame


_K = range(len(DIMENSIONS))
_PAIRS = [(i, j) for i in _K for j in range(i + 1)]
_MODEL = [f"m_{i}" for i in _K] + [f"l_{i}_{j}" for i, j in _PAIRS]
_MOMENTS = [f"m_{i}" for i in _K] + [f"v_{i}_{j}" for i, j in _PAIRS]
#: Bytes of a group's model in a broadcast, at most about.
_MODEL_BYTES = 1024


def _model_distance() -> Column:
    return _distance([F.col(f"x_{i}") for i in _K], [F.col(f"m_{i}") for i in _K], [[F.col(f"l_{i}_{j}") for j in range(i + 1)] for i in _K])


def _sent(frame: DataFrame, groups: int) -> DataFrame:
    """frame, of a row a group, marked for a broadcast if it is small enough for one."""
    return F.broadcast(frame) if groups * _MODEL_BYTES <= BROADCAST_BYTES else frame


_V = [f"v_{i}_{j}" for i, j in _PAIRS]
_X = [f"x_{i}" for i in _K]


def _floored(moments: DataFrame, *keys: str) -> DataFrame:
    """Means and covariances with variances no less than the floors, the whitening, and the logarithm of the determinant."""
    cov = [F.greatest(F.coalesce(f"v_{i}_{i}", F.lit(0.0)), F.lit(FLOORS[i] ** 2)) if i == j else F.coalesce(f"v_{i}_{j}", F.lit(0.0)) for i, j in _PAIRS]
    whole = _whitened(moments.select(*keys, *[f"m_{i}" for i in _K], *[c.alias(n) for c, n in zip(cov, _V)]))
    logdet = sum((-2 * F.log(f"l_{i}_{i}") for i in range(1, len(DIMENSIONS))), -2 * F.log("l_0_0"))
    return whole.select(*keys, *_MOMENTS, *[m for m in _MODEL if m.startswith("l_")], logdet.alias("logdet"))


def _moments() -> list[Column]:
    return [*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(_X)], *[F.covar_pop(f"x_{i}", f"x_{j}").alias(n) for (i, j), n in zip(_PAIRS, _V)]]


def _starts(vectors: DataFrame, groups: int) -> DataFrame:
    """(g, start, moments): medians with scaled absolute deviations, and the moments of STARTS - 1 quarters of a group, by hashes of the vectors."""
    middle = vectors.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(_X)])
    off = vectors.join(_sent(middle, groups), "g")
    spread = off.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i, x in enumerate(_X)])
    first = [(F.pow(F.col(f"s_{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(n) for (i, j), n in zip(_PAIRS, _V)]
    robust = middle.join(_sent(spread, groups), "g").select("g", F.lit(0).alias("start"), *[f"m_{i}" for i in _K], *first)
    some = vectors.withColumn("start", (F.pmod(F.xxhash64(*_X), F.lit(4)) + 1).cast("int")).where(F.col("start") < STARTS)
    return robust.unionByName(some.groupBy("g", "start").agg(*_moments()))


def fit(vectors: DataFrame, scratch: Scratch, groups: int, share: float = SHARE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row a group g: the mean m_i and covariance v_i_j of least determinant, and its logdet. vectors: (g, x_0...), best on disk; groups: how many.

    The inputs of a group are only aggregated: approximate quantiles of distances, then sums over the nearest `share`.
    """
    model = scratch.write(_floored(_starts(vectors, groups), "g", "start"), "step0")
    for step in range(1, STEPS + 1):
        far = vectors.join(_sent(model, STARTS * groups), "g").select("g", "start", *_X, _model_distance().alias("d"))
        near = far.groupBy("g", "start").agg(F.percentile_approx("d", share, 1000).alias("limit"))
        kept = far.join(_sent(near, STARTS * groups), ["g", "start"]).where("d <= limit")
        new = scratch.write(_floored(kept.groupBy("g", "start").agg(*_moments()), "g", "start"), f"step{step}")
        # a start's moments are of other vectors than a step's, so the first fall says nothing
        fell = new.select("g", "start", "logdet").join(model.select("g", "start", F.col("logdet").alias("old")), ["g", "start"]).agg(F.max(F.col("old") - F.col("logdet"))).first()[0]
        model = new
        if fell is None or step > 2 and fell <= FALL:
            break
    best = model.groupBy("g").agg(F.min_by(F.struct(*_MOMENTS, "logdet"), F.struct("logdet", "start")).alias("b")).select("g", "b.*")
    wider = [F.greatest(F.col(f"v_{i}_{i}") * consistency, F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"v_{i}_{j}") * consistency for i, j in _PAIRS]
    return scratch.write(best.select("g", *[f"m_{i}" for i in _K], *[c.alias(n) for c, n in zip(wider, _V)], "logdet"), "moments")


def _whitened(moments: DataFrame) -> DataFrame:
    """moments (m_i, v_i_j) and the whitening l_i_j."""
    return _whitening([[F.col(f"v_{i}_{j}") for j in range(i + 1)] for i in _K], moments)


def _shrunk(sizes: DataFrame, values: DataFrame, names: list[str], groups: int, min_group: int) -> DataFrame:
    """sizes (g1, g2, g3, n1, n2) and each g1's values: its own shrunk towards g2's, and those towards g3's, by their numbers of documents."""
    out = sizes
    for k in (1, 2, 3):
        out = out.join(_sent(values.select(F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}_{k}") for c in names]), groups), f"g{k}")
    own, language = (F.col(n) / (F.col(n) + F.lit(float(min_group))) for n in ("n1", "n2"))
    return out.select(*sizes.columns, *[(own * F.col(f"{c}_1") + (1 - own) * (language * F.col(f"{c}_2") + (1 - language) * F.col(f"{c}_3"))).alias(c) for c in names])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and its base statistics (n_words ... n_repeat_words, base_failed) as columns of the struct `quality`."""
    s = docs.withColumn("quality", base_statistics(F.col(text)))
    return s.withColumn("quality", F.col("quality").withField("base_failed", base_failed(F.col("quality.n_words"), F.col("quality.n_repeat_words"))))


def models(vectors: DataFrame, scratch: Scratch, min_group: int = MIN_GROUP) -> DataFrame:
    """(g1, model columns, scale) for every (lang, source) pair of vectors (g1 pair, g2 language, g3 all); scale multiplies the cutoff."""
    sizes = vectors.groupBy("g1", "g2", "g3").agg(F.count("*").alias("n1"))
    sizes = scratch.write(sizes.join(sizes.groupBy("g2").agg(F.sum("n1").alias("n2")), "g2"), "sizes")
    groups = 2 * sizes.count() + 1
    x = [f"x_{i}" for i in _K]
    levels = lambda frame, *names: frame.select(F.explode(F.array("g1", "g2", "g3")).alias("g"), *names)
    moments = fit(scratch.write(levels(vectors, *x), "levels"), scratch, groups)
    # deviations are shrunk by their logarithms and covariances as correlations, so that a few junk texts of a small group don't widen it
    root = lambda i: F.sqrt(f"v_{i}_{i}")
    rated = moments.select("g", *[f"m_{i}" for i in _K], *[(F.log(root(i)) if i == j else F.col(f"v_{i}_{j}") / root(i) / root(j)).alias(f"v_{i}_{j}") for i, j in _PAIRS])
    shrunk = _shrunk(sizes, rated, _MOMENTS, groups, min_group)
    deviation = lambda i: F.exp(f"v_{i}_{i}")
    whitened = _whitened(shrunk.select(*sizes.columns, *[f"m_{i}" for i in _K], *[((F.lit(1.0) if i == j else F.col(f"v_{i}_{j}")) * deviation(i) * deviation(j)).alias(f"v_{i}_{j}") for i, j in _PAIRS]))
    shrunk = scratch.write(whitened.select(*sizes.columns, *_MODEL), "shrunk")
    far = vectors.join(_sent(shrunk.select("g1", *_MODEL), groups), "g1").select("g1", "g2", "g3", _model_distance().alias("d"))
    medians = scratch.write(levels(far, "d").groupBy("g").agg(F.percentile_approx("d", 0.5, 1000).alias("d")), "medians")
    scales = _shrunk(sizes, medians, ["d"], groups, min_group).select("g1", F.greatest(F.col("d") / MEDIAN, F.lit(1.0)).alias("scale"))
    return scratch.write(shrunk.select("g1", *_MODEL).join(_sent(scales, groups), "g1"), "models")


def _groups() -> list[Column]:
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    return [F.concat(lang, F.lit("\x00"), source).alias("g1"), lang.alias("g2"), F.lit("all").alias("g3")]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of docs: doc_id, the five base statistics, base_failed, kept, distance (null where base_failed)."""
    scratch = Scratch(docs.sparkSession, "quality")
    flat = statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).select("doc_id", *_groups(), "quality.*")
    flat = scratch.write(flat, "statistics")
    return _judge(flat, scratch, cutoff, min_group).select("doc_id", *BASE, "base_failed", "kept", "distance")


def _judge(flat: DataFrame, scratch: Scratch, cutoff: float, min_group: int) -> DataFrame:
    vectors = flat.select("*", *[v.alias(f"x_{i}") for i, v in enumerate(_vector())])
    fitted = models(vectors.where("NOT base_failed").select("g1", "g2", "g3", *[f"x_{i}" for i in _K]), scratch, min_group)
    judged = vectors.join(small(fitted, _MODEL_BYTES), "g1", "left").withColumn("distance", F.when(~F.col("base_failed"), _model_distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance") / F.col("scale"), F.lit(0.0)) <= cutoff))


def quality_filter(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that pass, in docs' own columns. The statistics and their groups' estimates are joined to each row where it lies."""
    scratch = Scratch(docs.sparkSession, "quality")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    flat = statistics(docs.select(row, F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).select("row", *_groups(), "quality.*")
    flat = scratch.write(flat, "rows")
    return _judge(flat, scratch, cutoff, min_group).where("kept").select("row.*")
