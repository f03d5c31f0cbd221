"""Quality rules by robust multivariate outliers.

Base counts are taken from every whole text with built-in functions.  Texts that
fail no base rule become vectors of five transformed statistics.  For every
language and source a minimum-covariance-determinant estimate is found by
concentration steps: the three quarters of the texts nearest by Mahalanobis distance
give the next mean and covariance.  Four starts, scaled by medians and median absolute
deviations of the data, take two steps each; the one of least determinant goes on
until its determinant falls by less than a hundredth, ``MOST_STEPS`` steps at most.
A text whose distance to that estimate is beyond ``CUTOFF`` is rejected.

Everything is DataFrame operations.  Statistics are fixed-point integers, so sums
are exact, every step is deterministic and the hot source combines on the map
side; the text is read once, the steps read a table of numbers.

Groups of fewer than ``MIN_GROUP`` texts share an estimate with the other small
groups of their language, and what is left of small languages shares one.  A small
fixed variance is added to every statistic, so groups in which one is constant have an
estimate too.  It is so small that each statistic can reject alone: in a group without
symbols and repeats, from about 8 symbols, 6 repeated lines or 20 repeated words in a
hundred words on; a single repeated line or symbol in a usual text does not.

Null language and source are groups of their own; null text has no words and fails
the base rules; repeated rows count each; an empty table gives an empty result.
Columns of the input are kept apart from the statistics, so names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import forget, named, whole_text, written

#: Unit of the fixed-point statistics.
SCALE = 1024
N_STARTS, SCREEN_STEPS, MOST_STEPS = 4, 2, 8
#: A step counts while it brings the determinant below so much of the last one.
FALL = 0.99
#: Factor from a median absolute deviation to a standard deviation; cut of standardised values and what starts add to their diagonals.
NORMAL_MAD, WINSOR, RIDGE = 1.4826, 1.5, 0.01
MIN_GROUP = 100
#: Share of the texts that an estimate is made from.
CORE_SHARE = 0.75
#: For five statistics and three quarters, the factor that makes the covariance that of a normal sample.
CONSISTENCY = 1.41
#: Squared distance of rejection: the chi-square quantile of five dimensions for one in a million.
CUTOFF = 36.0
#: Standard deviations added to those found, in natural units, by statistic.
FLOORS = {"x0": 0.06, "x1": 0.35, "x2": 0.3, "x3": 0.5, "x4": 0.4}
#: Group tables up to so many rows (some 400 bytes each) are broadcast; larger ones are joined with a salt.
BROADCAST_GROUPS = 50_000
SALTS = 32

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_SPACE = "[ \\t-\\r]"
_SYMBOLS = "#*$%&|<>"
_XS = list(FLOORS)
_PAIRS = [(i, j) for i in range(len(_XS)) for j in range(i + 1)]
_KEYS = ["elang", "esource"]
_ESTIMATE = [f"m{i}" for i in range(len(_XS))] + [f"w{i}{j}" for i, j in _PAIRS]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in text order."""

    def repeated(ordered: Column) -> Column:
        same = lambda x, i, step: F.coalesce(F.get(ordered, i + step)["h"] == x["h"], F.lit(False))
        found = F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def union(starts: Column) -> Column:
        parts = F.transform(starts, lambda at, i: F.least(F.lit(WINDOW), F.get(starts, i + 1) - at).cast("bigint"))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda held, n: held + n)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _once(_once(ordered, repeated), union)


def base_counts(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the counts of ``text`` beside them, null text counting as empty."""
    words = F.array_remove(F.split("_text", _SPACE + "+"), "")
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit("[^ \\t-\\r]")))
    cut = rows.withColumn("_text", text).select(
        *rows.columns,
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"),
        lines.alias("_lines"),
        F.char_length(F.translate("_text", " \t\n\u000b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    last = F.size("_words") - (WINDOW - 1)
    windows = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    counted = cut.select(
        *rows.columns, "word_chars", "n_symbols",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("_windows"),
    )
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    repeat = F.when(unique, F.lit(0).cast("bigint")).otherwise(_covered(F.col("_windows")))
    return counted.select(*rows.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    """Log mean word length, symbols, repeated lines and repeated words in a hundred words, log length."""
    n = F.col("n_words").cast("double")
    share = lambda c: F.log(1.0 + 100.0 * F.col(c) / n)
    values = [F.log(F.col("word_chars") / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"), F.log(n)]
    return [F.floor(v * SCALE + 0.5).cast("bigint").alias(x) for v, x in zip(values, _XS, strict=True)]


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """The one row of ``groups`` beside each row; a hot group never meets in one task."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*_XS, "row"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _estimate_keys(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``glang, gsource`` and the ``elang, esource`` under which a group is estimated."""
    sizes = written(vectors.groupBy("glang", "gsource").agg(F.count("*").alias("n")), "group_sizes")
    small = sizes.filter(F.col("n") < MIN_GROUP)
    languages = small.groupBy("glang").agg(F.sum("n").alias("small_n"))
    keyed = sizes.join(languages, "glang", "left")
    own = F.col("n") >= MIN_GROUP
    shared = F.coalesce(F.col("small_n") >= MIN_GROUP, F.lit(False))
    keys = keyed.select(
        "glang", "gsource",
        F.when(own | shared, F.col("glang")).otherwise(F.lit("*")).alias("elang"),
        F.when(own, F.col("gsource")).otherwise(F.lit("*")).alias("esource"),
    )
    return written(keys, "estimate_keys"), sizes.count()


def _inverse_root(found: DataFrame) -> DataFrame:
    """From means ``m`` and covariances ``c`` the rows ``w`` of an inverse Cholesky factor, and the determinant."""
    d = len(_XS)
    for i in range(d):
        for j in range(i + 1):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.col(f"c{i}{j}") - rest) if i == j else (F.col(f"c{i}{j}") - rest) / F.col(f"l{j}{j}")
            found = found.withColumn(f"l{i}{j}", value)
    for j in range(d):
        for i in range(j, d):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            found = found.withColumn(f"w{i}{j}", ((1.0 if i == j else 0.0) - rest) / F.col(f"l{i}{i}"))
    root = F.col("l00")
    for i in range(1, d):
        root = root * F.col(f"l{i}{i}")
    return found.select("elang", "esource", "start", (root * root).alias("det"), *_ESTIMATE)


def _distance() -> Column:
    parts = []
    for i in range(len(_XS)):
        terms = [F.col(f"w{i}{j}") * (F.col(_XS[j]) / SCALE - F.col(f"m{j}")) for j in range(i + 1)]
        z = sum(terms[1:], terms[0])
        parts.append(z * z)
    return sum(parts[1:], parts[0])


def _ranked(distance: Column) -> Column:
    """The distance on a fine fixed scale, on which the core's radius is an exact order statistic."""
    return F.floor(256.0 * F.log(1.0 + distance)).cast("bigint")


def _standardised(vectors: DataFrame, n_groups: int) -> DataFrame:
    """Median ``m`` and robust deviation ``s`` of every statistic by group."""
    middle = lambda value, name: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias(name)
    d = range(len(_XS))
    medians = written(vectors.groupBy(*_KEYS).agg(*[middle(x, f"q{i}") for i, x in enumerate(_XS)]), "mcd_medians")
    away = _with_groups(vectors, medians, _KEYS, n_groups)
    away = away.groupBy(*_KEYS).agg(*[F.max(f"q{i}").alias(f"q{i}") for i in d], *[middle(f"abs({x} - q{i})", f"a{i}") for i, x in enumerate(_XS)])
    spread = lambda i: NORMAL_MAD * F.col(f"a{i}") / SCALE
    found = away.select(
        *_KEYS, *[(F.col(f"q{i}") / SCALE).alias(f"m{i}") for i in d],
        *[F.sqrt(spread(i) * spread(i) + FLOORS[_XS[i]] ** 2).alias(f"s{i}") for i in d],
    )
    found = written(found, "mcd_scales")
    forget(medians)
    return found


def _starts(vectors: DataFrame, n_groups: int) -> DataFrame:
    """Four first estimates of every group.

    All are centred at the medians.  The first is diagonal; the others are second moments of
    the standardised statistics' signs, of their values cut at ``WINSOR``, and of their directions.
    """
    d = range(len(_XS))
    scales = _standardised(vectors, n_groups)
    z = _with_groups(vectors, scales, _KEYS, n_groups).select(
        *_KEYS, *[((F.col(x) / SCALE - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, x in enumerate(_XS)]
    )
    square = F.col("z0") * F.col("z0")
    for i in d[1:]:
        square = square + F.col(f"z{i}") * F.col(f"z{i}")
    z = z.withColumn("norm", F.sqrt(square))
    forms = [
        lambda v: F.signum(v),
        lambda v: F.greatest(F.lit(-WINSOR), F.least(F.lit(WINSOR), v)),
        lambda v: F.when(F.col("norm") > 0.0, v / F.col("norm")).otherwise(0.0),
    ]
    fixed = lambda v: F.floor(v * SCALE + 0.5).cast("bigint")
    each = F.array(*[F.struct(F.lit(n).alias("start"), *[fixed(form(F.col(f"z{i}"))).alias(f"u{i}") for i in d]) for n, form in enumerate(forms, 1)])
    rows = z.select(*_KEYS, F.inline(each))
    sums = rows.groupBy(*_KEYS, "start").agg(F.count("*").alias("n"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}{j}") for i, j in _PAIRS])
    shared = [*_KEYS, *[f"m{i}" for i in d]]
    moment = lambda i, j: F.col(f"p{i}{j}") / F.col("n") / (SCALE * SCALE) + (RIDGE if i == j else 0.0)
    shaped = sums.join(scales, _KEYS).select(
        *shared, "start", *[(F.col(f"s{i}") * F.col(f"s{j}") * moment(i, j)).alias(f"c{i}{j}") for i, j in _PAIRS]
    )
    diagonal = scales.select(
        *shared, F.lit(0).alias("start"), *[(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    )
    found = written(_inverse_root(diagonal.unionByName(shaped)), "mcd_starts")
    forget(scales)
    return found


def _moments(core: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_XS)]
    products = [F.sum(F.col(_XS[i]) * F.col(_XS[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    found = core.groupBy(*_KEYS, "start").agg(F.count("*").alias("n"), *sums, *products)
    mean = lambda i: F.col(f"s{i}") / F.col("n") / SCALE
    columns = [mean(i).alias(f"m{i}") for i in range(len(_XS))]
    for i, j in _PAIRS:
        value = CONSISTENCY * (F.col(f"p{i}{j}") / F.col("n") / (SCALE * SCALE) - mean(i) * mean(j))
        columns.append((value + FLOORS[_XS[i]] ** 2 if i == j else value).alias(f"c{i}{j}"))
    return found.select(*_KEYS, "start", *columns)


def _concentrated(vectors: DataFrame, found: DataFrame, n_groups: int, name: str) -> DataFrame:
    """One concentration step: the estimate of the texts nearest to each estimate of ``found``."""
    near = _with_groups(vectors, found, _KEYS, n_groups).select(*_KEYS, "start", "row", *_XS, _ranked(_distance()).alias("rank"))
    radius = near.groupBy(*_KEYS, "start").agg(F.expr(f"percentile_disc({CORE_SHARE}) WITHIN GROUP (ORDER BY rank)").alias("radius"))
    radius = written(radius, f"{name}_radius")
    core = _with_groups(near, radius, [*_KEYS, "start"], n_groups * N_STARTS).filter("rank <= radius")
    after = written(_inverse_root(_moments(core)), name)
    forget(radius)
    return after


def estimates(vectors: DataFrame, n_groups: int) -> DataFrame:
    """The estimate of least determinant found for every group of ``vectors`` (``elang, esource``, statistics)."""
    found = _starts(vectors, n_groups)
    for step in range(SCREEN_STEPS):
        before, found = found, _concentrated(vectors, found, n_groups, f"mcd_screen{step}")
        forget(before)
    values = ["start", "det", *_ESTIMATE]
    least = found.groupBy(*_KEYS).agg(F.min_by(F.struct(*values), F.struct("det", "start")).alias("least"))
    best = written(least.select(*_KEYS, "least.*", F.lit(True).alias("moved")), "mcd_least")
    forget(found)
    for step in range(MOST_STEPS):
        moving = best.filter("moved").drop("moved")
        if moving.isEmpty():
            break
        after = _concentrated(vectors, moving, n_groups, f"mcd{step}")
        both = best.select(*_KEYS, F.struct(*values).alias("old")).join(after.select(*_KEYS, F.struct(*values).alias("new")), _KEYS, "left")
        falls = F.coalesce(F.col("new.det") < FALL * F.col("old.det"), F.lit(False))
        chosen = both.select(*_KEYS, F.when(falls, F.col("new")).otherwise(F.col("old")).alias("least"), falls.alias("moved"))
        before, best = best, written(chosen.select(*_KEYS, "least.*", "moved"), f"mcd_best{step}")
        forget(before, after)
    return best.drop("moved")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, by default all), the counts, ``base_failed`` and ``kept``."""
    keep = docs.columns if keep is None else keep
    group = lambda c: F.coalesce(F.concat(F.lit("="), named(c).cast("string")), F.lit("null"))
    rows = docs.select(
        F.struct(*[named(c) for c in keep]).alias("row"), group(lang).alias("glang"), group(source).alias("gsource"),
        whole_text(text).alias("body"),
    )
    counted = base_counts(rows, F.col("body")).drop("body").withColumn("base_failed", base_failed())
    counted = written(counted, "quality_counts")
    passed = counted.filter(~F.col("base_failed"))
    plain = passed.select("glang", "gsource", *_vector())
    keys, n_groups = _estimate_keys(plain)
    vectors = _with_groups(plain.withColumn("row", F.lit(0)), keys, ["glang", "gsource"], n_groups)
    found = estimates(vectors, n_groups)
    judged = _with_groups(passed.select("*", *_vector()), keys, ["glang", "gsource"], n_groups)
    judged = _with_groups(judged, found, _KEYS, n_groups)
    columns = ["row", *COUNTS, "base_failed"]
    return judged.select(*columns, (_distance() <= CUTOFF).alias("kept")).union(
        counted.filter("base_failed").select(*columns, F.lit(False).alias("kept"))
    )
