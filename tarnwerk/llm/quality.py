"""Quality rules: plain counts, base rules, and robust multivariate outliers.

All of it is DataFrame expressions. The counts of a text are computed inside its row with array
functions. The statistic vectors of texts that pass the base rules are then judged per language and
source by a minimum-covariance-determinant estimate. For every group:

1. Three starts: medians with absolute deviations, and around them the correlations of hyperbolic
   tangents and of spatial signs.
2. Concentration steps: the three quarters of the rows that are nearest give the next mean and
   covariance. After two steps of each start the one with the least determinant goes on, until the
   determinant no longer falls.
3. Consistency: the covariance is scaled so that the median distance is that of chi-square.
4. Small groups: a group's estimate is averaged with its language's, and that with the one over all, in
   proportion to the rows behind them, so that groups of every size are judged.
5. Rows are rejected by Mahalanobis distance.

Most texts have no symbols, repeated lines or repeated windows, so in most groups those statistics don't
vary among the nearest rows, and the covariance is singular. Only such a statistic gets a deviation from
the list below, and is independent of the others.

Groups only meet in aggregates with partial sums and in histograms of fixed grids, so a group of any
size is fine, and results don't depend on how rows are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, digest, empty, whole

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The statistic vector: name, transformation, and the deviation it has where it doesn't vary. For x2 to x4 that
#: deviation is the transformed limit of well-known repetition and symbol rules over the root of the cutoff, so
#: that a statistic alone rejects from there on: a symbol for every ten words (of six signs), three lines of ten
#: repeated (of fifteen words), a fifth of the words in repeated windows.
STATISTICS: tuple[tuple[str, str, float], ...] = (
    ("x0", "ln(n_words)", 0.1),
    ("x1", "ln(word_chars / n_words)", 0.01),
    ("x2", "ln(1 + 1000 * n_symbols / word_chars)", 0.566),
    ("x3", "ln(1 + 1000 * n_dup_lines / n_words)", 0.600),
    ("x4", "ln(1 + 100 * n_repeat_words / n_words)", 0.600),
)
NAMES = tuple(n for n, _, _ in STATISTICS)
FLOORS = tuple(f for _, _, f in STATISTICS)
D = len(NAMES)
#: Medians of chi-square with one to five degrees of freedom, and the 99.99% quantile with five.
CHI2_MEDIAN = (0.454936, 1.386294, 2.365974, 3.356694, 4.351460)
CUTOFF = 25.744832
#: Histogram cells a unit.
_GRID = 128
#: The lower triangle of a matrix of the statistics.
_CELLS = tuple((i, j) for i in range(D) for j in range(i + 1))


def counts(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, lang, source and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of
    every row; null texts are empty. With ``digests`` the text's digest comes too."""
    own = ["digest"] if digests else []
    text = F.coalesce(whole(docs, "text", "string"), F.lit(""))
    base = docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "lang", "string").alias("lang"), whole(docs, "source", "string").alias("source"), text.alias("text"), *([digest(docs).alias("digest")] if digests else []))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    solid = F.translate("text", SPACES, "")
    # one row in, one row out: what is exploded is computed once, however often it is read after
    first = base.select(
        "doc_id", "lang", "source", *own,
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.explode(F.array(F.struct(words.alias("words"), lines.alias("lines")))).alias("r"),
    )
    second = first.select(
        "doc_id", "lang", "source", *own, "word_chars", "n_symbols",
        F.size("r.words").cast("long").alias("n_words"),
        (F.size("r.lines") - F.size(F.array_distinct("r.lines"))).cast("long").alias("n_dup_lines"),
        F.col("r.words").alias("words"),
    )
    windows = F.expr("if(n_words >= 3, transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))), array())")
    third = second.withColumn("h", F.explode(F.array(windows))).drop("words")
    ordered = F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x as x, i as i))), cast(array() as array<struct<x:bigint,i:int>>))")
    fourth = third.select("doc_id", "lang", "source", *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.explode(F.array(ordered)).alias("s"))
    twice = "filter(transform(s, (v, k) -> if(v.x <=> get(s, k - 1).x or v.x <=> get(s, k + 1).x, v.i, null)), p -> p is not null)"
    covered = F.expr(f"cast(size(array_distinct(flatten(transform({twice}, p -> array(p, p + 1, p + 2))))) as bigint)")
    return fourth.select("doc_id", "lang", "source", *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def _quantile(df: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """The least value (to a straight line within its cell of the grid) below or at which ``share`` of each
    group's rows lie. Cells are counted before they meet in their group, which then has one row a cell."""
    cells = df.groupBy(*keys, F.floor(value * _GRID).alias("cell")).agg(F.count("*").alias("n"))
    sorted_cells = F.expr("sort_array(collect_list(struct(cell, n)))")
    lists = cells.groupBy(*keys).agg(sorted_cells.alias("cells"), F.ceil(F.sum("n") * share).alias("need"))
    walk = F.expr(f"aggregate(cells, named_struct('upto', 0L, 'at', cast(null as double)), (s, x) -> named_struct('upto', s.upto + x.n, 'at', coalesce(s.at, if(s.upto + x.n >= need, (x.cell + (need - s.upto) / cast(x.n as double)) / {_GRID}, null)))).at")
    return lists.select(*keys, walk.alias(name))


def _computed(df: DataFrame) -> DataFrame:
    """The same rows, exploded one to one: what they hold is computed once and not inlined where it is read."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def _factor(df: DataFrame) -> DataFrame:
    """With the Cholesky factor l of the covariance c: statistics that vary less than their floor (v false)
    have the floor's variance and no covariances. ``logdet`` is the logarithm of the determinant."""

    def cell(i: int, j: int) -> str:
        return f"if(v{i}, c{i}{i}, {FLOORS[i] ** 2!r}D)" if i == j else f"if(v{i} and v{j}, c{i}{j}, 0D)"

    def row(i: str) -> str:
        return f"slice(done, cast({i} * ({i} + 1) / 2 as int) + 1, {D})"

    # row by row, each cell from those before it
    cells = ", ".join(f"struct({i} as i, {j} as j, {cell(i, j)} as c)" for i, j in _CELLS)
    rest = f"(x.c - aggregate(slice(zip_with({row('x.i')}, {row('x.j')}, (p, q) -> p * q), 1, x.j), 0D, (a, b) -> a + b))"
    add = f"if(x.i = x.j, sqrt(greatest({rest}, x.c * 1e-6D)), {rest} / element_at({row('x.j')}, x.j + 1))"
    vary = _computed(df).selectExpr("*", *(f"c{i}{i} >= {FLOORS[i] ** 2!r}D as v{i}" for i in range(D)))
    folded = _computed(_computed(vary).selectExpr("*", f"aggregate(array({cells}), cast(array() as array<double>), (done, x) -> concat(done, array({add}))) as l"))
    logdet = " + ".join(f"2 * ln(l[{_CELLS.index((i, i))}])" for i in range(D))
    return folded.selectExpr("* except (l)", *(f"l[{k}] as l{i}{j}" for k, (i, j) in enumerate(_CELLS)), f"{logdet} as logdet")


def _solved() -> list[str]:
    """Coordinates whose squares add up to the Mahalanobis distance: forward substitution."""
    out: list[str] = []
    for i in range(D):
        rest = "".join(f" - l{i}{j} * {out[j]}" for j in range(i))
        out.append(f"(({NAMES[i]} - m{i}{rest}) / l{i}{i})")
    return out


def _distance() -> Column:
    return F.expr(" + ".join(f"{s} * {s}" for s in _solved()))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number, mean m and covariance c of each group's rows."""
    sums = [F.expr(f"avg({x})").alias(f"m{i}") for i, x in enumerate(NAMES)]
    products = [F.expr(f"avg({NAMES[i]} * {NAMES[j]})").alias(f"p{i}{j}") for i, j in _CELLS]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)
    return out.selectExpr(*keys, "n", *(f"m{i}" for i in range(D)), *(f"p{i}{j} - m{i} * m{j} as c{i}{j}" for i, j in _CELLS))


def _starts(x: DataFrame, work: Workspace) -> DataFrame:
    """Three estimates a group to start from: (g, s, m, c, l, v, logdet)."""
    long = x.select("g", F.posexplode(F.array(*NAMES)).alias("k", "v"))
    middle = work.keep(_quantile(long, ["g", "k"], F.col("v"), 0.5, "m"))
    spread = _quantile(long.join(middle, ["g", "k"]), ["g", "k"], F.abs(F.col("v") - F.col("m")), 0.5, "s")
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("k") + 1)
    both = middle.join(spread, ["g", "k"]).withColumn("s", F.greatest(F.col("s") * 1.4826, floor))
    base = work.keep(both.groupBy("g").agg(*(F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}{i}") for c in "ms" for i in range(D))))
    z = [(F.col(NAMES[i]) - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(D)]
    size = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in z]))
    bent = x.join(base, "g").select("g", *(F.tanh(c).alias(f"t{i}") for i, c in enumerate(z)), *((c / F.greatest(size, F.lit(1e-9))).alias(f"u{i}") for i, c in enumerate(z)))
    scatter = bent.groupBy("g").agg(*(F.avg(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}{j}") for c in "tu" for i, j in _CELLS))
    wide = base.join(scatter, "g")
    out = []
    for s, c in enumerate((None, "t", "u")):
        def cell(i: int, j: int, c: str | None = c) -> Column:
            if i == j or c is None:
                return F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)
            scale = F.sqrt(F.col(f"{c}{i}{i}") * F.col(f"{c}{j}{j}"))
            return F.when(scale > 1e-9, F.col(f"{c}{i}{j}") / scale).otherwise(0.0) * F.col(f"s{i}") * F.col(f"s{j}")

        out.append(_factor(wide.select("g", F.lit(s).alias("s"), *(f"m{i}" for i in range(D)), *(cell(i, j).alias(f"c{i}{j}") for i, j in _CELLS))))
    return work.keep(reduce(DataFrame.union, out))


def _step(x: DataFrame, estimate: DataFrame, keys: list[str], share: float, work: Workspace) -> DataFrame:
    """A concentration step: the estimate of the ``share`` of each group's rows that are nearest."""
    near = x.join(estimate, "g").select(*keys, *NAMES, F.log1p(_distance()).alias("close"))
    # written, so that its size is known: a join that deals rows by group would put a large group in one task
    limit = work.keep(_quantile(near, keys, F.col("close"), share, "limit"))
    return _factor(_moments(near.join(limit, keys).where("close <= limit"), keys))


def least_determinants(x: DataFrame, work: Workspace, share: float = 0.75, most_steps: int = 50) -> DataFrame:
    """For each group g of ``x`` (g, x0 to x4) the mean m and covariance c of its nearest ``share`` of rows with
    the least determinant that the starts lead to, not scaled yet, and the Cholesky factor l. Steps end
    when no group's determinant falls; ``most_steps`` only guards against rounding that goes round."""
    tried = _starts(x, work)
    for _ in range(2):
        tried = work.keep(_step(x, tried, ["g", "s"], share, work))

    def least(found: DataFrame, *ties: str) -> DataFrame:
        fields = [c for c in found.columns if c not in ("g", *ties)]
        return found.groupBy("g").agg(F.min_by(F.struct(*fields), F.struct("logdet", *ties)).alias("r")).select("g", "r.*")

    going = work.keep(least(tried, "s"))
    found = [going]
    for _ in range(most_steps):
        old = going.select("g", F.col("logdet").alias("before"))
        going = work.keep(_step(x, going, ["g"], share, work).join(old, "g").where(F.col("logdet") < F.col("before") - 1e-9).drop("before"))
        if empty(going):
            break
        found.append(going)
    return work.keep(least(reduce(DataFrame.unionByName, found)))


def estimates(x: DataFrame, work: Workspace, weight: int, share: float = 0.75) -> DataFrame:
    """The consistent estimate of each group g (with its language a): m, c, l, v. Each is the average of its own
    and its language's by their rows, the language counting as ``weight`` rows; a language's is the
    average over its groups and, with ``weight`` rows again, over all groups."""
    raw = least_determinants(x, work, share)
    varying = " + ".join(f"if(v{i}, {s} * {s}, 0D)" for i, s in enumerate(_solved()))
    half = _quantile(x.join(raw, "g").selectExpr("g", f"log1p({varying}) as close"), ["g"], F.col("close"), 0.5, "half")
    degrees = F.expr(" + ".join(f"cast(v{i} as int)" for i in range(D)))
    usual = F.when(degrees > 0, F.element_at(F.array(*map(F.lit, CHI2_MEDIAN)), F.greatest(degrees, F.lit(1))))
    scale = F.coalesce(F.expm1("half") / usual, F.lit(1.0))
    sizes = x.groupBy("g").agg(F.first("a").alias("a"), F.count("*").alias("rows"))
    cells = [f"m{i}" for i in range(D)] + [f"c{i}{j}" for i, j in _CELLS]
    own = raw.join(half, "g").withColumn("scale", scale).withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * F.col("scale") for i, j in _CELLS})
    own = work.keep(own.join(sizes, "g").select("g", "a", "rows", *cells))
    sums = own.groupBy("a").agg(F.sum("rows").alias("all"), *(F.sum(F.col(c) * F.col("rows")).alias(f"{c}_") for c in cells))
    one = sums.agg(F.sum("all").alias("all"), *(F.sum(f"{c}_").alias(c) for c in cells)).first()  # a single row of a few numbers
    whole_of = {c: (one[c] / one["all"] if one["all"] else 0.0) for c in cells}
    languages = sums.select("a", *(((F.col(f"{c}_") + F.lit(weight * whole_of[c])) / (F.col("all") + weight)).alias(f"{c}_") for c in cells))
    mixed = own.join(languages, "a").select("g", *(((F.col(c) * F.col("rows") + F.col(f"{c}_") * weight) / (F.col("rows") + weight)).alias(c) for c in cells))
    return work.keep(_factor(mixed))


def judged(docs: DataFrame, weight: int = 50, share: float = 0.75, digests: bool = False) -> DataFrame:
    """The counts of every row of ``docs`` (doc_id, text, lang, source), base_failed, kept and distance2, the
    squared robust distance.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. Rows
    that pass are rejected if their squared distance is above the 99.99% quantile of chi-square with five
    degrees of freedom. A group is a language and source, null ones included; every group is
    judged, by an estimate to which its language counts as ``weight`` rows. Null and empty texts have no
    words and fail the base rule. Repeated rows each count. With ``digests`` the text's digest comes
    too. Other columns are ignored; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "quality")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    measured = work.keep(counts(docs, digests).withColumn("base_failed", failed))
    passed = measured.where(~F.col("base_failed"))
    lang = F.to_json(F.struct(F.col("lang").alias("v")))
    both = F.to_json(F.struct(F.col("lang").alias("v"), F.col("source").alias("w")))
    x = work.keep(passed.select(*measured.columns, lang.alias("a"), both.alias("g"), *(F.expr(e).alias(n) for n, e, _ in STATISTICS)))
    far = x.join(estimates(x.select("a", "g", *NAMES), work, weight, share), "g")
    verdict = far.select(*measured.columns, _distance().alias("distance2")).withColumn("kept", F.col("distance2") <= CUTOFF)
    out = verdict.unionByName(measured.where("base_failed").select("*", F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept")))
    return out.select("doc_id", "lang", "source", *(["digest"] if digests else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
