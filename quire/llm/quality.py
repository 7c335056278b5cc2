"""Robust multivariate outliers among text statistics (operator 6), with DataFrame functions only.

Each document becomes a vector of six transformed statistics. For each language and
source a minimum-covariance-determinant estimate is found by concentration steps: the
three quarters of the documents nearest to the centre give the next centre and
covariance, whose determinant falls with each step. Three deterministic starts are
followed; the one with the smallest determinant is carried to convergence. A document
far from its group by Mahalanobis distance is rejected; the limit is a chi-square
quantile far out, since the statistics have longer tails than normal ones.

The same estimate is made for each language over all sources and for all documents. A
group's centre and covariance are drawn towards its language's, and those towards the
whole, the more the smaller it is; so documents of rare groups are judged as well, and
no verdict hangs on a least group size.

All statistics cover whole texts and all documents. A group is only ever seen through
sums and counts in bins, so a source with a third of all rows is no special
case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, cut, has_at_most

SPACE, BLANKS = r"\x20\x09-\x0D", "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Share of a group that the estimate rests on, and what makes its covariance consistent for six normal dimensions.
CORE, CONSISTENCY = 0.75, 1.3616
#: Concentration goes on until no log determinant falls by more than this, or for so many steps.
LEAST_FALL, MOST_STEPS = 1e-3, 30
#: Bins per doubling in which quantiles are found.
BINS = 32
#: Documents with which a group's own estimate weighs as much as the wider one's (weights go with the square).
SHRINK = 100
#: Rejected if six normal dimensions lie as far out with less than this probability (chi-square 82.8).
TAIL = 1e-15
#: Statistics, and the least standard deviation of each that a group is taken to have.
FEATURES = {"x1": 1.0, "x2": 0.25, "x3": 0.05, "x4": 0.2, "x5": 0.2, "x6": 0.05}
_CHI2_MEDIAN, LEAST_SCALE = 5.3481, 0.2  # of six degrees of freedom; least factor of a group's distances
BROADCAST_GROUPS = 100_000


def word_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_twice`` to ``docs``.

    ``n_twice`` counts words equal to the next one. Repeated windows are told by 64-bit hashes of eight words within one text.
    """
    t = docs.withColumn("__t", F.coalesce(text, F.lit("")))
    t = t.withColumn("__w", F.split(F.btrim("__t", F.lit(BLANKS)), f"[{SPACE}]+"))
    t = t.withColumn("__w", F.expr("if(element_at(__w, 1) = '', slice(__w, 2, 0), __w)"))
    t = t.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    t = t.withColumn("n_symbols", F.expr("length(__t) - length(regexp_replace(__t, '[#*$%&|<>]', ''))").cast("long"))
    t = t.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    t = t.withColumn("n_lines", F.size("__l").cast("long")).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    t = t.withColumn("__h", F.expr("transform(__w, w -> xxhash64(w))")).drop("__w", "__l", "__t")
    t = t.withColumn("n_twice", F.expr("size(filter(__h, (x, i) -> x = get(__h, i + 1)))").cast("long"))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        t = t.withColumn("__g", F.expr(f"transform(slice(__h, 1, greatest(size(__h) - {step}, 0)), (x, i) -> xxhash64(x, get(__h, i + {step})))"))
        t = t.drop("__h").withColumnRenamed("__g", "__h")
    t = t.withColumn("__s", F.expr("if(size(array_distinct(__h)) < size(__h), sort_array(transform(__h, (h, i) -> struct(h, i))), NULL)")).drop("__h")
    t = t.withColumn("__r", F.expr("""sort_array(filter(transform(__s, (x, k) ->
        if((k > 0 AND get(__s, k - 1).h = x.h) OR coalesce(get(__s, k + 1).h = x.h, false), x.i, -1)), x -> x >= 0))""")).drop("__s")
    return t.withColumn("n_repeat_words", F.expr(f"""coalesce(aggregate(__r, struct(0L AS n, 0 AS reach),
        (a, i) -> struct(a.n + i + {WINDOW} - greatest(i, a.reach) AS n, i + {WINDOW} AS reach), a -> a.n), 0L)""")).drop("__r")


def base_rules(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and what ``more`` names, for each row of ``docs``; null texts are empty."""
    rows = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"), *(c.alias(x) for x, c in (more or {}).items()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return word_statistics(rows, F.col("text")).drop("text").withColumn("base_failed", failed)


def vector() -> dict[str, Column]:
    """The transformed statistics."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x1": F.log1p(F.col("n_words")),
        "x2": F.col("word_chars") / n,
        "x3": F.sqrt(F.col("n_symbols") / c),
        "x4": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x5": F.sqrt(F.col("n_repeat_words") / n),
        "x6": F.col("n_twice") / n,
    }


@dataclass(frozen=True)
class _Mcd:
    """The parts of an estimate. ``few`` says whether the groups, counted once, are few enough to broadcast."""

    names: tuple[str, ...]
    few: bool

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [(a, b) for i, a in enumerate(self.names) for b in self.names[: i + 1]]

    def joined(self, rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
        return rows.join(F.broadcast(groups) if self.few else groups, list(keys or ("g",)))


def _quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """A quantile of ``value >= 0`` for each key, from counts in bins of 2 % width.

    A bin is represented by its largest value, so ties stay exact. Rows are counted before
    they are shuffled, by key and bin; what is then ordered is one key's bins.
    """
    bin_ = F.floor(BINS * F.log2(1.0 + 1000.0 * F.col(value))).cast("int").alias("bin")
    bins = rows.groupBy(*keys, bin_).agg(F.count("*").alias("n"), F.max(value).alias(name))
    by = f"PARTITION BY {', '.join(keys)}"
    bins = bins.selectExpr(*keys, name, "n", f"sum(n) OVER ({by} ORDER BY bin) AS upto", f"sum(n) OVER ({by}) AS size")
    return bins.where((F.col("upto") >= share * F.col("size")) & (F.col("upto") - F.col("n") < share * F.col("size"))).select(*keys, name)


def _centres(rows: DataFrame, p: _Mcd) -> DataFrame:
    """``m_x`` and ``s_x``: median and absolute deviation (made comparable to a standard deviation, not below the least one) of each group."""
    wide = lambda long, to: long.groupBy("g").agg(*(F.max(F.when(F.col("f") == x, F.col("at"))).alias(f"{to}_{x}") for x in p.names))
    each = lambda v: F.inline(F.array(*(F.struct(F.lit(x).alias("f"), v(x).alias("v")) for x in p.names)))
    mid = cut(wide(_quantile(rows.select("g", each(F.col)), ["g", "f"], "v", 0.5, "at"), "m"))
    off = p.joined(rows, mid).select("g", each(lambda x: F.abs(F.col(x) - F.col(f"m_{x}"))))
    mad = wide(_quantile(off, ["g", "f"], "v", 0.5, "at"), "d")
    least = [F.greatest(1.4826 * F.col(f"d_{x}"), F.lit(FEATURES[x])).alias(f"s_{x}") for x in p.names]
    return cut(p.joined(mid, mad).select("g", *(f"m_{x}" for x in p.names), *least))


def _starts(rows: DataFrame, p: _Mcd) -> DataFrame:
    """Three first estimates of each group, around its medians, told apart by ``s``.

    0: absolute deviations without correlation; 1: covariance of the directions from the
    centre (spatial signs); 2: of the hyperbolic tangents of the standardised statistics.
    """
    centre = _centres(rows, p)
    z = p.joined(rows, centre).select("g", *(((F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}")).alias(x) for x in p.names))
    far = F.sqrt(sum((F.col(x) * F.col(x) for x in p.names), F.lit(0.0)))
    sign = z.select("g", F.lit(1).alias("s"), *(F.when(far > 0, F.col(x) / far).otherwise(0.0).alias(x) for x in p.names))
    tanh = z.select("g", F.lit(2).alias("s"), *(F.tanh(x).alias(x) for x in p.names))
    both = sign.unionByName(tanh).groupBy("g", "s").agg(*(F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in p.pairs))
    plain = centre.select("g", F.lit(0).alias("s"), *(F.lit(float(a == b)).alias(f"c_{a}_{b}") for a, b in p.pairs))
    first = p.joined(plain.unionByName(both), centre)
    cov = [(F.col(f"c_{a}_{b}") * F.when(F.col("s") == 1, len(p.names)).otherwise(1) * F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"c_{a}_{b}") for a, b in p.pairs]
    return cut(_factor(first.select("g", "s", *(f"m_{x}" for x in p.names), *cov), p))


def _estimate(near: DataFrame, p: _Mcd) -> DataFrame:
    """Centre, Cholesky factor and log determinant of the covariance of each group's core.

    The covariance is made consistent for the normal distribution and gets the least
    variances added, so it is regular even where a statistic hardly varies.
    """
    m = near.groupBy("g", "s").agg(*(F.avg(x).alias(f"m_{x}") for x in p.names), *(F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in p.pairs))
    cov = [
        (CONSISTENCY * (F.col(f"c_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) + F.lit(FEATURES[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}") for a, b in p.pairs
    ]
    m = _factor(m.select("g", "s", *(f"m_{x}" for x in p.names), *cov), p)
    return m.withColumn("logdet", sum((2 * F.log(F.col(f"l_{x}_{x}")) for x in p.names), F.lit(0.0)))


def _factor(m: DataFrame, p: _Mcd) -> DataFrame:
    """The Cholesky factor in place of the covariance."""
    for j, b in enumerate(p.names):  # one column of the factor at a time
        done = lambda a: sum((F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in p.names[:j]), F.lit(0.0))
        m = m.withColumn(f"l_{b}_{b}", F.sqrt(F.greatest(F.col(f"c_{b}_{b}") - done(b), F.lit(FEATURES[b] ** 2))))
        m = m.withColumns({f"l_{a}_{b}": (F.col(f"c_{a}_{b}") - done(a)) / F.col(f"l_{b}_{b}") for a in p.names[j + 1 :]})
    return m.drop(*(f"c_{a}_{b}" for a, b in p.pairs))


def _squared(rows: DataFrame, p: _Mcd) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution; centre and factor are columns of ``rows``."""
    kept = rows.columns
    for i, a in enumerate(p.names):
        done = sum((F.col(f"l_{a}_{b}") * F.col(f"z_{b}") for b in p.names[:i]), F.lit(0.0))
        rows = rows.withColumn(f"z_{a}", (F.col(a) - F.col(f"m_{a}") - done) / F.col(f"l_{a}_{a}"))
    return rows.select(*kept, sum((F.col(f"z_{x}") * F.col(f"z_{x}") for x in p.names), F.lit(0.0)).alias("d2"))


def _distance(rows: DataFrame, estimate: DataFrame, p: _Mcd) -> DataFrame:
    return _squared(p.joined(rows, estimate), p).select("g", "s", *p.names, "d2")


def _concentrate(rows: DataFrame, estimate: DataFrame, p: _Mcd) -> DataFrame:
    """One concentration step: the estimate of the ``CORE`` of each group that is nearest by the last one."""
    d = _distance(rows, estimate, p)
    reach = _quantile(d, ["g", "s"], "d2", CORE, "reach")
    return _estimate(p.joined(d, reach, "g", "s").where("d2 <= reach"), p)


def _smallest(estimates: DataFrame) -> DataFrame:
    """The estimate with the smallest determinant of each group."""
    rest = [c for c in estimates.columns if c not in ("g", "s", "logdet")]
    return estimates.groupBy("g").agg(F.min(F.struct("logdet", "s", *rest)).alias("e")).select("g", "e.*")


def covariance_estimates(rows: DataFrame) -> DataFrame:
    """``rows(g, x1 .. x6)`` -> centre, factor, ``logdet``, ``size`` and ``scale`` of each group.

    Two concentration steps from each of three starts; the smallest determinant of a group
    goes on until no group's determinant falls any more.
    """
    rows = rows.select("g", *FEATURES)
    p = _Mcd(tuple(FEATURES), has_at_most(rows.select("g").distinct(), BROADCAST_GROUPS))
    est = cut(_concentrate(rows, _starts(rows, p), p))
    est = cut(_smallest(_concentrate(rows, est, p)))
    for _ in range(MOST_STEPS):
        before = est
        est = cut(_smallest(_concentrate(rows, before, p).unionByName(before, allowMissingColumns=True)))
        pair = p.joined(before.select("g", F.col("logdet").alias("before")), est.select("g", "logdet"))
        if (pair.agg(F.max(F.col("before") - F.col("logdet"))).first()[0] or 0.0) <= LEAST_FALL:
            break
    d = _distance(rows, est, p)
    size = d.groupBy("g").agg(F.count("*").alias("size"))
    scale = _quantile(d, ["g"], "d2", 0.5, "middle").withColumn("scale", F.col("middle") / _CHI2_MEDIAN).drop("middle")
    return cut(p.joined(p.joined(est.drop("s"), size), scale))


def _moments(estimate: DataFrame, level: str, p: _Mcd) -> DataFrame:
    """Weight, scale, centre and covariance of one level's estimates, with the level in their names."""
    size = F.col("size").cast("double")
    cov = {(a, b): sum((F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in p.names[: p.names.index(b) + 1]), F.lit(0.0)) for a, b in p.pairs}
    return estimate.where(F.col("g").startswith(level)).select(
        F.col("g").alias(f"g{level}"), (size * size / (size * size + SHRINK**2)).alias(f"w{level}"), F.col("scale").alias(f"scale{level}"),
        *(F.col(f"m_{x}").alias(f"m{level}_{x}") for x in p.names), *(cov[ab].alias(f"c{level}_{ab[0]}_{ab[1]}") for ab in p.pairs),
    )


def shrunk_estimates(rows: DataFrame) -> DataFrame:
    """``rows(g0, g1, g2, base_failed, x1 .. x6)`` -> centre, factor and ``scale`` for each ``g2``.

    Keys start with their level: 0 for all documents, 1 for a language, 2 for a language
    and source. A group none of whose documents passed has its language's estimate.
    """
    est = covariance_estimates(rows.where("NOT base_failed").select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *FEATURES))
    out = cut(rows.select("g0", "g1", "g2").distinct())
    p = _Mcd(tuple(FEATURES), has_at_most(out, BROADCAST_GROUPS))
    for level in "012":
        moments = _moments(est, level, p)
        out = out.join(F.broadcast(moments) if p.few else moments, f"g{level}", "inner" if level == "0" else "left")
    columns = ["scale{}"] + [f"m{{}}_{x}" for x in p.names] + [f"c{{}}_{a}_{b}" for a, b in p.pairs]
    values = {c: F.col(c.format(0)) for c in columns}
    for level in "12":
        w = F.coalesce(F.col(f"w{level}"), F.lit(0.0))
        values = {c: w * F.coalesce(F.col(c.format(level)), F.lit(0.0)) + (1 - w) * v for c, v in values.items()}
    return cut(_factor(out.select("g2", *(v.alias(c.replace("{}", "")) for c, v in values.items())), p))


def chi2_reach(tail: float) -> float:
    """Squared distance that six normal dimensions exceed with probability ``tail``."""
    low, high = 0.0, 1500.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2 + x * x / 8) > tail else (low, x)
    return high


def quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row per input row: ``doc_id, n_words``, the base statistics, ``base_failed, kept, distance2``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in 8-word windows that
    occur twice. Documents that fail it take no part in the estimates. Null language or
    source are values like any other; small groups are judged by estimates drawn towards
    their language's and the whole's. ``distance2`` is null only if no document passed the
    base rules. A null text counts as empty. Repeated rows count
    each; an empty table gives no rows; other columns are ignored.
    """
    rows = base_rules(docs, {"g": F.struct(col("lang").alias("lang"), col("source").alias("source"))})
    lang, source = (F.coalesce(F.col(f"g.{x}").cast("string"), F.lit("\x1e")) for x in ("lang", "source"))
    keys = {"g0": F.lit("0"), "g1": F.concat(F.lit("1"), lang), "g2": F.concat(F.lit("2"), lang, F.lit("\x1f"), source)}
    rows = cut(rows.withColumns(vector()).withColumns(keys).drop("g"))
    est = shrunk_estimates(rows)
    p = _Mcd(tuple(FEATURES), has_at_most(est, BROADCAST_GROUPS))
    out = rows.join(F.broadcast(est) if p.few else est, "g2", "left")
    out = _squared(out, p).withColumn("distance2", F.col("d2") / F.greatest(F.col("scale"), F.lit(LEAST_SCALE)))
    kept = ~F.col("base_failed") & (F.col("distance2") <= chi2_reach(tail))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")
