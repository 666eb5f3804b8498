"""The gate: candidates of both signals, their relative features, a logistic model, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators import logistic as logistic_fit
from loam.operators.retrieval import meet
from loam.session import BROADCAST_ROWS, materialize

# The features in order, and the weights of the model that is used without a fitted one.
FEATURES = ("sim", "lex", "sem_margin", "lex_margin", "sem_top", "lex_top", "both_top", "importance", "in_project")
WEIGHTS = {"bias": -4.91, "sim": 4.14, "lex": 3.19, "sem_margin": 2.46, "lex_margin": 0.3, "sem_top": 1.68, "lex_top": 1.94, "both_top": 0.87, "importance": -0.29, "in_project": 2.19}


@dataclass(frozen=True)
class GateModel:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    min_prob: float = 0.5


@dataclass(frozen=True)
class GateParams:
    max_hits: int = 1
    min_confidence: float = 0.9
    min_importance: float = 0.5
    sim_zero: float = 0.5
    sim_full: float = 0.8


def merge_signals(lexical: DataFrame, semantic: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(query, path, lex_conf, sim, and columns of the node to keep): what either signal found; lex_conf is 0 and sim null where a signal is silent. Rows come by query."""
    return meet(lexical, semantic, ("lex_conf", "sim"), keep).withColumn("lex_conf", F.coalesce("lex_conf", F.lit(0.0)))


def add_features(candidates: DataFrame) -> DataFrame:
    """Adds the features of candidates (query, path, lex_conf, sim, importance, in_project); margins are against the best other one of the query.

    All that share the best value are top, and their margin is against the second value, which equals it. A candidate
    without a sim counts as 0 against the best; one without a lexical score has a lexical margin of 0."""
    w = Window.partitionBy("query")

    def ranked(value: Column) -> tuple[Column, Column]:
        best = F.sort_array(F.collect_list(value).over(w), asc=False)
        return F.try_element_at(best, F.lit(1)), F.try_element_at(best, F.lit(2))

    lex = F.when(F.col("lex_conf") > 0, F.col("lex_conf"))
    (s1, s2), (l1, l2) = ranked(F.col("sim")), ranked(lex)
    df = candidates.withColumns({"_s1": s1, "_s2": s2, "_l1": l1, "_l2": l2})
    sim, zero = F.coalesce("sim", F.lit(0.0)), F.lit(0.0)
    sem_top, lex_top = F.coalesce(F.col("sim") == F.col("_s1"), F.lit(False)), F.coalesce((F.col("lex_conf") > 0) & (F.col("lex_conf") == F.col("_l1")), F.lit(False))
    sem_margin = F.when(F.col("_s1").isNull(), zero).when(sem_top, sim - F.coalesce("_s2", zero)).otherwise(sim - F.col("_s1"))
    lex_margin = F.when(F.col("lex_conf") <= 0, zero).when(lex_top, F.col("lex_conf") - F.coalesce("_l2", zero)).otherwise(F.col("lex_conf") - F.col("_l1"))
    as_number = lambda c: c.cast("double")
    return df.select(*candidates.columns, sim.alias("f_sim"), F.col("lex_conf").alias("f_lex"), sem_margin.alias("f_sem_margin"), lex_margin.alias("f_lex_margin"), as_number(sem_top).alias("f_sem_top"), as_number(lex_top).alias("f_lex_top"), as_number(sem_top & lex_top).alias("f_both_top"), F.col("importance").alias("f_importance"), as_number(F.coalesce("in_project", F.lit(False))).alias("f_in_project"))


def logistic(df: DataFrame, weights: dict[str, float], features: dict[str, str], clamp: float) -> Column:
    z = F.lit(float(weights.get("bias", 0.0)))
    for name, column in features.items():
        z = z + F.lit(float(weights.get(name, 0.0))) * F.col(column)
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z))))


def learned_confidence(featured: DataFrame, model: GateModel = GateModel()) -> DataFrame:
    return featured.withColumn("confidence", F.round(logistic(featured, model.weights, {f: f"f_{f}" for f in FEATURES}, 60.0), 9))


def _ramp(x: Column) -> Column:
    """x between 0 and 1; 0 for null, which greatest and least would skip."""
    return F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def threshold_confidence(candidates: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """1 - (1 - lexical)(1 - semantic), the latter from sim by a ramp."""
    span = p.sim_full - p.sim_zero
    sem = _ramp((F.col("sim") - p.sim_zero) / span) if span > 0 else F.lit(0.0)
    return candidates.withColumn("confidence", F.round(1.0 - (1.0 - F.col("lex_conf")) * (1.0 - sem), 9))


def select_hits(scored: DataFrame, threshold: float, p: GateParams = GateParams()) -> DataFrame:
    """The first max_hits of each query above the threshold and the least importance."""
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), F.desc("importance"), "path")
    ok = scored.filter((F.col("confidence") >= threshold) & (F.col("importance") >= p.min_importance))
    return ok.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= p.max_hits)


def near_miss(scored: DataFrame, threshold: float, p: GateParams = GateParams()) -> DataFrame:
    """(query, path, confidence, reason): the best candidate of each query that got none."""
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), F.desc("importance"), "path")
    best = scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    hit = select_hits(scored, threshold, p).select("query").distinct()
    reason = F.when(F.col("confidence") < threshold, "below threshold").otherwise("importance")
    return best.join(hit, "query", "left_anti").select("query", "path", "confidence", reason.alias("reason"))


def never_used(feedback: DataFrame, least: int = 3, prefixes: tuple[str, ...] = ("/projects/", "/references/")) -> DataFrame:
    """(path): shown at least so often and never used, of the suppressible branches. A null `used` is no use."""
    seen = feedback.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("used"), F.lit(False)).alias("u"))
    under = F.lit(False)
    for p in prefixes:
        under = under | F.col("path").startswith(p)
    return seen.filter((F.col("n") >= least) & ~F.col("u") & under).select("path")


def evaluate(gold: DataFrame, hits: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Metrics in one row, or one for each setting. gold: (query, expected, acceptable: arrays of paths); hits: (query, path), and with settings (setting: one row each) their column `setting`.

    recall: positives with an expected hit. precision: hits that are expected or acceptable, 1 without any hit.
    false_positive_rate: negatives (nothing expected) with a hit that isn't acceptable. injection_rate: queries with any hit."""
    by = [] if settings is None else ["setting"]
    none = F.array().cast("array<string>")
    g = gold.select("query", F.coalesce("expected", none).alias("e"), F.coalesce("acceptable", none).alias("a"))
    if settings is None:
        g = g.join(hits.groupBy("query").agg(F.collect_set("path").alias("paths")), "query", "left")
    else:  # few settings, each meets the whole gold set, once that has met the hits of all
        g = g.join(hits.groupBy("query").agg(F.collect_set(F.struct("setting", "path")).alias("_hits")), "query", "left").join(F.broadcast(settings.select("setting")))
        g = g.withColumn("paths", F.transform(F.filter("_hits", lambda x: x["setting"] == F.col("setting")), lambda x: x["path"]))
    g = g.withColumn("paths", F.coalesce("paths", none))
    good = F.size(F.array_intersect("paths", F.array_union("e", "a")))
    positive = F.size("e") > 0
    wrong = F.size(F.array_except("paths", "a")) > 0
    r = g.groupBy(*by).agg(F.count_if(positive).alias("p"), F.count_if(positive & F.arrays_overlap("paths", "e")).alias("found"), F.sum(F.size("paths")).alias("n"), F.sum(good).alias("good"), F.count_if(~positive).alias("neg"), F.count_if(~positive & wrong).alias("fp"), F.count_if(F.size("paths") > 0).alias("inj"), F.count(F.lit(1)).alias("all"))
    part = lambda a, b, none: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none), 9)
    return r.select(*by, part("found", "p", 0.0).alias("recall"), part("good", "n", 1.0).alias("precision"), part("fp", "neg", 0.0).alias("false_positive_rate"), part("inj", "all", 0.0).alias("injection_rate"))


#: Thresholds of a frontier.
FRONTIER = tuple(x / 20 for x in range(4, 20))


def sweep(gold: DataFrame, scored: DataFrame, thresholds: Sequence[float] = FRONTIER, p: GateParams = GateParams()) -> DataFrame:
    """The metrics at each threshold, from candidates scored once. As hits are taken by confidence, a query's hits at a threshold are its first ones that reach it: one pass serves all thresholds."""
    settings = scored.sparkSession.createDataFrame([(float(t),) for t in thresholds], "setting double")
    hits = select_hits(scored, min(thresholds), p).join(F.broadcast(settings)).filter(F.col("confidence") >= F.col("setting"))
    return evaluate(gold, hits, settings).withColumnRenamed("setting", "threshold")


def grid(gold: DataFrame, candidates: DataFrame, settings: Sequence[GateParams]) -> DataFrame:
    """The metrics of the threshold gate under each setting, with its values; all settings in one plan.

    Candidates travel once, by query; the settings meet them there, so what travels doesn't grow with the settings."""
    columns = "setting int, max_hits int, min_confidence double, min_importance double, sim_zero double, sim_full double"
    table = F.broadcast(candidates.sparkSession.createDataFrame([(i, p.max_hits, p.min_confidence, p.min_importance, p.sim_zero, p.sim_full) for i, p in enumerate(settings)], columns))
    span = F.col("sim_full") - F.col("sim_zero")
    ramp = F.when(span > 0, _ramp((F.col("sim") - F.col("sim_zero")) / span)).otherwise(0.0)
    scored = candidates.repartition("query").join(table).withColumn("confidence", F.round(1.0 - (1.0 - F.col("lex_conf")) * (1.0 - ramp), 9))
    order = Window.partitionBy("setting", "query").orderBy(F.desc("confidence"), F.desc("importance"), "path")
    ok = scored.filter((F.col("confidence") >= F.col("min_confidence")) & (F.col("importance") >= F.col("min_importance")))
    hits = ok.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= F.col("max_hits"))
    return evaluate(gold, hits.select("setting", "query", "path"), table).join(table, "setting")


def recommend(metrics: DataFrame, precision: float = 0.9) -> DataFrame:
    """The row of greatest recall among the precise ones, then precision, then fewest false positives, then strictness."""
    precise = metrics.withColumn("_ok", (F.col("precision") >= precision).cast("int"))
    strict = "threshold" if "threshold" in metrics.columns else "min_confidence"
    return precise.orderBy(F.desc("_ok"), F.desc("recall"), F.desc("precision"), "false_positive_rate", F.desc(strict)).limit(1).drop("_ok")


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold = position by key, modulo k; computed on the gold set, which is small."""
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(key)) - 1, F.lit(k)))


def labelled(gold: DataFrame, featured: DataFrame) -> DataFrame:
    """Candidates of the gold queries with y: whether they are expected or acceptable."""
    none = F.array().cast("array<string>")
    ok = gold.select("query", F.array_union(F.coalesce("expected", none), F.coalesce("acceptable", none)).alias("_ok"))
    return featured.join(ok, "query").withColumn("y", F.coalesce(F.array_contains("_ok", F.col("path")), F.lit(False)).cast("int")).drop("_ok")


def fit(rows: DataFrame, l2: float = 1.0, min_prob: float = GateModel().min_prob, table: bool = False) -> GateModel:
    """The model that minimises the logistic loss with a penalty of l2 / (2 n) on the weights of the features as they are, the bias free; the default model without rows. rows: of `labelled`; table: they are part of a table, which each round may read."""
    rows = rows.select("y", *[F.col(f"f_{f}").alias(f) for f in FEATURES])
    found = logistic_fit.fit(rows if table else materialize(rows), FEATURES, "y", penalty=l2)
    return GateModel() if found is None else GateModel({k: round(v, 4) for k, v in found.items()}, min_prob)


def cross_validate(gold: DataFrame, featured: DataFrame, k: int = 10, l2: float = 1.0) -> DataFrame:
    """Candidates with the confidence of a model that never saw their query; k models, each fitted on the other folds."""
    rows = materialize(labelled(gold, featured).join(folds(gold.select("query"), "query", k), "query"))
    parts = [learned_confidence(rows.filter(F.col("fold") == i), fit(rows.filter(F.col("fold") != i), l2, table=True)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).drop("y")


def failures(gold: DataFrame, scored: DataFrame, threshold: float, p: GateParams = GateParams(), show: int = 3) -> DataFrame:
    """(query, kind, path, confidence, position): queries whose expected nodes weren't hit (`missed`) or that got a hit neither expected nor acceptable (`wrong`), with their first candidates.

    Hits and first candidates come of one pass over the candidates: in one order, a hit is one of the first max_hits that reach both limits."""
    none = F.array().cast("array<string>")
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), F.desc("importance"), "path")
    ok = F.coalesce((F.col("confidence") >= threshold) & (F.col("importance") >= p.min_importance), F.lit(False))
    ranked = scored.withColumns({"position": F.row_number().over(order).cast("long"), "_ok": ok})
    ranked = ranked.withColumn("_hit", F.col("_ok") & (F.count_if("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= p.max_hits))
    kept = F.when(F.col("position") <= show, F.struct("path", "confidence", "position"))
    each = ranked.groupBy("query").agg(F.collect_set(F.when(F.col("_hit"), F.col("path"))).alias("paths"), F.collect_list(kept).alias("first"))
    g = gold.select("query", F.coalesce("expected", none).alias("e"), F.coalesce("acceptable", none).alias("a")).join(each, "query", "left").withColumn("paths", F.coalesce("paths", none))
    missed = (F.size("e") > 0) & ~F.arrays_overlap("paths", "e")
    wrong = F.size(F.array_except("paths", F.array_union("e", "a"))) > 0
    bad = g.select("query", F.when(missed, "missed").when(wrong, "wrong").alias("kind"), "first").filter("kind is not null")
    return bad.select("query", "kind", F.explode_outer("first").alias("c")).select("query", "kind", "c.path", "c.confidence", "c.position")


def candidate_pool(scored: DataFrame, most: int = 10) -> DataFrame:
    """What a reviewer labels a gold set from: the first candidates of each query, whatever their confidence and importance."""
    return select_hits(scored, 0.0, GateParams(max_hits=most, min_importance=0.0))


def without(candidates: DataFrame, suppressed: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Candidates without suppressed paths (path), and without those that were shown to the query before (query, path).

    Candidates stay where they are: up to BROADCAST_ROWS suppressed paths are sent to them, and what was shown joins them by query."""
    paths = materialize(suppressed.select("path").distinct())
    rows = candidates.join(F.broadcast(paths) if paths.count() <= BROADCAST_ROWS else paths, "path", "left_anti")
    if shown is None:
        return rows
    before = shown.groupBy("query").agg(F.collect_set("path").alias("_before"))
    return rows.join(before, "query", "left").filter(~F.coalesce(F.array_contains("_before", F.col("path")), F.lit(False))).drop("_before")
