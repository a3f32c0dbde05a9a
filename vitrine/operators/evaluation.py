"""Evaluation of a score against labels: AUC, bootstrap interval, precision and recall, size control, diagnostic model.

Inputs have an id, a label `y` (0 or 1) and a `score`. Everything starts from counts per score value, so
ties are exact and the ordered part is the set of distinct scores, not the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vitrine.functions import values
from vitrine.operators import ordering, resampling
from vitrine.session import materialize

BOOTSTRAP_RESAMPLES = 1000
BOOTSTRAP_SEED = 7
MIN_KNOWN_SIZES = 8
BUCKETS = ["q1_smallest", "q2", "q3", "q4_largest"]

# Inputs of the diagnostic model.
NUMERIC_FEATURES = [
    "workaround_app_count",
    "workaround_capability_count",
    "workaround_b2b",
    "workaround_multistore",
    "workaround_launch",
    "workaround_discount",
    "workaround_sso",
    "workaround_intl",
    "product_count",
    "catalog_growth_yoy",
    "products_last_90d",
    "review_count_max",
    "hreflang_alt_count",
]


def scored_labels(positives: DataFrame, negatives: DataFrame, scored: DataFrame) -> DataFrame:
    """Labelled stores that have a score, positives with y = 1 and negatives with y = 0, with their feature columns."""
    labelled = positives.select("domain", F.lit(1).alias("y")).unionByName(negatives.select("domain", F.lit(0).alias("y")))
    return labelled.join(scored.where(F.col("score").isNotNull()), "domain")


def _score_counts(df: DataFrame, score: str, y: str, group: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*group, score)
        .agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    )


def auc(df: DataFrame, score: str = "score", y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area under the ROC curve per group; NULL where one class is missing.

    Each positive counts the negatives below it plus half of those it ties with: with p and n per score
    value, sum(p * (negatives below + n / 2)) / (P * N).
    """
    wins = ordering.pair_wins(_score_counts(df, score, y, group), score, group)
    if not group:
        wins = wins.agg(*[F.sum(c).alias(c) for c in ("p", "n", "won2")])  # one row for an empty table too
    pairs2 = 2 * F.col("p").cast("double") * F.col("n").cast("double")
    return wins.select(*group, F.col("p").alias("positives"), F.col("n").alias("negatives"), F.try_divide(F.col("won2").cast("double"), pairs2).alias("auc"))


def bootstrap_interval(
    df: DataFrame,
    key: str,
    score: str = "score",
    y: str = "y",
    resamples: int = BOOTSTRAP_RESAMPLES,
    seed: int = BOOTSTRAP_SEED,
) -> DataFrame:
    """95 % percentile interval of the AUC over `resamples` Poisson resamples.

    A row counts Poisson(1) times in each resample, by a hash of seed, key and resample, so the result is a function
    of the data and the seed alone. One-class resamples are left out; both ends are NULL when none is left.
    """
    aucs = resampling.poisson_aucs(df, key, score, y, resamples, seed)
    # One value per resample from here on.
    return aucs.agg(
        F.count(F.lit(1)).alias("used"),
        F.percentile("auc", 0.025).alias("ci_low"),
        F.percentile("auc", 0.975).alias("ci_high"),
    )


def precision_recall_top(df: DataFrame, key: str, score: str = "score", y: str = "y", seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Precision and recall of the top max(1, n // 10) rows by score, ties at the cut taken in seeded hash order.

    The cut is an order statistic; only the rows that tie there are ordered, and of those only the ones in
    the hash prefix where the quota ends.
    """
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(key, score, y)
    quota = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    cut = ordering.value_at_positions(known, score, {"cut": (0.9, F.col("n") - quota)}).select(F.struct(quota.alias("k"), "cut"))
    placed = known.withColumn("_t", cut.scalar())
    higher = F.col(score) > F.col("_t.cut")
    summary = placed.agg(
        F.max("_t.k").alias("k"),
        F.max("_t.cut").alias("cut"),
        F.sum(y).alias("positives"),
        F.coalesce(F.sum(F.when(higher, F.col(y))), F.lit(0)).alias("sure"),
        (F.max("_t.k") - F.count_if(higher)).alias("quota"),
    )
    tied = known.where(F.col(score) == summary.select("cut").scalar())
    tied = tied.withColumn("_hash", values.seeded_order(seed, F.col(key)))
    taken = ordering.first_by_hash(tied, "_hash", summary.select("quota").scalar())
    extra = taken.agg(F.coalesce(F.sum(F.col(y)), F.lit(0)).alias("extra"))
    hits = summary.withColumn("hits", F.col("sure") + extra.scalar())
    return hits.select(
        "k",
        "hits",
        values.ratio(F.col("hits"), F.col("k")).alias("precision"),
        F.coalesce(values.ratio(F.col("hits"), F.col("positives")), F.lit(0.0)).alias("recall"),
    )


def precision_recall_at(df: DataFrame, threshold: float, score: str = "score", y: str = "y") -> DataFrame:
    """Flagged rows at or above the threshold, their precision and recall; 0 where nothing is flagged or positive."""
    at = F.col(score) >= threshold
    counts = df.where(F.col(score).isNotNull()).agg(
        F.count_if(at).alias("flagged"), F.count_if(at & (F.col(y) == 1)).alias("hits"), F.count_if(F.col(y) == 1).alias("positives")
    )
    zero = F.lit(0.0)
    return counts.select(
        "flagged",
        F.coalesce(values.ratio(F.col("hits"), F.col("flagged")), zero).alias("precision"),
        F.coalesce(values.ratio(F.col("hits"), F.col("positives")), zero).alias("recall"),
    )


def with_size_bucket(df: DataFrame, size: str) -> DataFrame:
    """Rows of known size with `bucket` 0 to 3 by interpolated quartiles; an edge value goes up. `_known` is their number."""
    known = df.where(F.col(size).isNotNull())
    edges = ordering.exact_percentiles(known, size, {"e1": 0.25, "e2": 0.5, "e3": 0.75})
    at = known.withColumn("_e", edges.select(F.struct("e1", "e2", "e3")).scalar())
    at = at.withColumn("_known", known.agg(F.count(F.lit(1))).scalar())
    value = F.col(size)
    steps = [(value >= F.col(f"_e.{e}")).cast("int") for e in ("e1", "e2", "e3")]
    return at.withColumn("bucket", steps[0] + steps[1] + steps[2]).drop("_e")


def size_bucket_aucs(df: DataFrame, size: str, score: str = "score", y: str = "y") -> DataFrame:
    """AUC within each size quartile; NULL for a one-class or empty quartile.

    With fewer than eight known sizes there is a single row `insufficient_product_count_data`.
    """
    spark = df.sparkSession
    bucketed = with_size_bucket(df, size)
    by_bucket = auc(bucketed.where(F.col("_known") >= MIN_KNOWN_SIZES), score, y, ["bucket"])
    known = df.where(F.col(size).isNotNull()).agg(F.count(F.lit(1))).scalar()
    names = spark.createDataFrame(list(enumerate(BUCKETS)), "bucket int, name string").withColumn("_known", known)
    full = names.where(F.col("_known") >= MIN_KNOWN_SIZES).join(by_bucket, "bucket", "left")
    few = names.where((F.col("_known") < MIN_KNOWN_SIZES) & (F.col("bucket") == 0))
    return full.select("name", "auc").unionByName(
        few.select(F.lit("insufficient_product_count_data").alias("name"), F.lit(None).cast("double").alias("auc"))
    )


def single_feature_aucs(df: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """AUC of each feature alone, over the rows where it is known."""
    typed = df.select(y, *[values.number(F.col(f), df.schema[f].dataType.simpleString()).alias(f) for f in features])
    long = typed.unpivot([y], list(features), "feature", "value").where(F.col("value").isNotNull())
    return auc(long, "value", y, ["feature"]).select("feature", "positives", "negatives", "auc")


def base_rate(df: DataFrame, y: str = "y") -> DataFrame:
    """Class counts and the share of positives."""
    counts = df.agg(F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) == 0).alias("negatives"))
    return counts.withColumn("base_rate", values.ratio(F.col("positives"), F.col("positives") + F.col("negatives")))


def score_table(df: DataFrame, key: str = "domain", score: str = "score", y: str = "y") -> DataFrame:
    """(key, label, score) from the highest score down; ties list positives first, then by key."""
    return df.select(key, F.col(y).alias("label"), F.round(score, 4).alias("score")).orderBy(
        F.desc("score"), F.desc("label"), key
    )


def top_negatives(negatives: DataFrame, scored: DataFrame, matches: DataFrame, top: int = 30) -> DataFrame:
    """The highest-scoring negatives with their components, sizes and matched apps, for a human to review.

    The cut is made before the app lists are gathered, and a list holds at most one entry per dictionary key.
    """
    rows = negatives.select("domain").join(scored.where(F.col("score").isNotNull()), "domain")
    best = rows.orderBy(F.desc("score"), "domain").limit(top)
    keys = matches.join(best.select("domain"), "domain", "left_semi").groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_set("key")), ";").alias("matched_app_keys")
    )
    return best.join(keys, "domain", "left").select(
        "domain",
        "score",
        "components",
        "product_count",
        "review_count_max",
        F.coalesce("matched_app_keys", F.lit("")).alias("matched_app_keys"),
        F.lit("").alias("reviewer_category"),
    ).orderBy(F.desc("score"), "domain")


def with_stratified_folds(df: DataFrame, key: str, folds: int, y: str = "y", seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Add `fold`: within each class, rows in seeded hash order are dealt out in turn, so folds keep the class balance."""
    hashed = df.withColumn("_hash", F.concat(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)))
    dealt = None
    for label in (0, 1):
        one = ordering.row_index(hashed.where(F.col(y) == label), "_hash", "_i")
        dealt = one if dealt is None else dealt.unionByName(one)
    return dealt.withColumn("fold", F.pmod(F.col("_i"), F.lit(folds)).cast("int")).drop("_hash", "_i")


def logistic_diagnostic(
    df: DataFrame, key: str, features: Sequence[str] = NUMERIC_FEATURES, y: str = "y", max_folds: int = 5
) -> dict[str, object]:
    """Cross-validated logistic regression on standardised inputs, missing values as 0. A diagnostic, not the score.

    Returns cv_folds, cv_auc_mean, cv_auc_std and coefficients, or `error` when rows or classes are too few.
    The penalty is the usual 0.5 * |w|^2 on the summed loss. Held-out rows are ranked by the linear predictor, an expression
    of the coefficients: a model's own `transform` ships its training summary and with it the session, which cannot be
    serialised once anything in the session has been observed.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    classes = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    rows = sum(classes.values())
    if len(classes) < 2 or rows < 10:
        return {"error": "too few labelled rows, or only one class"}
    folds = min(max_folds, min(classes.values()))
    if folds < 2:
        return {"error": "too few rows of one class to fold"}

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    filled = df.select(
        key, F.col(y).cast("double").alias("label"), *[F.coalesce(values.number(F.col(f), types[f]), F.lit(0.0)).alias(f) for f in features]
    )
    # Each fit passes over this some twenty times; read back, it has as many tasks as its size asks for.
    dealt = materialize(with_stratified_folds(filled, key, folds, "label").drop(key), "folds")

    def fit(train: DataFrame):
        stats = train.agg(F.count(F.lit(1)).alias("n"), *[s(f).alias(f"{n}_{f}") for f in features for n, s in (("m", F.avg), ("s", F.stddev_pop))]).first()
        scaled = {f: (F.col(f) - F.lit(stats[f"m_{f}"])) / F.lit(stats[f"s_{f}"] or 1.0) for f in features}
        prepared = VectorAssembler(inputCols=list(features), outputCol="features").transform(
            train.select("label", *[c.alias(f) for f, c in scaled.items()])
        )
        model = LogisticRegression(regParam=1.0 / stats["n"], standardization=False, maxIter=1000).fit(prepared)
        weights = dict(zip(features, (float(c) for c in model.coefficients.toArray()), strict=True))
        return weights, sum((scaled[f] * F.lit(w) for f, w in weights.items()), F.lit(float(model.intercept)))

    aucs = []
    for fold in range(folds):
        _, predictor = fit(dealt.where(F.col("fold") != fold))
        held_out = dealt.where(F.col("fold") == fold)
        aucs.append(auc(held_out.select(F.col("label").cast("int").alias("y"), predictor.alias("score"))).first()["auc"])
    coefficients, _ = fit(dealt)
    mean = sum(aucs) / folds
    return {
        "cv_folds": folds,
        "cv_auc_mean": mean,
        "cv_auc_std": (sum((a - mean) ** 2 for a in aucs) / folds) ** 0.5,
        "coefficients": coefficients,
    }


def metric_rows(spark, metrics: dict[str, object]) -> DataFrame:
    """(metric, value) rows of a report held on the driver."""
    flat = []
    for name, value in metrics.items():
        if isinstance(value, dict):
            flat += [(f"{name}.{k}", float(v)) for k, v in value.items()]
        elif isinstance(value, (int, float)):
            flat.append((name, float(value)))
    return spark.createDataFrame(flat, "metric string, value double")


