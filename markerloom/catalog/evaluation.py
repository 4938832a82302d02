"""Fold, score, summary and stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markerloom.catalog.common import BRANDS, WORDS, Registry, rounded
from markerloom.catalog.presence import CODES, PRUNED
from markerloom.operators import folds, metrics, presence, stability
from markerloom.session import written
from markerloom.sources import tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

SPLITS, REPEATS, SEED, INNER = 5, 2, 42, 3


def fold_ctes(stratified: bool = True, splits: int = SPLITS, repeats: int = REPEATS, inner: int = INNER) -> str:
    label = "label, " if stratified else ""
    return f"""dealt AS (
  SELECT sample_id, {label}repeat, row_number() OVER (
    PARTITION BY repeat ORDER BY {label}md5(concat_ws(':', {SEED}, repeat, sample_id)), sample_id) - 1 AS place
  FROM samples, (SELECT unnest(range(1, {repeats} + 1)) AS repeat)),
folds AS (
  SELECT sample_id, {label}CAST(repeat AS INTEGER) AS repeat, CAST(place % {splits} + 1 AS INTEGER) AS fold,
         CAST((place // {splits} + place % {splits}) % {inner} + 1 AS INTEGER) AS inner_fold,
         CAST((repeat - 1) * {splits} + place % {splits} + 1 AS INTEGER) AS fit_id
  FROM dealt)"""


def word_folds(spark, sf, repeats=REPEATS):
    return folds.repeated_folds(tables.document_baskets(spark, sf), SPLITS, repeats, SEED, True, INNER)


@registry.add("folds_stratified", f"WITH {WORDS}, {fold_ctes()} SELECT repeat, fold, fit_id, sample_id, label FROM folds")
def _folds(spark, sf):
    return word_folds(spark, sf).select("repeat", "fold", "fit_id", "sample_id", "label")


@registry.add("folds_plain", f"WITH {BRANDS}, {fold_ctes(False)} SELECT repeat, fold, fit_id, sample_id FROM folds")
def _folds_plain(spark, sf):
    samples = tables.customer_samples(spark, sf)
    return folds.repeated_folds(samples, SPLITS, REPEATS, SEED, False, INNER).select("repeat", "fold", "fit_id", "sample_id")


@registry.add("folds_inner", f"WITH {WORDS}, {fold_ctes()} SELECT fit_id, inner_fold, sample_id FROM folds")
def _folds_inner(spark, sf):
    return word_folds(spark, sf).select("fit_id", "inner_fold", "sample_id")


@registry.add(
    "folds_sizes",
    f"""WITH {WORDS}, {fold_ctes()},
    held AS (SELECT repeat, fold, fit_id, count(*) AS n_test, sum(CASE WHEN label = 'en' THEN 1 ELSE 0 END)::BIGINT AS positives_test
             FROM folds GROUP BY repeat, fold, fit_id)
    SELECT repeat, fold, fit_id, (sum(n_test) OVER w - n_test)::BIGINT AS n_train, n_test,
           (sum(positives_test) OVER w - positives_test)::BIGINT AS positives_train, positives_test
    FROM held WINDOW w AS (PARTITION BY repeat)""",
)
def _fold_sizes(spark, sf):
    return folds.fold_sizes(word_folds(spark, sf), "en")


def holdout_ctes(seed: str = str(SEED), name: str = "split", extra: str = "", source: str = "samples") -> str:
    part = f"{extra}, label" if extra else "label"
    shown = f"{extra}, " if extra else ""
    return f"""{name} AS (
  SELECT {shown}sample_id, label, row_number() OVER (PARTITION BY {part} ORDER BY md5({seed} || ':' || sample_id), sample_id)
         <= round_even(count(*) OVER (PARTITION BY {part}) * 0.2::DOUBLE, 0) AS is_test FROM {source})"""


@registry.add("folds_holdout", f"WITH {WORDS}, {holdout_ctes(repr(str(SEED)))} SELECT sample_id, label, is_test FROM split")
def _holdout(spark, sf):
    return folds.holdout_split(tables.document_baskets(spark, sf), 0.2, SEED)


# ---- scores -----------------------------------------------------------------

JUDGED = """judged AS (
  SELECT doc_id, quality, toxic, n_chars::DOUBLE AS score, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS y_pred
  FROM labels JOIN documents USING (doc_id)),
targets_ AS (SELECT 'quality' AS target, quality AS y_true, score, y_pred FROM judged UNION ALL
         SELECT 'toxic', toxic, score, y_pred FROM judged)"""


def judged(spark, sf):
    """Both judgements, scored by text length."""
    rows = F.array(
        F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y_true")),
        F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y_true")),
    )
    return tables.quality_labels(spark, sf).select(
        "score", F.when(F.col("score") >= 1500, 1).otherwise(0).alias("y_pred"), F.explode(rows).alias("r")
    ).select("score", "y_pred", "r.*")


@registry.add(
    "metric_auc",
    f"""WITH {JUDGED}
    SELECT p.target, round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc
    FROM targets_ p JOIN targets_ n ON p.target = n.target AND p.y_true = 1 AND n.y_true = 0 GROUP BY p.target""",
)
def _auc(spark, sf):
    return metrics.roc_auc(judged(spark, sf), ["target"]).select("target", rounded("auc"))


@registry.add(
    "metric_binary",
    f"""WITH {JUDGED}, c AS (
      SELECT target, sum((y_true = 1 AND y_pred = 1)::INT)::BIGINT AS "TP", sum((y_true = 0 AND y_pred = 1)::INT)::BIGINT AS "FP",
             sum((y_true = 0 AND y_pred = 0)::INT)::BIGINT AS "TN", sum((y_true = 1 AND y_pred = 0)::INT)::BIGINT AS "FN"
      FROM targets_ GROUP BY target)
    SELECT *, round(("TP" + "TN") / ("TP" + "FP" + "TN" + "FN")::DOUBLE, 6) AS accuracy,
      round(("TP" / ("TP" + "FN")::DOUBLE + "TN" / ("TN" + "FP")::DOUBLE) / 2, 6) AS balanced_accuracy,
      round(("TP"::DOUBLE * "TN" - "FP"::DOUBLE * "FN") /
        sqrt(("TP" + "FP")::DOUBLE * ("TP" + "FN") * ("TN" + "FP") * ("TN" + "FN")), 6) AS "MCC" FROM c""",
)
def _binary(spark, sf):
    scores = metrics.binary_scores(judged(spark, sf), ["target"])
    return scores.select("target", "TP", "FP", "TN", "FN", *[rounded(c) for c in ("accuracy", "balanced_accuracy", "MCC")])


# Marker words per language, as a plain classifier whose scores SQL can repeat.
HINTS = {"de": ("der", "die", "und"), "en": ("the", "and", "of"), "es": ("el", "los", "ci"), "fr": ("le", "les", "et")}


def hinted(spark, sf):
    """Documents with the number of marker words of each language they hold."""
    docs = tables.document_baskets(spark, sf).join(
        tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "source"), "sample_id"
    )
    hits = [
        F.size(F.array_intersect("items", F.array(*[F.lit(w) for w in words]))).alias(f"h_{lang}")
        for lang, words in HINTS.items()
    ]
    docs = docs.select("sample_id", "source", F.col("label").alias("y_true"), *hits)
    total = sum(F.col(f"h_{lang}") for lang in HINTS) + F.lit(float(len(HINTS)))
    prob = F.create_map(*[x for lang in HINTS for x in (F.lit(lang), (F.col(f"h_{lang}") + 1) / total)])
    best = F.greatest(*[F.col(f"h_{lang}") for lang in HINTS])
    pred = F.coalesce(*[F.when(F.col(f"h_{lang}") == best, F.lit(lang)) for lang in HINTS])
    return docs.select("sample_id", "source", "y_true", prob.alias("prob"), pred.alias("y_pred"))


HINTED = (
    f"""WITH {WORDS}, hits AS (SELECT s.sample_id, d.source, s.label AS y_true, """
    + ", ".join(
        f"count(CASE WHEN p.feature IN ({', '.join(repr(w) for w in words)}) THEN 1 END) AS h_{lang}" for lang, words in HINTS.items()
    )
    + """ FROM samples s JOIN documents d ON s.sample_id = CAST(d.doc_id AS VARCHAR)
      LEFT JOIN presence p ON p.sample_id = s.sample_id GROUP BY s.sample_id, d.source, s.label),
    scored AS (SELECT *, h_de + h_en + h_es + h_fr + 4.0::DOUBLE AS total, greatest(h_de, h_en, h_es, h_fr) AS best FROM hits),
    hinted AS (SELECT *, CASE WHEN h_de = best THEN 'de' WHEN h_en = best THEN 'en' WHEN h_es = best THEN 'es' ELSE 'fr' END AS y_pred,
               CASE y_true WHEN 'de' THEN h_de + 1 WHEN 'en' THEN h_en + 1 WHEN 'es' THEN h_es + 1 ELSE h_fr + 1 END / total AS p_true FROM scored)"""
)

REPORT = """,
    classes AS (SELECT DISTINCT source, y_true AS class FROM hinted UNION SELECT DISTINCT source, y_pred FROM hinted),
    report AS (SELECT c.source, c.class,
      count(CASE WHEN h.y_true = c.class AND h.y_pred = c.class THEN 1 END)::DOUBLE AS tp,
      count(CASE WHEN h.y_true = c.class THEN 1 END)::DOUBLE AS t, count(CASE WHEN h.y_pred = c.class THEN 1 END)::DOUBLE AS p
      FROM classes c JOIN hinted h ON c.source = h.source GROUP BY c.source, c.class),
    scored_report AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS "precision", CASE WHEN t = 0 THEN 0 ELSE tp / t END AS recall,
      2 * tp / (t + p) AS f1 FROM report)"""


@registry.add(
    "metric_class_report",
    f"""{HINTED}{REPORT} SELECT source, class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
    t::BIGINT AS support, tp::BIGINT AS hits FROM scored_report""",
)
def _report(spark, sf):
    report = metrics.class_report(hinted(spark, sf), ["source"])
    return report.select("source", "class", rounded("precision"), rounded("recall"), rounded("f1"), "support", "hits")


@registry.add(
    "metric_multiclass",
    f"""{HINTED}{REPORT} SELECT source, round(sum(tp) / sum(t), 6) AS accuracy,
    round(avg(CASE WHEN t > 0 THEN recall END), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1,
    round(avg("precision"), 6) AS macro_precision FROM scored_report GROUP BY source""",
)
def _multiclass(spark, sf):
    scores = metrics.multiclass_scores(hinted(spark, sf), ["source"])
    return scores.select("source", *[rounded(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "macro_precision")])


@registry.add(
    "metric_macro_auc",
    f"""{HINTED}, long AS (
      SELECT source, y_true, unnest(['de', 'en', 'es', 'fr']) AS class,
             unnest([(h_de + 1) / total, (h_en + 1) / total, (h_es + 1) / total, (h_fr + 1) / total]) AS score FROM hinted),
    pairs AS (SELECT p.source, p.class, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc
      FROM long p JOIN long n ON p.source = n.source AND p.class = n.class AND p.y_true = p.class AND n.y_true <> n.class GROUP BY p.source, p.class)
    SELECT s.source, CASE WHEN count(auc) = 4 THEN round(avg(auc), 6) END AS macro_auc
    FROM (SELECT DISTINCT source FROM hinted) s LEFT JOIN pairs p ON s.source = p.source GROUP BY s.source""",
)
def _macro_auc(spark, sf):
    return metrics.macro_auc(hinted(spark, sf), len(HINTS), ["source"]).select("source", rounded("macro_auc"))


@registry.add("metric_log_loss", f"{HINTED} SELECT source, round(-avg(ln(p_true)), 6) AS log_loss FROM hinted GROUP BY source")
def _log_loss(spark, sf):
    p_true = F.element_at("prob", F.col("y_true")).alias("p_true")
    return metrics.log_loss(hinted(spark, sf).select("source", p_true), ["source"]).select("source", rounded("log_loss"))


SPENT = """spent AS (
  SELECT c_mktsegment AS segment, c_acctbal AS y_true, coalesce(o.y_pred, 0) AS y_pred
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) / 500 AS y_pred FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey)"""


@registry.add(
    "metric_regression",
    f"""WITH {SPENT} SELECT segment, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) AS "R2",
    round(avg(abs(y_true - y_pred)), 4) AS "MAE", round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS "RMSE" FROM spent GROUP BY segment""",
)
def _regression(spark, sf):
    spent = tables.table(spark, sf, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 500).alias("y_pred"))
    customers = tables.table(spark, sf, "customer")
    pairs = customers.join(spent, customers.c_custkey == spent.o_custkey, "left").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("y_true"), F.coalesce("y_pred", F.lit(0.0)).alias("y_pred")
    )
    return metrics.regression_scores(pairs, ["segment"]).select(
        "segment", rounded("R2"), rounded("MAE", digits=4), rounded("RMSE", digits=4)
    )


# ---- coefficients that SQL can repeat ---------------------------------------
# Per fit and class, the difference of a word's share between the class and the
# rest of the training rows, set to zero when it is small.

CUT = 0.3


def word_profile(spark, sf):
    """Word baskets over the pruned vocabulary."""
    baskets = tables.document_baskets(spark, sf)
    kept = presence.prune_features(baskets)
    kept = written(kept, "kept")
    return written(presence.restrict_items(baskets, presence.vocabulary(kept)), "profile"), kept


def class_coef(baskets, assigned, cut=CUT):
    """``fit_id, class, feature, coef`` for every class and fit, zeros left out."""
    labels = [row.label for row in baskets.select("label").distinct().orderBy("label").collect()]
    marked = baskets.join(assigned.select("sample_id", "repeat", "fold"), "sample_id")
    held = marked.groupBy("repeat", "fold", "label").agg(F.count("*").alias("n"))
    held_f = marked.select("repeat", "fold", "label", F.explode("items").alias("feature")).groupBy(
        "repeat", "fold", "label", "feature"
    ).agg(F.count("*").alias("n"))

    def training(counts, keys):
        """Per fit: sums over the other folds, one column per label."""
        by_label = [F.sum(F.when(F.col("label") == lab, F.col("n")).otherwise(0)).alias(f"n_{lab}") for lab in labels]
        whole = counts.groupBy("repeat", *keys).agg(*by_label)
        out = counts.groupBy("repeat", "fold", *keys).agg(*[c.alias(f"out_{lab}") for lab, c in zip(labels, by_label)])
        cells = whole.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(SPLITS))))
        joined = cells.join(out, ["repeat", "fold", *keys], "left")
        return joined.select(
            "repeat", "fold", *keys, *[(F.col(f"n_{lab}") - F.coalesce(f"out_{lab}", F.lit(0))).alias(f"n_{lab}") for lab in labels]
        )

    rows = training(held, []).select("repeat", "fold", *[F.col(f"n_{lab}").alias(f"all_{lab}") for lab in labels])
    both = training(held_f, ["feature"]).join(rows, ["repeat", "fold"])
    n, everyone = sum(F.col(f"n_{lab}") for lab in labels), sum(F.col(f"all_{lab}") for lab in labels)

    def gap(lab):
        inside = F.col(f"n_{lab}") / F.col(f"all_{lab}").cast("double")
        return inside - (n - F.col(f"n_{lab}")) / (everyone - F.col(f"all_{lab}")).cast("double")

    classes = F.array(*[F.struct(F.lit(lab).alias("class"), gap(lab).alias("coef")) for lab in labels])
    return (
        both.select(((F.col("repeat") - 1) * SPLITS + F.col("fold")).cast("int").alias("fit_id"), "feature", F.explode(classes).alias("c"))
        .select("fit_id", "feature", "c.class", "c.coef")
        .filter(F.abs("coef") >= cut)
    )


COEF = f"""WITH {WORDS}, {PRUNED}, {fold_ctes()},
labels_ AS (SELECT DISTINCT label AS class FROM samples),
training AS (SELECT f.fit_id, o.sample_id, o.label FROM (SELECT DISTINCT repeat, fold, fit_id FROM folds) f
             JOIN folds o ON o.repeat = f.repeat AND o.fold <> f.fold),
totals AS (SELECT fit_id, class, sum((label = class)::INT) AS n_in, sum((label <> class)::INT) AS n_out
           FROM training, labels_ GROUP BY fit_id, class),
hits AS (SELECT t.fit_id, p.feature, t.label, count(*) AS n FROM training t
         JOIN presence p ON p.sample_id = t.sample_id JOIN kept k ON k.feature = p.feature GROUP BY t.fit_id, p.feature, t.label),
gaps AS (SELECT h.fit_id, c.class, h.feature,
           sum(CASE WHEN h.label = c.class THEN n ELSE 0 END) / any_value(n_in)::DOUBLE
             - sum(CASE WHEN h.label <> c.class THEN n ELSE 0 END) / any_value(n_out)::DOUBLE AS coef
         FROM hits h, labels_ c JOIN totals t ON t.class = c.class WHERE t.fit_id = h.fit_id GROUP BY h.fit_id, c.class, h.feature),
coef AS (SELECT * FROM gaps WHERE abs(coef) >= {CUT})"""


def word_coef(spark, sf):
    baskets, kept = word_profile(spark, sf)
    assigned = folds.repeated_folds(baskets, SPLITS, REPEATS, SEED, True, INNER)
    return baskets, kept, assigned, written(class_coef(baskets, assigned), "coef")


FITS = SPLITS * REPEATS


@registry.add(
    "stability_binary",
    f"""{COEF}, mine AS (SELECT * FROM coef WHERE class = 'en')
    SELECT k.feature AS "Orthogroup", count(coef) AS n_selected, round(count(coef) / {FITS}::DOUBLE, 6) AS selection_rate,
      round(coalesce(sum(coef), 0) / {FITS}, 6) AS mean_coef, round(coalesce(sum(abs(coef)), 0) / {FITS}, 6) AS mean_abs_coef,
      round(avg(coef), 6) AS mean_coef_selected, round(avg((coef > 0)::INT), 6) AS pos_rate_selected,
      round(avg((coef < 0)::INT), 6) AS neg_rate_selected
    FROM kept k LEFT JOIN mine m ON m.feature = k.feature GROUP BY k.feature""",
)
def _stability_binary(spark, sf):
    _, kept, _, coef = word_coef(spark, sf)
    table = stability.binary_stability(coef.filter(F.col("class") == "en"), kept, FITS)
    numbers = ("selection_rate", "mean_coef", "mean_abs_coef", "mean_coef_selected", "pos_rate_selected", "neg_rate_selected")
    return table.select("Orthogroup", "n_selected", *[rounded(c) for c in numbers])


@registry.add(
    "stability_any",
    f"""{COEF} SELECT k.feature AS "Orthogroup", count(DISTINCT fit_id) AS n_selected_any,
      round(count(DISTINCT fit_id) / {FITS}::DOUBLE, 6) AS selection_rate_any
    FROM kept k LEFT JOIN coef c ON c.feature = k.feature GROUP BY k.feature""",
)
def _stability_any(spark, sf):
    _, kept, _, coef = word_coef(spark, sf)
    return stability.any_class_stability(coef, kept, FITS).withColumn("selection_rate_any", rounded("selection_rate_any"))


TOI_SQL = f"""{COEF}, mine AS (SELECT * FROM coef WHERE class = 'fr'),
    toi AS (SELECT k.feature AS "Orthogroup", count(coef) AS n_selected_toi, round(count(coef) / {FITS}::DOUBLE, 6) AS selection_rate_toi,
      round(avg(coef), 6) AS "mean_coef_toi_selectedFits",
      CASE WHEN avg(coef) > 0 THEN 'enriched_in_TOI' WHEN avg(coef) < 0 THEN 'depleted_in_TOI' ELSE 'NA' END AS "direction_in_TOI"
    FROM kept k LEFT JOIN mine m ON m.feature = k.feature GROUP BY k.feature)"""


def toi_table(spark, sf):
    _, kept, _, coef = word_coef(spark, sf)
    table = stability.toi_stability(coef, kept, FITS, "fr")
    return table.withColumn("selection_rate_toi", rounded("selection_rate_toi")).withColumn(
        "mean_coef_toi_selectedFits", rounded("mean_coef_toi_selectedFits")
    )


@registry.add("stability_toi", f"{TOI_SQL} SELECT * FROM toi")
def _stability_toi(spark, sf):
    return toi_table(spark, sf)


@registry.add("stability_top20", f'{TOI_SQL} SELECT * FROM toi ORDER BY selection_rate_toi DESC, n_selected_toi DESC, "Orthogroup" LIMIT 20')
def _stability_top(spark, sf):
    return stability.ranked(toi_table(spark, sf), 20)


PREDICTIONS = f"""{COEF},
predictions AS (
  SELECT f.fit_id, f.fold, f.repeat, f.sample_id, (f.label = 'en')::INT AS y_true, 1 / (1 + exp(-coalesce(s.total, 0))) AS y_prob
  FROM folds f LEFT JOIN (
    SELECT f2.fit_id, f2.sample_id, sum(c.coef) AS total FROM folds f2 JOIN presence p ON p.sample_id = f2.sample_id
    JOIN coef c ON c.fit_id = f2.fit_id AND c.feature = p.feature AND c.class = 'en' GROUP BY f2.fit_id, f2.sample_id) s
  ON s.fit_id = f.fit_id AND s.sample_id = f.sample_id)"""


def word_predictions(spark, sf):
    """Held-out probabilities from the coefficients above."""
    baskets, _, assigned, coef = word_coef(spark, sf)
    held = baskets.join(assigned.select("sample_id", "fit_id"), "sample_id")
    scores = (
        held.select("fit_id", "sample_id", F.explode("items").alias("feature"))
        .join(coef.filter(F.col("class") == "en"), ["fit_id", "feature"])
        .groupBy("fit_id", "sample_id")
        .agg(F.sum("coef").alias("total"))
    )
    return held.join(scores, ["fit_id", "sample_id"], "left").select(
        "fit_id",
        "sample_id",
        F.when(F.col("label") == "en", 1).otherwise(0).alias("y_true"),
        (1 / (1 + F.exp(-F.coalesce("total", F.lit(0.0))))).alias("y_prob"),
    )


@registry.add(
    "summary_samples",
    f"""{PREDICTIONS} SELECT sample_id, avg(y_true)::DOUBLE AS y_true, round(avg(y_prob), 6) AS y_prob_mean, round(stddev_samp(y_prob), 6) AS y_prob_sd,
    count(*) AS n_predictions, CASE WHEN avg(y_prob) >= 0.5 THEN 1 ELSE 0 END AS y_pred_mean FROM predictions GROUP BY sample_id""",
)
def _summary(spark, sf):
    return stability.sample_summary(word_predictions(spark, sf)).withColumns(
        {c: rounded(c) for c in ("y_prob_mean", "y_prob_sd")}
    )


FOLD_SQL = f"""{PREDICTIONS}, marked AS (SELECT *, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM predictions),
    fold_metrics AS (SELECT fit_id,
      (avg(CASE WHEN y_true = 1 THEN y_pred END) + avg(CASE WHEN y_true = 0 THEN 1 - y_pred END)) / 2 AS balanced_accuracy,
      (sum(y_true * y_pred)::DOUBLE * sum((1 - y_true) * (1 - y_pred)) - sum((1 - y_true) * y_pred)::DOUBLE * sum(y_true * (1 - y_pred)))
      / sqrt(sum(y_pred)::DOUBLE * sum(y_true) * sum(1 - y_true) * sum(1 - y_pred)) AS "MCC" FROM marked GROUP BY fit_id)"""


@registry.add(
    "summary_folds",
    f"""{FOLD_SQL} SELECT 'balanced_accuracy' AS metric, round(avg(balanced_accuracy), 6) AS mean, round(stddev_samp(balanced_accuracy), 6) AS sd,
    count(balanced_accuracy) AS n_folds FROM fold_metrics
    UNION ALL SELECT 'MCC', round(avg("MCC"), 6), round(stddev_samp("MCC"), 6), count("MCC") FROM fold_metrics""",
)
def _summary_folds(spark, sf):
    marked = word_predictions(spark, sf).withColumn("y_pred", F.when(F.col("y_prob") >= 0.5, 1).otherwise(0))
    table = stability.metric_summary(metrics.binary_scores(marked, ["fit_id"]), ["balanced_accuracy", "MCC"])
    return table.select("metric", rounded("mean"), rounded("sd"), "n_folds")


# A brand's coefficient for the balance: mean with minus mean without, per training set.
BALANCE_CUT = 150.0


def balance_tables(spark, sf):
    baskets = tables.brand_baskets(spark, sf).join(
        tables.balances(spark, sf).select(F.col("sample").cast("string").alias("sample_id"), F.col("balance").alias("y")), "sample_id"
    )
    assigned = folds.repeated_folds(baskets, SPLITS, REPEATS, SEED, False, INNER)
    marked = baskets.join(assigned.select("sample_id", "repeat", "fold"), "sample_id")
    codes = F.concat(F.array(F.lit("")), F.col("items"))
    held = marked.select("repeat", "fold", "y", F.explode(codes).alias("feature")).groupBy("repeat", "fold", "feature").agg(
        F.count("*").alias("n"), F.sum("y").alias("s")
    )
    whole = held.groupBy("repeat", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cells = whole.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(SPLITS))))
    out = held.select("repeat", "fold", "feature", F.col("n").alias("n_out"), F.col("s").alias("s_out"))
    sums = cells.join(out, ["repeat", "fold", "feature"], "left").select(
        ((F.col("repeat") - 1) * SPLITS + F.col("fold")).cast("int").alias("fit_id"),
        "feature",
        (F.col("n") - F.coalesce("n_out", F.lit(0))).alias("n"),
        (F.col("s") - F.coalesce("s_out", F.lit(0.0))).alias("s"),
    )
    rows = sums.filter("feature = ''").select("fit_id", F.col("n").alias("all_n"), F.col("s").alias("all_s"))
    gap = F.col("s") / F.col("n") - (F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    coef = sums.filter("feature <> '' AND n > 0").join(rows, "fit_id").select("fit_id", "feature", gap.alias("coef"))
    return baskets, assigned, coef.filter(F.abs("coef") >= BALANCE_CUT)


BALANCE = f"""WITH {BRANDS}, {fold_ctes(False)},
outcome AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_acctbal AS y FROM customer),
features AS (SELECT DISTINCT feature FROM presence),
training AS (SELECT f.fit_id, o.sample_id, y FROM (SELECT DISTINCT repeat, fold, fit_id FROM folds) f
             JOIN folds o ON o.repeat = f.repeat AND o.fold <> f.fold JOIN outcome u ON u.sample_id = o.sample_id),
gaps AS (SELECT t.fit_id, f.feature, avg(CASE WHEN p.feature IS NOT NULL THEN y END) - avg(CASE WHEN p.feature IS NULL THEN y END) AS coef
         FROM training t CROSS JOIN features f LEFT JOIN presence p ON p.sample_id = t.sample_id AND p.feature = f.feature
         GROUP BY t.fit_id, f.feature),
coef AS (SELECT * FROM gaps WHERE abs(coef) >= {BALANCE_CUT})"""


@registry.add(
    "stability_regression",
    f"""{BALANCE} SELECT f.feature AS "Orthogroup", count(coef) AS n_selected, round(count(coef) / {FITS}::DOUBLE, 6) AS selection_rate
    FROM features f LEFT JOIN coef c ON c.feature = f.feature GROUP BY f.feature""",
)
def _stability_regression(spark, sf):
    baskets, _, coef = balance_tables(spark, sf)
    table = stability.regression_stability(coef, presence.feature_counts(baskets), FITS)
    return table.withColumn("selection_rate", rounded("selection_rate"))


@registry.add(
    "summary_regression",
    f"""{BALANCE} SELECT s.sample_id, round(any_value(y), 2) AS y_true, round(avg(total), 4) AS y_pred_mean, round(stddev_samp(total), 4) AS y_pred_sd,
      count(*) AS n_predictions
    FROM (SELECT f.fit_id, f.sample_id, coalesce(sum(c.coef), 0) AS total FROM folds f
          LEFT JOIN presence p ON p.sample_id = f.sample_id LEFT JOIN coef c ON c.fit_id = f.fit_id AND c.feature = p.feature
          GROUP BY f.fit_id, f.sample_id) s JOIN outcome u ON u.sample_id = s.sample_id GROUP BY s.sample_id""",
)
def _summary_regression(spark, sf):
    baskets, assigned, coef = balance_tables(spark, sf)
    held = baskets.join(assigned.select("sample_id", "fit_id"), "sample_id")
    scores = (
        held.select("fit_id", "sample_id", F.explode("items").alias("feature"))
        .join(coef, ["fit_id", "feature"])
        .groupBy("fit_id", "sample_id")
        .agg(F.sum("coef").alias("total"))
    )
    predictions = held.join(scores, ["fit_id", "sample_id"], "left").select(
        "sample_id", F.col("y").alias("y_true"), F.coalesce("total", F.lit(0.0)).alias("y_pred")
    )
    table = stability.regression_summary(predictions)
    return table.select(
        "sample_id", rounded("y_true", digits=2), rounded("y_pred_mean", digits=4), rounded("y_pred_sd", digits=4), "n_predictions"
    )


# ---- parameter choice -------------------------------------------------------
# Grid scores that SQL can repeat: a length threshold that depends on the grid
# point, scored by accuracy on each inner fold of each training set.

GRID_C, GRID_L1 = (0.5, 1.0, 2.0), (0.1, 0.5)


@registry.add(
    "choose_hyper",
    f"""WITH samples AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, CAST(quality AS VARCHAR) AS label, quality, n_chars FROM labels JOIN documents USING (doc_id)),
    {fold_ctes()}, grid AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS "C", l1_ratio FROM (SELECT unnest([0.1, 0.5])::DOUBLE AS l1_ratio)),
    scores AS (
      SELECT f.fit_id, g."C", g.l1_ratio, o.inner_fold, avg(((s.n_chars >= 400 * g."C" * (1 + g.l1_ratio))::INT = s.quality)::INT) AS score
      FROM (SELECT DISTINCT repeat, fold, fit_id FROM folds) f JOIN folds o ON o.repeat = f.repeat AND o.fold <> f.fold
      JOIN samples s ON s.sample_id = o.sample_id CROSS JOIN grid g GROUP BY ALL),
    means AS (SELECT fit_id, "C", l1_ratio, round(avg(score), 9) AS mean_score FROM scores GROUP BY ALL)
    SELECT fit_id, "C" AS "best_C", l1_ratio AS best_l1_ratio, round(mean_score, 6) AS mean_score FROM means
    QUALIFY row_number() OVER (PARTITION BY fit_id ORDER BY mean_score DESC, l1_ratio, "C") = 1""",
)
def _choose_hyper(spark, sf):
    judged_docs = tables.quality_labels(spark, sf)
    assigned = folds.repeated_folds(judged_docs, SPLITS, REPEATS, SEED, True, INNER)
    points = F.array(*[F.struct(F.lit(c).alias("C"), F.lit(l1).alias("l1_ratio")) for c in GRID_C for l1 in GRID_L1])
    # A row is in the training set of the repeat's other fits.
    others = F.filter(F.sequence(F.lit(1), F.lit(SPLITS)), lambda fold: fold != F.col("fold"))
    trained = (
        assigned.select("sample_id", "repeat", "inner_fold", F.explode(others).alias("other"))
        .join(judged_docs.select("sample_id", "quality", "score"), "sample_id")
        .select(((F.col("repeat") - 1) * SPLITS + F.col("other")).alias("fit_id"), "inner_fold", "quality", F.col("score").alias("n"), F.explode(points).alias("g"))
    )
    hit = F.when(F.col("n") >= 400 * F.col("g.C") * (1 + F.col("g.l1_ratio")), 1).otherwise(0) == F.col("quality")
    scores = trained.groupBy("fit_id", "g.C", "g.l1_ratio", "inner_fold").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("score"))
    return stability.choose_hyper(scores).withColumn("mean_score", rounded("mean_score"))


@registry.add(
    "choose_seeds",
    f"""WITH RECURSIVE samples AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, CAST(quality AS VARCHAR) AS label, i
      FROM labels JOIN documents USING (doc_id), (SELECT unnest(range(0, 4)) AS i)),
    {holdout_ctes("CAST(i AS VARCHAR)", "split", "i")},
    tested AS (SELECT s.i, j, label::INT AS t, (n_chars >= 300 * (j + 1))::INT AS p FROM split s
      JOIN documents d ON s.sample_id = CAST(d.doc_id AS VARCHAR), (SELECT unnest(range(0, 4)) AS j) WHERE is_test),
    c AS (SELECT i, j, sum(t * p)::DOUBLE AS tp, sum((1 - t) * p)::DOUBLE AS fp, sum((1 - t) * (1 - p))::DOUBLE AS tn, sum(t * (1 - p))::DOUBLE AS fn
      FROM tested GROUP BY i, j),
    scores AS (SELECT row_number() OVER (ORDER BY i, j) AS step, i, j, (tp + tn) / (tp + fp + tn + fn) AS acc,
      (CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END) / 2 AS f1,
      (CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END + CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END) / 2 AS prec FROM c),
    walk AS (SELECT 0::BIGINT AS step, 0::DOUBLE AS acc, 0::DOUBLE AS f1, 0::DOUBLE AS prec, 0::BIGINT AS i, 0::BIGINT AS j
      UNION ALL SELECT s.step,
        CASE WHEN s.acc >= w.acc AND s.f1 >= w.f1 AND s.prec >= w.prec THEN s.acc ELSE w.acc END,
        CASE WHEN s.acc >= w.acc AND s.f1 >= w.f1 AND s.prec >= w.prec THEN s.f1 ELSE w.f1 END,
        CASE WHEN s.acc >= w.acc AND s.f1 >= w.f1 AND s.prec >= w.prec THEN s.prec ELSE w.prec END,
        CASE WHEN s.acc >= w.acc AND s.f1 >= w.f1 AND s.prec >= w.prec THEN s.i ELSE w.i END,
        CASE WHEN s.acc >= w.acc AND s.f1 >= w.f1 AND s.prec >= w.prec THEN s.j ELSE w.j END
      FROM walk w JOIN scores s ON s.step = w.step + 1)
    SELECT round(acc, 6) AS accuracy, round(f1, 6) AS macro_f1, round(prec, 6) AS macro_precision, i::INTEGER AS split_seed, j::INTEGER AS model_seed
    FROM walk ORDER BY step DESC LIMIT 1""",
)
def _choose_seeds(spark, sf):
    judged_docs = tables.quality_labels(spark, sf)
    parts = []
    for i in range(4):
        test = folds.holdout_split(judged_docs, 0.2, i).filter("is_test").select("sample_id", F.lit(i).alias("split_seed"))
        parts.append(test)
    tested = parts[0]
    for part in parts[1:]:
        tested = tested.unionByName(part)
    marked = tested.join(judged_docs.select("sample_id", "quality", "score"), "sample_id").select(
        "split_seed", F.col("quality").alias("y_true"), "score", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("model_seed")
    )
    marked = marked.withColumn("y_pred", F.when(F.col("score") >= 300 * (F.col("model_seed") + 1), 1).otherwise(0))
    scores = metrics.multiclass_scores(marked, ["split_seed", "model_seed"])
    best = stability.choose_seeds(scores)
    return best.select(*[rounded(c) for c in ("accuracy", "macro_f1", "macro_precision")], "split_seed", "model_seed")


@registry.add(
    "summary_run",
    f"""WITH {WORDS}, {PRUNED}, {CODES}
    SELECT 'n_samples' AS key, CAST(count(*) AS VARCHAR) AS value FROM samples
    UNION ALL SELECT 'n_features', CAST(count(*) AS VARCHAR) FROM kept
    UNION ALL SELECT 'n_classes', CAST(count(*) AS VARCHAR) FROM codes
    UNION ALL SELECT 'class ' || label, CAST(count(*) AS VARCHAR) FROM samples GROUP BY label""",
)
def _run_summary(spark, sf):
    baskets = tables.document_baskets(spark, sf)
    counts = presence.class_counts(baskets)
    kept = presence.prune_features(baskets)
    rows = [
        counts.agg(F.sum("n").alias("v")).select(F.lit("n_samples").alias("key"), "v"),
        kept.agg(F.count("*").alias("v")).select(F.lit("n_features").alias("key"), "v"),
        counts.agg(F.count("*").alias("v")).select(F.lit("n_classes").alias("key"), "v"),
        counts.select(F.concat(F.lit("class "), "label").alias("key"), F.col("n").alias("v")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.select("key", F.col("v").cast("string").alias("value"))
