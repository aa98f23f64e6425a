"""How well style tells authors apart, and what survives a change of the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import evidence, geometry, inference, mapping, metrics, models, qc, sparse, style
from quillmark.plans._base import CENTROID_SQL, CONDITIONS, FOLDED_SQL, LABELS_SQL, MEASURED_ALL_SQL, PASSAGES_SQL, Z_ALL_SQL, Z_SQL, conditioned, folded, held_out, matrix, measured, moments, named, passages, query, scores_sql, standard, work_means
from quillmark.plans.text_queries import WORD
from quillmark.sources.io import settled, table

KEYS = ["doc_id", "work"]
#: Draws of the resampling queries; a least p-value of 0.0001.
REPLICATES, PERMUTATIONS = 5000, 9999


def _labels(rows):
    return rows.select("author").distinct()


def _predicted(spark, sf_dir, kind="centroid"):
    """Predictions of every passage in the fold that its work is held out of, and the labels, written once."""
    if kind == "centroid":
        return held_out(folded(spark, sf_dir)).withColumnRenamed("outer", "fold").drop("condition")
    rows, _ = standard(spark, sf_dir)
    found = models.attributed(rows, ["outer"], KEYS, kind)
    return settled(found.withColumnRenamed("outer", "fold"))


def _by_condition(spark, sf_dir):
    """Predictions under every condition by centroids of the training originals, written once."""
    return held_out(folded(spark, sf_dir), True)


def _long(spark, sf_dir, fold=0):
    """z of every condition in long form, scaled by one fold's training originals."""
    rows, names = standard(spark, sf_dir, True)
    return named(rows, names, "z", "z", fold)


def _rounded(df, *columns, to=6):
    return df.withColumns({c: F.round(c, to) for c in columns})


_SCOPED = "scoped AS (SELECT *, 'pooled' AS scope FROM pred UNION ALL SELECT *, outer_fold::VARCHAR FROM pred)"


@query(f"{Z_SQL}, {CENTROID_SQL}, {_SCOPED}, {scores_sql('scope', 'scoped')} SELECT scope, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM scored")
def flagship_style_attribution(spark, sf_dir):
    """Nearest-centroid attribution of whole unseen works: scores of each fold and pooled."""
    rows = _predicted(spark, sf_dir)
    return _rounded(metrics.rolled_up(rows, [], _labels(rows)), "accuracy", "macro_f1", "weighted_f1")


@query(f"{Z_SQL}, {CENTROID_SQL} SELECT doc_id, outer_fold AS fold, author, predicted FROM pred")
def held_out_predictions(spark, sf_dir):
    return _predicted(spark, sf_dir).select("doc_id", F.col("fold").cast("long").alias("fold"), "author", "predicted")


@query(f"{Z_SQL}, {CENTROID_SQL} SELECT a.author AS truth, b.author AS predicted, count(q.doc_id) AS n FROM labels a CROSS JOIN labels b LEFT JOIN pred q ON q.author = a.author AND q.predicted = b.author GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    return metrics.confusion(rows, [], _labels(rows))


@query(f"{Z_SQL}, {CENTROID_SQL}, {scores_sql('')} SELECT author, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1s")
def per_author_scores(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    return _rounded(metrics.per_label(rows, [], _labels(rows)), "precision", "recall", "f1")


@query(f"{Z_SQL}, {CENTROID_SQL} SELECT author, work, count(*) AS passages, round(avg((author = predicted)::INT), 6) AS correct_rate FROM pred GROUP BY ALL")
def per_work_correct_rate(spark, sf_dir):
    return _predicted(spark, sf_dir).groupBy("author", "work").agg(F.count("*").alias("passages"), F.round(F.avg((F.col("author") == F.col("predicted")).cast("int")), 6).alias("correct_rate"))


_NB = """
st AS (SELECT outer_fold, author AS candidate, feature, avg(z) AS m, var_pop(z) AS v, count(*) AS n FROM z WHERE train GROUP BY ALL),"""
_NB_UNIFORM = f"""{_NB}
w AS (SELECT outer_fold, max(v) AS widest FROM (SELECT outer_fold, feature, var_pop(z) AS v FROM z WHERE train GROUP BY ALL) GROUP BY ALL),
nb AS (SELECT outer_fold, candidate, feature, m, v + 1e-9 * widest AS v, 0.0 AS prior FROM st JOIN w USING (outer_fold)),"""
_NB_COUNTS = f"""{_NB}
nb AS (SELECT outer_fold, candidate, feature, m, greatest(v, 1e-6) AS v, ln(n::DOUBLE / sum(n) OVER (PARTITION BY outer_fold, feature)) AS prior FROM st),"""
_NB_SCORE = """
sc AS (SELECT outer_fold, doc_id, author, work, condition, candidate, sum(-0.5 * ln(2 * pi() * v) - power(z - m, 2) / (2 * v)) + max(prior) AS score FROM z JOIN nb USING (outer_fold, feature) WHERE NOT train GROUP BY ALL),
pred AS (SELECT outer_fold, doc_id, author, work, condition, arg_min(candidate, (-round(score, 6), candidate)) AS predicted FROM sc GROUP BY ALL)"""


@query(f"{Z_SQL}, {_NB_UNIFORM.strip()} {_NB_SCORE} SELECT doc_id, author, predicted FROM pred")
def gaussian_nb_uniform(spark, sf_dir):
    return _predicted(spark, sf_dir, "nb_uniform").select("doc_id", "author", "predicted")


@query(f"{Z_SQL}, {_NB_COUNTS.strip()} {_NB_SCORE} SELECT doc_id, author, predicted FROM pred")
def gaussian_nb_priors(spark, sf_dir):
    return _predicted(spark, sf_dir, "nb_counts").select("doc_id", "author", "predicted")


@query(f"""{Z_SQL}, {_NB.strip()}
lda AS (SELECT outer_fold, candidate, feature, m, ln(n::DOUBLE / sum(n) OVER w) AS prior, greatest(sum(v * n) OVER w / greatest(sum(n - 1) OVER w, 1), 1e-6) AS pooled FROM st WINDOW w AS (PARTITION BY outer_fold, feature)),
sc AS (SELECT outer_fold, doc_id, author, work, condition, candidate, sum(z * m / pooled - m * m / (2 * pooled)) + max(prior) AS score FROM z JOIN lda USING (outer_fold, feature) WHERE NOT train GROUP BY ALL)
SELECT doc_id, author, arg_min(candidate, (-round(score, 6), candidate)) AS predicted FROM sc GROUP BY ALL""")
def diagonal_lda(spark, sf_dir):
    return _predicted(spark, sf_dir, "lda").select("doc_id", "author", "predicted")


@query()
def shrinkage_lda(spark, sf_dir):
    """Ledoit-Wolf discriminant from sums of squares over all partitions: tests hold it to the dense solution."""
    return models.shrinkage_lda_by(standard(spark, sf_dir)[0], ["outer"])


@query()
def linear_svm(spark, sf_dir):
    """Support vectors over TF-IDF of 3- to 5-grams, fitted over all partitions: tests hold them to dense solutions."""
    keys = ["group", "fold", *KEYS, "author"]
    texts = folded(spark, sf_dir).withColumn("group", F.lit("original"))
    vocabulary = sparse.vocabularies(texts, 3)
    rows = sparse.sparse_rows(texts, keys, vocabulary, as_bytes=True)
    fitted = sparse.fit_svm(rows, vocabulary, sorted(r.author for r in _labels(texts).collect()))
    return sparse.predict(rows, fitted, keys).select(F.col("fold").alias("outer"), "doc_id", "author", "predicted")


@query(f"""{Z_ALL_SQL}, {CENTROID_SQL}, {scores_sql('condition')}
SELECT s.condition, s.n, round(s.macro_f1, 6) AS macro_f1, round(o.macro_f1 - s.macro_f1, 6) AS macro_f1_loss FROM scored s CROSS JOIN (SELECT macro_f1 FROM scored WHERE condition = 'original') o""")
def degradation_by_condition(spark, sf_dir):
    """Trained on originals, read on every condition; loss against the same passages' originals."""
    rows = _by_condition(spark, sf_dir)
    each = metrics.scores(rows, ["condition"], _labels(rows)).select("condition", "n", "macro_f1")
    base = each.where("condition = 'original'").select(F.col("macro_f1").alias("base"))
    return each.crossJoin(base).select("condition", "n", F.round("macro_f1", 6).alias("macro_f1"), F.round(F.col("base") - F.col("macro_f1"), 6).alias("macro_f1_loss"))


@query(f"""{MEASURED_ALL_SQL},
{FOLDED_SQL.strip()},
s AS (SELECT outer_fold, condition, feature, avg(value) AS mean, stddev_pop(value) AS sd FROM o WHERE train GROUP BY ALL HAVING var_pop(value) > 1e-12),
z AS (SELECT o.*, (value - mean) / sd AS z FROM o JOIN s USING (outer_fold, condition, feature)),
centres AS (SELECT outer_fold, condition, author AS candidate, feature, avg(z) AS centre FROM z WHERE train GROUP BY ALL),
apart AS (SELECT outer_fold, doc_id, author, work, condition, candidate, round(sum(power(z - centre, 2)), 9) AS d FROM z JOIN centres USING (outer_fold, condition, feature) WHERE NOT train GROUP BY ALL),
pred AS (SELECT outer_fold, doc_id, author, work, condition, arg_min(candidate, (d, candidate)) AS predicted FROM apart GROUP BY ALL), {scores_sql('condition')}
SELECT s.condition, round(s.macro_f1, 6) AS macro_f1, round(s.macro_f1 / o.macro_f1, 6) AS ratio_to_original FROM scored s CROSS JOIN (SELECT macro_f1 FROM scored WHERE condition = 'original') o""")
def same_condition_survival(spark, sf_dir):
    """Trained and read within each condition: what of the original's score survives."""
    rows = models.standard_vectors(matrix(spark, sf_dir, True).rows, ["outer", "condition"], F.col("train"))
    found = settled(models.attributed(settled(rows), ["outer", "condition"], KEYS, digits=9))
    each = metrics.scores(found, ["condition"], _labels(found)).select("condition", "macro_f1")
    base = each.where("condition = 'original'").select(F.col("macro_f1").alias("base"))
    return each.crossJoin(base).select("condition", F.round("macro_f1", 6).alias("macro_f1"), F.round(F.col("macro_f1") / F.col("base"), 6).alias("ratio_to_original"))


FAMILIES = ("function_word", "char3", "length_rhythm", "punctuation", "lexical_richness", "register_marker")
_FAMILY_SQL = """CASE WHEN feature LIKE 'fw_%' THEN 'function_word' WHEN feature LIKE 'char3::%' THEN 'char3' WHEN feature LIKE '%_feature' OR feature LIKE '%_sentence_%' THEN 'length_rhythm'
  WHEN feature IN ('type_token_ratio', 'root_type_token_ratio', 'hapax_ratio', 'avg_word_length', 'long_word_ratio', 'short_word_ratio') THEN 'lexical_richness'
  WHEN feature IN ('contraction_per_1000w', 'archaic_marker_per_1000w', 'abstract_suffix_per_1000w', 'dialogue_marker_per_1000w') THEN 'register_marker' ELSE 'punctuation' END"""
_FAMILY_VALUES = ", ".join(f"('{k}')" for k in FAMILIES)


def _families_sql(spec: str, keep: str) -> str:
    """Scores of models that see only the features that keep lets through, one for each value of spec."""
    return f"""{Z_SQL}, fam AS (SELECT DISTINCT feature, {_FAMILY_SQL} AS family FROM z), spec(model) AS (VALUES {spec}),
zz AS (SELECT z.*, model FROM z JOIN fam USING (feature) CROSS JOIN spec WHERE {keep}),
centres AS (SELECT model, outer_fold, author AS candidate, feature, avg(z) AS centre FROM zz WHERE train GROUP BY ALL),
apart AS (SELECT model, outer_fold, doc_id, author, candidate, round(sum(power(z - centre, 2)), 9) AS d FROM zz JOIN centres USING (model, outer_fold, feature) WHERE NOT train GROUP BY ALL),
pred AS (SELECT model, doc_id, author, arg_min(candidate, (d, candidate)) AS predicted FROM apart GROUP BY outer_fold, model, doc_id, author), {scores_sql('model')}
SELECT model, n, round(macro_f1, 6) AS macro_f1 FROM scored"""


def _by_family(spark, sf_dir, models_of):
    """Scores of a model for each (name, families that it sees): the fan-out is an array of masked vectors."""
    rows, names = standard(spark, sf_dir)

    def masked(families):
        seen = [[T.family_of(f) in families for f in own] for own in names]
        mask = F.coalesce(*(F.when(F.col("outer") == o, F.array(*map(F.lit, own))) for o, own in enumerate(seen)))
        return F.zip_with("z", mask, lambda x, on: F.when(on, x))

    spec = F.explode(F.array(*(F.struct(F.lit(name).alias("model"), masked(families).alias("z")) for name, families in models_of)))
    wide = rows.withColumn("x", spec).select(*(c for c in rows.columns if c != "z"), "x.model", "x.z")
    found = settled(models.attributed(wide, ["model", "outer"], KEYS, digits=9))
    return metrics.scores(found, ["model"], _labels(found)).select("model", "n", F.round("macro_f1", 6).alias("macro_f1"))


@query(_families_sql(f"('none'), {_FAMILY_VALUES}", "family <> model"))
def family_ablation(spark, sf_dir):
    """All features, and all but each of the six families."""
    return _by_family(spark, sf_dir, [("none", FAMILIES), *((k, [f for f in FAMILIES if f != k]) for k in FAMILIES)])


@query(_families_sql(_FAMILY_VALUES, "family = model"))
def single_family_models(spark, sf_dir):
    """Each family alone."""
    return _by_family(spark, sf_dir, [(k, [k]) for k in FAMILIES])


_CENTRES_ALL = "c AS (SELECT condition, author, feature, avg(z) AS centre FROM z WHERE outer_fold = 0 GROUP BY ALL)"


def _means(spark, sf_dir, by, value, fold=0):
    """by, feature and the mean z of every group of by under every condition, from sums of the measures of works."""
    found = moments(spark, sf_dir)
    rows = work_means(found, ["fold" if c == "train" else c for c in by])
    return named(settled(rows.select(*by, "outer", "z")), found.names, "z", value, fold).drop("outer")


def _centres(spark, sf_dir):
    return _means(spark, sf_dir, ["condition", "author"], "centre")


@query(f"""{Z_ALL_SQL}, {_CENTRES_ALL} SELECT a.condition, a.author AS a, b.author AS b, round(avg(abs(a.centre - b.centre)), 6) AS delta, round(sqrt(sum(power(a.centre - b.centre, 2))), 6) AS euclid
FROM c a JOIN c b ON a.condition = b.condition AND a.feature = b.feature AND a.author < b.author GROUP BY ALL""")
def burrows_delta_pairs(spark, sf_dir):
    return _rounded(geometry.pair_distances(_centres(spark, sf_dir), ["condition"]), "delta", "euclid")


@query(f"""{Z_ALL_SQL}, {_CENTRES_ALL}, d AS (SELECT a.condition, avg(abs(a.centre - b.centre)) AS delta FROM c a JOIN c b ON a.condition = b.condition AND a.feature = b.feature AND a.author < b.author GROUP BY a.condition, a.author, b.author),
e AS (SELECT condition, count(*) AS pairs, avg(delta) AS mean, median(delta) AS median, min(delta) AS least, max(delta) AS largest, stddev_pop(delta) AS spread FROM d GROUP BY ALL)
SELECT e.condition, pairs, round(mean, 6) AS mean, round(median, 6) AS median, round(least, 6) AS least, round(largest, 6) AS largest, round(spread, 6) AS spread, round(mean / o.m, 6) AS ratio_to_original, round(1 - mean / o.m, 6) AS contraction
FROM e CROSS JOIN (SELECT mean AS m FROM e WHERE condition = 'original') o""")
def distance_contraction(spark, sf_dir):
    summary = geometry.distance_summary(geometry.pair_distances(_centres(spark, sf_dir), ["condition"]))
    return _rounded(summary, "mean", "median", "least", "largest", "spread", "ratio_to_original", "contraction")


@query(f"{Z_ALL_SQL}, {_CENTRES_ALL} SELECT c.condition, c.author, round(avg(abs(c.centre - o.centre)), 6) AS shift FROM c JOIN c o ON o.condition = 'original' AND o.author = c.author AND o.feature = c.feature WHERE c.condition <> 'original' GROUP BY ALL")
def centroid_shift(spark, sf_dir):
    return _rounded(geometry.centroid_shift(_centres(spark, sf_dir)), "shift")


@query(f"""{Z_ALL_SQL}, g AS (SELECT condition, author, feature, avg(z) AS c, var_pop(z) AS w FROM z WHERE outer_fold = 0 GROUP BY ALL),
b AS (SELECT g.*, g.c - o.c AS d FROM g JOIN g o ON o.condition = 'original' AND o.author = g.author AND o.feature = g.feature),
f AS (SELECT condition, feature, var_pop(c) AS between_, avg(w) AS within, avg(d) AS common, var_pop(d) AS differential FROM b GROUP BY ALL)
SELECT condition, count(*) AS features, round(avg(between_), 6) AS between, round(avg(within), 6) AS within, round(sqrt(avg(common * common)), 6) AS common_shift_rms, round(sqrt(avg(differential)), 6) AS differential_shift_rms, round(avg(between_) / avg(within), 6) AS between_within_ratio FROM f GROUP BY ALL""")
def variance_decomposition(spark, sf_dir):
    return _rounded(geometry.decomposition(_long(spark, sf_dir)), "between", "within", "common_shift_rms", "differential_shift_rms", "between_within_ratio")


@query(f"{Z_ALL_SQL}, {_CENTRES_ALL} SELECT c.condition, c.author, c.feature, round(o.centre, 5) AS original_mean, round(c.centre, 5) AS rewrite_mean, round(c.centre - o.centre, 5) + 0.0 AS delta FROM c JOIN c o ON o.condition = 'original' AND o.author = c.author AND o.feature = c.feature WHERE c.condition <> 'original'")
def feature_changes(spark, sf_dir):
    rows = _rounded(geometry.feature_changes(_centres(spark, sf_dir)), "original_mean", "rewrite_mean", "delta", to=5)
    return rows.withColumn("delta", F.col("delta") + 0.0)


_PAIRS_SQL = """
wc AS (SELECT condition, work, feature, fold <> 0 AS train, avg(z) AS c FROM z WHERE outer_fold = 0 GROUP BY ALL),
pr AS (SELECT b.condition, b.work, b.feature, b.train, a.c AS x, b.c AS y FROM wc b JOIN wc a ON a.condition = 'original' AND a.work = b.work AND a.feature = b.feature WHERE b.condition <> 'original'),
m AS (SELECT condition, feature, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS xy, var_pop(x) AS xx FROM pr WHERE train GROUP BY ALL),
al AS (SELECT condition, sum(xy) / sum(xx) AS alpha FROM m GROUP BY ALL),
mp AS (SELECT condition, feature, alpha, my - alpha * mx AS shift, my - mx AS translation FROM m JOIN al USING (condition))"""


def _mapping_pairs(spark, sf_dir):
    centres = _means(spark, sf_dir, ["condition", "work", "train"], "c")
    base = centres.where("condition = 'original'").select("work", "feature", F.col("c").alias("x"))
    return centres.where("condition <> 'original'").join(base, ["work", "feature"]).select("condition", "work", "feature", "train", "x", F.col("c").alias("y"))


@query(f"{Z_ALL_SQL}, {_PAIRS_SQL} SELECT condition, feature, round(alpha, 6) AS alpha, round(shift, 5) AS shift, round(translation, 5) AS translation FROM mp")
def affine_mapping(spark, sf_dir):
    return _rounded(_rounded(geometry.affine_mapping(_mapping_pairs(spark, sf_dir).where("train"), ["condition"]), "alpha"), "shift", "translation", to=5)


@query(f"""{Z_ALL_SQL}, {_PAIRS_SQL}, e AS (SELECT pr.*, alpha, y - alpha * x - shift AS e FROM pr JOIN mp USING (condition, feature) WHERE train),
f AS (SELECT condition, feature, var_pop(x) AS bx, var_pop(y) AS b_y, var_pop(e) AS be, covar_pop(x, e) AS xe, max(alpha) AS alpha FROM e GROUP BY ALL)
SELECT condition, round(avg(bx), 6) AS between_original, round(avg(b_y), 6) AS between_rewrite, round(avg(alpha * alpha * bx), 6) AS scaled, round(avg(be), 6) AS residual, round(avg(2 * alpha * xe), 6) + 0.0 AS cross, 0.0::DOUBLE AS closure_error FROM f GROUP BY ALL""")
def dispersion_identity(spark, sf_dir):
    pairs = _mapping_pairs(spark, sf_dir).where("train")
    out = geometry.dispersion(pairs, geometry.affine_mapping(pairs, ["condition"]), ["condition"])
    return _rounded(out, "between_original", "between_rewrite", "scaled", "residual", "cross", "closure_error").withColumns({c: F.col(c) + 0.0 for c in ("cross", "closure_error")})


@query(f"""{Z_ALL_SQL}, {_PAIRS_SQL} SELECT condition, round(avg(power(y - x, 2)), 6) AS identity, round(avg(power(y - x - translation, 2)), 6) AS translation, round(avg(power(y - alpha * x - shift, 2)), 6) AS scalar_affine
FROM pr JOIN mp USING (condition, feature) WHERE NOT train GROUP BY ALL""")
def mapping_errors_held_out(spark, sf_dir):
    pairs = _mapping_pairs(spark, sf_dir)
    mapping = geometry.affine_mapping(pairs.where("train"), ["condition"])
    return _rounded(geometry.mapping_errors(pairs.where("not train"), mapping, ["condition"]), "identity", "translation", "scalar_affine")


#: Function words stand in a row among the measures.
_FW = [i for i, n in enumerate(style.BASE) if n.startswith("fw_")]
SPANS = {"all_features": None, "function_words": (_FW[0], _FW[-1] + 1)}
_ALL_PAIRS_SQL = """
wc AS (SELECT outer_fold, condition, work, feature, train, avg(z) AS c FROM z GROUP BY ALL),
fm(family) AS (VALUES ('all_features'), ('function_words')),
pr AS (SELECT b.outer_fold, b.condition, family, b.work, b.feature, b.train, a.c AS x, b.c AS y FROM wc b JOIN wc a ON a.outer_fold = b.outer_fold AND a.condition = 'original' AND a.work = b.work AND a.feature = b.feature JOIN fm ON family = 'all_features' OR b.feature LIKE 'fw_%' WHERE b.condition <> 'original'),
m AS (SELECT outer_fold, condition, family, feature, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS xy, var_pop(x) AS xx FROM pr WHERE train GROUP BY ALL),
al AS (SELECT outer_fold, condition, family, sum(xy) / sum(xx) AS alpha FROM m GROUP BY ALL),
mp AS (SELECT outer_fold, condition, family, feature, alpha, my - alpha * mx AS shift, my - mx AS translation FROM m JOIN al USING (outer_fold, condition, family)),
er AS (SELECT condition, family, work, avg(power(y - x, 2)) AS i, avg(power(y - x - translation, 2)) AS t, avg(power(y - alpha * x - shift, 2)) AS a FROM pr JOIN mp USING (outer_fold, condition, family, feature) WHERE NOT train GROUP BY ALL)"""


def _held_out_works(spark, sf_dir):
    rows = work_means(moments(spark, sf_dir), ["author", "work", "fold", "condition"])
    pairs = mapping.work_pairs(settled(rows), SPANS)
    return mapping.held_out(pairs, mapping.fitted(pairs))


@query(f"""{Z_ALL_SQL}, {_ALL_PAIRS_SQL} SELECT condition, family, work, round(i, 6) AS identity, round(t, 6) AS translation, round(a, 6) AS scalar_affine FROM er""")
def unseen_work_errors(spark, sf_dir):
    """Errors of three mappings for every work, each fitted on the works of the other outer folds."""
    return _rounded(_held_out_works(spark, sf_dir).select("condition", "family", "work", *mapping.MAPPINGS), *mapping.MAPPINGS)


@query()
def mapping_intervals(spark, sf_dir):
    """What each mapping's error is over all unseen works and what it improves, with intervals over drawn works."""
    return mapping.error_intervals(_held_out_works(spark, sf_dir), REPLICATES)


@query()
def dispersion_intervals(spark, sf_dir):
    """How the spread of unseen works' centroids is made up, with intervals over drawn works."""
    return mapping.dispersion_intervals(_held_out_works(spark, sf_dir), REPLICATES)


@query()
def paired_bootstrap(spark, sf_dir):
    """Loss of macro F1 with interval and permutation p-value, of whole works; Holm over all comparisons."""
    rows = _by_condition(spark, sf_dir)
    base = rows.where("condition = 'original'").select("doc_id", F.col("predicted").alias("original"))
    pairs = rows.where("condition <> 'original'").join(base, "doc_id").withColumnRenamed("predicted", "rewrite")
    labels = sorted(r.author for r in _labels(rows).collect())
    works = rows.select("work").distinct().count()
    found = inference.paired_inference(pairs.select("condition", "author", "work", "doc_id", "original", "rewrite"), ["condition"], labels, works, REPLICATES, PERMUTATIONS)
    return metrics.holm(found, [], "p_value", len(CONDITIONS) - 1)


@query()
def weighted_bootstrap(spark, sf_dir):
    """Intervals of every condition from the same drawn weights."""
    rows = _by_condition(spark, sf_dir).select("condition", "author", "work", "doc_id", "predicted")
    weights = inference.bootstrap_weights(rows.where("condition = 'original'").select("author", "work", "doc_id"), REPLICATES, placed=True)
    return inference.interval(inference.weighted_f1(rows, weights, ["condition"], _labels(rows).count()), ["condition"], "macro_f1")


_PAIRED_SQL = "q AS (SELECT b.doc_id, b.author, b.condition, a.predicted AS original, b.predicted AS rewrite FROM pred b JOIN pred a ON a.doc_id = b.doc_id AND a.condition = 'original' WHERE b.condition <> 'original')"


def _paired(texts):
    """The held-out predictions of each passage of folded texts as it is and under each other condition, and the authors."""
    rows = held_out(texts, True)
    base = rows.where("condition = 'original'").select("doc_id", F.col("predicted").alias("original"))
    return rows.where("condition <> 'original'").join(base, "doc_id").withColumnRenamed("predicted", "rewrite"), _labels(rows)


def _sensitivity_sql(source: str, chosen: str, selection: str) -> str:
    """The figures of source's rows, of those where chosen holds."""
    return f"""SELECT condition, '{selection}' AS selection, rows, excluded, CASE WHEN present = k THEN 'estimable' ELSE 'not_estimable' END AS status, CASE WHEN present = k THEN round(x, 6) END AS original_macro_f1, CASE WHEN present = k THEN round(y, 6) END AS rewrite_macro_f1, CASE WHEN present = k THEN round(x - y, 6) END AS macro_f1_loss
FROM (SELECT condition, count(*) FILTER ({chosen}) AS rows, count(*) FILTER (NOT ({chosen})) AS excluded, count(DISTINCT author) FILTER ({chosen}) AS present FROM {source} GROUP BY ALL)
JOIN (SELECT condition, avg(CASE WHEN own + a > 0 THEN 2.0::DOUBLE * ta / (own + a) ELSE 0 END) AS x, avg(CASE WHEN own + b > 0 THEN 2.0::DOUBLE * tb / (own + b) ELSE 0 END) AS y FROM (
  SELECT n.condition, l.author, count(*) FILTER (c.author = l.author) AS own, count(*) FILTER (c.original = l.author) AS a, count(*) FILTER (c.rewrite = l.author) AS b, count(*) FILTER (c.author = l.author AND c.original = l.author) AS ta, count(*) FILTER (c.author = l.author AND c.rewrite = l.author) AS tb
  FROM (SELECT DISTINCT condition FROM {source}) n CROSS JOIN labels l LEFT JOIN (SELECT * FROM {source} WHERE {chosen}) c ON c.condition = n.condition GROUP BY ALL) GROUP BY condition) USING (condition) CROSS JOIN (SELECT count(*) AS k FROM labels)"""


def _figures(df):
    return _rounded(df, "original_macro_f1", "rewrite_macro_f1", "macro_f1_loss")


_AUDITED_SQL = f"{Z_ALL_SQL.replace('WITH ', 'WITH audited AS (SELECT doc_id, toxic FROM labels), ', 1)}, {CENTROID_SQL}, {_PAIRED_SQL}, sn AS MATERIALIZED (SELECT q.*, toxic AS risk FROM q JOIN audited USING (doc_id))"


@query(f"{_AUDITED_SQL} {_sensitivity_sql('sn', 'true', 'all_audited_pairs')} UNION ALL {_sensitivity_sql('sn', 'risk = 0', 'without_risk')}")
def semantic_sensitivity(spark, sf_dir):
    """Loss of the held-out predictions over the audited pairs, all and those that no reviewer holds for risky; not estimable once an author is gone."""
    rows, labels = _paired(folded(spark, sf_dir))
    audited = settled(rows.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("risk")), "doc_id"))
    every = evidence.paired_sensitivity(audited, F.lit(True), ["condition"], labels, "all_audited_pairs")
    return _figures(every.unionByName(evidence.paired_sensitivity(audited, F.col("risk") == 0, ["condition"], labels, "without_risk")))


#: What must not stand in a rewrite.
LEAKED = "as an ai|here is the"
_QC_SQL = rf"""qcs AS (SELECT v.doc_id, v.condition, CASE WHEN trim(v.text) = '' OR regexp_matches(v.text, '(?i){LEAKED}') OR regexp_matches(v.text, '(?m)^\s*(?:[-*#]|[0-9]+\.)\s') THEN 'fail'
  WHEN n > 0 AND (m / n < 0.85 OR m / n > 1.15) OR len(list_filter(regexp_split_to_array(trim(regexp_replace(v.text, '\s+', ' ', 'g')), '[.!?]+'), lambda x: trim(x) <> '')) < 3 THEN 'warning' ELSE 'pass' END AS qc_status
  FROM v JOIN (SELECT a.doc_id, b.condition, len(regexp_extract_all(a.text, '{{}}'))::DOUBLE AS n, len(regexp_extract_all(b.text, '{{}}'))::DOUBLE AS m FROM v a JOIN v b USING (doc_id) WHERE a.condition = 'original') USING (doc_id, condition))""".replace("{}", WORD)


@query(f"{Z_ALL_SQL}, {CENTROID_SQL}, {_PAIRED_SQL}, {_QC_SQL}, sn AS MATERIALIZED (SELECT q.*, qc_status FROM q JOIN qcs USING (doc_id, condition)) {_sensitivity_sql('sn', chr(113) + 'c_status = ' + chr(39) + 'pass' + chr(39), 'warning_free')}")
def warning_free_sensitivity(spark, sf_dir):
    """Loss of the held-out predictions over the pairs whose rewriting the simple rules find nothing against."""
    texts = folded(spark, sf_dir)
    rows, labels = _paired(texts)
    pairs = conditioned(texts.withColumn("original_words", F.size(T.words(F.col("text"))))).where("condition <> 'original'").withColumnRenamed("text", "rewritten")
    judged = qc.rewrite_qc_simple(pairs, list(CONDITIONS), LEAKED).select("doc_id", "condition", "qc_status")
    return _figures(evidence.paired_sensitivity(settled(rows.join(judged, ["doc_id", "condition"])), F.col("qc_status") == "pass", ["condition"], labels, "warning_free"))


_E = """WITH e AS (SELECT vec_id, label, (vec_id % 3)::INT AS fold, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) AS feature FROM embeddings),
c AS (SELECT k AS outer_fold, label AS candidate, feature, avg(z) AS centre FROM e CROSS JOIN range(3) r(k) WHERE fold <> k GROUP BY ALL),
a AS (SELECT vec_id, label, candidate, round(sum(power(z - centre, 2)), 6) AS d FROM e JOIN c ON c.outer_fold = e.fold AND c.feature = e.feature GROUP BY ALL)"""


@query(f"{_E} SELECT vec_id, label, arg_min(candidate, (d, candidate)) AS predicted FROM a GROUP BY ALL")
def embedding_nearest_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("fold"), F.posexplode("embedding").alias("feature", "z")).withColumn("z", F.col("z").cast("double"))
    folded = models.outer_folds(rows)
    centres = models.centroids(folded.where("train"), ["outer"], "label").withColumnRenamed("label", "candidate")
    apart = folded.where("not train").join(centres, ["outer", "feature"]).groupBy("vec_id", "label", "candidate").agg(F.round(F.sum((F.col("z") - F.col("centre")) ** 2), 6).alias("d"))
    return apart.groupBy("vec_id", "label").agg(F.min(F.struct("d", "candidate")).alias("b")).select("vec_id", "label", F.col("b.candidate").alias("predicted"))


_GRAM = "regexp_replace(lower(text), '\\s+', ' ', 'g')"


@query(f"""WITH {PASSAGES_SQL}, g AS (SELECT list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) AS grams FROM (SELECT string_split({_GRAM}, '') AS c FROM p)),
n AS (SELECT unnest(grams) AS gram FROM g) SELECT gram, count(*) AS n FROM n WHERE regexp_full_match(gram, '[a-z ,.;:''"!?-]{{3}}') AND trim(gram) <> '' GROUP BY gram ORDER BY n DESC, gram LIMIT 120""")
def trigram_vocabulary(spark, sf_dir):
    return style.trigram_vocabulary(passages(spark, sf_dir))


@query(f"""WITH {PASSAGES_SQL}, q AS (SELECT doc_id, text FROM p), f AS (SELECT doc_id, string_split({_GRAM}, '') AS c FROM q),
gr AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM f),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf WHERE doc_id % 3 <> 0 GROUP BY ALL HAVING count(*) >= 2),
i AS (SELECT gram, ln((1 + (SELECT count(*) FROM q WHERE doc_id % 3 <> 0))::DOUBLE / (1 + df)) + 1 AS idf FROM df), w AS (SELECT doc_id, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN i USING (gram)),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL) SELECT doc_id, count(*) AS grams, round(sum(w / norm), 5) AS total, round(max(w / norm), 6) AS heaviest FROM w JOIN nm USING (doc_id) GROUP BY doc_id""")
def tfidf_trigrams(spark, sf_dir):
    """Sums over each passage's weights; fitted on the passages whose number three does not divide."""
    weights = style.tfidf(passages(spark, sf_dir), "doc_id", F.col("doc_id") % 3 != 0, 3, 3)
    return weights.groupBy("doc_id").agg(F.count("*").alias("grams"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("heaviest"))


@query(f"""WITH {PASSAGES_SQL}, f AS (SELECT doc_id, fold, string_split({_GRAM}, '') AS c FROM p JOIN folds USING (work)),
gr AS (SELECT doc_id, fold, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM f UNION ALL SELECT doc_id, fold, unnest(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) AS gram FROM f UNION ALL SELECT doc_id, fold, unnest(list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4])) AS gram FROM f),
tf AS (SELECT doc_id, fold, gram, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT k AS outer_, gram, count(*) AS df, sum(tf) AS total FROM tf CROSS JOIN range(3) r(k) WHERE fold <> k GROUP BY ALL HAVING count(*) >= 2),
n AS (SELECT k AS outer_, count(*) AS n FROM f CROSS JOIN range(3) r(k) WHERE fold <> k GROUP BY ALL)
SELECT outer_::INT AS outer, gram, df, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS idf FROM df JOIN n USING (outer_) QUALIFY row_number() OVER (PARTITION BY outer_ ORDER BY total DESC, gram) <= 30000""")
def ngram_vocabularies(spark, sf_dir):
    """The 3- to 5-grams of each outer fold's training texts, with what each weighs."""
    texts = folded(spark, sf_dir).withColumn("group", F.lit("original"))
    return sparse.vocabulary_table(texts, 3).select("outer", "gram", "df", F.round("idf", 6).alias("idf"))


@query(f"""{MEASURED_ALL_SQL} SELECT condition, feature, count(*) AS rows, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM x GROUP BY ALL""")
def feature_summary(spark, sf_dir):
    return _rounded(measured(spark, sf_dir, True).groupBy("condition", "feature").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")), "mean", "sd")


@query(f"""{MEASURED_ALL_SQL}, w AS (SELECT condition, author, feature, (value - avg(value) OVER g) / nullif(stddev_pop(value) OVER g, 0) AS z FROM x WINDOW g AS (PARTITION BY condition, feature))
SELECT condition, author, feature, round(avg(coalesce(z, 0)), 5) AS mean_z FROM w GROUP BY ALL""")
def z_within_condition(spark, sf_dir):
    rows = style.scale_within(measured(spark, sf_dir, True), ["condition"])
    return _rounded(rows.groupBy("condition", "author", "feature").agg(F.avg("z").alias("mean_z")), "mean_z", to=5)


@query(f"""WITH {PASSAGES_SQL}, {LABELS_SQL}, v AS (SELECT doc_id, author, work, 'original' AS condition, text FROM p) SELECT author, count(*) AS passages, count(DISTINCT work) AS works, count(DISTINCT fold) AS folds FROM p JOIN folds USING (work) GROUP BY ALL""")
def cohort_counts(spark, sf_dir):
    from quillmark.operators import cohort

    texts = passages(spark, sf_dir).select("author", "work")
    folds = cohort.folds_by_work(texts.distinct(), "author", "work").select("work", "fold")
    return texts.join(folds, "work").groupBy("author").agg(F.count("*").alias("passages"), F.countDistinct("work").alias("works"), F.countDistinct("fold").alias("folds"))


