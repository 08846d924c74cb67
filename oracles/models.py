"""Oracle text for evaluation tables."""

CTES = {
    "pr": """
SELECT 'quality' AS model, quality AS label, least(1.0::DOUBLE, CAST((doc_id * 7919 + 13) % 1000 AS DOUBLE) / 1000.0::DOUBLE * 0.7::DOUBLE + quality * 0.3::DOUBLE) AS p FROM labels
UNION ALL SELECT 'toxic', toxic, least(1.0::DOUBLE, CAST((doc_id * 104729 + 13) % 1000 AS DOUBLE) / 1000.0::DOUBLE * 0.7::DOUBLE + toxic * 0.3::DOUBLE) FROM labels""",
    "ranked": "SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM pr",
    "auc": """
SELECT model, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS roc_auc FROM ranked GROUP BY model""",
    "cm": """
SELECT model, count(*) AS support, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn,
  avg(-CASE WHEN label = 1 THEN ln(greatest(least(p, 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(p, 1 - 1e-7), 1e-7)) END) AS ll,
  avg((p - label) * (p - label)) AS br, CAST(sum(label) AS DOUBLE) / count(*) AS positive_rate FROM pr GROUP BY model""",
    "cand": "SELECT team1 AS task, 'm' || season AS model, CASE WHEN count(*) % 3 <> 0 THEN CAST(count(*) AS DOUBLE) END AS roc_auc, CAST(sum(place_key) AS DOUBLE) AS rmse FROM hdr GROUP BY team1, season",
    "bestc": """
SELECT a.task, a.model AS best_model, r.model AS best_by_rmse FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY roc_auc DESC NULLS LAST, model) AS n FROM cand) a
JOIN (SELECT *, row_number() OVER (PARTITION BY task ORDER BY rmse, model) AS n FROM cand) r USING (task) WHERE a.n = 1 AND r.n = 1""",
    "reg": "SELECT l_returnflag AS model, l_quantity * 3 AS y, l_quantity * 3 + l_suppkey % 31 - 12 AS p FROM lineitem",
    "lab": """
SELECT 'winner' AS task, season, target_team1_wins AS y FROM feat WHERE is_completed UNION ALL SELECT 'first_innings_score', season, first_innings_runs FROM feat WHERE is_completed AND first_innings_runs IS NOT NULL
UNION ALL SELECT 'chase', season, target_chase_success FROM ch2 UNION ALL SELECT 'award', season, target_is_award FROM aw5""",
    "parted": """
SELECT task, y, CASE WHEN season < CASE WHEN max(season) OVER w < 2000 AND max(season) OVER w > min(season) OVER w THEN max(season) OVER w ELSE 2000 END THEN 'train' ELSE 'test' END AS part
FROM lab WINDOW w AS (PARTITION BY task)""",
    "twofold": "SELECT * FROM parted UNION ALL SELECT task, 1 - y, part FROM parted WHERE task = 'winner' AND part = 'train'",
    "bal": "SELECT task, part, count(y) AS rows, CASE WHEN task <> 'first_innings_score' THEN coalesce(CAST(sum(y) AS DOUBLE), 0.0::DOUBLE) END AS positives FROM twofold GROUP BY task, part",
    "top1": "SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY runs DESC, player DESC) AS n FROM aw5 WHERE target_is_award IS NOT NULL",
}

SQL = {
    "m1_clean_features": """
SELECT match_id, CASE WHEN match_id % 3 = 2 THEN team1_form_short END AS team1_form_short, NULL::DOUBLE AS absent, CASE WHEN match_id % 4 = 0 THEN 'Unknown' ELSE venue END AS venue, 'Unknown' AS nowhere
FROM feat WHERE is_completed""",
    "m2_split_by_season": """
SELECT 2000 AS test_from, CASE WHEN season < 2000 THEN 'train' ELSE 'test' END AS part, season, count(*) AS rows FROM hdr GROUP BY season
UNION ALL SELECT 2100, CASE WHEN season < (SELECT max(season) FROM hdr) THEN 'train' ELSE 'test' END, season, count(*) FROM hdr GROUP BY season""",
    "m6_class_balance": """
SELECT t.task, p.part, coalesce(b.rows, 0) AS rows, CASE WHEN t.task <> 'first_innings_score' THEN coalesce(b.positives, 0.0::DOUBLE) END AS positives,
  CASE WHEN t.task = 'award' AND p.part = 'train' THEN (coalesce(b.rows, 0) - greatest(coalesce(b.positives, 0.0::DOUBLE), 1.0::DOUBLE)) / greatest(coalesce(b.positives, 0.0::DOUBLE), 1.0::DOUBLE) END AS positive_weight
FROM (VALUES ('winner'), ('first_innings_score'), ('chase'), ('award')) t(task) CROSS JOIN (VALUES ('train'), ('test')) p(part) LEFT JOIN bal b ON b.task = t.task AND b.part = p.part""",
    "m11_classification_metrics": """
SELECT model, support, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, round(ll, 6) AS log_loss, round(br, 6) AS brier, positive_rate,
  CAST(tp + tn AS DOUBLE) / support AS accuracy, coalesce(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 0.0::DOUBLE) AS precision,
  coalesce(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 0.0::DOUBLE) AS recall,
  coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 0.0::DOUBLE) AS f1, round(roc_auc, 6) AS roc_auc
FROM cm JOIN auc USING (model)""",
    "m12_regression_metrics": """
SELECT model, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(p - y), 6) AS mean_error,
  round(avg(CASE WHEN abs(p - y) <= 10 THEN 1 ELSE 0 END), 6) AS within_10, round(avg(CASE WHEN abs(p - y) <= 20 THEN 1 ELSE 0 END), 6) AS within_20,
  round(stddev_pop(p - y), 6) AS residual_std, count(*) AS support FROM reg GROUP BY model""",
    "m13_pick_best": "SELECT * FROM bestc",
    "m14_calibration_table": """
SELECT model, CAST(least(floor(p * 10), 9) AS INTEGER) AS bucket, count(*) AS count, round(avg(p), 6) AS predicted, CAST(sum(label) AS DOUBLE) / count(*) AS observed FROM pr GROUP BY 1, 2""",
    "m15_roc_points": """
SELECT model, round(p, 6) AS threshold, CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (PARTITION BY model) AS fpr, CAST(sum(q) OVER w AS DOUBLE) / sum(q) OVER (PARTITION BY model) AS tpr
FROM (SELECT model, p, sum(1 - label) AS n, sum(label) AS q FROM pr GROUP BY model, p) WINDOW w AS (PARTITION BY model ORDER BY p DESC)""",
    "m17_comparison_table": """
SELECT c.*, CASE model WHEN 'm1999' THEN 'old' WHEN 'm2001' THEN 'new' END AS family, model = best_model AS is_best FROM cand c JOIN bestc USING (task)""",
    "m21_award_share": """
SELECT match_id, rank, player, team, award_probability FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY award_probability DESC, player) AS INTEGER) AS rank FROM (
    SELECT match_id, player, team, round_even(runs * 100.0::DOUBLE / (CASE WHEN t = 0 THEN 1.0 ELSE t END), 2) AS award_probability
    FROM (SELECT *, CAST(sum(runs) OVER (PARTITION BY match_id) AS DOUBLE) AS t FROM aw5)))
WHERE rank <= 5""",
    "m10_top1_accuracy": "SELECT CAST(sum(target_is_award) AS DOUBLE) / count(*) AS top1_accuracy FROM top1 WHERE n = 1",
}
