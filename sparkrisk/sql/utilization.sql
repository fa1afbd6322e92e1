-- Earlier use of the house. All statements reduce the fact table to one row per number of
-- visits first; tiers are a table of bounds, joined to the reduced rows.
WITH bounds AS (
  SELECT * FROM VALUES (1, 0, 0, '0 - No prior visits'), (2, 1, 2, '1-2 - Low utilization'),
    (3, 3, 5, '3-5 - Moderate utilization'), (4, 6, NULL, '6+ - High utilization')
    AS t (tier, low, high, label)),
visits AS (
  SELECT service_utilization AS v, COUNT(*) AS n, SUM(readmitted_30d) AS positives
  FROM encounters GROUP BY service_utilization)
SELECT label AS utilization_tier, SUM(n) AS n_encounters, SUM(positives) AS n_readmissions,
       CAST(ROUND(100.0 * SUM(positives) / SUM(n), 2) AS DOUBLE) AS readmit_rate_pct
FROM visits JOIN bounds ON v >= low AND (high IS NULL OR v <= high)
GROUP BY tier, label ORDER BY tier;

WITH stays AS (
  SELECT time_in_hospital AS days, COUNT(*) AS n, SUM(readmitted_30d) AS positives,
         SUM(num_medications) AS medications, COUNT(num_medications) AS n_medications,
         SUM(num_procedures) AS procedures, COUNT(num_procedures) AS n_procedures
  FROM encounters GROUP BY time_in_hospital)
SELECT days AS length_of_stay_days, n AS n_encounters,
       CAST(ROUND(100.0 * positives / n, 2) AS DOUBLE) AS readmit_rate_pct,
       CAST(ROUND(1.0 * medications / n_medications, 1) AS DOUBLE) AS avg_medications,
       CAST(ROUND(1.0 * procedures / n_procedures, 1) AS DOUBLE) AS avg_procedures
FROM stays ORDER BY days;

WITH bounds AS (
  SELECT * FROM VALUES (0, 0, 'No prior visits'), (1, 2, 'Low utilization'),
    (3, 5, 'Moderate utilization'), (6, NULL, 'High utilization') AS t (low, high, label)),
visits AS (
  SELECT diag_1_group, service_utilization AS v, COUNT(*) AS n, SUM(readmitted_30d) AS positives
  FROM encounters GROUP BY diag_1_group, service_utilization),
segments AS (
  SELECT diag_1_group, label, SUM(n) AS n, SUM(positives) AS positives
  FROM visits JOIN bounds ON v >= low AND (high IS NULL OR v <= high)
  GROUP BY diag_1_group, label)
SELECT diag_1_group, label AS utilization_tier, n AS n_encounters,
       CAST(ROUND(100.0 * positives / n, 2) AS DOUBLE) AS readmit_rate_pct
FROM segments WHERE n >= 300
ORDER BY readmit_rate_pct DESC, diag_1_group, label LIMIT 10;
