-- Overall rate; rate and share per diagnosis group; rate per specialty of some size.
SELECT COUNT(*) AS total_encounters, COALESCE(SUM(readmitted_30d), 0) AS total_readmissions,
       CAST(ROUND(100.0 * SUM(readmitted_30d) / COUNT(*), 2) AS DOUBLE) AS readmit_rate_pct
FROM encounters;

WITH groups AS (
  SELECT diag_1_group, COUNT(*) AS n_encounters, SUM(readmitted_30d) AS n_readmissions
  FROM encounters GROUP BY diag_1_group)
SELECT diag_1_group, n_encounters, n_readmissions,
       CAST(ROUND(100.0 * n_readmissions / n_encounters, 2) AS DOUBLE) AS readmit_rate_pct,
       CAST(ROUND(100.0 * n_encounters / (SELECT COUNT(*) FROM encounters), 2) AS DOUBLE)
         AS pct_of_all_encounters
FROM groups ORDER BY readmit_rate_pct DESC, diag_1_group;

WITH specialties AS (
  SELECT medical_specialty, COUNT(*) AS n, SUM(readmitted_30d) AS positives
  FROM encounters GROUP BY medical_specialty)
SELECT medical_specialty, n AS n_encounters,
       CAST(ROUND(100.0 * positives / n, 2) AS DOUBLE) AS readmit_rate_pct
FROM specialties WHERE n >= 185 ORDER BY readmit_rate_pct DESC, medical_specialty;
