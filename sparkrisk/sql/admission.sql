-- Rates by a code whose text is in a dimension table; only groups of some size are shown.
WITH per_code AS (
  SELECT admission_type_id AS code, COUNT(*) AS n, SUM(readmitted_30d) AS positives
  FROM encounters GROUP BY admission_type_id)
SELECT d.description AS admission_type, SUM(n) AS n_encounters,
       CAST(ROUND(100.0 * SUM(positives) / SUM(n), 2) AS DOUBLE) AS readmit_rate_pct
FROM per_code JOIN lookup_admission_type d ON per_code.code = d.admission_type_id
GROUP BY d.description HAVING SUM(n) >= 200
ORDER BY readmit_rate_pct DESC, admission_type;

WITH per_code AS (
  SELECT admission_source_id AS code, COUNT(*) AS n, SUM(readmitted_30d) AS positives
  FROM encounters GROUP BY admission_source_id)
SELECT d.description AS admission_source, SUM(n) AS n_encounters,
       CAST(ROUND(100.0 * SUM(positives) / SUM(n), 2) AS DOUBLE) AS readmit_rate_pct
FROM per_code JOIN lookup_admission_source d ON per_code.code = d.admission_source_id
GROUP BY d.description HAVING SUM(n) >= 590
ORDER BY readmit_rate_pct DESC, admission_source;
