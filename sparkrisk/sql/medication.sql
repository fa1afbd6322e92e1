-- Change of medication and insulin; both are ordered by the code behind the text.
WITH changes AS (
  SELECT change, COUNT(*) AS n, SUM(readmitted_30d) AS positives FROM encounters GROUP BY change),
names AS (SELECT * FROM VALUES (1, 'Medication changed'), (0, 'No change') AS t (code, label))
SELECT label AS med_change_status, n AS n_encounters,
       CAST(ROUND(100.0 * positives / n, 2) AS DOUBLE) AS readmit_rate_pct
FROM changes JOIN names ON change = code ORDER BY code DESC;

SELECT ELT(insulin + 1, 'No', 'Down', 'Steady', 'Up') AS insulin_status,
       COUNT(*) AS n_encounters,
       CAST(ROUND(100.0 * SUM(readmitted_30d) / COUNT(*), 2) AS DOUBLE) AS readmit_rate_pct
FROM encounters GROUP BY insulin ORDER BY insulin;
