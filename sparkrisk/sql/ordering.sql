-- Results whose order is part of the answer: by a selected column, by an aggregate that is not
-- selected, by a key behind a text.
SELECT age_numeric, COUNT(*) AS n_encounters FROM encounters
GROUP BY age_numeric ORDER BY n_encounters DESC, age_numeric;

SELECT diag_1_group, COUNT(*) AS n_encounters FROM encounters
GROUP BY diag_1_group ORDER BY SUM(num_medications) DESC, diag_1_group;

WITH answers AS (
  SELECT CASE gender WHEN 'Male' THEN 2 WHEN 'Female' THEN 1 ELSE 3 END AS place, gender,
         COUNT(*) AS n_encounters FROM encounters GROUP BY gender)
SELECT COALESCE(gender, 'unknown') AS gender, n_encounters FROM answers
ORDER BY CASE WHEN place = 1 THEN 9 ELSE place END, gender;
