"""ANSI-style SQL for each registered query, written from the semantics.

The texts share common table expressions; every one is self-contained and runs
on the given tables. They are read by the correctness check only.
"""

from creditweir import fixed_values as fv

BASE = """
li AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CAST(round(l_discount*100) AS BIGINT)) AS disc_pct,
         sum(CAST(floor(l_quantity) AS BIGINT)) AS qty,
         count(*) FILTER (WHERE l_returnflag='R') AS n_r,
         count(*) FILTER (WHERE l_returnflag='A') AS n_a
  FROM lineitem GROUP BY l_orderkey),
base AS MATERIALIZED (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS price,
         CAST(coalesce(n_lines,0) AS BIGINT) AS n_lines, CAST(coalesce(disc_pct,0) AS BIGINT) AS disc_pct,
         CAST(coalesce(qty,0) AS BIGINT) AS qty,
         CAST(coalesce(n_r,0) AS BIGINT) AS n_r, CAST(coalesce(n_a,0) AS BIGINT) AS n_a,
         CAST((coalesce(disc_pct,0)*7 + o_orderkey) % 115 AS BIGINT) AS util_pct
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey)"""

BRONZE = BASE + """,
raw AS MATERIALIZED (
  SELECT k*2 AS bronze_id, CAST(k AS STRING) AS raw_row_id,
    CASE WHEN k % 997 = 0 THEN ''
         WHEN util_pct + 20*greatest(n_r-1,0) + 15*greatest(n_a-1,0) + (k*7919) % 101 > 215
         THEN '1' ELSE '0' END AS serious_dlqin_2yrs,
    CASE WHEN k % 211 = 0 THEN '50000' ELSE CAST(util_pct/100 AS STRING) END
         AS revolving_utilization_unsecured_lines,
    CASE WHEN k % 1499 = 0 THEN '0' ELSE CAST(18 + c % 60 AS STRING) END AS age,
    CASE WHEN k % 557 = 0 THEN '98' ELSE CAST(greatest(n_r-1,0) AS STRING) END
         AS times_30_59_days_past_due,
    CAST((qty % 97)/50 AS STRING) AS debt_ratio,
    CASE WHEN k % 5 = 0 THEN '' ELSE CAST(price % 14000 AS STRING) END AS monthly_income,
    CAST(n_lines + c % 12 AS STRING) AS open_credit_lines_and_loans,
    CASE WHEN k % 563 = 0 THEN '96' ELSE CAST(greatest(n_r+n_a-4,0) AS STRING) END
         AS times_90_days_late,
    CAST(c % 4 AS STRING) AS real_estate_loans_or_lines,
    CAST(greatest(n_a-1,0) AS STRING) AS times_60_89_days_past_due,
    CASE WHEN k % 37 = 0 THEN '' ELSE CAST(c % 5 AS STRING) END AS number_of_dependents
  FROM base),
bronze AS MATERIALIZED (
  SELECT * FROM raw
  UNION ALL
  SELECT bronze_id+1, raw_row_id, serious_dlqin_2yrs, revolving_utilization_unsecured_lines, age,
         times_30_59_days_past_due, debt_ratio, '4321', open_credit_lines_and_loans,
         times_90_days_late, real_estate_loans_or_lines, times_60_89_days_past_due,
         number_of_dependents
  FROM raw WHERE bronze_id % 100 = 0)"""

SILVER = BRONZE + """,
newest AS (
  SELECT raw_row_id, max(bronze_id) AS bronze_id FROM bronze GROUP BY raw_row_id),
parsed AS (
  SELECT CAST(b.raw_row_id AS BIGINT) AS applicant_id,
         try_cast(serious_dlqin_2yrs AS DOUBLE) AS label,
         try_cast(revolving_utilization_unsecured_lines AS DOUBLE) AS util,
         try_cast(age AS DOUBLE) AS age0,
         try_cast(debt_ratio AS DOUBLE) AS debt,
         try_cast(monthly_income AS DOUBLE) AS income,
         try_cast(open_credit_lines_and_loans AS BIGINT) AS open_credit_lines,
         try_cast(real_estate_loans_or_lines AS BIGINT) AS real_estate_loans,
         try_cast(times_30_59_days_past_due AS BIGINT) AS t30,
         try_cast(times_60_89_days_past_due AS BIGINT) AS t60,
         try_cast(times_90_days_late AS BIGINT) AS t90,
         try_cast(number_of_dependents AS BIGINT) AS number_of_dependents
  FROM bronze b JOIN newest n ON b.raw_row_id = n.raw_row_id AND b.bronze_id = n.bronze_id),
silver AS MATERIALIZED (
  SELECT applicant_id, DATE '2026-01-01' AS snapshot_date,
         CAST(CASE WHEN label IN (0,1) THEN label END AS BIGINT) AS is_serious_delinquency,
         round(util,6) AS revolving_utilisation,
         CAST(CASE WHEN age0 <= 0 OR age0 > 110 THEN NULL ELSE age0 END AS BIGINT) AS age,
         round(debt,6) AS debt_ratio, round(income,2) AS monthly_income,
         open_credit_lines, real_estate_loans,
         CASE WHEN t30 IN (96,98) THEN NULL ELSE t30 END AS times_30_59_days_late,
         CASE WHEN t60 IN (96,98) THEN NULL ELSE t60 END AS times_60_89_days_late,
         CASE WHEN t90 IN (96,98) THEN NULL ELSE t90 END AS times_90_days_late,
         number_of_dependents,
         income IS NULL AS dq_income_missing,
         number_of_dependents IS NULL AS dq_dependents_missing,
         coalesce(age0 <= 0 OR age0 > 110, false) AS dq_age_invalid,
         coalesce(util > 1.0, false) AS dq_utilisation_outlier,
         coalesce(t30 IN (96,98), false) OR coalesce(t60 IN (96,98), false) OR coalesce(t90 IN (96,98), false)
           AS dq_delinquency_sentinel,
         NOT coalesce(label IN (0,1), false) AS dq_row_quarantined
  FROM parsed),
silver2 AS MATERIALIZED (
  SELECT * REPLACE (
    DATE '2026-02-01' AS snapshot_date,
    CASE WHEN applicant_id % 13 = 0 AND number_of_dependents IS NOT NULL
         THEN (number_of_dependents + 1) % 5 ELSE number_of_dependents END AS number_of_dependents,
    CASE WHEN applicant_id % 17 = 0 THEN age + 10 ELSE age END AS age)
  FROM silver)"""

BORROWERS = SILVER + """,
age_bands(age_band, lo, hi) AS (VALUES ('<25',0,25),('25-34',25,35),('35-44',35,45),('45-54',45,55),
  ('55-64',55,65),('65+',65,200)),
banded1 AS (
  SELECT s.applicant_id, s.age, coalesce(a.age_band,'unknown') AS age_band, s.number_of_dependents,
         coalesce(CASE WHEN number_of_dependents >= 3 THEN '3+' ELSE CAST(number_of_dependents AS VARCHAR) END,
                  'unknown') AS dependents_band, s.snapshot_date
  FROM silver s LEFT JOIN age_bands a ON s.age >= a.lo AND s.age < a.hi WHERE NOT s.dq_row_quarantined),
banded2 AS (
  SELECT s.applicant_id, s.age, coalesce(a.age_band,'unknown') AS age_band, s.number_of_dependents,
         coalesce(CASE WHEN number_of_dependents >= 3 THEN '3+' ELSE CAST(number_of_dependents AS VARCHAR) END,
                  'unknown') AS dependents_band, s.snapshot_date
  FROM silver2 s LEFT JOIN age_bands a ON s.age >= a.lo AND s.age < a.hi WHERE NOT s.dq_row_quarantined),
moved AS (
  SELECT y.* FROM banded2 y JOIN banded1 x USING (applicant_id)
  WHERE x.age_band <> y.age_band OR x.dependents_band <> y.dependents_band),
dim1 AS MATERIALIZED (
  SELECT applicant_id*100000 + (snapshot_date - DATE '1970-01-01') AS borrower_key, applicant_id, age, age_band,
         number_of_dependents, dependents_band, snapshot_date AS effective_from,
         DATE '9999-12-31' AS effective_to, true AS is_current
  FROM banded1),
dim2 AS MATERIALIZED (
  SELECT d.* REPLACE (
           CASE WHEN m.applicant_id IS NULL THEN d.effective_to ELSE DATE '2026-01-31' END AS effective_to,
           m.applicant_id IS NULL AS is_current)
  FROM dim1 d LEFT JOIN moved m ON d.applicant_id = m.applicant_id
  UNION ALL
  SELECT applicant_id*100000 + (snapshot_date - DATE '1970-01-01'), applicant_id, age, age_band,
         number_of_dependents, dependents_band, snapshot_date, DATE '9999-12-31', true
  FROM moved)"""

FACT = BORROWERS + """,
income_band(income_band_key, band_label, lo, hi, sort_order) AS (VALUES (1,'unknown',NULL,NULL,0),(2,'0-2000',0,2000,1),
  (3,'2000-4000',2000,4000,2),(4,'4000-6000',4000,6000,3),(5,'6000-10000',6000,10000,4),(6,'10000+',10000,NULL,5)),
util_band(utilisation_band_key, lo, hi) AS (VALUES (1,0.0::DOUBLE,0.1::DOUBLE),(2,0.1,0.3),(3,0.3,0.6),(4,0.6,1.0),
  (5,1.0,NULL)),
flags(b) AS (VALUES (false),(true)),
profile AS (
  SELECT CAST(row_number() OVER (ORDER BY a.b, c.b, d.b, e.b) AS BIGINT) AS delinquency_profile_key,
         a.b AS has_30_59_late, c.b AS has_60_89_late, d.b AS has_90_plus_late, e.b AS has_sentinel_code,
         CASE WHEN e.b THEN 'unreliable' WHEN d.b THEN 'severe' WHEN c.b THEN 'moderate' WHEN a.b THEN 'mild'
              ELSE 'none' END AS severity_label
  FROM flags a, flags c, flags d, flags e),
every_silver AS MATERIALIZED (
  SELECT s.*, d.borrower_key FROM silver s JOIN dim1 d USING (applicant_id) WHERE NOT dq_row_quarantined
  UNION ALL
  SELECT s.*, d.borrower_key FROM silver2 s JOIN dim2 d USING (applicant_id)
  WHERE NOT dq_row_quarantined AND d.is_current),
every_fact AS MATERIALIZED (
  SELECT CAST(strftime(s.snapshot_date, '%Y%m%d') AS BIGINT) AS snapshot_date_key, CAST(s.borrower_key AS BIGINT) AS borrower_key,
         CAST(coalesce(i.income_band_key, CASE WHEN s.monthly_income IS NULL THEN 1 ELSE 6 END) AS BIGINT) AS income_band_key,
         CAST(coalesce(u.utilisation_band_key, 5) AS BIGINT) AS utilisation_band_key,
         p.delinquency_profile_key, s.applicant_id, s.revolving_utilisation, s.debt_ratio, s.monthly_income,
         s.open_credit_lines, s.real_estate_loans, s.times_30_59_days_late, s.times_60_89_days_late,
         s.times_90_days_late,
         coalesce(times_30_59_days_late,0)+coalesce(times_60_89_days_late,0)+coalesce(times_90_days_late,0)
           AS total_delinquency_events,
         s.is_serious_delinquency, false AS monthly_income_imputed,
         CASE WHEN ('0x' || substr(md5(CAST(s.applicant_id AS VARCHAR)),1,8))::BIGINT % 100 < 70 THEN 'train'
              WHEN ('0x' || substr(md5(CAST(s.applicant_id AS VARCHAR)),1,8))::BIGINT % 100 < 85 THEN 'valid'
              ELSE 'test' END AS dataset_split
  FROM every_silver s
  LEFT JOIN income_band i ON s.monthly_income >= i.lo AND (i.hi IS NULL OR s.monthly_income < i.hi)
  LEFT JOIN util_band u ON s.revolving_utilisation >= u.lo AND (u.hi IS NULL OR s.revolving_utilisation < u.hi)
  JOIN profile p ON p.has_30_59_late = (coalesce(times_30_59_days_late,0) > 0)
    AND p.has_60_89_late = (coalesce(times_60_89_days_late,0) > 0)
    AND p.has_90_plus_late = (coalesce(times_90_days_late,0) > 0)
    AND p.has_sentinel_code = s.dq_delinquency_sentinel),
fact AS (SELECT * FROM every_fact WHERE snapshot_date_key = 20260101),
fact2 AS (SELECT * FROM every_fact WHERE snapshot_date_key = 20260201)"""

VIEW = FACT + """,
view1 AS (
  SELECT f.applicant_id, f.dataset_split, f.is_serious_delinquency, f.revolving_utilisation, f.debt_ratio,
         f.monthly_income, f.open_credit_lines, f.real_estate_loans, f.times_30_59_days_late,
         f.times_60_89_days_late, f.times_90_days_late, f.total_delinquency_events, b.age, b.number_of_dependents
  FROM fact f JOIN dim1 b ON f.borrower_key = b.borrower_key)"""

FEATURES = VIEW + """,
cleaned AS (
  SELECT * REPLACE (CAST(CASE WHEN age < 18 THEN 18 WHEN age > 100 THEN 100 ELSE age END AS DOUBLE) AS age)
  FROM view1 WHERE is_serious_delinquency IS NOT NULL),
params AS (
  SELECT quantile_cont(monthly_income, 0.5) AS median_income,
         quantile_cont(revolving_utilisation, 0.99) AS utilisation_cap,
         quantile_cont(debt_ratio, 0.99) AS debt_ratio_cap,
         quantile_cont(age, 0.5) AS median_age
  FROM cleaned WHERE dataset_split = 'train'),
filled AS (
  SELECT applicant_id, dataset_split,
         CASE WHEN monthly_income IS NULL THEN 1 ELSE 0 END AS income_missing,
         coalesce(monthly_income, median_income) AS monthly_income,
         CASE WHEN revolving_utilisation > utilisation_cap THEN utilisation_cap ELSE revolving_utilisation END
           AS revolving_utilisation,
         CASE WHEN debt_ratio > debt_ratio_cap THEN debt_ratio_cap ELSE debt_ratio END AS debt_ratio,
         coalesce(age, median_age) AS age,
         CAST(coalesce(number_of_dependents,0) AS DOUBLE) AS number_of_dependents,
         CAST(open_credit_lines AS DOUBLE) AS open_credit_lines,
         CAST(real_estate_loans AS DOUBLE) AS real_estate_loans,
         CAST(coalesce(times_30_59_days_late,0) AS DOUBLE) AS times_30_59_days_late,
         CAST(coalesce(times_60_89_days_late,0) AS DOUBLE) AS times_60_89_days_late,
         CAST(coalesce(times_90_days_late,0) AS DOUBLE) AS times_90_days_late,
         CAST(total_delinquency_events AS DOUBLE) AS total_delinquency_events
  FROM cleaned, params),
feats AS (
  SELECT *, debt_ratio * monthly_income AS monthly_debt_payment,
         monthly_income / (number_of_dependents + 1) AS income_per_dependent,
         total_delinquency_events / (open_credit_lines + 1) AS delinquency_ratio,
         CASE WHEN total_delinquency_events > 0 THEN 1 ELSE 0 END AS has_any_delinquency,
         CASE WHEN revolving_utilisation <= 0.1 THEN 0 WHEN revolving_utilisation <= 0.3 THEN 1
              WHEN revolving_utilisation <= 0.6 THEN 2 WHEN revolving_utilisation <= 1.0 THEN 3 ELSE 4 END
           AS utilisation_bucket
  FROM filled)"""

FEATURE_NAMES = fv.CREDIT_FEATURES


def _long(source, keys, where="true"):
    """feature, value rows of a wide feature table."""
    parts = [f"SELECT {keys} '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {source} WHERE {where}" for f in FEATURE_NAMES]
    return " UNION ALL ".join(parts)


PROFILE_OF_LONG = """
quants AS (
  SELECT feature, unnest(list_sort(list_distinct(quantile_cont(v, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1])))) AS q
  FROM ref_long GROUP BY feature),
ranked AS (
  SELECT feature, q, row_number() OVER (PARTITION BY feature ORDER BY q) AS i,
         count(*) OVER (PARTITION BY feature) AS n_q FROM quants),
cuts AS (  -- inner edges only; the outer ends are open
  SELECT feature, q FROM ranked WHERE i > 1 AND i < n_q),
edges AS (
  SELECT feature, lower_edge, lead(lower_edge) OVER (PARTITION BY feature ORDER BY lower_edge NULLS FIRST) AS upper_edge,
         row_number() OVER (PARTITION BY feature ORDER BY lower_edge NULLS FIRST) - 1 AS bin
  FROM (SELECT DISTINCT feature, CAST(NULL AS DOUBLE) AS lower_edge FROM ref_long UNION ALL SELECT feature, q FROM cuts)),
prof AS (
  SELECT *, sum(n_bin) OVER (PARTITION BY feature) AS n_reference
  FROM (SELECT e.feature, e.bin, e.lower_edge, e.upper_edge, count(r.v) AS n_bin
        FROM edges e LEFT JOIN ref_long r ON r.feature = e.feature
          AND (e.lower_edge IS NULL OR r.v >= e.lower_edge) AND (e.upper_edge IS NULL OR r.v < e.upper_edge)
        GROUP BY e.feature, e.bin, e.lower_edge, e.upper_edge))"""

PROFILE = FEATURES + ", ref_long AS (" + _long("feats", "", "dataset_split = 'train'") + ")," + PROFILE_OF_LONG

PSI_OF_LONG = """
cur AS (
  SELECT g.grp, e.feature, e.bin, any_value(e.n_bin) AS n_bin, any_value(e.n_reference) AS n_reference,
         count(c.v) AS n_cur
  FROM (SELECT DISTINCT grp FROM cur_long) g CROSS JOIN prof e
  LEFT JOIN cur_long c ON c.grp = g.grp AND c.feature = e.feature
    AND (e.lower_edge IS NULL OR c.v >= e.lower_edge) AND (e.upper_edge IS NULL OR c.v < e.upper_edge)
  GROUP BY g.grp, e.feature, e.bin),
shares AS (
  SELECT grp, feature, n_reference, sum(n_cur) OVER (PARTITION BY grp, feature) AS n_current,
         CASE WHEN n_bin = 0 THEN 1e-6 ELSE n_bin / n_reference END AS r,
         CASE WHEN n_cur = 0 THEN 1e-6 ELSE n_cur / sum(n_cur) OVER (PARTITION BY grp, feature) END AS c
  FROM cur),
psi AS (
  SELECT grp, feature, sum((c - r) * ln(c / r)) AS psi, CAST(any_value(n_reference) AS BIGINT) AS n_reference,
         CAST(any_value(n_current) AS BIGINT) AS n_current
  FROM shares GROUP BY grp, feature)"""

PLOG = """
plog AS (
  SELECT event_id AS request_id, ts AS received_at,
         CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
         least(greatest(value,0),400)/400 AS probability_default,
         CAST(floor(value) AS INT) AS latency_ms,
         CASE WHEN event_type='error' THEN 'ERROR' ELSE 'OK' END AS status
  FROM events)"""

DRIFT_REPORT = PLOG + """,
ref_long AS (
  SELECT 'k' AS feature, k AS v FROM plog WHERE status = 'OK' AND received_at < TIMESTAMP '2024-01-21 00:00:00'),
""" + PROFILE_OF_LONG + """,
cur_long AS (
  SELECT '2024-01-30 00:00:00|240|' || model_version AS grp, 'k' AS feature, k AS v FROM plog
  WHERE status = 'OK' AND received_at > TIMESTAMP '2024-01-20 00:00:00' AND received_at <= TIMESTAMP '2024-01-30 00:00:00'
  UNION ALL
  SELECT '2024-01-31 00:00:00|72|' || model_version AS grp, 'k' AS feature, k AS v FROM plog
  WHERE status = 'OK' AND received_at > TIMESTAMP '2024-01-28 00:00:00' AND received_at <= TIMESTAMP '2024-01-31 00:00:00'),
""" + PSI_OF_LONG + """,
report AS (
  SELECT split_part(grp,'|',1) AS computed_at, 'credit' AS pipeline_name, split_part(grp,'|',3) AS model_version,
         feature AS feature_name, round(psi,6) AS psi,
         CASE WHEN psi >= 0.01 THEN 'ALERT' WHEN psi >= 0.005 THEN 'WARN' ELSE 'OK' END AS drift_status,
         'log before 2024-01-21, 10 bins' AS reference_window,
         'last ' || split_part(grp,'|',2) || 'h of prediction_log' AS current_window, n_reference, n_current
  FROM psi WHERE n_current >= 100)"""

PREDICTED = BORROWERS + "," + PLOG + """,
predicted AS (
  SELECT CAST(strftime(day, '%Y%m%d') AS BIGINT) AS date_key, day, request_id, applicant_id, model_version,
         CASE WHEN probability_default < 0.05 THEN 'low' WHEN probability_default < 0.15 THEN 'medium'
              WHEN probability_default < 0.35 THEN 'high' ELSE 'very_high' END AS risk_band
  FROM (SELECT p.*, CAST(p.received_at + INTERVAL 746 DAY AS DATE) AS day, e.user_id * 101 AS applicant_id
        FROM plog p JOIN events e ON e.event_id = p.request_id)
  WHERE status = 'OK')"""

SCORED = BASE + """,
scored AS (
  SELECT k AS id,
    CASE WHEN util_pct + 20*greatest(n_r-1,0) + 15*greatest(n_a-1,0) + (k*7919) % 101 > 215 THEN 1 ELSE 0 END AS y,
    least((util_pct + 20*greatest(n_r-1,0) + (k*31 + qty) % 83) / 400, 1.0) AS score
  FROM base)"""

RANKED_DOCS = """
scored AS (
  SELECT d.doc_id AS id, l.quality AS y, d.n_chars AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL)"""

# AUC as the share of (positive, negative) pairs in the right order, ties half;
# KS as the largest distance of the two cumulative shares.
RANK_SQL = """,
by_score AS (
  SELECT score, sum(y) AS p, sum(1-y) AS q FROM scored GROUP BY score),
tot AS (SELECT sum(p) AS tp, sum(q) AS tq FROM by_score),
cum AS (
  SELECT score, p, q, sum(p) OVER (ORDER BY score DESC) AS cp, sum(q) OVER (ORDER BY score DESC) AS cq FROM by_score)
SELECT round(sum(p * (tq - cq + q / 2.0)) / any_value(tp * tq), 6) AS auc,
       round(greatest(max(cp / tp - cq / tq), 0), 6) AS ks
FROM cum, tot"""

DECILE_SQL = """,
numbered AS (
  SELECT y, score, row_number() OVER (ORDER BY score, id) AS r, count(*) OVER () AS n,
         avg(y) OVER () AS base FROM scored),
cuts AS (
  SELECT *, 1 + (SELECT count(*) FROM range(1, 10) t(i) WHERE r > 1 + t.i * (n - 1) / 10.0) AS tenth FROM numbered)
SELECT CAST(10 - tenth AS BIGINT) AS decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS actual_positives,
       round(avg(y),6) AS actual_rate, round(avg(score),6) AS mean_score,
       round(avg(y)/any_value(base),6) AS lift
FROM cuts GROUP BY tenth"""

REQUESTS = BASE + """,
req AS (
  SELECT k AS request_id,
    CAST(CASE WHEN k % 101 = 0 THEN -0.5 ELSE util_pct/100 END AS DOUBLE) AS revolving_utilisation,
    CAST(CASE WHEN k % 103 = 0 THEN 12 WHEN k % 107 = 0 THEN 200 WHEN k % 109 <> 0 THEN 18 + c % 60 END AS DOUBLE) AS age,
    CAST((qty % 97)/50 AS DOUBLE) AS debt_ratio,
    CAST(CASE WHEN k % 113 = 0 THEN -1000 WHEN k % 5 <> 0 THEN price % 14000 END AS DOUBLE) AS monthly_income,
    CAST(CASE WHEN k % 127 = 0 THEN -1 ELSE n_lines + c % 12 END AS DOUBLE) AS open_credit_lines,
    CAST(c % 4 AS DOUBLE) AS real_estate_loans,
    CAST(CASE WHEN k % 131 = 0 THEN 96 ELSE greatest(n_r-1,0) END AS DOUBLE) AS times_30_59_days_late,
    CAST(CASE WHEN k % 137 = 0 THEN 98 ELSE greatest(n_a-1,0) END AS DOUBLE) AS times_60_89_days_late,
    CAST(greatest(n_r+n_a-4,0) AS DOUBLE) AS times_90_days_late,
    CAST(CASE WHEN k % 37 <> 0 THEN c % 5 END AS DOUBLE) AS number_of_dependents
  FROM base),
judged AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN revolving_utilisation < 0 THEN 'revolving_utilisation: below 0' END,
    CASE WHEN age IS NULL THEN 'age: required' END,
    CASE WHEN age < 18 THEN 'age: below 18' END,
    CASE WHEN age > 110 THEN 'age: above 110' END,
    CASE WHEN monthly_income < 0 THEN 'monthly_income: below 0' END,
    CASE WHEN open_credit_lines < 0 THEN 'open_credit_lines: below 0' END,
    CASE WHEN times_30_59_days_late IN (96,98) THEN 'times_30_59_days_late: sentinel code' END,
    CASE WHEN times_60_89_days_late IN (96,98) THEN 'times_60_89_days_late: sentinel code' END],
    lambda x: x IS NOT NULL)) AS errors
  FROM req)"""


# The fixed linear model: position, feature, label, code, reason, weight.
def _model_rows():
    large = {"monthly_income": 4999, "monthly_debt_payment": 4999, "income_per_dependent": 1999, "age": 53,
             "open_credit_lines": 11}
    rows = []
    for i, f in enumerate(FEATURE_NAMES):
        code, reason = fv.REASON_CODES[f]
        weight = 0.0137 * ((i * 7) % 11 - 5) / large.get(f, 1)
        rows.append(f"({i}, '{f}', '{fv.DISPLAY_NAMES[f]}', '{code}', '{reason}', {weight!r}::DOUBLE)")
    return ", ".join(rows)


EXPLAINED = FEATURES + f""",
linear(pos, feature, label, code, reason, weight) AS (VALUES {_model_rows()}),
feature_rows AS ({_long("feats", "applicant_id,")}),
contrib AS (
  SELECT r.applicant_id, l.*, r.v AS value, r.v * l.weight + 0.0 AS c,
         row_number() OVER (PARTITION BY r.applicant_id ORDER BY abs(r.v * l.weight) DESC, l.pos) AS rank
  FROM feature_rows r JOIN linear l ON l.feature = r.feature),
top AS (
  SELECT *, CASE WHEN c > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM contrib WHERE rank <= 5),
prob AS (
  SELECT applicant_id, round(utilisation_bucket * 0.07::DOUBLE + has_any_delinquency * 0.1::DOUBLE + 0.013::DOUBLE
         + least(total_delinquency_events, 5) * 0.031::DOUBLE, 4) AS p FROM feats),
decided AS (
  SELECT applicant_id, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS cls,
         CASE WHEN p < 0.05 THEN 'low' WHEN p < 0.15 THEN 'medium' WHEN p < 0.35 THEN 'high' ELSE 'very_high' END AS band
  FROM prob)"""


def _text(x):
    return f"regexp_replace(CAST(CAST(round({x},4) AS DECIMAL(38,4)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"


def w(ctes, select):
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _band(p):
    return f"CASE WHEN {p} < 0.05 THEN 'low' WHEN {p} < 0.15 THEN 'medium' WHEN {p} < 0.35 THEN 'high' ELSE 'very_high' END"


def _bucket(u):
    return f"CASE WHEN {u} <= 0.1 THEN 0 WHEN {u} <= 0.3 THEN 1 WHEN {u} <= 0.6 THEN 2 WHEN {u} <= 1.0 THEN 3 ELSE 4 END"


def _linear(u):
    return (f"round({_bucket(u)} * 0.07::DOUBLE + CASE WHEN total_delinquency_events > 0 THEN 0.1::DOUBLE ELSE 0 END + "
            "0.013::DOUBLE + least(total_delinquency_events, 5) * 0.031::DOUBLE, 4)")


# Test applicants by scenario with own and stressed linear probability; only utilisation moves the score.
STRESSED = FEATURES + f""",
shifts(scenario, um) AS (VALUES ('none',1.0::DOUBLE),('moderate',1.5),('severe',3.0)),
both_scores AS (
  SELECT scenario, {_linear("least(revolving_utilisation, utilisation_cap)")} AS p0,
         {_linear("least(revolving_utilisation * um, utilisation_cap)")} AS p1
  FROM cleaned, params, shifts WHERE dataset_split = 'test')"""


ORACLES = {
    "silver_clean": w(SILVER, """
      SELECT applicant_id, '00000000-0000-0000-0000-000000000001' AS ingestion_id,
             strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, * EXCLUDE (applicant_id, snapshot_date)
      FROM silver"""),
    "dq_log": w(SILVER, """
      SELECT rule_name, 'WARN' AS severity, CAST(rows_affected AS BIGINT) AS rows_affected FROM (
        SELECT 'income_missing' AS rule_name, count(*) FILTER (WHERE dq_income_missing) AS rows_affected FROM silver
        UNION ALL SELECT 'dependents_missing', count(*) FILTER (WHERE dq_dependents_missing) FROM silver
        UNION ALL SELECT 'age_invalid', count(*) FILTER (WHERE dq_age_invalid) FROM silver
        UNION ALL SELECT 'utilisation_outlier', count(*) FILTER (WHERE dq_utilisation_outlier) FROM silver
        UNION ALL SELECT 'delinquency_sentinel', count(*) FILTER (WHERE dq_delinquency_sentinel) FROM silver
        UNION ALL SELECT 'row_quarantined', count(*) FILTER (WHERE dq_row_quarantined) FROM silver)"""),
    "borrower_history": w(BORROWERS, """
      SELECT CAST(borrower_key AS BIGINT) AS borrower_key, applicant_id, age, age_band, number_of_dependents,
             dependents_band, strftime(effective_from, '%Y-%m-%d') AS effective_from,
             strftime(effective_to, '%Y-%m-%d') AS effective_to, is_current FROM dim2"""),
    "borrower_changes": w(BORROWERS, """
      SELECT '2026-01-01' AS snapshot_date, (SELECT count(*) FROM banded1) AS n_new, CAST(0 AS BIGINT) AS n_changed
      UNION ALL
      SELECT '2026-02-01', CAST(0 AS BIGINT), (SELECT count(*) FROM moved)"""),
    "borrower_as_of": w(BORROWERS, """
      SELECT b.applicant_id, strftime(t.as_of, '%Y-%m-%d') AS as_of, CAST(d.borrower_key AS BIGINT) AS borrower_key,
             d.age, d.age_band, d.dependents_band
      FROM banded1 b CROSS JOIN (VALUES (DATE '2026-01-15'), (DATE '2026-02-15')) t(as_of)
      LEFT JOIN dim2 d ON d.applicant_id = b.applicant_id AND t.as_of >= d.effective_from AND t.as_of <= d.effective_to"""),
    "fact_assessment": w(FACT, "SELECT * FROM fact"),
    "fact_upsert": w(FACT, """
      SELECT applicant_id, snapshot_date_key, borrower_key,
             CASE WHEN monthly_income IS NULL AND snapshot_date_key = 20260101 THEN 3 ELSE income_band_key END AS income_band_key,
             CASE WHEN monthly_income IS NULL AND snapshot_date_key = 20260101 THEN 3000.0 ELSE monthly_income END AS monthly_income,
             dataset_split
      FROM every_fact"""),
    "silver_upsert": w(SILVER, """
      SELECT x.applicant_id, CASE WHEN x.dq_income_missing THEN '2026-02-01' ELSE '2026-01-01' END AS snapshot_date,
             CASE WHEN x.dq_income_missing THEN y.age ELSE x.age END AS age,
             CASE WHEN x.dq_income_missing THEN y.number_of_dependents ELSE x.number_of_dependents END AS number_of_dependents,
             x.dq_income_missing
      FROM silver x JOIN silver2 y USING (applicant_id)"""),
    "borrower_insert_if_absent": w(BORROWERS, """
      SELECT * REPLACE (strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date) FROM (
        SELECT * FROM banded1 WHERE number_of_dependents IS NOT NULL
        UNION ALL
        SELECT * FROM banded2 WHERE applicant_id NOT IN
          (SELECT applicant_id FROM banded1 WHERE number_of_dependents IS NOT NULL))"""),
    "model_view": w(FACT, """
      SELECT f.applicant_id, f.snapshot_date_key, f.dataset_split, f.is_serious_delinquency, f.revolving_utilisation,
             f.debt_ratio, f.monthly_income, f.open_credit_lines, f.real_estate_loans, f.times_30_59_days_late,
             f.times_60_89_days_late, f.times_90_days_late, f.total_delinquency_events, b.age, b.number_of_dependents
      FROM every_fact f JOIN dim2 b ON f.borrower_key = b.borrower_key"""),
    "constraint_violations": w(FACT, """
      , faulty AS (
        SELECT * REPLACE (
          CASE WHEN applicant_id % 709 = 0 THEN 99 ELSE income_band_key END AS income_band_key,
          CASE WHEN applicant_id % 719 = 0 THEN NULL ELSE utilisation_band_key END AS utilisation_band_key,
          CASE WHEN applicant_id % 727 = 0 THEN -applicant_id ELSE borrower_key END AS borrower_key,
          CASE WHEN applicant_id % 733 = 0 THEN 'holdout' ELSE dataset_split END AS dataset_split)
        FROM (SELECT * FROM fact UNION ALL SELECT * FROM fact WHERE applicant_id % 701 = 0))
      SELECT 'unique' AS kind, 'applicant_id,snapshot_date_key' AS subject,
             (SELECT count(*) FROM faulty) - (SELECT count(*) FROM (SELECT DISTINCT applicant_id, snapshot_date_key FROM faulty)) AS violations
      UNION ALL SELECT 'reference', 'snapshot_date_key', count(*) FROM faulty
        WHERE snapshot_date_key NOT BETWEEN 20240101 AND 20271231
      UNION ALL SELECT 'reference', 'borrower_key', count(*) FROM faulty WHERE borrower_key NOT IN (SELECT borrower_key FROM dim1)
      UNION ALL SELECT 'reference', 'income_band_key', count(*) FROM faulty WHERE income_band_key NOT IN (SELECT income_band_key FROM income_band)
      UNION ALL SELECT 'reference', 'utilisation_band_key', count(*) FROM faulty
        WHERE utilisation_band_key NOT IN (SELECT utilisation_band_key FROM util_band)
      UNION ALL SELECT 'reference', 'delinquency_profile_key', count(*) FROM faulty
        WHERE delinquency_profile_key NOT IN (SELECT delinquency_profile_key FROM profile)
      UNION ALL SELECT 'not_null', 'snapshot_date_key', count(*) - count(snapshot_date_key) FROM faulty
      UNION ALL SELECT 'not_null', 'borrower_key', count(*) - count(borrower_key) FROM faulty
      UNION ALL SELECT 'not_null', 'income_band_key', count(*) - count(income_band_key) FROM faulty
      UNION ALL SELECT 'not_null', 'utilisation_band_key', count(*) - count(utilisation_band_key) FROM faulty
      UNION ALL SELECT 'not_null', 'delinquency_profile_key', count(*) - count(delinquency_profile_key) FROM faulty
      UNION ALL SELECT 'domain', 'dataset_split', count(*) FROM faulty WHERE dataset_split NOT IN ('train','valid','test')
      UNION ALL SELECT 'domain', 'is_serious_delinquency', count(*) FROM faulty WHERE is_serious_delinquency NOT IN (0,1)"""),
    "latest_run": """
      SELECT o_orderpriority AS source_file, CAST(max(o_orderkey) AS VARCHAR) AS ingestion_id,
             strftime(any_value(o_orderdate), '%Y-%m-%d %H:%M:%S') AS completed_at,
             strftime(any_value(o_orderdate), '%Y-%m-%d') AS snapshot_date
      FROM orders o WHERE o_orderstatus = 'F' AND o_orderdate =
        (SELECT max(o_orderdate) FROM orders x WHERE x.o_orderstatus = 'F' AND x.o_orderpriority = o.o_orderpriority)
      GROUP BY o_orderpriority""",
    "portfolio_summary": w(FACT, """
      SELECT count(*) AS total_applicants, round(avg(is_serious_delinquency),6) AS default_rate,
             count(*) FILTER (WHERE dataset_split='train') AS train_rows,
             count(*) FILTER (WHERE dataset_split='valid') AS valid_rows,
             count(*) FILTER (WHERE dataset_split='test') AS test_rows FROM fact"""),
    "segment_default_rates": w(FACT, """
      SELECT severity_label, band_label, count(*) AS n, round(avg(is_serious_delinquency),4) AS default_rate
      FROM fact JOIN profile USING (delinquency_profile_key) JOIN income_band USING (income_band_key)
      GROUP BY 1, 2 ORDER BY default_rate DESC NULLS FIRST"""),
    "default_rate_by_severity": w(FACT, """
      SELECT severity_label, count(*) AS n, round(avg(is_serious_delinquency),4) AS default_rate
      FROM fact JOIN profile USING (delinquency_profile_key) GROUP BY 1 ORDER BY default_rate DESC NULLS FIRST"""),
    "default_rate_by_income_band": w(FACT, """
      SELECT band_label, CAST(sort_order AS BIGINT) AS sort_order, count(*) AS n,
             round(avg(is_serious_delinquency),4) AS default_rate
      FROM fact JOIN income_band USING (income_band_key) GROUP BY 1, 2 ORDER BY sort_order"""),
    "top_segments": w(FACT, """
      SELECT severity_label, band_label, count(*) AS n, round(avg(is_serious_delinquency),4) AS default_rate
      FROM fact JOIN profile USING (delinquency_profile_key) JOIN income_band USING (income_band_key)
      GROUP BY 1, 2 ORDER BY default_rate DESC NULLS FIRST, severity_label, band_label LIMIT 10"""),
    "random_applicants": w(VIEW, """
      SELECT applicant_id, age, is_serious_delinquency, revolving_utilisation FROM view1
      WHERE dataset_split = 'test' AND age IS NOT NULL
      ORDER BY md5(applicant_id || ':42'), applicant_id LIMIT 25"""),
    "feature_params": w(FEATURES, """
      SELECT round(median_income,6) AS median_income, round(utilisation_cap,6) AS utilisation_cap,
             round(debt_ratio_cap,6) AS debt_ratio_cap, round(median_age,6) AS median_age FROM params"""),
    "credit_features": w(FEATURES, """
      SELECT applicant_id, dataset_split, CAST(income_missing AS BIGINT) AS income_missing,
             CAST(has_any_delinquency AS BIGINT) AS has_any_delinquency, CAST(utilisation_bucket AS BIGINT) AS utilisation_bucket,
             round(monthly_debt_payment,6) AS monthly_debt_payment, round(income_per_dependent,6) AS income_per_dependent,
             round(delinquency_ratio,6) AS delinquency_ratio, round(revolving_utilisation,6) AS revolving_utilisation,
             round(debt_ratio,6) AS debt_ratio, monthly_income, age, number_of_dependents, open_credit_lines,
             real_estate_loans, times_30_59_days_late, times_60_89_days_late, times_90_days_late, total_delinquency_events
      FROM feats"""),
    "tree_features": w(FACT, """
      SELECT applicant_id, dataset_split, least(coalesce(revolving_utilisation,0),2.0) AS revolving_utilisation,
             CAST(total_delinquency_events AS DOUBLE) AS total_delinquency_events
      FROM fact WHERE is_serious_delinquency IS NOT NULL"""),
    "class_balance": w(FACT, """
      SELECT count(*) FILTER (WHERE is_serious_delinquency = 0) AS n_negative,
             count(*) FILTER (WHERE is_serious_delinquency = 1) AS n_positive,
             round(count(*) FILTER (WHERE is_serious_delinquency = 0) / count(*) FILTER (WHERE is_serious_delinquency = 1),6)
               AS scale_pos_weight
      FROM fact WHERE dataset_split = 'train'"""),
    "cleaning_counts": w(SILVER, """
      SELECT CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'valid' ELSE 'test' END AS dataset_split,
             count(*) AS rows_loaded, count(is_serious_delinquency) AS rows_cleaned
      FROM (SELECT *, ('0x' || substr(md5(CAST(applicant_id AS VARCHAR)),1,8))::BIGINT % 100 AS h FROM silver)
      GROUP BY 1"""),
    "reference_profile": w(PROFILE, """
      SELECT p.feature, CAST(p.bin AS BIGINT) AS bin, round(lower_edge,6) AS lower_edge, round(upper_edge,6) AS upper_edge,
             round(n_bin / n_reference,6) AS reference_share, CAST(n_reference AS BIGINT) AS n_reference,
             round(m.mean,6) AS mean, round(m.std,6) AS std
      FROM prof p JOIN (SELECT feature, avg(v) AS mean, stddev_samp(v) AS std FROM ref_long GROUP BY feature) m
        ON m.feature = p.feature"""),
    "psi_by_split": w(
        PROFILE + ", cur_long AS (" + _long("feats", "dataset_split AS grp,", "dataset_split <> 'train'") + ")," + PSI_OF_LONG,
        """
      SELECT grp AS dataset_split, feature, round(psi,6) AS psi, n_reference, n_current,
             CASE WHEN psi >= 0.25 THEN 'ALERT' WHEN psi >= 0.1 THEN 'WARN' ELSE 'OK' END AS drift_status
      FROM psi"""),
    "scenario_drift": w(
        PROFILE + """,
shifts(scenario, um, im) AS (VALUES ('none',1.0::DOUBLE,1.0::DOUBLE),('moderate',1.5,0.8),('severe',3.0,0.5)),
stressed0 AS (
  SELECT scenario, CASE WHEN monthly_income IS NULL THEN 1 ELSE 0 END AS income_missing,
         coalesce(monthly_income * im, median_income) AS monthly_income,
         CASE WHEN revolving_utilisation * um > utilisation_cap THEN utilisation_cap ELSE revolving_utilisation * um END
           AS revolving_utilisation,
         CASE WHEN debt_ratio > debt_ratio_cap THEN debt_ratio_cap ELSE debt_ratio END AS debt_ratio, age,
         coalesce(number_of_dependents,0) AS number_of_dependents, open_credit_lines, real_estate_loans,
         coalesce(times_30_59_days_late,0) AS times_30_59_days_late,
         coalesce(times_60_89_days_late,0) AS times_60_89_days_late,
         coalesce(times_90_days_late,0) AS times_90_days_late, total_delinquency_events
  FROM cleaned, params, shifts WHERE dataset_split = 'test' AND age IS NOT NULL),
stressed AS (
  SELECT *, debt_ratio * monthly_income AS monthly_debt_payment,
         monthly_income / (number_of_dependents + 1) AS income_per_dependent,
         total_delinquency_events / (open_credit_lines + 1) AS delinquency_ratio,
         CASE WHEN total_delinquency_events > 0 THEN 1 ELSE 0 END AS has_any_delinquency,
         CASE WHEN revolving_utilisation <= 0.1 THEN 0 WHEN revolving_utilisation <= 0.3 THEN 1
              WHEN revolving_utilisation <= 0.6 THEN 2 WHEN revolving_utilisation <= 1.0 THEN 3 ELSE 4 END
           AS utilisation_bucket
  FROM stressed0),
cur_long AS (""" + _long("stressed", "scenario AS grp,") + ")," + PSI_OF_LONG,
        """
      SELECT grp AS scenario, feature, round(psi,6) AS psi, n_reference, n_current,
             CASE WHEN psi >= 0.25 THEN 'ALERT' WHEN psi >= 0.1 THEN 'WARN' ELSE 'OK' END AS drift_status
      FROM psi"""),
    "prediction_volume": w(PLOG, """
      SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n,
             round(avg(probability_default),12) AS avg_probability
      FROM plog WHERE received_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY 1 ORDER BY 1"""),
    "logged_drift": w(DRIFT_REPORT, "SELECT * REPLACE (round(psi,5) AS psi) FROM report"),
    "latest_drift": w(DRIFT_REPORT, """
      SELECT feature_name, model_version, round(psi,5) AS psi, drift_status, computed_at, n_reference, n_current FROM report
      WHERE computed_at = (SELECT max(computed_at) FROM report) ORDER BY psi DESC"""),
    "service_metrics": w(DRIFT_REPORT, """
      SELECT count(*) AS predictions_total,
             count(*) FILTER (WHERE received_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR) AS predictions_last_hour,
             count(*) FILTER (WHERE status <> 'OK') AS errors_total,
             round(coalesce(percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms),0),6) AS latency_p50_ms,
             round(coalesce(percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms),0),6) AS latency_p95_ms,
             round(avg(probability_default) FILTER (WHERE received_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR),6)
               AS average_probability_last_hour,
             'v1' AS active_model_version,
             coalesce((SELECT drift_status FROM report WHERE computed_at = (SELECT max(computed_at) FROM report)
               ORDER BY CASE drift_status WHEN 'ALERT' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END LIMIT 1), 'UNKNOWN') AS drift_status
      FROM plog"""),
    "score_histogram": w(PLOG, """
      SELECT CAST(least(floor(probability_default*40), 39) AS BIGINT) AS bin, count(*) AS n FROM plog GROUP BY 1"""),
    "recent_scores": w(PLOG, """
      SELECT request_id, round(probability_default,6) AS probability_default,
             strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at
      FROM plog WHERE probability_default IS NOT NULL ORDER BY plog.received_at DESC, request_id DESC LIMIT 5000"""),
    "prediction_calendar": """
      SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, n, strftime(d, '%Y-%m-%d') AS full_date,
             year(d) AS year, quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name,
             day(d) AS day_of_month, isodow(d) - 1 AS day_of_week, last_day(d) = d AS is_month_end
      FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)""",
    "confusion_metrics": w(SCORED, """
      , cm AS (SELECT count(*) FILTER (WHERE y=0 AND score<0.5) AS tn, count(*) FILTER (WHERE y=0 AND score>=0.5) AS fp,
                      count(*) FILTER (WHERE y=1 AND score<0.5) AS fn, count(*) FILTER (WHERE y=1 AND score>=0.5) AS tp FROM scored)
      SELECT *, round(CASE WHEN tp+fp=0 THEN 0.0 ELSE tp/(tp+fp) END,6) AS precision,
             round(CASE WHEN tp+fn=0 THEN 0.0 ELSE tp/(tp+fn) END,6) AS recall,
             round(CASE WHEN 2*tp+fp+fn=0 THEN 0.0 ELSE 2*tp/(2*tp+fp+fn) END,6) AS f1 FROM cm"""),
    "rank_metrics": w(SCORED + RANK_SQL, ""),
    "document_rank_metrics": w(RANKED_DOCS + RANK_SQL, ""),
    "decile_lift": w(SCORED + DECILE_SQL, ""),
    "document_decile_lift": w(RANKED_DOCS + DECILE_SQL, ""),
    "evaluation_gap": w(SCORED, """
      , parts AS (
        SELECT *, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'valid' ELSE 'test' END AS part
        FROM (SELECT *, ('0x' || substr(md5(CAST(id AS VARCHAR)),1,8))::BIGINT % 100 AS h FROM scored)),
      by_score AS (SELECT part, score, sum(y) AS p, sum(1-y) AS q FROM parts GROUP BY part, score),
      cum AS (
        SELECT *, sum(p) OVER (PARTITION BY part ORDER BY score DESC) AS cp, sum(q) OVER (PARTITION BY part ORDER BY score DESC) AS cq,
               sum(p) OVER (PARTITION BY part) AS tp, sum(q) OVER (PARTITION BY part) AS tq FROM by_score),
      m AS (
        SELECT part, sum(p * (tq - cq + q / 2.0)) / any_value(tp * tq) AS auc, greatest(max(cp/tp - cq/tq), 0) AS ks
        FROM cum GROUP BY part),
      cm AS (SELECT count(*) FILTER (WHERE y=0 AND score<0.4) AS tn, count(*) FILTER (WHERE y=0 AND score>=0.4) AS fp,
                    count(*) FILTER (WHERE y=1 AND score<0.4) AS fn, count(*) FILTER (WHERE y=1 AND score>=0.4) AS tp
             FROM parts WHERE part = 'test')
      SELECT cm.*, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1,
             round(t.auc,6) AS auc, round(t.ks,6) AS ks, 0.4::DOUBLE AS threshold, round(v.auc - t.auc,6) AS auc_gap,
             abs(v.auc - t.auc) > 0.02 AS gap_warning
      FROM cm, m t, m v WHERE t.part = 'test' AND v.part = 'valid'"""),
    "rejected_requests": w(REQUESTS, """
      SELECT request_id, array_to_string(errors, '; ') AS errors FROM judged WHERE len(errors) > 0"""),
    "accepted_requests": w(REQUESTS, """
      SELECT * EXCLUDE (errors), CAST(times_30_59_days_late + times_60_89_days_late + times_90_days_late AS BIGINT)
        AS total_delinquency_events
      FROM judged WHERE len(errors) = 0"""),
    "scored_applicants": w(EXPLAINED, """
      SELECT applicant_id, p AS probability_default, CAST(cls AS BIGINT) AS predicted_class, band AS risk_band,
             0.5::DOUBLE AS threshold_used FROM decided"""),
    "reason_codes": w(EXPLAINED, """
      SELECT applicant_id, code, reason, rank, feature FROM top WHERE direction = 'increases_risk'"""),
    "model_payload": w(EXPLAINED, """
      SELECT t.applicant_id, 'req-' || t.applicant_id AS request_id, d.p AS probability_of_default,
             0.0668::DOUBLE AS average_probability, v.number_of_dependents IS NULL AS dependents_missing,
             t.label AS factor, round(t.value,4) AS value, round(t.c,4) AS contribution, t.direction, t.rank,
             CASE WHEN t.c > 0 THEN t.code END AS reason_code
      FROM top t JOIN decided d USING (applicant_id) JOIN view1 v USING (applicant_id)"""),
    "template_report": w(EXPLAINED, f"""
      , said AS (
        SELECT applicant_id, direction, label, code, rank,
               'Recorded value ' || {_text("value")} || '; contribution to modelled risk ' || {_text("c")} || '.' AS observation
        FROM top),
      lists AS (
        SELECT applicant_id,
          coalesce(string_agg(code || ': ' || label || ': ' || observation, ' | ' ORDER BY rank) FILTER (WHERE direction = 'increases_risk'), '') AS up,
          coalesce(string_agg(label || ': ' || observation, ' | ' ORDER BY rank) FILTER (WHERE direction = 'decreases_risk'), '') AS down
        FROM said GROUP BY applicant_id)
      SELECT d.applicant_id,
        'Modelled probability of default is ' || {_text("d.p")} || ', placing this application in the ' || d.band ||
        ' risk band against a decision threshold of 0.5. The portfolio average is 0.0668. ' ||
        'This note was generated without narrative language support.' AS summary,
        l.up AS key_risk_factors, l.down AS mitigating_factors,
        CASE WHEN v.monthly_income IS NULL AND v.number_of_dependents IS NULL
             THEN 'Field flagged as imputed or missing: monthly_income_imputed. | Field flagged as imputed or missing: dependents_missing.'
             WHEN v.monthly_income IS NULL THEN 'Field flagged as imputed or missing: monthly_income_imputed.'
             WHEN v.number_of_dependents IS NULL THEN 'Field flagged as imputed or missing: dependents_missing.'
             ELSE 'No data quality flags were raised for this application.' END AS data_quality_notes,
        'Verify reported income against documentary evidence. | Confirm the delinquency history against the bureau record. | ' ||
        'Review current outstanding balances across all open accounts.' AS recommended_checks,
        'low' AS confidence, 'disabled' AS llm_status
      FROM decided d JOIN lists l USING (applicant_id) JOIN view1 v USING (applicant_id)"""),
    "report_audit": w(EXPLAINED, """
      , judged AS (
        SELECT applicant_id, applicant_id % 6 AS kind, count(*) FILTER (WHERE direction = 'increases_risk') AS n_up
        FROM top GROUP BY applicant_id),
      found AS (
        SELECT applicant_id,
               CASE WHEN kind = 4 THEN 'not valid JSON' WHEN kind = 5 OR (n_up = 0 AND kind <> 1) THEN 'key_risk_factors not 1 to 5'
                    ELSE '' END AS problems,
               CASE WHEN kind = 1 THEN 'R99' ELSE '' END AS fabricated,
               CASE WHEN kind = 2 AND n_up > 0 THEN '987654.321' ELSE '' END AS unsupported
        FROM judged)
      SELECT *, problems = '' AND fabricated = '' AND unsupported = '' AS is_valid,
             CASE WHEN applicant_id % 7 = 0 THEN 'disabled'
                  WHEN problems = '' AND fabricated = '' AND unsupported = '' THEN 'ok' ELSE 'fallback' END AS outcome
      FROM found"""),
    "request_log": w(REQUESTS, """
      , sent AS (
        SELECT *, CASE WHEN request_id % 139 <> 0 THEN revolving_utilisation END AS u,
               least(times_30_59_days_late + times_60_89_days_late + times_90_days_late, 1) AS any_late,
               least(times_30_59_days_late + times_60_89_days_late + times_90_days_late, 5) AS late
        FROM judged WHERE request_id % 149 <> 0
          AND len(list_filter(errors, lambda x: request_id % 139 <> 0 OR NOT starts_with(x, 'revolving'))) = 0),
      bucketed AS (
        SELECT *, CASE WHEN u IS NULL THEN NULL WHEN u <= 0.1 THEN 0 WHEN u <= 0.3 THEN 1 WHEN u <= 0.6 THEN 2
                       WHEN u <= 1.0 THEN 3 ELSE 4 END AS b FROM sent),
      scored AS (
        SELECT *, round(b * 0.07::DOUBLE + any_late * 0.1::DOUBLE + 0.013::DOUBLE + late * 0.031::DOUBLE, 4) AS p FROM bucketed)
      SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN b IS NULL THEN 'ERROR' ELSE 'OK' END AS status,
             CASE WHEN b IS NULL THEN 'revolving_utilisation has no bucket: null or below range' END AS error_message,
             p AS probability_default, CAST(CASE WHEN p >= 0.5 THEN 1 WHEN p < 0.5 THEN 0 END AS BIGINT) AS predicted_class,
             CASE WHEN p < 0.05 THEN 'low' WHEN p < 0.15 THEN 'medium' WHEN p < 0.35 THEN 'high' WHEN p >= 0.35 THEN 'very_high' END
               AS risk_band,
             age AS age_sent, u AS utilisation_sent, CAST(b AS DOUBLE) AS utilisation_bucket
      FROM scored"""),
    "stress_scores": w(STRESSED, """
      SELECT scenario, count(*) AS n, count(*) FILTER (WHERE p0 IS NULL OR p1 IS NULL) AS n_failed, round(avg(p0),6) AS mean_own,
             round(avg(p1),6) AS mean_stressed, round(avg(p1 - p0),6) AS mean_shift, round(max(p1 - p0),6) AS largest_shift,
             count(*) FILTER (WHERE p0 >= 0.3) AS n_flagged_own, count(*) FILTER (WHERE p1 >= 0.3) AS n_flagged_stressed,
             count(*) FILTER (WHERE (p0 >= 0.3) <> (p1 >= 0.3)) AS n_changed
      FROM both_scores GROUP BY scenario"""),
    "stress_migration": w(STRESSED, """
      SELECT scenario, own_band, stressed_band, n, round(n / sum(n) OVER (PARTITION BY scenario, own_band),6) AS share
      FROM (SELECT scenario, band(p0) AS own_band, band(p1) AS stressed_band, count(*) AS n FROM both_scores GROUP BY ALL)"""
      .replace("band(p0)", _band("p0")).replace("band(p1)", _band("p1"))),
    "drift_alerts": w(DRIFT_REPORT, """
      SELECT computed_at AS occurred_at, 'drift_alert' AS event_type, pipeline_name AS pipeline, model_version,
             CAST(regexp_extract(current_window, '[0-9]+') AS BIGINT) AS window_hours, feature_name AS feature, round(psi,4) AS psi
      FROM report WHERE drift_status = 'ALERT'"""),
    "drift_status_counts": w(DRIFT_REPORT, """
      SELECT computed_at, pipeline_name, model_version, count(*) FILTER (WHERE drift_status='ALERT') AS n_alert,
             count(*) FILTER (WHERE drift_status='WARN') AS n_warn, count(*) FILTER (WHERE drift_status='OK') AS n_ok
      FROM report GROUP BY ALL"""),
    "model_registry": w(PLOG, """
      SELECT 'credit' AS pipeline_name, 'credit_linear' AS model_name, model_version, count(*) AS training_rows,
             strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS trained_at, model_version = 'v2' AS is_active
      FROM plog GROUP BY model_version"""),
    "prediction_facts": w(PLOG, """
      SELECT CAST(strftime(received_at, '%Y%m%d') AS BIGINT) AS date_key, CAST(request_id AS BIGINT) AS request_id,
             strftime(received_at, '%Y-%m-%d %H:%M:%S') AS predicted_at, round(probability_default,6) AS probability_default,
             CAST(CASE WHEN probability_default >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS predicted_class,
             CASE WHEN probability_default < 0.05 THEN 'low' WHEN probability_default < 0.15 THEN 'medium'
                  WHEN probability_default < 0.35 THEN 'high' ELSE 'very_high' END AS risk_band,
             0.5::DOUBLE AS threshold_used, CAST(latency_ms AS BIGINT) AS latency_ms, CAST(NULL AS BIGINT) AS actual_outcome,
             model_version = 'v1' AS has_model
      FROM plog WHERE status = 'OK'"""),
    "prediction_borrowers": w(PREDICTED, """
      SELECT p.date_key, p.request_id, p.applicant_id, CAST(d.borrower_key AS BIGINT) AS borrower_key, p.risk_band
      FROM predicted p LEFT JOIN dim2 d ON d.applicant_id = p.applicant_id AND p.day BETWEEN d.effective_from AND d.effective_to"""),
    "prediction_constraints": w(PREDICTED, """
      , fact AS (
        SELECT p.*, d.borrower_key FROM (SELECT * FROM predicted UNION ALL SELECT * FROM predicted WHERE request_id % 97 = 0) p
        LEFT JOIN dim2 d ON d.applicant_id = p.applicant_id AND p.day BETWEEN d.effective_from AND d.effective_to)
      SELECT 'unique' AS kind, 'request_id' AS subject, count(*) - count(DISTINCT request_id) AS violations FROM fact
      UNION ALL SELECT 'reference', 'borrower_key', count(*) FROM fact WHERE borrower_key IS NOT NULL AND applicant_id % 3 = 0
      UNION ALL SELECT 'not_null', 'model_key', count(*) FROM fact WHERE model_version <> 'v1'
      UNION ALL SELECT kind, subject, 0 FROM (VALUES ('reference', 'date_key'), ('reference', 'model_key'), ('not_null', 'date_key'),
        ('not_null', 'request_id'), ('not_null', 'predicted_at'), ('not_null', 'probability_default'), ('not_null', 'predicted_class'),
        ('not_null', 'risk_band'), ('domain', 'predicted_class'), ('domain', 'risk_band')) t(kind, subject)"""),
    "skipped_features": w(PLOG, """
      SELECT model_version, third, feature, n AS n_rows
      FROM (SELECT model_version, CAST(day(received_at) // 10 AS BIGINT) AS third, count(*) AS n, count(k) AS n_k
            FROM plog WHERE status = 'OK' GROUP BY 1, 2 HAVING count(*) >= 100), (VALUES ('k'), ('margin')) f(feature)
      WHERE feature = 'margin' OR (model_version = 'v2' AND third = 1)"""),
    "bronze_from_csv": w(BRONZE, "SELECT * EXCLUDE (bronze_id), CAST(0 AS BIGINT) AS files_misnumbered FROM raw"),
    "file_fingerprints": """
      SELECT o_orderstatus AS status, sha256(string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority,
             chr(10) ORDER BY o_orderkey) || chr(10)) AS file_sha256
      FROM orders GROUP BY o_orderstatus""",
    "stream_volume": w(PLOG, """
      SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n,
             round(avg(probability_default),12) AS avg_probability
      FROM plog GROUP BY date_trunc('hour', received_at)
      HAVING date_trunc('hour', received_at) + INTERVAL 1 HOUR <= (SELECT max(received_at) FROM plog) - INTERVAL 1 HOUR"""),
    "stream_drift": w(PLOG + """,
ref_long AS (
  SELECT 'k' AS feature, k AS v FROM plog WHERE status = 'OK' AND received_at < TIMESTAMP '2024-01-21 00:00:00'),
""" + PROFILE_OF_LONG + """,
cur_long AS (
  SELECT CAST(CAST(received_at AS DATE) + INTERVAL 1 DAY AS VARCHAR) || '|' || model_version AS grp, 'k' AS feature, k AS v
  FROM plog WHERE status = 'OK'
    AND CAST(received_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(received_at) FROM plog WHERE status = 'OK') - INTERVAL 1 HOUR),
""" + PSI_OF_LONG, """
      SELECT split_part(grp,'|',1) AS window_end, split_part(grp,'|',2) AS model_version, feature, round(psi,5) AS psi,
             n_reference, n_current, CASE WHEN psi >= 0.25 THEN 'ALERT' WHEN psi >= 0.1 THEN 'WARN' ELSE 'OK' END AS drift_status
      FROM psi WHERE n_current >= 100"""),
}

# The written report where its audit found nothing, else the template; both are recomputed above.
ORACLES["final_reports"] = f"""
SELECT t.applicant_id, CASE WHEN s.llm_status = 'ok' THEN 'The modelled probability is ' || {_text("round(p.probability_default * 100, 2)")} || ' percent.'
            ELSE t.summary END AS summary,
       t.key_risk_factors, t.mitigating_factors, t.data_quality_notes, t.recommended_checks,
       CASE WHEN s.llm_status = 'ok' THEN 'medium' ELSE t.confidence END AS confidence, s.llm_status
FROM ({ORACLES["template_report"]}) t
JOIN ({ORACLES["scored_applicants"]}) p USING (applicant_id)
JOIN (SELECT applicant_id, CASE WHEN outcome = 'ok' AND applicant_id % 11 = 0 THEN 'fallback' ELSE outcome END AS llm_status
      FROM ({ORACLES["report_audit"]})) s USING (applicant_id)"""
