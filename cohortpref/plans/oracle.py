"""The registered queries in plain SQL, over the same tables, for comparison with another engine."""

from __future__ import annotations

from cohortpref.config import BOOKING_COLUMNS, DAY_BOUNDS, ColumnRoles

ROLES = ColumnRoles()
CHOICES = (
    "STRING_Y_STER", "STRING_Y_UE", "Y_GIORNO_SETTIMANA", "Y_MESE_ANNO", "Y_FASCIA_ORARIA",
    "Y_GIORNI_ALLA_PRENOTAZIONE",
)
COLUMNS = [name for name, _ in BOOKING_COLUMNS]

RAW = """
raw AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BOOKING_ID,
    CAST(18 + c_custkey % 80 AS INTEGER) AS X_ETA,
    CAST(1 + c_custkey % 2 AS INTEGER) AS X_SESSO,
    CAST(c_nationkey AS VARCHAR) AS STRING_X_CAP,
    CAST(n_regionkey AS VARCHAR) AS STRING_X_USL,
    c_mktsegment AS STRING_X_FASCIA,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS X_GRADO_URG,
    p_type AS STRING_X_QDGN,
    l_returnflag AS STRING_X_INVIANTE,
    o_orderstatus AS STRING_X_ESENZIONE,
    CAST(o_custkey % 200 AS VARCHAR) AS STRING_X_PRESCRITTORE,
    CAST(l_partkey AS VARCHAR) AS STRING_X_PRESTAZIONE,
    p_brand AS STRING_X_BRANCA_SPECIALISTICA,
    p_name AS STRING_X_GRUPPO_EROGABILE,
    CAST(s_nationkey AS VARCHAR) AS STRING_Y_STER,
    CAST(l_partkey % 1000 AS VARCHAR) AS STRING_Y_UE,
    CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS Y_GIORNO_SETTIMANA,
    CAST(month(l_shipdate) AS INTEGER) AS Y_MESE_ANNO,
    CAST(1 + l_linenumber % 4 AS INTEGER) AS Y_FASCIA_ORARIA,
    CAST((date_diff('day', o_orderdate, l_shipdate) % 90 + 90) % 90 AS INTEGER) AS Y_GIORNI_ALLA_PRENOTAZIONE,
    CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) || '#1'), 1, 8) AS BIGINT)
      % 10000 AS SPLIT_BUCKET,
    CAST(c_nationkey AS INTEGER) AS CLUSTER
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

_CODES = " ".join(f"WHEN Y_GIORNI_ALLA_PRENOTAZIONE < {b} THEN {n}" for n, b in enumerate(DAY_BOUNDS))
DAY_CODE = f"CAST(CASE {_CODES} ELSE {len(DAY_BOUNDS)} END AS INTEGER)"

BOOKINGS = f"{RAW},\nb AS (SELECT * REPLACE ({DAY_CODE} AS Y_GIORNI_ALLA_PRENOTAZIONE) FROM raw)"
TRAIN = "SPLIT_BUCKET < 9000"
TEST = "SPLIT_BUCKET >= 9000"


def _cells(columns, source, keep="", where="TRUE", name="col"):
    keep = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS {name}, CAST({c} AS VARCHAR) AS val FROM {source} WHERE {where}" for c in columns
    )


def _ranking(base, rows, train, choices=CHOICES, names=CHOICES):
    """`base` and the tables frequency, ranking and totals over the `train` rows of the table `rows`."""
    cells = _cells(choices, rows, "CLUSTER AS cluster", train, "ycol")
    for choice, name in zip(choices, names):
        cells = cells.replace(f"'{choice}' AS ycol", f"'{name}' AS ycol")
    return f"""{base},
cells AS ({cells}),
frequency AS (SELECT cluster, ycol, val, CAST(count(*) AS BIGINT) AS occur FROM cells GROUP BY ALL),
ranking AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY cluster, ycol ORDER BY occur DESC) AS INTEGER) AS pos FROM frequency
),
filled AS (
  SELECT cluster, ycol, max(pos) AS last, CAST(sum(occur) AS BIGINT) AS tot_values, CAST(count(*) AS BIGINT) AS tot_distinct
  FROM ranking GROUP BY ALL
),
grid AS (
  SELECT CAST(c.range AS INTEGER) AS cluster, y.ycol
  FROM range(30) c, (SELECT unnest({list(names)}) AS ycol) y
),
totals AS (
  SELECT grid.cluster, grid.ycol, last, coalesce(tot_values, 0) AS tot_values, coalesce(tot_distinct, 0) AS tot_distinct
  FROM grid LEFT JOIN filled USING (cluster, ycol)
)"""


def _accuracy(ranking, rows, test, choices=CHOICES, names=CHOICES):
    """`ranking` and the tables long (a row per test row and choice), mean and hist."""
    cells = _cells(choices, "held_out", "rid, BOOKING_ID, CLUSTER AS cluster", name="ycol")
    for choice, name in zip(choices, names):
        cells = cells.replace(f"'{choice}' AS ycol", f"'{name}' AS ycol")
    return f"""{ranking},
held_out AS (SELECT *, row_number() OVER () AS rid FROM {rows} WHERE {test}),
test AS ({cells}),
long AS (
  SELECT rid, BOOKING_ID, t.cluster, t.ycol, t.val, CAST(pos - 1 AS INTEGER) AS pos, last AS last_pos,
    coalesce(CAST(last - (pos - 1) AS DOUBLE) / CAST(last AS DOUBLE), 0.0) AS acc
  FROM test t LEFT JOIN ranking USING (cluster, ycol, val) LEFT JOIN totals USING (cluster, ycol)
),
mean AS (
  SELECT rid, sum(acc) AS tot_acc, sum(acc) / {len(choices)} AS mean_acc FROM long GROUP BY rid
),
hist AS (
  SELECT ycol, coalesce(pos, last_pos) AS position FROM long WHERE coalesce(pos, last_pos) IS NOT NULL
)"""


FREQUENCY = RANKING = _ranking(BOOKINGS, "b", TRAIN)
# One cluster is left out of the train rows here: its test rows have no ranking.
ACCURACY = _accuracy(_ranking(BOOKINGS, "b", f"{TRAIN} AND CLUSTER <> 24"), "b", TEST)

def _distribution(value):
    quantiles = ", ".join(f"round(quantile_cont({value}, {p / 100}), 6) AS p{p}" for p in range(0, 100, 10))
    return (
        f"CAST(count(*) AS BIGINT) AS n_clusters, round(avg({value}), 6) AS mean, min({value}) AS min, max({value}) AS max, "
        f"round(median({value}), 6) AS median, {quantiles}"
    )


def _wide(columns):
    return ", ".join(
        f"max(CASE WHEN ycol = '{c}' THEN {old} END) AS {new}_{c}"
        for c in columns
        for old, new in (("pos", "POS"), ("last_pos", "LAST_POS"), ("round(acc, 6)", "ACC"))
    )


INDEX = f"""{BOOKINGS},
cells AS ({_cells([raw for raw, _ in ROLES.string_pairs()], "b", "BOOKING_ID")}),
counted AS (SELECT substr(col, 8) AS col, val, CAST(count(*) AS BIGINT) AS cnt FROM cells GROUP BY ALL),
idx AS (SELECT col, val, CAST(row_number() OVER (PARTITION BY col ORDER BY cnt DESC, val) - 1 AS INTEGER) AS idx, cnt FROM counted)"""

ONE_HOT_RAW = [ROLES.raw_name(c) for c in ROLES.one_hot_features]

# Test rows as requests, some of them altered: an unknown value, a null, both, or an excepted column null.
REQUESTS = f"""{BOOKINGS},
requests AS (
  SELECT * REPLACE (
    CASE WHEN SPLIT_BUCKET % 7 = 0 THEN 'unknown-' || STRING_X_CAP ELSE STRING_X_CAP END AS STRING_X_CAP,
    CASE WHEN SPLIT_BUCKET % 5 = 0 THEN NULL ELSE X_SESSO END AS X_SESSO,
    CASE WHEN SPLIT_BUCKET % 11 = 0 THEN NULL ELSE X_ETA END AS X_ETA
  ), row_number() OVER () AS rid FROM b WHERE {TEST}
),
domain AS ({_cells(ROLES.validated, "b", where=TRAIN).replace("SELECT", "SELECT DISTINCT")}),
asked AS ({_cells(ROLES.validated, "requests", "rid, BOOKING_ID")}),
bad AS (SELECT rid, BOOKING_ID, col, val FROM asked a WHERE NOT EXISTS (SELECT 1 FROM domain d WHERE d.col = a.col AND d.val = a.val))"""

# The model of the separated bookings: its clusters are the districts, and with all components the PCA only rotates, so a
# distance is that of the one-hot features: squares of the age's difference and of the shares of the centre's values, where
# a row has one value of share p in every column: 1 - 2 p + sum of all shares' squares.
_NAMES = [c.removeprefix("STRING_") for c in CHOICES]
SEPARATED = f"""{RAW},
s AS (
  SELECT * REPLACE ({DAY_CODE} AS Y_GIORNI_ALLA_PRENOTAZIONE, CAST(X_ETA + 1000 * CAST(STRING_X_USL AS INTEGER) AS INTEGER) AS X_ETA,
    CAST(STRING_X_USL AS INTEGER) AS CLUSTER) FROM raw
)"""
_CENTERS = f"""
size AS (SELECT CLUSTER AS cluster, count(*)::DOUBLE AS n, avg(X_ETA) AS age FROM s WHERE {TRAIN} GROUP BY CLUSTER),
train_cells AS ({_cells(ONE_HOT_RAW, "s", "CLUSTER AS cluster", TRAIN)}),
share AS (SELECT cluster, col, val, count(*)::DOUBLE / any_value(n) AS p FROM train_cells JOIN size USING (cluster) GROUP BY cluster, col, val),
square AS (SELECT cluster, sum(p * p) AS pp FROM share GROUP BY cluster)"""


def _distances(rows):
    """d2 of every row (rid, CLUSTER, X_ETA and the one-hot columns) of a table to the centre of its cluster."""
    return f"""
row_cells AS ({_cells(ONE_HOT_RAW, rows, "rid, CLUSTER AS cluster")}),
row_share AS (SELECT rid, sum(coalesce(p, 0)) AS p FROM row_cells LEFT JOIN share USING (cluster, col, val) GROUP BY rid),
distance AS (
  SELECT rid, (X_ETA - age) * (X_ETA - age) + {len(ONE_HOT_RAW)}::DOUBLE + pp - 2 * p AS d2
  FROM {rows} JOIN row_share USING (rid) JOIN size ON size.cluster = {rows}.CLUSTER JOIN square ON square.cluster = {rows}.CLUSTER
)"""


# Test rows as requests: an unknown post code in some of them, no age in others.
_MODEL_REQUESTS = f"""
asked AS (
  SELECT * REPLACE (
    CASE WHEN SPLIT_BUCKET % 7 = 0 THEN 'nowhere' ELSE STRING_X_CAP END AS STRING_X_CAP,
    CASE WHEN SPLIT_BUCKET % 11 = 0 THEN NULL ELSE X_ETA END AS X_ETA
  ), CAST(STRING_X_PRESCRITTORE AS BIGINT) AS request_id, row_number() OVER () AS rid FROM s WHERE {TEST}
),
valid AS (SELECT * FROM asked WHERE SPLIT_BUCKET % 7 <> 0 AND SPLIT_BUCKET % 11 <> 0)"""
_SCORED = f"""{_accuracy(_ranking(f"{SEPARATED},{_CENTERS},{_MODEL_REQUESTS}", "s", TRAIN, CHOICES, _NAMES), "valid", "TRUE", CHOICES, _NAMES)
    .replace("held_out AS (SELECT *, row_number() OVER () AS rid FROM valid WHERE TRUE)", "held_out AS (SELECT * FROM valid)")},
{_distances("valid")},
batch AS (SELECT request_id, sum(sqrt(d2)) AS total, sum(d2) AS request_wssse FROM distance JOIN valid USING (rid) GROUP BY request_id),
measured AS (
  SELECT rid, request_id, BOOKING_ID AS row_id, CLUSTER AS prediction, sqrt(d2) AS d, tot_acc, mean_acc, (total - sqrt(d2)) / nullif(total, 0) AS left_over, request_wssse
  FROM valid JOIN distance USING (rid) JOIN mean USING (rid) JOIN batch USING (request_id)
)"""
_SCORED_ROWS = f"""WITH {_SCORED} SELECT m.request_id, m.row_id, any_value(m.prediction) AS prediction,
  {", ".join(f"max(CASE WHEN ycol = '{c}' THEN {old} END) AS {new}_{c}" for c in _NAMES
             for old, new in (("pos", "POS"), ("last_pos", "LAST_POS"), ("round(acc, 6)", "ACC"), ("round(acc * left_over, 6)", "ACC_NORM")))},
  round(any_value(m.tot_acc), 6) AS tot_acc, round(any_value(m.mean_acc), 6) AS mean_acc,
  round(any_value(m.mean_acc * left_over), 6) AS mean_acc_norm, round(any_value(d), 6) AS centerdistance,
  round(any_value(m.request_wssse), 4) AS request_wssse
  FROM measured m JOIN long USING (rid) GROUP BY rid, m.request_id, m.row_id"""
_MICRO = "CAST(round({} * 10000) AS BIGINT)"
_RESPONSES = f"""WITH {_SCORED},
counts AS (
  SELECT request_id, CAST(count(*) FILTER (SPLIT_BUCKET % 7 <> 0 AND SPLIT_BUCKET % 11 <> 0) AS BIGINT) AS n_valid,
    CAST(count(*) FILTER (SPLIT_BUCKET % 7 = 0) AS BIGINT) AS n_rejected,
    CAST(count(*) FILTER (SPLIT_BUCKET % 7 <> 0 AND SPLIT_BUCKET % 11 = 0) AS BIGINT) AS n_incomplete,
    string_agg(CASE WHEN SPLIT_BUCKET % 7 = 0 THEN BOOKING_ID || '=STRING_X_CAP:' || STRING_X_CAP END, ';' ORDER BY BOOKING_ID) AS rejected,
    string_agg(CASE WHEN SPLIT_BUCKET % 7 <> 0 AND SPLIT_BUCKET % 11 = 0 THEN BOOKING_ID END, ';' ORDER BY BOOKING_ID) AS incomplete
  FROM asked GROUP BY request_id
),
entries AS (
  SELECT request_id, any_value(request_wssse) AS request_wssse, string_agg(row_id || '=' || prediction || ':' || {_MICRO.format("mean_acc")} || ':'
      || {_MICRO.format("mean_acc * left_over")} || ':' || {_MICRO.format("d")}, ';' ORDER BY row_id) AS accuracies
  FROM measured GROUP BY request_id
)
SELECT request_id, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS parts, '1.0.0' AS version, 'OK' AS status, n_valid, n_rejected, n_incomplete,
  round(request_wssse, 4) AS request_wssse, coalesce(accuracies, '') AS accuracies, coalesce(rejected, '') AS rejected, coalesce(incomplete, '') AS incomplete
FROM counts LEFT JOIN entries USING (request_id)"""

# Vectors in ten groups far apart, in two halves farther apart.
_GROUPED = """
points AS (
  SELECT vec_id, label, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) + CASE WHEN i = label + 1 THEN 20.0::DOUBLE WHEN i = 21 AND label >= 5 THEN 200.0::DOUBLE ELSE 0.0::DOUBLE END) AS v,
    CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '#1'), 1, 8) AS BIGINT) % 10000 < 9000 AS in_train
  FROM embeddings
),
cells AS (SELECT vec_id, label, in_train, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM points)"""


def _group_cost(k, group):
    return f"""SELECT CAST({k} AS INTEGER) AS k, round(sum((x - c) * (x - c)) FILTER (in_train), 6) AS wssse_train,
      round(sum((x - c) * (x - c)) FILTER (NOT in_train), 6) AS wssse_test
      FROM cells JOIN (SELECT {group} AS g, i, avg(x) AS c FROM cells WHERE in_train GROUP BY ALL) m ON m.g = {group.replace("label", "cells.label")} AND m.i = cells.i"""


def _power_iteration(steps=12):
    """The first principal component of the vectors `cells`: covariance, then repeated products from a vector of ones."""
    out = """,
m AS (SELECT i, avg(x) AS m FROM cells GROUP BY i),
off AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM cells JOIN m USING (i)),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS c FROM off a JOIN off b USING (vec_id) GROUP BY ALL),
u0 AS (SELECT DISTINCT i, 1.0::DOUBLE AS u FROM cov)"""
    for n in range(steps):
        out += f""",
y{n} AS (SELECT cov.i, sum(c * u) AS y FROM cov JOIN u{n} ON u{n}.i = cov.j GROUP BY cov.i),
u{n + 1} AS MATERIALIZED (SELECT i, y / sqrt(sum(y * y) OVER ()) AS u, sqrt(sum(y * y) OVER ()) AS length FROM y{n})"""
    return out + f""",
first_component AS (SELECT i, u * sign(first(u) OVER (ORDER BY round(abs(u), 9) DESC, i)) AS u, length FROM u{steps})"""


def _lloyd_rounds(rounds):
    out = "c0 AS (SELECT CAST(vec_id AS INTEGER) AS cluster, v AS center FROM points WHERE vec_id < 10)"
    for n in range(rounds):
        out += f""",
a{n} AS MATERIALIZED (
  SELECT vec_id, v, cluster FROM points, c{n}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cluster) = 1
),
s{n} AS (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(l.center, c.center) AS center, coalesce(l.n, 0) AS n FROM c{n} c LEFT JOIN
    (SELECT cluster, list(x ORDER BY i) AS center, any_value(k.n) AS n FROM s{n} JOIN (SELECT cluster, count(*) AS n FROM a{n} GROUP BY cluster) k USING (cluster) GROUP BY cluster) l USING (cluster)
)"""
    return out


_VECTORS = """
points AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM points),
means AS (SELECT CAST(label AS INTEGER) AS cluster, i, avg(x) AS x FROM cells GROUP BY ALL),
centers AS (SELECT cluster, list(x ORDER BY i) AS center FROM means GROUP BY cluster),
pairs AS (
  SELECT vec_id, label, cluster, list_sum(list_transform(list_zip(v, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM points, centers
),
nearest AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) = 1
)"""

_PROJECTION = ", ".join(
    f"round(list_sum(list_transform(range(64), lambda j: v[j + 1] * ((j * 7 + {c} * 3) % 5 - 2))), 6) AS p{c}" for c in range(4)
)

SQL: dict[str, str] = {
    "bookings_clean": f"WITH {BOOKINGS} SELECT * FROM b",
    "csv_scan_dropmalformed": f"WITH {RAW} SELECT BOOKING_ID, {', '.join(COLUMNS)} FROM raw WHERE SPLIT_BUCKET % 10 > 2",
    "json_records": f"WITH {RAW} SELECT {', '.join(COLUMNS)} FROM raw WHERE SPLIT_BUCKET % 10 <> 0",
    "json_text_column": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "parquet_snapshot_roundtrip": f"WITH {RAW} SELECT * FROM raw",
    "quantize_days": f"""WITH {RAW} SELECT BOOKING_ID, Y_GIORNI_ALLA_PRENOTAZIONE AS days, {DAY_CODE} AS code FROM raw""",
    "hour_band": """SELECT event_id, CAST(CASE WHEN hour(ts) < 11 THEN 0 WHEN hour(ts) < 13 THEN 1 WHEN hour(ts) < 15 THEN 2
        ELSE 3 END AS INTEGER) AS band FROM events""",
    "drop_columns": f"""WITH {BOOKINGS} SELECT BOOKING_ID, SPLIT_BUCKET, CLUSTER,
        {', '.join(c for c in COLUMNS if c not in ROLES.dropped)} FROM b""",
    "value_domain": f"""WITH {BOOKINGS}, cells AS ({_cells(COLUMNS, "b")})
        SELECT col, val, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY ALL""",
    "validate_requests_valid": f"""WITH {REQUESTS}
        SELECT BOOKING_ID, {', '.join(COLUMNS)} FROM requests WHERE rid NOT IN (SELECT rid FROM bad)""",
    "validate_requests_rejected": f"""WITH {REQUESTS}
        SELECT BOOKING_ID, string_agg(col || '=' || coalesce(val, 'null'), ',' ORDER BY col) AS rejected_cols FROM bad
        GROUP BY rid, BOOKING_ID""",
    "string_index": f"WITH {INDEX} SELECT * FROM idx",
    "apply_string_index": f"""WITH {INDEX} SELECT BOOKING_ID,
        {", ".join(f"i_{name}.idx AS {name}" for _, name in ROLES.string_pairs())} FROM b
        {" ".join(f"JOIN idx i_{name} ON i_{name}.col = '{name}' AND i_{name}.val = b.{raw}" for raw, name in ROLES.string_pairs())}""",
    "index_report": f"WITH {INDEX} SELECT col, CAST(count(*) AS BIGINT) AS values FROM idx GROUP BY col",
    "one_hot_long": f"""WITH {BOOKINGS}, cells AS ({_cells(ONE_HOT_RAW, "b")}),
        counted AS (SELECT replace(col, 'STRING_', '') AS col, val, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY ALL)
        SELECT col, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, val) - 1 AS INTEGER) AS slot, n FROM counted""",
    "assembled_width": f"""WITH {BOOKINGS}, cells AS ({_cells(ONE_HOT_RAW, "b")})
        SELECT CAST(1 + count(DISTINCT col || '=' || val) AS INTEGER) AS tot_col FROM cells""",
    "assembled_features": f"""WITH {BOOKINGS} SELECT BOOKING_ID, CAST(X_ETA AS DOUBLE) AS numeric_part,
        CAST({len(ONE_HOT_RAW)} AS DOUBLE) AS one_hot_part FROM b""",
    "hash_split_counts": f"""WITH {RAW} SELECT CASE WHEN SPLIT_BUCKET < 9000 THEN 'train' ELSE 'test' END AS part,
        CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY ALL""",
    "choice_frequency": f"WITH {FREQUENCY} SELECT * FROM frequency",
    "choice_ranking": f"WITH {RANKING} SELECT * FROM ranking",
    "choice_top_n": f"WITH {RANKING} SELECT * FROM ranking WHERE pos <= 3",
    "ranking_totals": f"WITH {RANKING} SELECT * FROM totals",
    "cluster_size_distribution": f"WITH {RANKING} SELECT {_distribution('tot_values')} FROM totals WHERE ycol = 'STRING_Y_STER'",
    "cluster_distinct_distribution": f"WITH {RANKING} SELECT ycol, {_distribution('tot_distinct')} FROM totals GROUP BY ycol",
    "choice_accuracy_long": f"WITH {ACCURACY} SELECT BOOKING_ID, cluster, ycol, val, pos, last_pos, round(acc, 6) AS acc FROM long",
    "choice_accuracy_wide": f"""WITH {ACCURACY} SELECT l.BOOKING_ID, l.cluster, {_wide(CHOICES)},
        round(max(tot_acc), 6) AS tot_acc, round(max(mean_acc), 6) AS mean_acc
        FROM long l JOIN mean USING (rid) GROUP BY rid, l.BOOKING_ID, l.cluster""",
    "accuracy_by_choice": f"""WITH {ACCURACY} SELECT ycol, CAST(count(*) AS BIGINT) AS n,
        CAST(count(*) FILTER (pos IS NULL) AS BIGINT) AS n_unranked, round(avg(acc), 6) AS mean_acc, round(max(acc), 6) AS max_acc,
        round(min(acc), 6) AS min_acc FROM long GROUP BY ycol""",
    "accuracy_overall": f"""WITH {ACCURACY} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(mean_acc), 6) AS mean_acc,
        round(max(mean_acc), 6) AS max_acc, round(min(mean_acc), 6) AS min_acc FROM mean""",
    "position_stats": f"""WITH {ACCURACY} SELECT ycol, CAST(count(*) AS BIGINT) AS count_position, round(avg(position), 6) AS mean_pos,
        min(position) AS min_pos, max(position) AS max_pos, CAST(median(position) AS DOUBLE) AS median_pos FROM hist GROUP BY ycol""",
    "cmc_curve": f"""WITH {ACCURACY} SELECT ycol, CAST(i.range AS INTEGER) AS i,
        CAST(count(*) FILTER (position <= i.range) AS BIGINT) AS n_within, CAST(count(*) AS BIGINT) AS n,
        round(CAST(count(*) FILTER (position <= i.range) AS DOUBLE) / count(*), 6) AS share
        FROM hist, range(10) i GROUP BY ycol, i.range""",
    "center_table": f"WITH {_VECTORS} SELECT cluster, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM means",
    "nearest_center": f"WITH {_VECTORS} SELECT vec_id, cluster, round(d2, 6) AS d2, round(sqrt(d2), 6) AS distance FROM nearest",
    "center_distance": f"""WITH {_VECTORS} SELECT vec_id, round(sqrt(d2), 6) AS centerdistance FROM pairs WHERE label = cluster""",
    "wssse": f"""WITH {_VECTORS} SELECT CASE WHEN vec_id % 10 < 9 THEN 'train' ELSE 'test' END AS part,
        CAST(count(*) AS BIGINT) AS n, round(sum(d2), 6) AS wssse FROM nearest GROUP BY ALL""",
    "fixed_projection": f"WITH {_VECTORS} SELECT vec_id, {_PROJECTION} FROM points",
    "score_normalized": f"""WITH {_VECTORS},
        counted AS (SELECT cluster, label, count(*) AS occur FROM nearest GROUP BY ALL),
        ranking AS (SELECT *, dense_rank() OVER (PARTITION BY cluster ORDER BY occur DESC) AS pos FROM counted),
        lasts AS (SELECT cluster, max(pos) AS last FROM ranking GROUP BY cluster),
        scored AS (
          SELECT vec_id, vec_id // 5 AS request_id, sqrt(d2) AS d, d2, CAST(last - (pos - 1) AS DOUBLE) / last AS acc
          FROM nearest JOIN ranking USING (cluster, label) JOIN lasts USING (cluster)
        ),
        batch AS (SELECT request_id, sum(d) AS total, sum(d2) AS request_wssse FROM scored GROUP BY request_id)
        SELECT vec_id, request_id, round(d, 6) AS centerdistance, round(acc, 6) AS acc,
          round(acc * (total - d) / nullif(total, 0), 6) AS acc_norm, round(request_wssse, 6) AS request_wssse
        FROM scored JOIN batch USING (request_id)""",
    "staged_run": f"""WITH {_accuracy(_ranking(SEPARATED, "s", TRAIN, CHOICES, _NAMES), "s", TEST, CHOICES, _NAMES)}
        SELECT ycol, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (pos IS NULL) AS BIGINT) AS n_unranked,
          round(avg(acc), 6) AS mean_acc, round(max(acc), 6) AS max_acc, round(min(acc), 6) AS min_acc FROM long GROUP BY ycol""",
    "model_info": f"""WITH {SEPARATED}, {_CENTERS}, trained AS (SELECT *, row_number() OVER () AS rid FROM s WHERE {TRAIN}), {_distances("trained")},
        width AS (SELECT 1 + count(*) AS w FROM (SELECT DISTINCT col, val FROM ({_cells(ONE_HOT_RAW, "s")})))
        SELECT CAST(5 AS BIGINT) AS num_custer, CAST(5 AS BIGINT) AS centers, CAST(w AS BIGINT) AS tot_col, CAST(w AS BIGINT) AS k_pca,
          round(sum(d2), 3) AS wssse_train FROM distance, width GROUP BY w""",
    "score_requests": _SCORED_ROWS,
    "score_requests_stream": _SCORED_ROWS,
    "score_responses": _RESPONSES,
    "kmeans_fit_assign": f"""WITH {_GROUPED}, means AS (SELECT label, i, avg(x) AS c FROM cells GROUP BY ALL),
        named AS (SELECT label, CAST(row_number() OVER (ORDER BY list(round(c, 9) ORDER BY i)) - 1 AS INTEGER) AS prediction FROM means GROUP BY label)
        SELECT vec_id, prediction FROM points JOIN named USING (label)""",
    "kmeans_sweep": f"WITH {_GROUPED} {_group_cost(2, 'label // 5')} UNION ALL {_group_cost(10, 'label')}",
    "kmeans_rounds": f"""WITH points AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {_lloyd_rounds(3)}
        SELECT cluster, CAST(n AS BIGINT) AS n, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x
        FROM (SELECT cluster, n, unnest(center) AS x, generate_subscripts(center, 1) AS i FROM c3)""",
    "nearest_center_in_cells": f"WITH {_VECTORS} SELECT vec_id, cluster, round(d2, 6) AS d2 FROM nearest",
    "pca_leading_projection": f"""WITH {_GROUPED}{_power_iteration()}, trace AS (SELECT sum(c) AS t FROM cov WHERE i = j)
        SELECT vec_id, round(sum(x * u), 6) AS p0, round(any_value(length) / any_value(t), 6) AS share FROM cells JOIN first_component USING (i), trace GROUP BY vec_id""",
    "pca_full_norms": f"WITH {_VECTORS} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2 FROM points",
    "staged_run_totals": f"""WITH {RAW}, counts AS (
          SELECT CAST(count(*) FILTER (SPLIT_BUCKET < 9000) AS BIGINT) AS n_train,
            CAST(count(*) FILTER (SPLIT_BUCKET >= 9000) AS BIGINT) AS n_test FROM raw
        ) SELECT unnest({list(ROLES.y)}) AS ycol, n_train, n_test FROM counts""",
    "scored_request_counts": f"""WITH {RAW} SELECT CLUSTER AS request_id,
        CAST(count(*) FILTER (SPLIT_BUCKET % 4 <> 0) AS BIGINT) AS n_scored,
        CAST(count(*) FILTER (SPLIT_BUCKET % 4 = 0) AS BIGINT) AS n_rejected FROM raw WHERE {TEST} GROUP BY CLUSTER""",
}
