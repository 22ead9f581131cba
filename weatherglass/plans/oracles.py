"""SQL for the catalog's queries, for an independent engine: common tables, and one SELECT a query."""

from __future__ import annotations

import re

CHANNELS = ("temperature_c", "pressure_hpa", "humidity_pct")


def _by(t, p, h) -> str:
    return f"CASE channel WHEN 'temperature_c' THEN {t} WHEN 'pressure_hpa' THEN {p} ELSE {h} END"


RATE, CAP, MIN_STD = _by("1.0::DOUBLE", "0.5::DOUBLE", "5.0::DOUBLE"), _by("10.0::DOUBLE", "10.0::DOUBLE", "40.0::DOUBLE"), _by("0.1::DOUBLE", "0.1::DOUBLE", "1.0::DOUBLE")
ALLOWED = f"least({RATE} * dt1, {CAP})"
ALLOWED2 = f"least({RATE} * dt2, {CAP})"
PLACE = _by(1, 2, 3)



def _factors() -> str:
    """The factors of a symmetric 6 x 6 matrix a = L D L': l<i><j> and d<j>, each from those before it."""
    out = []
    for j in range(6):
        out.append(" - ".join([f"a{j}{j}", *(f"l{j}{k} * l{j}{k} * d{k}" for k in range(j))]) + f" AS d{j}")
        for i in range(j + 1, 6):
            out.append("(" + " - ".join([f"a{i}{j}", *(f"l{i}{k} * l{j}{k} * d{k}" for k in range(j))]) + f") / d{j} AS l{i}{j}")
    return ", ".join(out)


#: The forest of operators.forest in SQL: its constants, draws and depth.
PRIME, TREES, SUBSAMPLE, DEPTH, SEED = 2147483647, 100, 256, 8, 42


def _mixed(h: str, x: str) -> str:
    y = f"((({h}) * 48271 + (CAST({x} AS BIGINT) % {PRIME} + {PRIME}) % {PRIME} + 11) % {PRIME})"
    return f"(({y} * {y} + ({h})) % {PRIME})"


def _average_depth(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _forest() -> str:
    """Trees level by level: members of each node, its split (feature f, cut; none at a leaf), and its children's members; then
    the walk of all usable rows."""
    x = ", ".join(f"x{i}" for i in range(8))
    out = [f"""forest_pool AS MATERIALIZED (
  SELECT station_id, seq, {x} FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY {_mixed(_mixed(f'{SEED}::BIGINT', 'seq'), '1')}, seq) AS k FROM forest_rows) WHERE k <= {16 * SUBSAMPLE}
), forest_sizes AS MATERIALIZED (
  SELECT station_id, least({SUBSAMPLE}, count(*)) AS rows_, CAST(ceil(log2(greatest(least({SUBSAMPLE}, count(*)), 2))) AS INTEGER) AS depth_ FROM forest_pool GROUP BY ALL
), forest_trees AS MATERIALIZED (
  SELECT t::BIGINT AS tree, {_mixed(f'{SEED}::BIGINT', 't::BIGINT')} AS h FROM range({TREES}) r(t)
), forest_m0 AS MATERIALIZED (
  SELECT station_id, tree, h, depth_, 1::BIGINT AS node, {x} FROM (SELECT p.*, depth_, tree, h, row_number() OVER (PARTITION BY p.station_id, tree ORDER BY {_mixed('h', 'seq')}, seq) AS k FROM forest_pool p JOIN forest_sizes z ON z.station_id = p.station_id, forest_trees) WHERE k <= {SUBSAMPLE}
)"""]
    for level in range(DEPTH + 1):
        open_ = "[" + ", ".join(f"CASE WHEN high[{i + 1}] - low[{i + 1}] > 1e-9 THEN {i + 1} END" for i in range(8)) + "]"
        leaf = f"{level} >= depth_ OR len(open_) = 0"
        out.append(f"""forest_s{level} AS MATERIALIZED (
  SELECT station_id, tree, node, f, CASE WHEN f IS NULL THEN {level * 1_000_000} + CAST(round_even(1000000 * ({_average_depth('n')}), 0) AS BIGINT) END AS length,
    low[f] + {_mixed('g', '2')}::DOUBLE / {PRIME} * (high[f] - low[f]) AS cut FROM (
    SELECT *, CASE WHEN {leaf} THEN NULL ELSE open_[1 + ({_mixed('g', '1')}) % len(open_)] END AS f FROM (
      SELECT *, {_mixed('h', 'node')} AS g, list_filter({open_}, lambda v: v IS NOT NULL) AS open_ FROM (
        SELECT station_id, tree, h, depth_, node, count(*) AS n, [{', '.join(f'min(x{i})' for i in range(8))}] AS low, [{', '.join(f'max(x{i})' for i in range(8))}] AS high FROM forest_m{level} GROUP BY ALL)))
)""")
        if level < DEPTH:
            out.append(f"""forest_m{level + 1} AS MATERIALIZED (
  SELECT m.station_id, m.tree, h, depth_, 2 * m.node + CASE WHEN [{', '.join(f'x{i}' for i in range(8))}][f] > cut THEN 1 ELSE 0 END AS node, {x} FROM forest_m{level} m JOIN forest_s{level} s ON s.station_id = m.station_id AND s.tree = m.tree AND s.node = m.node WHERE f IS NOT NULL
)""")
    out.append("forest_nodes AS MATERIALIZED (\n  " + " UNION ALL ".join(f"SELECT * FROM forest_s{level}" for level in range(DEPTH + 1)) + "\n)")
    out.append("""forest_w0 AS MATERIALIZED (
  SELECT r.station_id, r.seq, t.tree, 1::BIGINT AS node, [x0, x1, x2, x3, x4, x5, x6, x7] AS x FROM forest_rows r, forest_trees t
)""")
    for level in range(DEPTH):
        out.append(f"""forest_w{level + 1} AS MATERIALIZED (
  SELECT w.station_id, w.seq, w.tree, CASE WHEN f IS NULL THEN w.node WHEN x[f] > cut THEN 2 * w.node + 1 ELSE 2 * w.node END AS node, x FROM forest_w{level} w JOIN forest_nodes s ON s.station_id = w.station_id AND s.tree = w.tree AND s.node = w.node
)""")
    out.append(f"""forest_totals AS MATERIALIZED (
  SELECT w.station_id, w.seq, CAST(sum(s.length) AS BIGINT) AS total FROM forest_w{DEPTH} w JOIN forest_nodes s ON s.station_id = w.station_id AND s.tree = w.tree AND s.node = w.node GROUP BY ALL
)""")
    return ", ".join(out) + f""", forest_limit AS MATERIALIZED (
  SELECT station_id, quantile_disc(total, 0.005) AS least FROM forest_totals GROUP BY station_id
), rare_ AS (
  SELECT t.station_id, t.seq, total < least AS rare, -pow(2, -(total::DOUBLE / 1000000 / {TREES}) / ({_average_depth('rows_')})) AS score, -pow(2, -(least::DOUBLE / 1000000 / {TREES}) / ({_average_depth('rows_')})) AS threshold
  FROM forest_totals t JOIN forest_limit l ON l.station_id = t.station_id JOIN forest_sizes z ON z.station_id = t.station_id"""


def _solved() -> str:
    """r = a^-1 q by substitution forwards (y) and backwards (r)."""
    out = [" - ".join([f"q{i}", *(f"l{i}{k} * y{k}" for k in range(i))]) + f" AS y{i}" for i in range(6)]
    return ", ".join(out + [" - ".join([f"y{i} / d{i}", *(f"l{k}{i} * r{k}" for k in range(i + 1, 6))]) + f" AS r{i}" for i in range(5, -1, -1)])


TABLES = f"""
WITH RECURSIVE base_ AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), readings AS (
  SELECT 'S' || CAST(user_id % 10 AS VARCHAR) AS station_id, event_id AS seq, ts, epoch_us(ts) AS us,
    CASE WHEN event_type = 'error' AND k < 10 THEN NULL ELSE round_even(value / 8 - 5, 0) END AS temperature_c,
    round_even(990 + k / 4, 0)::DOUBLE AS pressure_hpa,
    CASE WHEN event_type = 'signup' AND k < 5 THEN NULL ELSE (50 + k % 60)::DOUBLE END AS humidity_pct,
    CASE WHEN event_type = 'error' AND k >= 95 THEN 2 WHEN event_type = 'error' AND k >= 90 THEN 1 ELSE 0 END AS qc_flag
  FROM base_
), stations AS (
  SELECT 'S' || CAST(i AS VARCHAR) AS station_id, 10 + 1.5::DOUBLE * i AS lat, 70 + (i * 7) % 10 * 0.8::DOUBLE AS lon, 'Z' || CAST(i % 3 AS VARCHAR) AS climate_zone, 30.0::DOUBLE AS cadence_minutes FROM range(10) r(i)
), instants AS (
  -- One reading whenever three hours of data time have gone by since the last one, or time has gone back behind it.
  SELECT station_id, min(seq) AS seq, arg_min(us, seq) AS us FROM readings GROUP BY station_id
  UNION ALL
  SELECT i.station_id, min(r.seq), arg_min(r.us, r.seq) FROM instants i JOIN readings r ON r.station_id = i.station_id AND r.seq > i.seq AND (r.us >= i.us + 10800000000 OR r.us < i.us) GROUP BY i.station_id
), long_ AS (
  SELECT station_id, seq, ts, us, 'temperature_c' AS channel, temperature_c AS value, temperature_c AS t, humidity_pct AS h FROM readings
  UNION ALL SELECT station_id, seq, ts, us, 'pressure_hpa', pressure_hpa, temperature_c, humidity_pct FROM readings
  UNION ALL SELECT station_id, seq, ts, us, 'humidity_pct', humidity_pct, temperature_c, humidity_pct FROM readings
), cells AS (
  SELECT station_id, month(ts)::INTEGER AS month, hour(ts)::INTEGER AS hour, channel, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n
  FROM long_ WHERE value IS NOT NULL GROUP BY ALL HAVING count(value) >= 10
), joined AS (
  SELECT l.*, c.mean AS e, greatest(c.std, {MIN_STD.replace('channel', 'l.channel')}) AS s FROM long_ l
  LEFT JOIN cells c ON c.station_id = l.station_id AND c.channel = l.channel AND c.month = month(l.ts) AND c.hour = hour(l.ts)
), corners AS (
  SELECT l.station_id, l.seq, l.channel, l.ts, l.value, (day(l.ts) - 0.5::DOUBLE + hour(l.ts) / 24.0::DOUBLE) / day(last_day(l.ts)) AS pos, minute(l.ts) / 60.0::DOUBLE AS wh, month(l.ts) AS m, hour(l.ts) AS h FROM long_ l
), weighted AS (
  SELECT station_id, seq, channel, (CASE WHEN b.late THEN CASE WHEN pos >= 0.5 THEN m % 12 + 1 ELSE m END ELSE CASE WHEN pos >= 0.5 THEN m ELSE (m + 10) % 12 + 1 END END) AS month,
    (CASE WHEN d.next THEN (h + 1) % 24 ELSE h END) AS hour,
    (CASE WHEN b.late THEN CASE WHEN pos >= 0.5 THEN pos - 0.5 ELSE pos + 0.5 END ELSE 1 - CASE WHEN pos >= 0.5 THEN pos - 0.5 ELSE pos + 0.5 END END) * (CASE WHEN d.next THEN wh ELSE 1 - wh END) AS w
  FROM corners, (VALUES (FALSE), (TRUE)) b(late), (VALUES (FALSE), (TRUE)) d(next)
), smooth AS (
  SELECT w.station_id, w.seq, w.channel, sum(w.w * c.mean) / nullif(sum(w.w), 0) AS smooth FROM weighted w JOIN cells c ON c.station_id = w.station_id AND c.channel = w.channel AND c.month = w.month AND c.hour = w.hour GROUP BY ALL
), feat_ AS (
  SELECT *, CASE WHEN e IS NULL THEN NULL ELSE s END AS sg, (value - e) / s AS z,
    lag(value) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(e) OVER w AS e1, lag(us) OVER w AS us1, lag(us, 2) OVER w AS us2, row_number() OVER w AS place
  FROM joined WINDOW w AS (PARTITION BY station_id, channel ORDER BY seq)
), feat AS (
  SELECT *, (us - us1) / 6e7 AS dt1, (us1 - us2) / 6e7 AS dt2 FROM feat_
), runs_ AS (
  SELECT *, sum(fresh) OVER (PARTITION BY station_id, channel ORDER BY seq) AS run FROM (
    SELECT *, CASE WHEN value IS NULL OR v1 IS NULL OR value <> v1 OR dt1 > 90 THEN 1 ELSE 0 END AS fresh FROM feat)
), runs AS (
  SELECT station_id, channel, min(us) AS start_us, count(*) AS n, (max(us) - min(us)) / 6e7 AS minutes FROM runs_ WHERE value IS NOT NULL GROUP BY station_id, channel, run HAVING count(*) >= 2
), jitter_ AS (
  SELECT *, list_transform(window_, lambda x: x.v) AS vals FROM (
    SELECT *, list({{'v': value}}) OVER (PARTITION BY station_id, channel ORDER BY us RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW) AS window_ FROM feat)
), jitter AS (
  SELECT station_id, channel, seq, sqrt(list_sum(list_transform(range(1, len(vals) - 1), lambda i: pow(vals[i + 2] - 2 * vals[i + 1] + vals[i], 2))) / (len(vals) - 2) / 6.0) AS jitter
  FROM jitter_ WHERE len(vals) >= 7 AND len(list_filter(vals, lambda v: v IS NULL)) = 0
), steps AS (
  SELECT station_id, channel, dt1 AS dt, abs(value - v1) AS change FROM feat WHERE dt1 > 0 AND dt1 <= 90 AND value IS NOT NULL AND v1 IS NOT NULL
), resolution AS (
  SELECT station_id, channel, CASE WHEN count(*) < 50 THEN NULL WHEN avg(CAST(abs(value - round_even(value, 0)) < 1e-6 AS INTEGER)) > 0.98 THEN 1.0::DOUBLE
    WHEN avg(CAST(abs(value / 0.5 - round_even(value / 0.5, 0)) < 1e-6 AS INTEGER)) > 0.98 THEN 0.5::DOUBLE WHEN avg(CAST(abs(value / 0.1 - round_even(value / 0.1, 0)) < 1e-6 AS INTEGER)) > 0.98 THEN 0.1::DOUBLE END AS resolution
  FROM long_ WHERE value IS NOT NULL GROUP BY ALL
), limits AS (
  SELECT r.station_id, 30.0::DOUBLE AS cadence_minutes, r.channel, r.resolution, a.frozen_minutes, b.noise_std, c.typical_step, c.step_cap, coalesce(a.n_runs, 0) AS n_runs FROM resolution r
  LEFT JOIN (SELECT station_id, channel, count(*) AS n_runs, CASE WHEN count(*) >= 30 THEN quantile_cont(minutes, 0.999) END AS frozen_minutes FROM runs GROUP BY ALL) a USING (station_id, channel)
  LEFT JOIN (SELECT station_id, channel, CASE WHEN count(*) >= 200 THEN quantile_cont(jitter, 0.999) * 1.1 END AS noise_std FROM jitter GROUP BY ALL) b USING (station_id, channel)
  LEFT JOIN (SELECT station_id, channel, CASE WHEN count(CASE WHEN dt <= 45 THEN 1 END) >= 200 THEN quantile_cont(CASE WHEN dt <= 45 THEN change END, 0.75) END AS typical_step,
                    CASE WHEN count(*) >= 500 THEN quantile_cont(change, 0.999) * 1.1 END AS step_cap FROM steps GROUP BY ALL) c USING (station_id, channel)
), history_rows AS (
  -- Rows of history: the longest configured window (360 minutes), or twice the longest learned frozen window, at 30 minutes, and 9.
  SELECT station_id, CAST(ceil(greatest(360, 2 * coalesce(max(frozen_minutes), 0)) / 30.0) AS INTEGER) + 9 AS rows_, CAST(ceil(greatest(1440, 2 * coalesce(max(frozen_minutes), 0)) / 30.0) AS INTEGER) + 9 AS clock_rows FROM limits GROUP BY station_id
), held AS (
  SELECT f.*, list({{'us': us, 'v': value, 'e': e, 's': s, 't': t, 'h': h}}) OVER (PARTITION BY station_id, channel ORDER BY seq ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)[-rows_:] AS hist
  FROM feat f JOIN history_rows USING (station_id)
), both_ AS (
  SELECT f.*, l.frozen_minutes, l.noise_std, l.typical_step, greatest({_by(60.0, 180.0, 120.0).replace('channel', 'f.channel')}, 60.0, coalesce(l.frozen_minutes, 0))::DOUBLE AS frozen_window,
    CASE WHEN f.e IS NOT NULL AND f.e1 IS NOT NULL AND abs(f.value - f.v1 - (f.e - f.e1)) < abs(f.value - f.v1) THEN f.value - f.v1 - (f.e - f.e1) ELSE f.value - f.v1 END AS judged_step
  FROM held f LEFT JOIN limits l USING (station_id, channel)
), lists_ AS (
  SELECT *, list_filter(hist, lambda x: x.us >= us - frozen_window * 6e7) AS frozen_rows, list_filter(hist, lambda x: x.us >= us - 180 * 6e7) AS noise_rows,
    list_transform(list_filter(hist, lambda x: x.us >= us - 360 * 6e7 AND x.v IS NOT NULL AND x.e IS NOT NULL), lambda x: greatest(-4.0, least(4.0, (x.v - x.e) / x.s))) AS zs
  FROM both_
), measured AS (
  SELECT *, list_max(list_transform(frozen_rows, lambda x: x.v)) - list_min(list_transform(frozen_rows, lambda x: x.v)) AS spread,
    (us - hist[1].us) / 6e7 AS span,
    CASE WHEN value IS NULL THEN 0 ELSE (us - hist[coalesce(list_max(list_filter(range(1, len(hist)), lambda i: coalesce(hist[i].v <> value, TRUE) OR hist[i + 1].us - hist[i].us > 90 * 6e7)), 0) + 1].us) / 6e7 END AS run_minutes,
    CASE WHEN len(noise_rows) >= 7 AND len(list_filter(noise_rows, lambda x: x.v IS NULL)) = 0 THEN
      sqrt(list_sum(list_transform(range(1, len(noise_rows) - 1), lambda i: pow(noise_rows[i + 2].v - 2 * noise_rows[i + 1].v + noise_rows[i].v, 2))) / (len(noise_rows) - 2) / 6.0) END AS jitter,
    CASE WHEN len(zs) > 0 THEN greatest(0,
      list_max(flatten(list_transform(range(1, len(zs) + 1), lambda i: list_transform(range(i, len(zs) + 1), lambda j: list_sum(list_transform(zs[i:j], lambda v: (v - 1.5) * 2)))))),
      list_max(flatten(list_transform(range(1, len(zs) + 1), lambda i: list_transform(range(i, len(zs) + 1), lambda j: list_sum(list_transform(zs[i:j], lambda v: (-v - 1.5) * 2))))))) END AS peak
  FROM lists_
), flags_ AS (
  SELECT *,
    coalesce(value NOT BETWEEN {_by(-90.0, 300.0, 0.0)} AND {_by(60.0, 1100.0, 100.0)}, FALSE) AS range_flag,
    coalesce(span >= frozen_window AND len(frozen_rows) >= 3 AND len(list_filter(frozen_rows, lambda x: x.v IS NULL)) = 0 AND spread <= 0, FALSE) AS frozen_flag,
    (coalesce(frozen_minutes, 0) = 0 OR run_minutes >= 2 * frozen_window)
      AND NOT (channel <> 'pressure_hpa' AND len(list_filter(frozen_rows, lambda x: NOT coalesce(x.h >= 99.5, FALSE))) = 0) AS frozen_hard,
    coalesce(dt1 > 0 AND dt1 <= 90 AND abs(judged_step) > {ALLOWED}, FALSE) AS step_flag,
    coalesce(dt1 > 0 AND dt1 <= 90 AND abs(value - v1) > {ALLOWED}, FALSE) AS plain_step,
    coalesce(dt1 > 0 AND dt2 > 0 AND dt1 <= 90 AND dt2 <= 90 AND abs(v1 - v2) > {ALLOWED2} AND abs(value - v1) > {ALLOWED} AND (v1 - v2) * (value - v1) < 0
      AND abs(value - v2) <= least({RATE} * (dt1 + dt2), {CAP}), FALSE) AS spike_flag,
    coalesce(jitter > greatest({_by(0.5, 0.5, 3.0)}, coalesce(noise_std, 0)), FALSE) AS noise_flag,
    coalesce(peak >= 40, FALSE) AS drift_flag,
    coalesce(abs(z) > 4, FALSE) AS normality_flag,
    NOT coalesce(dt1 > 0 AND abs(value - v1) > CASE WHEN typical_step IS NOT NULL AND dt1 <= 45 THEN least(0.5 * {ALLOWED}, 1.5 * typical_step) ELSE 0.5 * {ALLOWED} END, FALSE)
      AND NOT coalesce(dt2 > 0 AND abs(v1 - v2) > CASE WHEN typical_step IS NOT NULL AND dt2 <= 45 THEN least(0.5 * {ALLOWED2}, 1.5 * typical_step) ELSE 0.5 * {ALLOWED2} END, FALSE) AS quiet,
    list_filter(hist[1:len(hist) - 1], lambda x: x.us <= us - 60 * 6e7)[-1].v AS before_v
  FROM measured
), marked AS (
  SELECT *, CASE WHEN abs(value - before_v) < {_by(1.0, 1.0, 5.0)} THEN 0 WHEN value - before_v > 0 THEN 1 WHEN value - before_v < 0 THEN -1 ELSE 0 END AS move FROM flags_
), wide_ AS (
  SELECT f.station_id, f.seq, max(dt1) AS dt1, {", ".join(f"max(CASE WHEN f.channel = '{c}' THEN value END) AS {c}, max(CASE WHEN f.channel = '{c}' THEN v1 END) AS {c}_1, max(CASE WHEN f.channel = '{c}' THEN smooth END) AS m_{c}" for c in CHANNELS)}
  FROM feat f LEFT JOIN smooth s USING (station_id, seq, channel) GROUP BY f.station_id, f.seq
), used AS (
  SELECT station_id, seq, {", ".join(f"{c} - m_{c} AS x{k}, ({c} - {c}_1) / dt1 AS x{k + 3}" for k, c in enumerate(CHANNELS))} FROM wide_
  WHERE dt1 > 0 AND {" AND ".join(f"{c} IS NOT NULL AND {c}_1 IS NOT NULL AND m_{c} IS NOT NULL" for c in CHANNELS)}
), spread_ AS (
  SELECT station_id, {", ".join(f"avg(x{i}) AS m{i}" for i in range(6))}, {", ".join(f"covar_samp(x{i}, x{j}){' + 1e-6' * (i == j)} AS a{i}{j}" for i in range(6) for j in range(i + 1))}
  FROM used GROUP BY station_id HAVING count(*) >= 50
), factors AS (
  SELECT station_id, {", ".join(f"m{i}" for i in range(6))}, {_factors()} FROM spread_
), solved AS (
  SELECT station_id, seq, {", ".join(f"x{i} - m{i} AS q{i}" for i in range(6))}, {_solved()} FROM used JOIN factors USING (station_id)
), distance AS (
  SELECT station_id, seq, {" + ".join(f"q{i} * r{i}" for i in range(6))} AS d2, [{", ".join(f"q{i} * r{i}" for i in range(6))}] AS parts FROM solved
), far_limit AS (
  SELECT station_id, quantile_cont(d2, 0.995) AS threshold FROM distance GROUP BY station_id
), far_ AS (
  SELECT d.*, threshold, d2 > threshold AS far FROM distance d JOIN far_limit USING (station_id)
), forest_rows AS (
  SELECT w.station_id, w.seq, w.temperature_c AS x0, w.pressure_hpa AS x1, w.humidity_pct AS x2, {", ".join(f"(w.{c} - w.{c}_1) / dt1 AS x{k + 3}" for k, c in enumerate(CHANNELS))},
    sin(2 * 3.141592653589793::DOUBLE * (hour(r.ts) + minute(r.ts) / 60.0::DOUBLE) / 24) AS x6, cos(2 * 3.141592653589793::DOUBLE * (hour(r.ts) + minute(r.ts) / 60.0::DOUBLE) / 24) AS x7
  FROM wide_ w JOIN readings r ON r.station_id = w.station_id AND r.seq = w.seq WHERE dt1 > 0 AND {" AND ".join(f"w.{c} IS NOT NULL AND w.{c}_1 IS NOT NULL" for c in CHANNELS)}
), {_forest()}
), ranked AS (
  SELECT station_id, seq, us, row_number() OVER (PARTITION BY station_id ORDER BY seq) AS place FROM readings
), clock_hours AS (
  SELECT i.station_id, i.seq, l.channel, l.us // 3600000000 AS hour, avg(l.value) AS mean FROM instants i JOIN ranked p USING (station_id, seq) JOIN history_rows k USING (station_id)
  JOIN ranked r ON r.station_id = i.station_id AND r.place <= p.place AND r.place > p.place - k.clock_rows AND r.us >= i.us - 86400000000
  JOIN long_ l ON l.station_id = r.station_id AND l.seq = r.seq AND l.channel <> 'pressure_hpa' AND l.value IS NOT NULL GROUP BY ALL
), clock_enough AS (
  SELECT station_id, seq FROM clock_hours GROUP BY ALL HAVING count(DISTINCT hour) >= 18
), clock_moved AS (
  SELECT h.*, s.shift, make_timestamp((hour + s.shift) * 3600000000) AS at_time FROM clock_hours h JOIN clock_enough USING (station_id, seq), range(-6, 7) s(shift)
), clock_scores AS (
  SELECT m.station_id, m.seq, m.shift, avg(pow((m.mean - c.mean) / greatest(c.std, {MIN_STD.replace('channel', 'c.channel')}), 2)) AS score, count(*) AS terms
  FROM clock_moved m JOIN cells c ON c.station_id = m.station_id AND c.channel = m.channel AND c.month = month(at_time) AND c.hour = hour(at_time) GROUP BY m.station_id, m.seq, m.shift HAVING count(*) >= 18
), clock_best AS (
  SELECT station_id, seq, arg_min(shift, {{'a': score, 'b': abs(shift)}}) AS best, min(score) AS low, max(CASE WHEN shift = 0 THEN score END) AS zero, count(*) AS n FROM clock_scores GROUP BY ALL
), clock_ AS (
  SELECT station_id, seq, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS flag FROM (
    SELECT r.station_id, r.seq, CASE WHEN p.seq IS NOT NULL THEN coalesce(best <> 0 AND n >= 2 AND low < 0.5 * zero, FALSE) END AS flag FROM readings r LEFT JOIN instants p USING (station_id, seq) LEFT JOIN clock_best b USING (station_id, seq))
), formulas AS (
  SELECT station_id, seq, ts, temperature_c AS t, pressure_hpa AS p, humidity_pct AS h,
    CASE WHEN humidity_pct > 0 THEN 243.12 * (ln(humidity_pct / 100.0) + 17.62 * temperature_c / nullif(temperature_c + 243.12, 0)) / nullif(17.62 - (ln(humidity_pct / 100.0) + 17.62 * temperature_c / nullif(temperature_c + 243.12, 0)), 0) END AS dew_point,
    CASE WHEN humidity_pct >= 0 THEN temperature_c * atan(0.151977 * sqrt(humidity_pct + 8.313659)) + atan(temperature_c + humidity_pct) - atan(humidity_pct - 1.676331) + 0.00391838 * pow(humidity_pct, 1.5) * atan(0.023101 * humidity_pct) - 4.686035 END AS wet_bulb
  FROM readings
), listed AS (
  SELECT station_id, seq, 'range' AS kind, channel, 'hard' AS severity, 100 + {PLACE} AS place, NULL::DOUBLE AS value FROM marked WHERE range_flag
  UNION ALL SELECT station_id, seq, 'dew_point', NULL, 'hard', 104, dew_point FROM formulas WHERE dew_point > t + 0.5
  UNION ALL SELECT station_id, seq, 'wet_bulb', NULL, 'soft', 105, wet_bulb FROM formulas WHERE wet_bulb >= 35
  UNION ALL SELECT station_id, seq, 'timestamp', NULL, 'hard', 200, NULL FROM marked WHERE channel = 'temperature_c' AND us <= us1
  UNION ALL SELECT station_id, seq, 'dropout', NULL, 'hard', 201, CAST(t IS NULL AS INTEGER) + CAST(p IS NULL AS INTEGER) + CAST(h IS NULL AS INTEGER) FROM formulas WHERE t IS NULL OR p IS NULL OR h IS NULL
  UNION ALL SELECT station_id, seq, 'gap', NULL, 'hard', 202, dt1 FROM marked WHERE channel = 'temperature_c' AND dt1 > 90
  UNION ALL SELECT station_id, seq, 'limits', NULL, 'hard', 203, NULL FROM readings WHERE station_id IN (SELECT station_id FROM limits GROUP BY station_id HAVING count(noise_std) < 3)
  UNION ALL SELECT station_id, seq, 'frozen', channel, CASE WHEN frozen_hard THEN 'hard' ELSE 'soft' END, 300 + 10 * {PLACE}, spread FROM marked WHERE frozen_flag
  UNION ALL SELECT station_id, seq, 'step', channel, 'hard', 301 + 10 * {PLACE}, judged_step FROM marked WHERE step_flag
  UNION ALL SELECT station_id, seq, 'spike', channel, 'hard', 302 + 10 * {PLACE}, NULL FROM marked WHERE spike_flag
  UNION ALL SELECT station_id, seq, 'noise', channel, 'hard', 303 + 10 * {PLACE}, jitter FROM marked WHERE noise_flag
  UNION ALL SELECT station_id, seq, 'drift', channel, 'soft', 304 + 10 * {PLACE}, peak FROM marked WHERE drift_flag
  UNION ALL SELECT station_id, seq, 'clock', NULL, 'soft', 399, NULL FROM clock_ WHERE flag
  UNION ALL SELECT station_id, seq, 'isolation_forest', NULL, 'soft', 510, score FROM rare_ WHERE rare
  UNION ALL SELECT station_id, seq, 'mahalanobis', NULL, 'soft', 520, d2 FROM far_ WHERE far
  UNION ALL SELECT station_id, seq, 'cojump', NULL, 'hard', 400, count(*) FROM marked WHERE plain_step GROUP BY station_id, seq HAVING count(*) >= 2
  UNION ALL SELECT station_id, seq, 'normality', channel, 'soft', 500 + {PLACE}, z FROM marked WHERE normality_flag
), per_reading AS (
  SELECT station_id, seq, ts, max(us) AS us, max(CASE WHEN channel = 'temperature_c' THEN move END) AS move_t, max(CASE WHEN channel = 'pressure_hpa' THEN move END) AS move_p, max(CASE WHEN channel = 'humidity_pct' THEN move END) AS move_h,
    list(channel) FILTER (NOT quiet) AS moving, count(*) FILTER (abs(z) >= 2) AS far,
    max(CASE WHEN channel = 'temperature_c' THEN value END) AS temperature_c, max(CASE WHEN channel = 'pressure_hpa' THEN value END) AS pressure_hpa, max(CASE WHEN channel = 'humidity_pct' THEN value END) AS humidity_pct
  FROM marked GROUP BY station_id, seq, ts
), summed AS (
  SELECT station_id, seq, count(*) AS n, count(*) FILTER (severity = 'hard') AS hard, count(*) FILTER (severity = 'soft') AS soft,
    count(*) FILTER (severity = 'hard' AND kind IN ('range', 'dew_point', 'frozen', 'dropout')) AS faults, arg_min(severity, place) AS first_severity,
    list(DISTINCT channel) FILTER (severity = 'hard' AND kind IN ('step', 'spike')) AS jumpers, list(DISTINCT channel) FILTER (channel IS NOT NULL) AS channels
  FROM listed WHERE kind NOT IN ('gap', 'limits') GROUP BY station_id, seq
), ruled AS (
  SELECT p.*, coalesce(s.n, 0) AS n_flags, coalesce(s.soft, 0) AS soft, s.first_severity,
    CASE WHEN move_t = -1 AND move_h = 1 THEN 'cooling and moistening' WHEN move_t = 1 AND move_h = -1 THEN 'warming and drying'
         WHEN move_p = -1 AND move_h = 1 THEN 'falling pressure and moistening' WHEN move_p = 1 AND move_h = 1 THEN 'rising pressure and moistening' END AS signature,
    CASE WHEN far >= 2 THEN far ELSE 0 END AS coherent,
    CASE WHEN s.faults > 0 THEN 1
         WHEN len(s.jumpers) = 1 AND len(list_filter(coalesce(moving, []), lambda c: c <> s.jumpers[1])) = 0 AND len(list_filter(s.channels, lambda c: c <> s.jumpers[1])) = 0 THEN 2
         WHEN s.n > 0 AND s.hard = 0 AND (far >= 2 OR (move_t = -1 AND move_h = 1) OR (move_t = 1 AND move_h = -1) OR (move_p IN (-1, 1) AND move_h = 1)) THEN 3
         WHEN s.n > 0 THEN 4 ELSE 5 END AS rule
  FROM per_reading p LEFT JOIN summed s USING (station_id, seq)
), verdicts AS (
  SELECT *, CASE rule WHEN 1 THEN 'FAULT' WHEN 2 THEN 'FAULT' WHEN 3 THEN 'WEATHER' WHEN 4 THEN 'SUSPECT' ELSE 'VALID' END AS verdict,
    round_even(least(0.99::DOUBLE, (CASE rule WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 WHEN 4 THEN 0.5 ELSE 0.9 END)::DOUBLE + 0.05::DOUBLE * (soft - CASE WHEN rule = 4 AND first_severity = 'soft' THEN 1 ELSE 0 END)), 3) AS confidence
  FROM ruled
), pointed AS (
  SELECT DISTINCT station_id, seq, channel FROM listed WHERE channel IS NOT NULL
  UNION SELECT d.station_id, d.seq, l.channel FROM listed d JOIN long_ l USING (station_id, seq) WHERE d.kind = 'dropout' AND l.value IS NULL
  UNION SELECT station_id, seq, c FROM listed, (VALUES ('temperature_c'), ('humidity_pct')) x(c) WHERE kind = 'dew_point'
), judged AS (
  SELECT v.*, l.channel, l.value, p.channel IS NOT NULL AS pointed_at, r.qc_flag FROM verdicts v JOIN long_ l USING (station_id, seq) JOIN readings r USING (station_id, seq)
  LEFT JOIN pointed p ON p.station_id = v.station_id AND p.seq = v.seq AND p.channel = l.channel
), residuals AS (
  SELECT j.station_id, j.channel, CAST(j.ts AS DATE) AS day, sum(greatest(-3 * f.s, least(3 * f.s, j.value - m.smooth))) AS sum, count(*) AS n
  FROM judged j JOIN smooth m USING (station_id, seq, channel) JOIN joined f USING (station_id, seq, channel)
  WHERE j.value IS NOT NULL AND m.smooth IS NOT NULL AND f.e IS NOT NULL AND NOT (j.verdict = 'FAULT' AND j.pointed_at) GROUP BY ALL
), days AS (
  SELECT station_id, channel, day, sum / n AS mean FROM residuals WHERE n >= 24
), last_day AS (
  SELECT station_id, max(CAST(ts AS DATE)) AS eval_day FROM readings GROUP BY ALL
), every_day AS (
  SELECT station_id, CAST(unnest(range(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS eval_day FROM readings GROUP BY station_id
), evaluated AS (
  SELECT station_id, channel, eval_day, list(x ORDER BY x) AS xs, list(mean ORDER BY x) AS ys FROM (
    SELECT d.station_id, d.channel, a.eval_day, d.mean, datediff('day', DATE '0001-01-01', d.day)::DOUBLE + 1 AS x FROM days d JOIN every_day a USING (station_id) WHERE d.day <= a.eval_day AND datediff('day', d.day, a.eval_day) < 60) GROUP BY ALL
), fitted_ AS (
  SELECT *, len(xs) AS n, list_avg(xs) AS mx, list_avg(ys) AS my FROM evaluated WHERE len(xs) >= 21
), fitted AS (
  SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: (xs[i] - mx) * (ys[i] - my))) / list_sum(list_transform(xs, lambda x: (x - mx) * (x - mx))) AS ols, list_sum(list_transform(xs, lambda x: (x - mx) * (x - mx))) AS sxx FROM fitted_
), residual_ AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: ys[i] - my - ols * (xs[i] - mx)) AS r FROM fitted
), correlated AS (
  SELECT *, r[1:n - 1] AS ra, r[2:n] AS rb, list_median(flatten(list_transform(range(1, n), lambda i: list_transform(range(i + 1, n + 1), lambda j: (ys[j] - ys[i]) / (xs[j] - xs[i]))))) AS slope FROM residual_
), tested_ AS (
  SELECT *, least(0.9, greatest(0.0, coalesce(list_sum(list_transform(range(1, n), lambda i: (ra[i] - list_avg(ra)) * (rb[i] - list_avg(rb))))
    / nullif(sqrt(list_sum(list_transform(ra, lambda v: pow(v - list_avg(ra), 2))) * list_sum(list_transform(rb, lambda v: pow(v - list_avg(rb), 2)))), 0), 0))) AS rho FROM correlated
), tested AS (
  SELECT station_id, channel, eval_day, n, slope, se, CASE WHEN se > 0 THEN slope / se ELSE 0 END AS z, offset_now FROM (
    SELECT *, sqrt(list_sum(list_transform(r, lambda v: v * v)) / (n - 2) / sxx) * sqrt((1 + rho) / (1 - rho)) AS se,
      list_median(ys) - slope * list_median(list_transform(xs, lambda x: x - xs[1])) + slope * (datediff('day', DATE '0001-01-01', eval_day) + 1 - xs[1]) AS offset_now FROM tested_)
), isolated AS (
  SELECT *, abs(z) >= 4 AND count(*) FILTER (abs(z) >= 2.5) OVER (PARTITION BY station_id, eval_day) - CASE WHEN abs(z) >= 2.5 THEN 1 ELSE 0 END = 0 AS significant FROM tested
), persistent AS (
  SELECT *, coalesce(sum(CASE WHEN significant AND slope > 0 THEN 1 ELSE 0 END) OVER w = 7 OR sum(CASE WHEN significant AND slope < 0 THEN 1 ELSE 0 END) OVER w = 7, FALSE) AS drifts,
    (CASE WHEN slope > 0 THEN 1 ELSE -1 END * {_by(0.5, 1.0, 3.0)} - offset_now) / nullif(slope, 0) AS ahead
  FROM isolated WINDOW w AS (PARTITION BY station_id, channel ORDER BY datediff('day', DATE '1970-01-01', eval_day) RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)
), lasting AS (
  SELECT station_id, channel, drifts, offset_now, CASE WHEN drifts AND ahead <= 0 THEN eval_day WHEN drifts AND ahead <= 3650 THEN CAST(eval_day + CAST(floor(ahead) AS INTEGER) AS DATE) END AS service_date FROM persistent JOIN last_day USING (station_id, eval_day)
), scored AS (
  SELECT f.*, drifts, service_date, round_even(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - 100 * fault_fraction - 50 * suspect_fraction - CASE WHEN drifts THEN 40 * least(1.0, abs(offset_now) / {_by(0.5, 1.0, 3.0)}) ELSE 0 END)), 2) AS score FROM (
    SELECT station_id, channel, count(*) AS records, max(ts) AS now, avg(CAST(verdict = 'FAULT' AND pointed_at AS INTEGER)) AS fault_fraction, avg(CAST(verdict = 'SUSPECT' AND pointed_at AS INTEGER)) AS suspect_fraction,
      avg(CAST(verdict = 'FAULT' AND pointed_at AS INTEGER)) FILTER (us >= now_us - 3600000000) AS recent_fraction
    FROM (SELECT *, max(us) OVER (PARTITION BY station_id) AS now_us FROM judged) WHERE us >= now_us - 10080 * 6e7 GROUP BY station_id, channel HAVING count(*) >= 30) f LEFT JOIN lasting USING (station_id, channel)
), tickets AS (
  SELECT *, coalesce(recent_fraction >= 0.5, FALSE) AS faulty, coalesce(datediff('day', CAST(now AS DATE), service_date) <= 30, FALSE) AS due FROM scored
), reports AS (
  SELECT station_id, max(now) AS now, max(records) AS records, min(score) AS score, min(service_date) AS service_date,
    CASE WHEN count(*) FILTER (score <= 60 OR faulty OR due) = 0 THEN NULL WHEN bool_or(faulty OR (due AND service_date <= CAST(now AS DATE))) OR min(score) <= 30 THEN 'high' ELSE 'normal' END AS ticket,
    coalesce(string_agg(channel, ',' ORDER BY {PLACE}) FILTER (score <= 60 OR faulty OR due), '') AS channels
  FROM tickets GROUP BY station_id
)
"""

#: The tables that depend on the readings to judge, not on what the models learn from.
JUDGED = ("readings", "instants", "long_", "joined", "corners", "weighted", "smooth", "feat_", "feat", "held", "both_", "lists_", "measured", "flags_", "marked", "wide_", "used", "solved", "distance", "far_", "ranked",
          "forest_rows", *(f"forest_w{k}" for k in range(DEPTH + 1)), "forest_totals", "rare_",
          "clock_hours", "clock_enough", "clock_moved", "clock_scores", "clock_best", "clock_", "formulas", "listed", "per_reading", "summed", "ruled", "verdicts")


#: The tables from readings to what a station learns of them.
LEARNING = ("readings", "long_", "cells", "joined", "feat_", "feat", "runs_", "runs", "jitter_", "jitter", "steps", "resolution", "limits")


def judging(readings: str, suffix: str = "_f", tables: tuple[str, ...] = JUDGED, given: dict[str, str] | None = None) -> str:
    """Tables after TABLES that judge other readings (a SELECT with the columns of readings) by the same models, or by those
    given (a SELECT each); their names end in suffix."""
    given = {"readings": readings} | (given or {})
    names = "|".join(sorted({*tables, *given}, key=len, reverse=True))
    parts = re.split(r"^\), (\w+) AS (?:MATERIALIZED )?\($", re.sub(r"^WITH RECURSIVE ", "), ", TABLES.strip(), count=1), flags=re.M)
    out = [f", {name}{suffix} AS ({body})" for name, body in given.items()]
    for name, body in zip(parts[1::2], parts[2::2], strict=True):
        if name in tables and name not in given:
            own = re.sub(rf"\b(FROM|JOIN) ({names})\b", rf"\1 \2{suffix}", body.rstrip())
            own = re.sub(r"\b(readings|long_|listed|instants|ranked)\.", rf"\1{suffix}.", own)
            out.append(f", {name}{suffix} AS ({own})")
    return "\n".join(out)


def configured(configs: str) -> str:
    """Tables after TABLES that fuse the same checks in several configurations: configs is a SELECT of config and off, the kinds
    that it leaves out; verdicts_c has a verdict for each reading and config."""
    bodies = dict(re.findall(r"^\), (summed|ruled|verdicts) AS \(\n(.*?)(?=^\), )", TABLES, flags=re.M | re.S))
    summed = bodies["summed"].replace("SELECT station_id, seq, count(*)", "SELECT config, station_id, seq, count(*)", 1).replace("FROM listed WHERE", "FROM listed, configs_ WHERE NOT list_contains(off, kind) AND").replace("GROUP BY station_id, seq", "GROUP BY config, station_id, seq")
    ruled = bodies["ruled"].replace("FROM per_reading p LEFT JOIN summed s USING (station_id, seq)", "FROM (SELECT * FROM per_reading, configs_) p LEFT JOIN summed_c s USING (config, station_id, seq)")
    return f", configs_ AS ({configs}), summed_c AS ({summed}), ruled_c AS ({ruled}), verdicts_c AS ({bodies['verdicts'].replace('FROM ruled', 'FROM ruled_c')})"
