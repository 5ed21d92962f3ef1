"""SQL twins of the derived tables, as composable common table expressions.

The statements are ANSI SQL in DuckDB's dialect. ``sql(body, ...)`` prefixes a
query with the tables it names and everything those depend on.
"""

from __future__ import annotations

CUTOFF = "2024-01-20 00:00:00"
NOON_OF_FIRST_DAY = "2024-01-01 12:00:00"
FIFTH_DAY = "2024-01-05 00:00:00"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(sin(radians(({lat2}) - ({lat1})) / 2) * sin(radians(({lat2}) - ({lat1})) / 2) + "
         f"cos(radians({lat1})) * cos(radians({lat2})) * sin(radians(({lon2}) - ({lon1})) / 2) "
         f"* sin(radians(({lon2}) - ({lon1})) / 2))")
    a = f"(CASE WHEN {a} > 1 THEN 1.0::DOUBLE ELSE {a} END)"
    return f"round(6371::DOUBLE * (2 * atan2(sqrt({a}), sqrt(1 - {a}))), 2)"


def cell(column: str) -> str:
    return f"CAST(round({column} * 1000) AS BIGINT)"


def hours(start: str, end: str) -> str:
    return f"(date_diff('microsecond', {start}, {end}) / 3600000000::DOUBLE)"


def hour(ts: str = '"timestamp"') -> str:
    return f"CAST(hour({ts}) AS INTEGER)"


def day(ts: str = '"timestamp"') -> str:
    return f"CAST(isodow({ts}) - 1 AS INTEGER)"


def tiers(speed: str) -> str:
    return (f"CASE WHEN {speed} > 1000 THEN 1.0::DOUBLE WHEN {speed} > 800 THEN 0.9::DOUBLE "
            f"WHEN {speed} > 300 THEN 0.6::DOUBLE WHEN {speed} > 150 THEN 0.3::DOUBLE "
            f"WHEN {speed} > 80 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END")


def chi2_cdf_3(d: str) -> str:
    """Series of the regularised incomplete gamma function at 3/2."""
    x = f"(({d}) / 2)"
    return (f"CASE WHEN ({d}) > 100 THEN 1.0::DOUBLE WHEN ({d}) <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, "
            f"list_sum(list_transform(range(0, 121), lambda k: exp((k + 1.5::DOUBLE) * ln({x}) - {x} "
            f"- lgamma(k + 2.5::DOUBLE))))) END")


def sigmoid(z: str) -> str:
    return f"(1::DOUBLE / (1 + exp(-0.5::DOUBLE * (({z}) - 3))))"


def escape_html(column: str) -> str:
    out = column
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        out = f"replace({out}, '{raw}', '{safe}')"
    return out


FORMAT_TS = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S')"
YES_NO = "CASE WHEN is_anomalous THEN 'Yes' ELSE 'No' END"

_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def table(name: str, statement: str, *needs: str) -> str:
    _TABLES[name] = (needs, statement)
    return name


def sql(body: str, *needs: str) -> str:
    """``body`` with the tables it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in _TABLES[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS ({_TABLES[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{body}"


def _cities(axis: int) -> str:
    from loginlens.sources.event_logins import HOME_CITIES
    whens = " ".join(f"WHEN {i} THEN {c[axis]}" for i, c in enumerate(HOME_CITIES[:-1]))
    return f"CAST(CASE city {whens} ELSE {HOME_CITIES[-1][axis]} END AS DOUBLE)"


table("logins", f"""
  SELECT event_id, 'user' || CAST(uid AS VARCHAR) AS user_id, login_ts AS "timestamp", latitude,
    CASE WHEN lon0 > 180 THEN lon0 - 360::DOUBLE ELSE lon0 END AS longitude,
    CASE WHEN event_id % 41 = 0 THEN 'device_new_' || CAST(event_id AS VARCHAR)
         WHEN habitual THEN 'device_mobile_' || CAST(uid AS VARCHAR)
         ELSE 'device_' || CASE WHEN event_type IN ('click','view','purchase') THEN 'mobile'
              WHEN event_type = 'signup' THEN 'tablet' ELSE 'desktop' END || '_' || CAST(uid AS VARCHAR)
    END AS device_id,
    '10.' || CAST(uid % 256 AS VARCHAR) || '.' || CAST(k AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR)
      AS ip_address
  FROM (SELECT *,
      {_cities(0)} + CAST(CASE WHEN habitual THEN 0 ELSE (k % 25) - 12 END AS DOUBLE) / 1000::DOUBLE AS latitude,
      {_cities(1)} + CAST(CASE WHEN habitual THEN event_id % 3 ELSE (event_id % 37) - 18 END AS DOUBLE)
        / 1000::DOUBLE AS lon0
    FROM (SELECT *, CAST(CASE WHEN event_id % 29 = 0 THEN (uid + 3) % 8
                              WHEN event_id % 31 = 0 THEN (uid + 5) % 8 ELSE uid % 8 END AS INT) AS city
      FROM (SELECT event_id, user_id AS uid, event_type, user_id % 3 = 0 AS habitual,
              CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k,
              CASE WHEN user_id % 3 = 0 AND event_id % 17 <> 0
                   THEN ts - to_hours(CAST(hour(ts) - 9 AS INT)) ELSE ts END AS login_ts
            FROM events)))""")

for _name, _where in (("hist", f"< TIMESTAMP '{CUTOFF}'"), ("fresh", f">= TIMESTAMP '{CUTOFF}'"),
                      ("early", f"< TIMESTAMP '{NOON_OF_FIRST_DAY}'"),
                      ("later", f">= TIMESTAMP '{NOON_OF_FIRST_DAY}'"),
                      ("start", f"< TIMESTAMP '{FIFTH_DAY}'"), ("after_start", f">= TIMESTAMP '{FIFTH_DAY}'")):
    table(_name, f'SELECT * FROM logins WHERE "timestamp" {_where}', "logins")

table("raw", """
  SELECT event_id, user_id,
    CASE WHEN event_id % 47 = 0 THEN 'not a time'
         ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp",
    CASE WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 59 = 0 THEN '95.5'
         WHEN event_id % 61 = 0 THEN NULL ELSE CAST(latitude AS VARCHAR) END AS latitude,
    CASE WHEN event_id % 67 = 0 THEN '-180.5' ELSE CAST(longitude AS VARCHAR) END AS longitude,
    CASE WHEN event_id % 71 = 0 THEN NULL ELSE device_id END AS device_id,
    CASE WHEN event_id % 37 = 0 THEN '300.1.1.1' WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 73 = 0 THEN ':::'
         WHEN event_id % 79 = 0 THEN '1:2' WHEN event_id % 83 = 0 THEN '1::2::3'
         WHEN event_id % 89 = 0 THEN '2001:db8::12345' WHEN event_id % 97 = 0 THEN '2001:DB8::1:2'
         WHEN event_id % 101 = 0 THEN '::ffff:10.0.0.1' ELSE ip_address END AS ip_address
  FROM logins""", "logins")

table("typed_raw", """
  SELECT event_id, user_id, try_cast("timestamp" AS TIMESTAMP) AS "timestamp",
    try_cast(latitude AS DOUBLE) AS latitude, try_cast(longitude AS DOUBLE) AS longitude, device_id, ip_address
  FROM raw""", "raw")


def profile_tables(src: str) -> None:
    """Totals, devices, cells, hour and weekday counters of a login table."""
    table(f"{src}_totals", f"""
      SELECT user_id, count(*) AS total_logins, min("timestamp") AS first_login, max("timestamp") AS last_login
      FROM {src} GROUP BY user_id""", src)
    table(f"{src}_devices", f"""
      SELECT d.user_id, device_id, d."count", d."count" / total_logins::DOUBLE * 100 AS percentage,
             first_seen, last_seen
      FROM (SELECT user_id, device_id, count(*) AS "count", min("timestamp") AS first_seen,
                   max("timestamp") AS last_seen FROM {src} GROUP BY user_id, device_id) d
      JOIN {src}_totals t ON t.user_id = d.user_id""", f"{src}_totals")
    table(f"{src}_cells", f"""
      SELECT user_id, {cell('latitude')} AS cell_lat, {cell('longitude')} AS cell_lon, count(*) AS "count",
             min_by(latitude, ROW("timestamp", event_id)) AS lat, min_by(longitude, ROW("timestamp", event_id)) AS lon,
             min("timestamp") AS first_seen, max("timestamp") AS last_seen, min(ROW("timestamp", event_id)) AS ord
      FROM {src} GROUP BY ALL""", src)
    table(f"{src}_hours", f'SELECT user_id, {hour()} AS "hour", count(*) AS "count" FROM {src} GROUP BY ALL', src)
    table(f"{src}_days", f'SELECT user_id, {day()} AS "day", count(*) AS "count" FROM {src} GROUP BY ALL', src)
    table(f"{src}_gaps", f"""
      SELECT user_id, avg(g) AS mean_gap_h, stddev_pop(g) AS std_gap_h, min(g) AS min_gap_h, max(g) AS max_gap_h,
             quantile_cont(g, 0.5) AS median_gap_h
      FROM (SELECT user_id, {hours('lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id)',
                                   '"timestamp"')} AS g FROM {src}) GROUP BY user_id""", src)
    table(f"{src}_centers", center(src, "user_id"), src)
    table(f"{src}_spread", spread(src, "user_id", f"{src}_centers"), f"{src}_centers")
    table(f"{src}_place", f"""
      SELECT c.user_id, min_by(lat, ROW(abs(date_diff('microsecond', last_seen, last_login)), ord)) AS prev_lat,
             min_by(lon, ROW(abs(date_diff('microsecond', last_seen, last_login)), ord)) AS prev_lon
      FROM {src}_cells c JOIN {src}_totals t ON t.user_id = c.user_id GROUP BY c.user_id""",
          f"{src}_cells", f"{src}_totals")


def center(src: str, *keys: str) -> str:
    by = ", ".join(keys)
    return f"""
      SELECT {by}, n AS points, degrees(atan2(z, sqrt(x * x + y * y))) AS center_lat,
             degrees(atan2(y, x)) AS center_lon
      FROM (SELECT {by}, count(*) AS n, avg(cos(radians(latitude)) * cos(radians(longitude))) AS x,
                   avg(cos(radians(latitude)) * sin(radians(longitude))) AS y, avg(sin(radians(latitude))) AS z
            FROM {src} GROUP BY {by})"""


def spread(src: str, key: str, centers: str, *more: str) -> str:
    keys = [key, *more]
    on = " AND ".join(f"l.{k} = c.{k}" for k in keys)
    by = ", ".join(f"l.{k}" for k in keys)
    km = haversine("latitude", "longitude", "center_lat", "center_lon")
    return f"""
      SELECT {by}, any_value(center_lat) AS center_lat, any_value(center_lon) AS center_lon,
             any_value(points) AS points,
             CASE WHEN any_value(points) <= 1 THEN 0.0::DOUBLE ELSE sqrt(avg({km} * {km})) END AS std_distance
      FROM {src} l JOIN {centers} c ON {on} GROUP BY {by}"""


for _src in ("logins", "hist", "fresh", "early"):
    profile_tables(_src)

# State before each login.
_PAST = 'ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING'
_SEQ = 'PARTITION BY user_id ORDER BY "timestamp", event_id'
table("with_first", f"""
  SELECT *, first_value(latitude) OVER c AS first_lat, first_value(longitude) OVER c AS first_lon
  FROM logins WINDOW c AS (PARTITION BY user_id, {cell('latitude')}, {cell('longitude')}
                           ORDER BY "timestamp", event_id)""", "logins")
table("replay_state", f"""
  SELECT *, count(*) OVER (PARTITION BY user_id {_PAST}) AS total_logins,
    count(*) OVER (PARTITION BY user_id, device_id {_PAST}) AS device_count,
    count(*) OVER (PARTITION BY user_id, hour("timestamp") {_PAST}) AS hour_count,
    count(*) OVER (PARTITION BY user_id, isodow("timestamp") {_PAST}) AS day_count,
    lag("timestamp") OVER ({_SEQ}) AS last_login, lag(first_lat) OVER ({_SEQ}) AS prev_lat,
    lag(first_lon) OVER ({_SEQ}) AS prev_lon
  FROM with_first""", "with_first")
table("replay_speed", f"""
  SELECT *, km / nullif(gap_h, 0) AS speed FROM (
    SELECT *, {haversine('prev_lat', 'prev_lon', 'latitude', 'longitude')} AS km,
           {hours('last_login', '"timestamp"')} AS gap_h FROM replay_state)""", "replay_state")
table("replay", f"""
  SELECT event_id, user_id, "timestamp", total_logins, device_count, hour_count, day_count,
    CASE WHEN total_logins = 0 THEN 0.5::DOUBLE WHEN device_count = 0 THEN 0.9::DOUBLE
         ELSE 1 - (device_count / total_logins::DOUBLE * 100) / 100 END AS device_score,
    CASE WHEN total_logins = 0 THEN 0.5::DOUBLE
         ELSE 1 - (0.7::DOUBLE * (hour_count / total_logins::DOUBLE)
                   + 0.3::DOUBLE * (day_count / total_logins::DOUBLE)) END AS time_score,
    CASE WHEN total_logins = 0 THEN 0.5::DOUBLE WHEN gap_h <= 0 THEN 1.0::DOUBLE ELSE {tiers('speed')} END
      AS velocity_score
  FROM replay_speed""", "replay_speed")
table("scored", """
  SELECT l.*, s.anomaly_score, s.anomaly_score > 0.7::DOUBLE AS is_anomalous
  FROM logins l JOIN (SELECT event_id, (device_score * 0.2::DOUBLE + time_score * 0.15::DOUBLE
    + velocity_score * 0.2::DOUBLE) / 0.55::DOUBLE AS anomaly_score FROM replay) s ON s.event_id = l.event_id""",
      "logins", "replay")


def feature_tables(src: str) -> None:
    """Features, their scale, DBSCAN cores and labels of a login table."""
    table(f"{src}_unwrapped", f"""
      SELECT l.*, CASE WHEN r.n > 1 AND r.lon_range > 180 AND longitude < 0 THEN longitude + 360
                       ELSE longitude END AS lon_unwrapped
      FROM {src} l JOIN (SELECT user_id, count(*) AS n, max(longitude) - min(longitude) AS lon_range
                         FROM {src} GROUP BY user_id) r ON r.user_id = l.user_id""", src)
    pi2 = "(2 * pi())"
    table(f"{src}_features", f"""
      SELECT *, {hour()} AS "hour", {day()} AS "day",
        sin({pi2} * hour("timestamp") / 24) AS hour_sin, cos({pi2} * hour("timestamp") / 24) AS hour_cos,
        sin({pi2} * (isodow("timestamp") - 1) / 7) AS day_sin, cos({pi2} * (isodow("timestamp") - 1) / 7) AS day_cos
      FROM {src}_unwrapped""", f"{src}_unwrapped")
    names = ("latitude", "lon_unwrapped", "hour_sin", "hour_cos", "day_sin", "day_cos")
    scales = ", ".join(
        f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1.0::DOUBLE ELSE stddev_pop({c}) END AS {c}_std"
        for c in names)
    table(f"{src}_scales", f"SELECT user_id, count(*) AS n, {scales} FROM {src}_features GROUP BY user_id",
          f"{src}_features")
    table(f"{src}_z", "SELECT f.*, " + ", ".join(f"({c} - {c}_mean) / {c}_std AS {c}_z" for c in names)
          + f" FROM {src}_features f JOIN {src}_scales s ON s.user_id = f.user_id", f"{src}_scales")
    table(f"{src}_uv", f"""
      SELECT f.*, latitude / latitude_std AS u, lon_unwrapped / lon_unwrapped_std AS v,
             hour_sin / hour_sin_std AS p, hour_cos / hour_cos_std AS q
      FROM {src}_features f JOIN {src}_scales s ON s.user_id = f.user_id""", f"{src}_scales")
    table(f"{src}_near", f"""
      SELECT a.user_id, a.event_id AS a, b.event_id AS b, b."timestamp" AS b_time
      FROM {src}_uv a JOIN {src}_uv b ON a.user_id = b.user_id AND a.device_id = b.device_id AND a."day" = b."day"
      WHERE (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) + (a.p - b.p) * (a.p - b.p)
            + (a.q - b.q) * (a.q - b.q) <= 0.25::DOUBLE""", f"{src}_uv")
    table(f"{src}_core", f"SELECT user_id, a AS event_id FROM {src}_near GROUP BY ALL HAVING count(*) >= 5",
          f"{src}_near")
    table(f"{src}_reach", f"""
      SELECT event_id AS a, event_id AS b FROM {src}_core
      UNION
      SELECT r.a, n.b FROM {src}_reach r JOIN {src}_near n ON n.a = r.b
      JOIN {src}_core c ON c.event_id = n.b""", f"{src}_core")
    table(f"{src}_component", f"""
      SELECT r.a AS event_id, min(ROW(l."timestamp", l.event_id)) AS root
      FROM {src}_reach r JOIN {src} l ON l.event_id = r.b GROUP BY r.a""", f"{src}_reach")
    table(f"{src}_rooted", f"""
      SELECT l.user_id, l.event_id, coalesce(any_value(own.root), min(near.root)) AS root
      FROM {src} l LEFT JOIN {src}_component own ON own.event_id = l.event_id
      LEFT JOIN {src}_near n ON n.a = l.event_id LEFT JOIN {src}_component near ON near.event_id = n.b
      GROUP BY l.user_id, l.event_id""", f"{src}_component")
    table(f"{src}_labels", f"""
      SELECT r.user_id, r.event_id, CAST(coalesce(k.rank - 1, -1) AS INTEGER) AS cluster
      FROM {src}_rooted r LEFT JOIN (
        SELECT user_id, root, row_number() OVER (PARTITION BY user_id ORDER BY root) AS rank
        FROM (SELECT DISTINCT user_id, root FROM {src}_rooted WHERE root IS NOT NULL)) k
      ON k.user_id = r.user_id AND k.root = r.root""", f"{src}_rooted")
    table(f"{src}_labelled", f"""
      SELECT l.*, c.cluster FROM {src} l JOIN {src}_labels c ON c.event_id = l.event_id""", f"{src}_labels", src)
    table(f"{src}_real", f"SELECT * FROM {src}_labelled WHERE cluster <> -1", f"{src}_labelled")
    table(f"{src}_cluster_centers", center(f"{src}_real", "user_id", "cluster"), f"{src}_real")
    table(f"{src}_cluster_spread", spread(f"{src}_real", "user_id", f"{src}_cluster_centers", "cluster"),
          f"{src}_cluster_centers")
    table(f"{src}_clusters", f"""
      SELECT s.user_id, s.cluster, s.points AS "count", s.points / t.total::DOUBLE * 100 AS percentage,
             center_lat, center_lon, std_distance, t.num_clusters
      FROM {src}_cluster_spread s JOIN (
        SELECT user_id, count(*) AS total, count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS num_clusters
        FROM {src}_labelled GROUP BY user_id) t ON t.user_id = s.user_id""", f"{src}_cluster_spread")


for _src in ("logins", "hist", "fresh"):
    feature_tables(_src)

# Covariance and Mahalanobis model from exact integer sums.
_COV = {"xx": ("x", "x", 1e12), "xy": ("x", "y", 1e12), "xh": ("x", "h", 1e6),
        "yy": ("y", "y", 1e12), "yh": ("y", "h", 1e6), "hh": ("h", "h", 1.0)}


_MICRO = """CAST(round(latitude * 1e6) AS BIGINT) AS x, CAST(round(longitude * 1e6) AS BIGINT) AS y, hour("timestamp") AS h"""


def covariance_tables(src: str, keys: str, sums: str) -> None:
    """Means, covariances, pivots and the degenerate flag from the table ``sums`` with ``keys``, n and sums."""
    covs = ", ".join(
        f"CASE WHEN n > 1 THEN CAST(n * s{k} - s{a} * s{b} AS DOUBLE) / (n::DOUBLE * (n - 1)) / {u}::DOUBLE END AS cov_{k}"
        for k, (a, b, u) in _COV.items())
    table(f"{src}_cov", f"""
      SELECT {keys}, n, sx::DOUBLE / nullif(n, 0) / 1e6 AS mean_lat, sy::DOUBLE / nullif(n, 0) / 1e6 AS mean_lon,
             sh::DOUBLE / nullif(n, 0) AS mean_hour, {covs} FROM {sums}""", sums)
    table(f"{src}_pivots", f"""
      SELECT *, cov_hh - cov_xh * cov_xh / nullif(cov_xx, 0) - m * m / nullif(p2, 0) AS p3 FROM (
        SELECT *, cov_yy - cov_xy * cov_xy / nullif(cov_xx, 0) AS p2,
               cov_yh - cov_xy * cov_xh / nullif(cov_xx, 0) AS m FROM {src}_cov)""", f"{src}_cov")
    table(f"{src}_model", f"""
      SELECT *, NOT coalesce(cov_xx > 0 AND p2 / nullif(cov_yy, 0) > 1e-9 AND p3 / nullif(cov_hh, 0) > 1e-9, false)
               AS degenerate FROM {src}_pivots""", f"{src}_pivots")


def user_covariance(src: str) -> None:
    sums = ", ".join(f"sum(CAST({a} AS HUGEINT) * {b}) AS s{k}" for k, (a, b, _) in _COV.items())
    table(f"{src}_sums", f"""
      SELECT user_id, count(*) AS n, sum(CAST(x AS HUGEINT)) AS sx, sum(CAST(y AS HUGEINT)) AS sy,
             sum(CAST(h AS HUGEINT)) AS sh, {sums}
      FROM (SELECT user_id, {_MICRO} FROM {src}) GROUP BY user_id""", src)
    covariance_tables(src, "user_id", f"{src}_sums")


user_covariance("hist")
def mahalanobis_table(logins: str, src: str) -> None:
    """Distance and score of logins against the models of ``src``; degenerate users are left out."""
    z3 = "(h - cov_xh / cov_xx * x - m / p2 * (y - cov_xy / cov_xx * x))"
    z2 = "(y - cov_xy / cov_xx * x)"
    table(f"{logins}_mahalanobis", f"""
      SELECT event_id, user_id, n, d, {chi2_cdf_3('d')} AS score FROM (
        SELECT event_id, user_id, n,
               sqrt(greatest(0, x * x / cov_xx + {z2} * {z2} / p2 + {z3} * {z3} / p3)) AS d
        FROM (SELECT f.event_id, f.user_id, c.*, f.latitude - mean_lat AS x, f.longitude - mean_lon AS y,
                     hour(f."timestamp") - mean_hour AS h
              FROM {logins} f JOIN (SELECT * EXCLUDE (user_id), user_id AS owner FROM {src}_model
                                    WHERE NOT degenerate) c ON c.owner = f.user_id))""", logins, f"{src}_model")


user_covariance("start")
mahalanobis_table("fresh", "hist")
mahalanobis_table("after_start", "start")

# The covariance model of all logins before each one.
_RUNNING = ", ".join(f"coalesce(sum(CAST({a} AS HUGEINT) * {b}) OVER p, 0) AS s{k}" for k, (a, b, _) in _COV.items())
table("asof_sums", f"""
  SELECT event_id, user_id, "timestamp", latitude, longitude, count(*) OVER p AS n, coalesce(sum(CAST(x AS HUGEINT)) OVER p, 0) AS sx,
         coalesce(sum(CAST(y AS HUGEINT)) OVER p, 0) AS sy, coalesce(sum(CAST(h AS HUGEINT)) OVER p, 0) AS sh, {_RUNNING}
  FROM (SELECT *, {_MICRO} FROM logins) WINDOW p AS (PARTITION BY user_id {_PAST})""", "logins")
covariance_tables("asof", 'event_id, user_id, "timestamp", latitude, longitude', "asof_sums")
_Y = "(y - cov_xy / cov_xx * x)"
_H = f"(h - cov_xh / cov_xx * x - m / p2 * {_Y})"
table("asof_mahalanobis", f"""
  SELECT event_id, n, degenerate, CASE WHEN NOT degenerate THEN {chi2_cdf_3('d')} END AS score FROM (
    SELECT *, CASE WHEN NOT degenerate
                   THEN sqrt(greatest(0, x * x / cov_xx + {_Y} * {_Y} / p2 + {_H} * {_H} / p3)) END AS d
    FROM (SELECT *, latitude - mean_lat AS x, longitude - mean_lon AS y, hour("timestamp") - mean_hour AS h FROM asof_model))""",
      "asof_model")

# Detectors on the frozen profile.
table("fresh_device", """
  SELECT f.event_id, f.user_id, CASE WHEN d."count" IS NULL THEN 0.9::DOUBLE ELSE 1 - d.percentage / 100 END AS score,
    CASE WHEN d."count" IS NULL THEN 'new' ELSE 'known' END AS device_status,
    coalesce(d."count", 0) AS previous_usage_count, coalesce(d.percentage, 0) AS previous_usage_percent
  FROM fresh f LEFT JOIN hist_devices d ON d.user_id = f.user_id AND d.device_id = f.device_id""",
      "fresh", "hist_devices")
table("fresh_time", f"""
  SELECT event_id, user_id, hour_count, day_count, 1 - (0.7::DOUBLE * (hour_count / total_logins::DOUBLE)
         + 0.3::DOUBLE * (day_count / total_logins::DOUBLE)) AS score, {hour()} AS login_hour, {day()} AS login_day,
         hour_count / total_logins::DOUBLE AS hour_frequency, day_count / total_logins::DOUBLE AS day_frequency
  FROM (SELECT f.*, t.total_logins, coalesce(h."count", 0) AS hour_count, coalesce(d."count", 0) AS day_count
        FROM fresh f LEFT JOIN hist_totals t ON t.user_id = f.user_id
        LEFT JOIN hist_hours h ON h.user_id = f.user_id AND h."hour" = hour(f."timestamp")
        LEFT JOIN hist_days d ON d.user_id = f.user_id AND d."day" = isodow(f."timestamp") - 1)""",
      "fresh", "hist_totals", "hist_hours", "hist_days")
table("fresh_velocity", f"""
  SELECT event_id, user_id, CASE WHEN prev_lat IS NULL THEN 0.0::DOUBLE WHEN gap_h <= 0 THEN 1.0::DOUBLE
              ELSE {tiers('km / gap_h')} END AS score, km, gap_h, prev_lat, prev_lon
  FROM (SELECT f.event_id, f.user_id, p.prev_lat, p.prev_lon, {hours('t.last_login', 'f."timestamp"')} AS gap_h,
               {haversine('p.prev_lat', 'p.prev_lon', 'f.latitude', 'f.longitude')} AS km
        FROM fresh f LEFT JOIN hist_totals t ON t.user_id = f.user_id
        LEFT JOIN hist_place p ON p.user_id = f.user_id)""", "fresh", "hist_totals", "hist_place")
table("fresh_nearest", f"""
  SELECT event_id, user_id, min(ROW(km, cluster, std_distance)) AS near FROM (
    SELECT f.event_id, f.user_id, c.cluster, c.std_distance,
           {haversine('c.center_lat', 'c.center_lon', 'f.latitude', 'f.longitude')} AS km
    FROM fresh f JOIN hist_clusters c ON c.user_id = f.user_id) GROUP BY event_id, user_id""",
      "fresh", "hist_clusters")
table("fresh_location", f"""
  SELECT event_id, user_id, km, cluster, std_distance, z, {sigmoid('z')} AS score FROM (
    SELECT *, CASE WHEN std_distance > 0 THEN km / std_distance WHEN km > 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS z
    FROM (SELECT event_id, user_id, struct_extract_at(near, 1) AS km, struct_extract_at(near, 2) AS cluster,
                 struct_extract_at(near, 3) AS std_distance FROM fresh_nearest))""", "fresh_nearest")
table("fresh_scores", """
  SELECT f.event_id, f.user_id, h.user_id IS NOT NULL AND l.event_id IS NOT NULL AS stored,
    l.score AS location, d.score AS device, t.score AS "time", v.score AS velocity,
    CASE WHEN n.n >= 10 THEN m.score ELSE 0.5::DOUBLE END AS mahalanobis, n.degenerate, n.n
  FROM fresh f LEFT JOIN hist_totals h ON h.user_id = f.user_id
  LEFT JOIN fresh_location l ON l.event_id = f.event_id JOIN fresh_device d ON d.event_id = f.event_id
  JOIN fresh_time t ON t.event_id = f.event_id JOIN fresh_velocity v ON v.event_id = f.event_id
  LEFT JOIN hist_model n ON n.user_id = f.user_id LEFT JOIN fresh_mahalanobis m ON m.event_id = f.event_id""",
      "fresh_location", "fresh_device", "fresh_time", "fresh_velocity", "fresh_mahalanobis")

# The same logins one after another: the state of the replay, patterns of the history.
table("fresh_replayed", """
  SELECT f.event_id, f.user_id, l.event_id IS NOT NULL AS stored, r.total_logins, r.device_count, r.hour_count, r.day_count,
    l.score AS location, r.device_score AS device, r.time_score AS "time", r.velocity_score AS velocity,
    m.n >= 10 AND m.degenerate AS degenerate, CASE WHEN m.n >= 10 THEN m.score ELSE 0.5::DOUBLE END AS mahalanobis
  FROM fresh f JOIN replay r ON r.event_id = f.event_id JOIN asof_mahalanobis m ON m.event_id = f.event_id
  LEFT JOIN fresh_location l ON l.event_id = f.event_id""", "fresh_location", "replay", "asof_mahalanobis")
