"""The catalog's queries as SQL over the same Parquet tables.

Written against the table definitions, not generated from the operators, so that the two
can disagree. Statements are assembled from common table expressions by name.
"""

from __future__ import annotations

BASE = {
    "sensors": """
        SELECT DISTINCT CAST(user_id AS INTEGER) AS id, CAST(FLOOR(user_id / 6) AS INTEGER) AS zone_id,
          CASE user_id % 6 WHEN 0 THEN 'temperature' WHEN 1 THEN 'humidity' WHEN 2 THEN 'soil_moisture'
                           WHEN 3 THEN 'light' WHEN 4 THEN 'co2' ELSE 'irrigation' END AS sensor_type,
          CASE user_id % 6 WHEN 0 THEN 'C' WHEN 3 THEN 'lux' WHEN 4 THEN 'ppm' WHEN 5 THEN 'L/min' ELSE '%' END AS unit,
          'active' AS status, TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM events""",
    "inventory": """
        SELECT DISTINCT CAST(user_id AS INTEGER) AS id FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00'""",
    "zone_ids": "SELECT DISTINCT CAST(FLOOR(user_id / 6) AS INTEGER) AS id FROM events",
    "zones": """
        SELECT id, id % 5 AS greenhouse_id, 'Zone ' || CAST(id AS VARCHAR) AS name,
          CASE id % 4 WHEN 0 THEN 'tomato' WHEN 1 THEN 'cucumber' WHEN 2 THEN 'lettuce' ELSE 'pepper' END AS crop_type,
          CAST(18 AS DOUBLE) AS target_temperature_min, CAST(26 AS DOUBLE) AS target_temperature_max,
          CAST(60 AS DOUBLE) AS target_humidity_min, CAST(80 AS DOUBLE) AS target_humidity_max,
          CAST(55 AS DOUBLE) AS target_soil_moisture_min, CAST(75 AS DOUBLE) AS target_soil_moisture_max
        FROM zone_ids""",
    "greenhouses": """
        SELECT r_regionkey AS id, r_name AS name, 'site-' || CAST(r_regionkey AS VARCHAR) AS location,
          'active' AS status, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM region""",
    "readings": """
        SELECT event_id AS id, CAST(user_id AS INTEGER) AS sensor_id, ts AS "timestamp",
          CAST(value * CASE user_id % 6 WHEN 0 THEN 0.5 WHEN 3 THEN 400.0 WHEN 4 THEN 20.0 WHEN 5 THEN 0.1 ELSE 1.0 END
               AS DECIMAL(12,4)) AS value
        FROM events""",
    "repeated": """
        SELECT id, sensor_id, date_trunc('hour', "timestamp") AS "timestamp", value FROM readings""",
    "clock": 'SELECT max("timestamp") AS now FROM readings',
    "alerts": """
        SELECT event_id AS id, CAST(FLOOR(user_id / 6) AS INTEGER) % 5 AS greenhouse_id,
          CAST(FLOOR(user_id / 6) AS INTEGER) AS zone_id, CAST(user_id AS INTEGER) AS sensor_id, t AS alert_type,
          CASE WHEN value >= 100 THEN 'critical' WHEN value >= 10 THEN 'warning' ELSE 'info' END AS severity,
          CASE WHEN rn > 1 THEN 'resolved' WHEN event_id % 2 = 0 THEN 'open' ELSE 'acknowledged' END AS status,
          'alert from sensor ' || CAST(user_id AS VARCHAR) AS message,
          CAST(CAST(value AS DECIMAL(12,4)) AS DOUBLE) AS value, 'n/a' AS threshold, ts AS created_at,
          CASE WHEN rn = 1 AND event_id % 2 = 1 THEN ts END AS acknowledged_at, CASE WHEN rn > 1 THEN ts END AS resolved_at
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, t ORDER BY ts DESC) AS rn
              FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'threshold_high' WHEN 1 THEN 'threshold_low' ELSE 'anomaly' END AS t
                    FROM events WHERE event_type = 'error') x) y""",
    "recommendations": """
        SELECT event_id AS id, CAST(FLOOR(user_id / 6) AS INTEGER) % 5 AS greenhouse_id,
          CAST(FLOOR(user_id / 6) AS INTEGER) AS zone_id, CAST(user_id AS INTEGER) AS sensor_id, t AS recommendation_type,
          CASE WHEN value >= 150 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 15 THEN 'medium' ELSE 'low' END AS priority,
          CASE WHEN rn = 1 THEN 'open' WHEN event_id % 2 = 0 THEN 'dismissed' ELSE 'completed' END AS status,
          'review zone ' || CAST(CAST(FLOOR(user_id / 6) AS INTEGER) AS VARCHAR) AS message,
          'derived from a purchase event' AS reason, ts AS created_at, ts AS updated_at,
          CASE WHEN rn > 1 THEN ts END AS resolved_at
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY FLOOR(user_id / 6), t ORDER BY ts DESC) AS rn
              FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 'irrigation_needed' WHEN 1 THEN 'temperature_high'
                              WHEN 2 THEN 'temperature_low' WHEN 3 THEN 'humidity_high_risk' WHEN 4 THEN 'co2_out_of_range'
                              WHEN 5 THEN 'anomaly_review' ELSE 'yield_risk' END AS t
                    FROM events WHERE event_type = 'purchase') x) y""",
    "records": """
        SELECT record_id,
          CASE pk % 4 WHEN 0 THEN 'Tomato' WHEN 1 THEN 'Cucumber' WHEN 2 THEN 'Lettuce' ELSE 'Pepper' END AS crop_type,
          15.0::DOUBLE + q * 0.3::DOUBLE AS "avg_temperature_C", 9.0::DOUBLE + q * 0.3::DOUBLE AS "min_temperature_C",
          20.0::DOUBLE + q * 0.3::DOUBLE + tx * 10 AS "max_temperature_C",
          CAST(60 + sk % 30 AS DOUBLE) AS humidity_percent, 600.0::DOUBLE + pr / 250 AS co2_ppm,
          10000.0::DOUBLE + pr / 4 AS light_intensity_lux, 10.0::DOUBLE + ds * 40 AS photoperiod_hours,
          CAST(2 + pk % 7 AS DOUBLE) AS irrigation_mm, CAST(60 + pk % 140 AS DOUBLE) AS "fertilizer_N_kg_ha",
          CAST(30 + sk % 70 AS DOUBLE) AS "fertilizer_P_kg_ha", CAST(40 + record_id % 110 AS DOUBLE) AS "fertilizer_K_kg_ha",
          tx * 100 AS pest_severity, 5.5::DOUBLE + ds * 20 AS "soil_pH",
          CAST(60 + record_id % 61 AS INTEGER) AS days_to_maturity,
          3.0::DOUBLE + CASE pk % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END
            - abs(15.0::DOUBLE + q * 0.3::DOUBLE - 23) / 10 + pr / 200000 - tx * 8 - q * tx * 0.15::DOUBLE
            + CAST((record_id * 7919) % 1000 AS DOUBLE) / 2500 - 0.2::DOUBLE AS yield_kg_per_m2
        FROM (SELECT l_orderkey * 10 + l_linenumber AS record_id, min(l_partkey) AS pk, min(l_suppkey) AS sk,
                     min(l_quantity) AS q, min(l_extendedprice) AS pr, min(l_discount) AS ds, min(l_tax) AS tx
              FROM lineitem GROUP BY 1) g""",
    "bounded": """
        SELECT r.id, r.sensor_id, s.sensor_type, r."timestamp", CAST(r.value AS DOUBLE) AS value
        FROM readings r JOIN sensors s ON s.id = r.sensor_id
        WHERE (s.sensor_type = 'temperature' AND r.value BETWEEN -50 AND 80)
           OR (s.sensor_type = 'humidity' AND r.value BETWEEN 0 AND 100)
           OR (s.sensor_type = 'soil_moisture' AND r.value BETWEEN 0 AND 100)
           OR (s.sensor_type = 'light' AND r.value BETWEEN 0 AND 200000)
           OR (s.sensor_type = 'co2' AND r.value BETWEEN 0 AND 10000)
           OR (s.sensor_type = 'irrigation' AND r.value BETWEEN 0 AND 1000)""",
    "deduped": """
        SELECT id, sensor_id, sensor_type, "timestamp", value
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sensor_id, "timestamp" ORDER BY id DESC) AS rn FROM bounded) b
        WHERE rn = 1""",
    "rolled": """
        SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM deduped
        WINDOW w AS (PARTITION BY sensor_id ORDER BY "timestamp" ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)""",
    "clean": """
        SELECT id, sensor_id, sensor_type, "timestamp", value,
          COALESCE(sd > 0 AND abs((value - m) / NULLIF(sd, 0)) > 5.0, FALSE) AS is_outlier
        FROM rolled""",
    "hourly": """
        SELECT s.zone_id, c.sensor_type, date_trunc('hour', c."timestamp") AS hour_utc,
          min(c.value) AS min_value, max(c.value) AS max_value,
          CAST(sum(CAST(c.value AS DECIMAL(12,4))) AS DOUBLE) / count(*) AS avg_value,
          round(stddev_pop(c.value) + 1e-9, 4) AS std_value, count(*) AS sample_count
        FROM clean c JOIN sensors s ON s.id = c.sensor_id WHERE NOT c.is_outlier
        GROUP BY 1, 2, 3""",
    "fact": """
        SELECT c.id AS reading_id, c."timestamp" AS reading_timestamp, date_trunc('hour', c."timestamp") AS hour_utc,
          c.sensor_id, s.zone_id, z.greenhouse_id, c.sensor_type, c.value AS reading_value, c.is_outlier
        FROM clean c JOIN sensors s ON s.id = c.sensor_id JOIN zones z ON z.id = s.zone_id""",
    "ranges": """
        SELECT s.id AS sensor_id, s.zone_id, z.greenhouse_id, s.sensor_type, s.unit,
          CASE s.sensor_type WHEN 'temperature' THEN target_temperature_min WHEN 'humidity' THEN target_humidity_min
               WHEN 'soil_moisture' THEN target_soil_moisture_min END AS target_min,
          CASE s.sensor_type WHEN 'temperature' THEN target_temperature_max WHEN 'humidity' THEN target_humidity_max
               WHEN 'soil_moisture' THEN target_soil_moisture_max END AS target_max
        FROM sensors s JOIN zones z ON z.id = s.zone_id""",
    "alerting": """
        SELECT sensor_id, zone_id, greenhouse_id, sensor_type, unit,
          COALESCE(target_min, CASE WHEN sensor_type = 'co2' THEN 400.0::DOUBLE END) AS range_min,
          COALESCE(target_max, CASE WHEN sensor_type = 'co2' THEN 1500.0::DOUBLE END) AS range_max
        FROM ranges""",
    "latest": """
        SELECT sensor_id, "timestamp", value
        FROM (SELECT sensor_id, "timestamp", CAST(value AS DOUBLE) AS value,
                ROW_NUMBER() OVER (PARTITION BY sensor_id ORDER BY "timestamp" DESC) AS rn FROM readings) r
        WHERE rn = 1""",
    "windowed": """
        SELECT * FROM readings
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-30 12:00:00'""",
    "stats": """
        SELECT sensor_id, CAST(arg_max(value, "timestamp") AS DOUBLE) AS current_value,
          CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value,
          CAST(sum(value) AS DOUBLE) / count(*) AS avg_value, count(*) AS reading_count,
          max("timestamp") AS last_updated
        FROM windowed GROUP BY sensor_id""",
    "summaries": """
        SELECT sensor_id, zone_id, greenhouse_id, sensor_type, unit, current_value, last_updated, min_value, max_value,
          avg_value, reading_count, {status} AS status, target_min, target_max, {deviation} AS deviation_percent
        FROM (SELECT r.*, t.current_value, t.last_updated, t.min_value, t.max_value, t.avg_value,
                COALESCE(t.reading_count, 0) AS reading_count
              FROM ranges r LEFT JOIN stats t ON t.sensor_id = r.sensor_id) x""",
    "zone_status": """
        SELECT z.id AS zone_id, z.greenhouse_id, z.name, z.crop_type,
          CASE COALESCE(max(CASE s.status WHEN 'normal' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END), 0)
               WHEN 0 THEN 'unknown' WHEN 1 THEN 'normal' WHEN 2 THEN 'warning' ELSE 'critical' END AS overall_status,
          count(s.sensor_id) AS sensor_count
        FROM zones z LEFT JOIN summaries s ON s.zone_id = z.id GROUP BY 1, 2, 3, 4""",
    "counts": """
        SELECT g.id AS greenhouse_id,
          (SELECT count(*) FROM alerts a WHERE a.greenhouse_id = g.id AND a.status IN ('open', 'acknowledged')) AS open_alerts_count,
          (SELECT count(*) FROM alerts a WHERE a.greenhouse_id = g.id AND a.status IN ('open', 'acknowledged')
             AND a.severity = 'critical') AS critical_alerts_count,
          (SELECT count(*) FROM recommendations r WHERE r.greenhouse_id = g.id AND r.status = 'open') AS open_recommendations_count,
          (SELECT count(*) FROM recommendations r WHERE r.greenhouse_id = g.id AND r.status = 'open'
             AND r.priority IN ('high', 'critical')) AS high_priority_recommendations_count
        FROM greenhouses g""",
    "recent": """
        SELECT sensor_id, "timestamp", CAST(value AS DOUBLE) AS value, rank
        FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY sensor_id ORDER BY "timestamp" DESC) AS rank
              FROM readings r WHERE "timestamp" >= (SELECT now FROM clock) - INTERVAL 744 HOUR) x""",
    "scores": """
        SELECT sensor_id, count(*) AS n, max(CASE WHEN rank = 1 THEN value END) AS current_value,
          avg(CASE WHEN rank > 1 THEN value END) AS m, stddev_pop(CASE WHEN rank > 1 THEN value END) AS sd
        FROM recent WHERE rank <= 60 GROUP BY sensor_id""",
    "verdicts": """
        SELECT sensor_id, n, current_value, m, sd,
          CASE WHEN n >= 10 THEN CASE WHEN sd < 1e-9 THEN 0.0 ELSE (current_value - m) / sd END END AS z
        FROM scores""",
    "views": """
        SELECT sensor_id, max(CASE WHEN rank = 1 THEN value END) AS current_value, max("timestamp") AS last_timestamp,
          count(CASE WHEN rank <= 2 THEN 1 END) AS wc, min(CASE WHEN rank <= 2 THEN value END) AS wmin,
          max(CASE WHEN rank <= 2 THEN value END) AS wmax,
          CAST(sum(CASE WHEN rank <= 2 THEN CAST(value AS DECIMAL(12,4)) END) AS DOUBLE)
            / count(CASE WHEN rank <= 2 THEN 1 END) AS wavg,
          min(CASE WHEN rank <= 2 THEN "timestamp" END) AS wstart
        FROM recent WHERE rank <= 30 GROUP BY sensor_id""",
    "wide": """
        SELECT z.id AS zone_id, z.greenhouse_id, z.name, z.crop_type, z.target_temperature_min, z.target_temperature_max,
          z.target_humidity_min, z.target_humidity_max, z.target_soil_moisture_min, z.target_soil_moisture_max,
          {wide_columns}
          max(CASE WHEN s.sensor_type = 'temperature' THEN v.wc END) AS temperature_window_count,
          max(CASE WHEN s.sensor_type = 'temperature' THEN v.wmin END) AS temperature_window_min,
          max(CASE WHEN s.sensor_type = 'temperature' THEN v.wmax END) AS temperature_window_max,
          max(CASE WHEN s.sensor_type = 'temperature' THEN v.wavg END) AS temperature_window_avg,
          max(CASE WHEN s.sensor_type = 'temperature' THEN v.wstart END) AS temperature_window_start
        FROM zones z LEFT JOIN sensors s ON s.zone_id = z.id LEFT JOIN views v ON v.sensor_id = s.id
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""",
    "inputs": """
        SELECT * FROM (
          SELECT zone_id, upper(crop_type[1]) || lower(crop_type[2:]) AS crop_type,
            t AS "avg_temperature_C", t - 5.0 AS "min_temperature_C", t + 5.0 AS "max_temperature_C",
            COALESCE(NULLIF(humidity_value, 0), 70.0::DOUBLE) AS humidity_percent,
            COALESCE(NULLIF(co2_value, 0), 800.0::DOUBLE) AS co2_ppm,
            COALESCE(NULLIF(light_value, 0), 20000.0::DOUBLE) AS light_intensity_lux,
            14.0::DOUBLE AS photoperiod_hours, 5.0::DOUBLE AS irrigation_mm, 120.0::DOUBLE AS "fertilizer_N_kg_ha",
            60.0::DOUBLE AS "fertilizer_P_kg_ha", 80.0::DOUBLE AS "fertilizer_K_kg_ha", 2.0::DOUBLE AS pest_severity,
            6.5::DOUBLE AS "soil_pH", 90 AS days_to_maturity
          FROM (SELECT *, COALESCE(NULLIF(temperature_value, 0), 22.0::DOUBLE) AS t FROM wide
                WHERE temperature_sensor_id IS NOT NULL AND humidity_sensor_id IS NOT NULL
                  AND soil_moisture_sensor_id IS NOT NULL AND temperature_value IS NOT NULL) w) i
        WHERE "avg_temperature_C" BETWEEN -10 AND 50 AND "min_temperature_C" BETWEEN -20 AND 40
          AND "max_temperature_C" BETWEEN -5 AND 60 AND humidity_percent BETWEEN 0 AND 100
          AND co2_ppm BETWEEN 0 AND 5000 AND light_intensity_lux BETWEEN 0 AND 100000""",
    "predicted": """
        SELECT zone_id, greatest(0.0::DOUBLE, CAST(printf('%.4f', 4.0::DOUBLE - abs("avg_temperature_C" - 23.0::DOUBLE) / 10) AS DOUBLE))
          AS predicted_yield
        FROM inputs""",
}

HORIZON = "TIMESTAMP '2024-01-21'"  # a day after the evaluation
_TYPES = ("temperature", "humidity", "soil_moisture", "light", "co2", "irrigation")


_PRIME = 2305843009213693951
_NUMBERS = (
    "avg_temperature_C", "min_temperature_C", "max_temperature_C", "humidity_percent", "co2_ppm", "light_intensity_lux",
    "photoperiod_hours", "irrigation_mm", "fertilizer_N_kg_ha", "fertilizer_P_kg_ha", "fertilizer_K_kg_ha", "pest_severity",
    "soil_pH",
)
_FEATURES = (*_NUMBERS, "days_to_maturity", "temp_range_C", "temp_deviation_C", "light_daily_integral", "nutrient_total_kg_ha")
_MOMENTS = [*(f"{name}_scaled" for name in _FEATURES), "yield_kg_per_m2"]
_DOUBLE_TEXT = (
    "CAST(CAST(floor(\"{0}\" * 1048576) AS BIGINT) AS VARCHAR) || '.' || "
    "CAST(CAST(floor((\"{0}\" * 1048576 - floor(\"{0}\" * 1048576)) * 4503599627370496) AS BIGINT) AS VARCHAR)"
)
_RECORD_TEXT = (
    "concat_ws(chr(31), CAST(record_id AS VARCHAR), crop_type, "
    + ", ".join(_DOUBLE_TEXT.format(name) for name in _NUMBERS)
    + ", CAST(days_to_maturity AS VARCHAR), "
    + _DOUBLE_TEXT.format("yield_kg_per_m2")
    + ")"
)


def _yield_ctes() -> dict[str, str]:
    each = ", ".join
    return {
        "parts": """SELECT record_id, crop_type, CASE WHEN r <= n - 2 * h THEN 'train' WHEN r <= n - h THEN 'validation' ELSE 'test' END AS split
            FROM (SELECT *, (15 * n + 50) // 100 AS h FROM (SELECT record_id, crop_type, count(*) OVER (PARTITION BY crop_type) AS n,
              row_number() OVER (PARTITION BY crop_type ORDER BY CAST('0x' || substr(md5('42:' || record_id), 1, 13) AS BIGINT), record_id) AS r
              FROM records) x) y""",
        "incomplete": f"""SELECT *, "max_temperature_C" - "min_temperature_C" AS "temp_range_C", abs("avg_temperature_C" - 23.0::DOUBLE) AS "temp_deviation_C",
              light_intensity_lux * photoperiod_hours AS light_daily_integral,
              "fertilizer_N_kg_ha" + "fertilizer_P_kg_ha" + "fertilizer_K_kg_ha" AS nutrient_total_kg_ha
            FROM (SELECT record_id, split, CASE WHEN record_id % 11 <> 0 THEN r.crop_type END AS crop_type, yield_kg_per_m2,
              {each(f'CASE WHEN record_id % {n} <> 0 THEN "{c}" END AS "{c}"' if n else f'"{c}"' for c in _FEATURES[:14] for n in [{"co2_ppm": 7, "soil_pH": 5}.get(c)])}
            FROM records r JOIN parts USING (record_id)) x""",
        "middle": "SELECT " + each(f'CAST(median("{c}") AS DOUBLE) AS "{c}"' for c in _FEATURES) + " FROM incomplete WHERE split = 'train'",
        "filled": "SELECT record_id, split, yield_kg_per_m2, coalesce(crop_type, (SELECT crop_type FROM incomplete WHERE split = 'train' AND crop_type IS NOT NULL "
        "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS crop, "
        + each(f'coalesce(i."{c}", m."{c}") AS "{c}"' for c in _FEATURES)
        + " FROM incomplete i CROSS JOIN middle m",
        "scale": "SELECT " + each(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in _FEATURES) + " FROM filled WHERE split = 'train'",
        "prepared": "SELECT record_id, split, yield_kg_per_m2, "
        + each(f"CAST(crop = '{c}' AS DOUBLE) AS crop_{i}" for i, c in enumerate(("Cucumber", "Lettuce", "Pepper", "Tomato")))
        + ", "
        + each(f'("{c}" - "m_{c}") / CASE WHEN "s_{c}" > 0 THEN "s_{c}" ELSE 1 END AS "{c}_scaled"' for c in _FEATURES)
        + " FROM filled CROSS JOIN scale",
    }


def _status(value: str, low: str, high: str) -> str:
    distance = f"CASE WHEN {value} < {low} THEN {low} - {value} ELSE {value} - {high} END"
    return f"""CASE WHEN {value} IS NULL OR {low} IS NULL OR {high} IS NULL THEN 'unknown'
        WHEN {value} >= {low} AND {value} <= {high} THEN 'normal' WHEN {high} - {low} <= 0 THEN 'unknown'
        WHEN {distance} <= ({high} - {low}) * 15.0 / 100.0 THEN 'warning' ELSE 'critical' END"""


def _deviation(value: str, low: str, high: str) -> str:
    below = f"-(({low} - {value}) / ({high} - {low})) * 100.0"
    above = f"(({value} - {high}) / ({high} - {low})) * 100.0"
    return f"""CASE WHEN {value} IS NULL OR {low} IS NULL OR {high} IS NULL THEN NULL
        WHEN {value} >= {low} AND {value} <= {high} THEN 0.0::DOUBLE WHEN {high} - {low} <= 0 THEN NULL
        WHEN {value} < {low} THEN CAST(printf('%.2f', {below}) AS DOUBLE)
        ELSE CAST(printf('%.2f', {above}) AS DOUBLE) END"""


def _plain(value: str) -> str:
    return f"regexp_replace(CAST(CAST({value} AS DECIMAL(38,4)) AS VARCHAR), '0{{1,3}}$', '')"


def _compact(value: str, unit: str) -> str:
    return f"(regexp_replace(printf('%.2f', {value}), '\\.?0+$', '') || '{unit}')"


def _label(kind: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN '{t.replace('_', ' ').title()}'" for t in _TYPES)
    return f"CASE {kind} {cases} END"


def _fill(text: str) -> str:
    wide = ", ".join(
        f"max(CASE WHEN s.sensor_type = '{t}' THEN {column} END) AS {t}_{name}"
        for t in _TYPES
        for name, column in (("sensor_id", "s.id"), ("value", "v.current_value"), ("at", "v.last_timestamp"))
    )
    return (
        text.replace("{wide_columns}", wide + ",")
        .replace("{status}", _status("current_value", "target_min", "target_max"))
        .replace("{deviation}", _deviation("current_value", "target_min", "target_max"))
    )


def _threshold_evaluation(horizon: str | None = None) -> str:
    """Both threshold types of every sensor with a range and a reading, not later than a horizon."""
    newest = "latest" if horizon is None else f"""(SELECT sensor_id, CAST(arg_max(value, "timestamp") AS DOUBLE) AS value
        FROM readings WHERE "timestamp" <= {horizon} GROUP BY sensor_id)"""
    status = _status("value", "range_min", "range_max")

    def side(kind: str, fires: str, word: str, limit: str) -> str:
        return f"""SELECT sensor_id, '{kind}' AS alert_type, {fires} AS fired, greenhouse_id, zone_id,
            CASE WHEN {fires} THEN status END AS severity,
            CASE WHEN {fires} THEN {_label('sensor_type')} || ' ' || {_plain('value')} || unit || ' is {word} target '
              || {_plain(limit)} || unit END AS message,
            value, {_plain('range_min')} || '–' || {_plain('range_max')} || ' ' || unit AS threshold FROM judged"""

    outside = "status IN ('warning', 'critical')"
    return f"""WITH judged AS (SELECT a.*, l.value, {status} AS status FROM alerting a JOIN {newest} l ON l.sensor_id = a.sensor_id
          WHERE range_min IS NOT NULL AND range_max IS NOT NULL)
        {side('threshold_high', f'({outside} AND value > range_max)', 'above', 'range_max')}
        UNION ALL
        {side('threshold_low', f'({outside} AND NOT value > range_max)', 'below', 'range_min')}"""


def _anomaly_evaluation(z: float) -> str:
    fires = f"COALESCE(abs(z) > {z}, FALSE)"
    return f"""SELECT v.sensor_id, 'anomaly' AS alert_type, {fires} AS fired, r.greenhouse_id, r.zone_id,
          CASE WHEN {fires} THEN 'warning' END AS severity,
          CASE WHEN {fires} THEN {_label('r.sensor_type')} || ' ' || {_plain('v.current_value')} || r.unit
            || ' is a statistical anomaly (z=' || printf('%.2f', z) || ')' END AS message,
          CASE WHEN v.n >= 10 THEN v.current_value ELSE 0.0 END AS value, 'z>{z}' AS threshold
        FROM verdicts v JOIN ranges r ON r.sensor_id = v.sensor_id"""


def _zone_rule(kind: str, when: str, priority: str, sensor: str, message: str, reason: str) -> str:
    return f"""SELECT '{kind}' AS recommendation_type, {priority} AS priority, greenhouse_id, zone_id,
        {sensor} AS sensor_id, {message} AS message, {reason} AS reason, NULL::BIGINT AS source_id
      FROM context WHERE {when}"""


def _rules() -> dict[str, str]:
    soil, hum, co2 = "soil_moisture_value", "humidity_value", "co2_value"
    slo, shi = "target_soil_moisture_min", "target_soil_moisture_max"
    hlo, hhi = "target_humidity_min", "target_humidity_max"
    tlo, thi = "target_temperature_min", "target_temperature_max"
    irrigation = _zone_rule(
        "irrigation_needed", f"{soil} < {slo}",
        f"CASE WHEN {slo} - {soil} >= ({shi} - {slo}) * 0.5 THEN 'critical' ELSE 'high' END", "soil_moisture_sensor_id",
        f"""'Soil moisture in ' || name || ' is ' || {_compact(soil, '%')} || ', below the target minimum of '
            || {_compact(slo, '%')} || '. Irrigation is recommended.'""",
        f"""'Zone target for soil moisture is ' || {_compact(slo, '%')} || '-' || {_compact(shi, '%')}
            || '. Latest reading from sensor #' || soil_moisture_sensor_id || ' (Soil Moisture) is ' || {_compact(soil, '%')} || '.'""",
    )

    def sustained(kind: str, beyond: str, word: str, action: str, limit: str) -> str:
        minutes = "greatest(1, CAST(floor((epoch_us(temperature_at) - epoch_us(temperature_window_start)) / 60000000.0) AS BIGINT))"
        return _zone_rule(
            kind, f"temperature_window_count >= 2 AND {beyond}", "'high'", "temperature_sensor_id",
            f"""name || ' temperature has been {word} the crop target for the last ~' || {minutes} || ' minutes (avg '
                || {_compact('temperature_window_avg', 'C')} || ' vs target ' || {_compact(tlo, 'C')} || '-' || {_compact(thi, 'C')}
                || '). {action}.'""",
            f"""'Last 2 temperature readings from sensor #' || temperature_sensor_id || ' were all {word} ' || {_compact(limit, 'C')} || '.'""",
        )

    humidity = _zone_rule(
        "humidity_high_risk", f"{hum} > {hhi}", f"CASE WHEN {hum} - {hhi} >= 10 THEN 'high' ELSE 'medium' END",
        "humidity_sensor_id",
        f"""'Humidity in ' || name || ' is ' || {_compact(hum, '%')} || ', above the target maximum of ' || {_compact(hhi, '%')}
            || '. Sustained high humidity increases fungal disease risk.'""",
        f"""'Zone humidity target is ' || {_compact(hlo, '%')} || '-' || {_compact(hhi, '%')}
            || '. Latest reading from sensor #' || humidity_sensor_id || ' is ' || {_compact(hum, '%')} || '.'""",
    )
    carbon = _zone_rule(
        "co2_out_of_range", f"{co2} < 400 OR {co2} > 1500", "'medium'", "co2_sensor_id",
        f"""'CO2 in ' || name || ' is ' || {_compact(co2, ' ppm')} || ', ' || CASE WHEN {co2} > 1500 THEN 'above' ELSE 'below' END
            || ' the acceptable range (400-1500 ppm).'""",
        f"""'Latest CO2 reading from sensor #' || co2_sensor_id || ' is ' || {_compact(co2, ' ppm')}
            || ' against configured bounds 400-1500 ppm.'""",
    )
    review = """SELECT 'anomaly_review' AS recommendation_type,
          CASE WHEN a.severity = 'critical' THEN 'high' ELSE 'medium' END AS priority, a.greenhouse_id, a.zone_id, a.sensor_id,
          'Statistical anomaly detected in ' || CASE WHEN a.zone_id <> 0 THEN c.name ELSE 'zone #' || a.zone_id END
            || '. Review recent readings and confirm sensor integrity.' AS message,
          'Open anomaly alert #' || a.id || ': ' || a.message AS reason, a.id AS source_id
        FROM alerts a JOIN context c ON c.zone_id = a.zone_id
        WHERE a.status IN ('open', 'acknowledged') AND a.alert_type = 'anomaly'"""
    baseline = "CASE crop_type WHEN 'tomato' THEN 4.8::DOUBLE WHEN 'cucumber' THEN 3.6::DOUBLE WHEN 'lettuce' THEN 2.7::DOUBLE WHEN 'pepper' THEN 3.2::DOUBLE END"
    risk = _zone_rule(
        "yield_risk", f"predicted_yield < {baseline} * 0.85::DOUBLE", "'high'", "NULL::INTEGER",
        f"""'Current environmental trends in ' || name || ' may reduce predicted yield to ' || {_compact('predicted_yield', ' kg/m2')}
            || ' (baseline ' || {_compact(baseline, ' kg/m2')} || ').'""",
        f"""'ML model v1 predicts yield ' || printf('%.1f', ({baseline} - predicted_yield) / {baseline} * 100.0::DOUBLE)
            || '% below the ' || crop_type || ' baseline under the zone''s current averaged conditions.'""",
    )
    return {
        "irrigation_needed": irrigation,
        "temperature_high": sustained("temperature_high", f"temperature_window_min > {thi}", "above", "Increase ventilation", thi),
        "temperature_low": sustained("temperature_low", f"temperature_window_max < {tlo}", "below", "Activate heating", tlo),
        "humidity_high_risk": humidity,
        "co2_out_of_range": carbon,
        "anomaly_review": review,
        "yield_risk": risk,
    }


def _check(name: str, violations: str) -> str:
    return f"SELECT '{name}' AS \"check\", CAST(v AS BIGINT) AS violations, v = 0 AS passed FROM ({violations}) q(v)"




def _with(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the body with the expressions it names, directly or through others."""
    known = {**BASE, **(extra or {})}

    def uses(text: str) -> set[str]:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        return {name for name in known if name in words}

    wanted: set[str] = set()
    queue = [body]
    while queue:
        for name in uses(queue.pop()) - wanted:
            wanted.add(name)
            queue.append(known[name])
    ordered = [n for n in known if n in wanted]
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{n} AS ({_fill(known[n])})" for n in ordered) + " " + _fill(body)


_CANDIDATE = "recommendation_type, priority, greenhouse_id, zone_id, sensor_id, message, reason"


def statements() -> dict[str, str]:
    rules = _rules()
    context = {"context": "SELECT w.*, p.predicted_yield FROM wide w LEFT JOIN predicted p ON p.zone_id = w.zone_id"}
    proposed = {
        **context,
        "proposals": " UNION ALL ".join(f"({text})" for text in rules.values()),
        "chosen": f"""SELECT {_CANDIDATE} FROM (SELECT *, ROW_NUMBER() OVER (
            PARTITION BY greenhouse_id, COALESCE(zone_id, 0), recommendation_type ORDER BY source_id DESC NULLS LAST) AS rn
            FROM proposals) x WHERE rn = 1""",
    }
    evaluated = {
        "evaluations": f"SELECT * FROM ({_threshold_evaluation()}) t UNION ALL {_anomaly_evaluation(4.0)}"
    }

    def rule(*names: str) -> str:
        text = " UNION ALL ".join(f"SELECT {_CANDIDATE} FROM ({rules[n]}) {n[0]}_{i}" for i, n in enumerate(names))
        return _with(text, context)

    plain = {
        "stg_sensor_readings": 'SELECT id AS reading_id, sensor_id, sensor_type, "timestamp" AS reading_timestamp, value AS reading_value, is_outlier FROM clean',
        "stg_sensors": "SELECT id AS sensor_id, zone_id, sensor_type, unit, status, created_at FROM sensors",
        "stg_zones": """SELECT id AS zone_id, greenhouse_id, name AS zone_name, crop_type, target_temperature_min,
            target_temperature_max, target_humidity_min, target_humidity_max, target_soil_moisture_min,
            target_soil_moisture_max FROM zones""",
        "stg_greenhouses": "SELECT id AS greenhouse_id, name AS greenhouse_name, location, status, created_at, updated_at FROM greenhouses",
        "stg_alerts": """SELECT id AS alert_id, greenhouse_id, zone_id, sensor_id, alert_type, severity, status, message, value,
            threshold, created_at, acknowledged_at, resolved_at FROM alerts""",
        "dim_date": """SELECT CAST(d AS DATE) AS date_day, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
              CAST(day(d) AS INTEGER) AS day, CAST(dayofweek(d) AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week_of_year
            FROM (SELECT unnest(generate_series(min(CAST("timestamp" AS DATE)), max(CAST("timestamp" AS DATE)), INTERVAL 1 DAY)) AS d
                  FROM clean) x""",
        "fact_sensor_readings": "SELECT * FROM fact",
        "bounds_filter": "SELECT * FROM bounded",
        "dedup_readings": """SELECT id, sensor_id, "timestamp", CAST(value AS DOUBLE) AS value FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY sensor_id, "timestamp" ORDER BY id DESC) AS rn FROM repeated ) x WHERE rn = 1""",
        "rolling_zscore": """SELECT id, sensor_id, "timestamp", value, round(m + 1e-9, 6) AS rolling_mean,
              round(sd + 1e-9, 4) AS rolling_std, COALESCE(sd > 0 AND abs((value - m) / NULLIF(sd, 0)) > 5.0, FALSE) AS is_outlier
            FROM (SELECT id, sensor_id, "timestamp", CAST(value AS DOUBLE) AS value, avg(CAST(value AS DOUBLE)) OVER w AS m,
                    stddev_pop(CAST(value AS DOUBLE)) OVER w AS sd FROM readings
                  WINDOW w AS (PARTITION BY sensor_id ORDER BY "timestamp" ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)) x""",
        "clean_readings": "SELECT * FROM clean",
        "hourly_rollup": "SELECT * FROM hourly",
        "hourly_zone_metrics": "SELECT h.*, z.greenhouse_id FROM hourly h JOIN zones z ON z.id = h.zone_id",
        "daily_greenhouse_metrics": """SELECT greenhouse_id, CAST(reading_timestamp AS DATE) AS metric_date, sensor_type,
              min(reading_value) AS min_value, max(reading_value) AS max_value,
              CAST(sum(CAST(reading_value AS DECIMAL(12,4))) AS DOUBLE) / count(*) AS avg_value,
              round(stddev_pop(reading_value) + 1e-9, 4) AS std_value, count(*) AS sample_count,
              CAST(sum(CASE WHEN is_outlier THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count
            FROM fact WHERE NOT is_outlier GROUP BY 1, 2, 3""",
        "sensor_health_summary": """SELECT sensor_id, zone_id, greenhouse_id, sensor_type, total_readings, outlier_readings,
              CAST(round(CAST(outlier_readings AS DECIMAL(18,6)) * 100 / total_readings, 2) AS DOUBLE) AS outlier_pct, last_seen_at,
              (SELECT now FROM clock ) - last_seen_at < INTERVAL 5 MINUTE AS is_reporting
            FROM (SELECT sensor_id, zone_id, greenhouse_id, sensor_type, count(*) AS total_readings,
                    CAST(sum(CASE WHEN is_outlier THEN 1 ELSE 0 END) AS BIGINT) AS outlier_readings,
                    max(reading_timestamp) AS last_seen_at FROM fact GROUP BY 1, 2, 3, 4) x""",
        "zone_targets_long": " UNION ALL ".join(
            f"SELECT id AS zone_id, greenhouse_id, '{t}' AS sensor_type, target_{t}_min AS target_min, target_{t}_max AS target_max FROM zones"
            for t in ("temperature", "humidity", "soil_moisture")
        ),
        "resolved_ranges": "SELECT * FROM alerting",
        "status_classification": f"""SELECT id, sensor_id, value, {_status('value', 'range_min', 'range_max')} AS status,
              {_deviation('value', 'range_min', 'range_max')} AS deviation_percent
            FROM (SELECT r.id, r.sensor_id, CAST(r.value AS DOUBLE) AS value, a.range_min, a.range_max
                  FROM readings r JOIN alerting a ON a.sensor_id = r.sensor_id) x""",
        "latest_readings": """SELECT r.greenhouse_id, l.sensor_id, r.zone_id, r.sensor_type, r.unit, l.value, l."timestamp"
            FROM latest l JOIN ranges r ON r.sensor_id = l.sensor_id""",
        "sensor_stats": "SELECT * FROM stats",
        "sensor_history": """SELECT id, sensor_id, "timestamp", CAST(value AS DOUBLE) AS value FROM windowed WHERE sensor_id = 7
            ORDER BY "timestamp" DESC, id DESC LIMIT 1000 OFFSET 5""",
        "greenhouse_history": """SELECT id, sensor_id, "timestamp", CAST(value AS DOUBLE) AS value FROM windowed
            WHERE sensor_id IN (SELECT sensor_id FROM ranges WHERE greenhouse_id = 1 AND sensor_type = 'humidity')
            ORDER BY "timestamp" DESC, id DESC LIMIT 1000""",
        "recent_topn": "SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM recent WHERE rank <= 30",
        "multi_window_stats": """SELECT r.sensor_id, w.h AS window_hours,
              min(CAST(r.value AS DOUBLE)) FILTER (r."timestamp" >= now - to_hours(w.h)) AS min_value,
              max(CAST(r.value AS DOUBLE)) FILTER (r."timestamp" >= now - to_hours(w.h)) AS max_value,
              CAST(sum(r.value) FILTER (r."timestamp" >= now - to_hours(w.h)) AS DOUBLE)
                / NULLIF(count(*) FILTER (r."timestamp" >= now - to_hours(w.h)), 0) AS avg_value,
              arg_max(CAST(r.value AS DOUBLE), r."timestamp") FILTER (r."timestamp" >= now - to_hours(w.h)) AS latest_value,
              count(*) FILTER (r."timestamp" >= now - to_hours(w.h)) AS reading_count
            FROM readings r, clock , (VALUES (1), (6), (24), (168)) w(h)
            WHERE r."timestamp" >= now - INTERVAL 168 HOUR GROUP BY 1, 2""",
        "readings_total": "SELECT count(*) AS readings_total FROM readings",
        "history_after": """SELECT id, sensor_id, "timestamp", CAST(value AS DOUBLE) AS value FROM windowed
            WHERE sensor_id = 7 AND ("timestamp" < TIMESTAMP '2024-01-25' OR ("timestamp" = TIMESTAMP '2024-01-25' AND id < 1000))
            ORDER BY "timestamp" DESC, id DESC LIMIT 20""",
        "alerts_after": """SELECT * FROM alerts WHERE severity = 'warning'
              AND (created_at < TIMESTAMP '2024-01-25' OR (created_at = TIMESTAMP '2024-01-25' AND id < 1000))
            ORDER BY created_at DESC, id DESC LIMIT 50""",
        "greenhouse_listing": "SELECT * FROM greenhouses",
        "zones_of_greenhouse": "SELECT * FROM zones",
        "sensors_of_zone": "SELECT * FROM sensors",
        "sensor_summary": "SELECT * FROM summaries",
        "zone_overview": "SELECT * FROM zone_status",
        "greenhouse_overview": """SELECT g.id AS greenhouse_id, g.name, g.location,
              CASE COALESCE(max(CASE z.overall_status WHEN 'normal' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END), 0)
                   WHEN 0 THEN 'unknown' WHEN 1 THEN 'normal' WHEN 2 THEN 'warning' ELSE 'critical' END AS overall_status,
              TIMESTAMP '2024-01-20 00:00:00' AS window_start, TIMESTAMP '2024-01-30 12:00:00' AS window_end,
              count(z.zone_id) AS zone_count, CAST(COALESCE(sum(z.sensor_count), 0) AS BIGINT) AS sensor_count,
              any_value(c.open_alerts_count) AS open_alerts_count, any_value(c.critical_alerts_count) AS critical_alerts_count,
              any_value(c.open_recommendations_count) AS open_recommendations_count,
              any_value(c.high_priority_recommendations_count) AS high_priority_recommendations_count
            FROM greenhouses g JOIN counts c ON c.greenhouse_id = g.id LEFT JOIN zone_status z ON z.greenhouse_id = g.id
            GROUP BY 1, 2, 3""",
        "open_counts": "SELECT * FROM counts",
        "fleet_kpis": """SELECT k.*, c.* FROM (SELECT count(current_value) AS active_sensors,
                count(*) FILTER (status = 'warning') AS warning_count, count(*) FILTER (status = 'critical') AS critical_count,
                CAST(sum(CAST(current_value AS DECIMAL(12,4))) FILTER (sensor_type = 'temperature') AS DOUBLE)
                  / count(current_value) FILTER (sensor_type = 'temperature') AS avg_temperature,
                CAST(sum(CAST(current_value AS DECIMAL(12,4))) FILTER (sensor_type = 'humidity') AS DOUBLE)
                  / count(current_value) FILTER (sensor_type = 'humidity') AS avg_humidity,
                CAST(sum(CAST(current_value AS DECIMAL(12,4))) FILTER (sensor_type = 'soil_moisture') AS DOUBLE)
                  / count(current_value) FILTER (sensor_type = 'soil_moisture') AS avg_soil_moisture FROM summaries ) k,
              (SELECT CAST(sum(open_alerts_count) AS BIGINT) AS open_alerts, CAST(sum(critical_alerts_count) AS BIGINT) AS critical_alerts,
                CAST(sum(open_recommendations_count) AS BIGINT) AS open_recommendations,
                CAST(sum(high_priority_recommendations_count) AS BIGINT) AS high_priority_recommendations FROM counts ) c""",
        "topology": """SELECT g.id AS greenhouse_id, g.name AS greenhouse_name, g.location, g.status, z.id AS zone_id, z.name AS zone_name,
              z.crop_type, z.target_temperature_min, z.target_temperature_max, z.target_humidity_min, z.target_humidity_max,
              z.target_soil_moisture_min, z.target_soil_moisture_max,
              COALESCE(string_agg(s.id || ':' || s.sensor_type || ':' || s.unit || ':' || s.status, ',' ORDER BY s.id), '') AS sensors
            FROM greenhouses g LEFT JOIN zones z ON z.greenhouse_id = g.id LEFT JOIN sensors s ON s.zone_id = z.id
            GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13""",
        "alerts_list": "SELECT * FROM alerts WHERE severity = 'warning' AND status = 'resolved' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10",
        "alerts_list_total": "SELECT count(*) AS total FROM alerts WHERE severity = 'warning' AND status = 'resolved'",
        "recommendations_list": "SELECT * FROM recommendations WHERE priority = 'high' AND status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 50",
        "recommendations_list_total": "SELECT count(*) AS total FROM recommendations WHERE priority = 'high' AND status = 'completed'",
        "alert_banner": """SELECT greenhouse_id, severity, severity_count, CAST(position AS INTEGER) AS position, id AS alert_id, message FROM (
              SELECT *, count(*) OVER (PARTITION BY greenhouse_id, severity) AS severity_count,
                ROW_NUMBER() OVER (PARTITION BY greenhouse_id, severity ORDER BY created_at DESC, id DESC) AS position
              FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY greenhouse_id ORDER BY created_at DESC, id DESC) AS rn
                    FROM alerts WHERE status = 'open') x WHERE rn <= 10 AND severity IN ('critical', 'warning')) y WHERE position <= 3""",
        "anomaly_latest": """SELECT sensor_id, COALESCE(abs(z) > 2.0, FALSE) AS is_anomaly, round(z + 1e-9, 4) AS z_score,
              CASE WHEN n >= 10 THEN current_value END AS current_value, CASE WHEN n >= 10 THEN round(m + 1e-9, 6) END AS mean,
              CASE WHEN n >= 10 THEN round(sd + 1e-9, 4) END AS std FROM verdicts""",
        "threshold_alerts": f"SELECT * EXCLUDE (fired) FROM ({_threshold_evaluation(HORIZON)}) t WHERE fired",
        "anomaly_alerts": f"SELECT * EXCLUDE (fired) FROM ({_anomaly_evaluation(2.0)}) t WHERE fired",
        "alert_transitions": """SELECT id, greenhouse_id, zone_id, sensor_id, alert_type, severity, message, value, threshold, created_at,
              CASE WHEN severity IN ('info', 'warning') AND status <> 'resolved' THEN 'resolved'
                   WHEN severity = 'critical' AND status = 'open' THEN 'acknowledged' ELSE status END AS status,
              CASE WHEN severity = 'critical' AND status = 'open' THEN created_at + INTERVAL 5 MINUTE ELSE acknowledged_at END AS acknowledged_at,
              CASE WHEN severity IN ('info', 'warning') AND status <> 'resolved' THEN created_at + INTERVAL 3 MINUTE ELSE resolved_at END AS resolved_at
            FROM alerts""",
        "zone_wide_view": "SELECT * FROM wide",
        "recommendation_transitions": """SELECT id, greenhouse_id, zone_id, sensor_id, recommendation_type, priority, message, reason, created_at,
              CASE WHEN status = 'open' AND priority = 'high' THEN 'dismissed'
                   WHEN status = 'open' AND priority IN ('medium', 'critical') THEN 'completed' ELSE status END AS status,
              CASE WHEN status = 'open' AND priority = 'high' THEN created_at + INTERVAL 2 HOUR
                   WHEN status = 'open' AND priority IN ('medium', 'critical') THEN created_at + INTERVAL 1 HOUR ELSE updated_at END AS updated_at,
              CASE WHEN status = 'open' AND priority = 'high' THEN created_at + INTERVAL 2 HOUR
                   WHEN status = 'open' AND priority IN ('medium', 'critical') THEN created_at + INTERVAL 1 HOUR ELSE resolved_at END AS resolved_at
            FROM recommendations""",
        "affected_zones": """SELECT DISTINCT s.zone_id FROM sensors s JOIN readings r ON r.sensor_id = s.id
            WHERE r."timestamp" >= (SELECT now FROM clock ) - INTERVAL 6 HOUR""",
        "ingest_validate": """SELECT event_id AS seq, CAST(user_id AS INTEGER) AS sensor_id, ts AS "timestamp",
              CASE WHEN event_type <> 'error' THEN value END AS value,
              CASE WHEN event_type = 'purchase' THEN 'unexpected field' WHEN user_id <= 0 THEN 'sensor_id'
                   WHEN event_type = 'error' THEN 'value' END AS problem
            FROM events""",
        "ingest_stats": """SELECT received, inserted, rejected, received - rejected - inserted AS duplicates FROM (
              SELECT count(*) AS received, count(*) FILTER (i.id IS NULL) AS rejected,
                count(DISTINCT CASE WHEN i.id IS NOT NULL AND r."timestamp" >= TIMESTAMP '2024-01-11 00:00:00'
                  THEN r.sensor_id || ' ' || r."timestamp" END) AS inserted
              FROM repeated r LEFT JOIN inventory i ON i.id = r.sensor_id) x""",
        "dq_freshness": _check("fresh_readings", """SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM readings
            WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 MINUTE"""),
        "dq_gap": _check("no_ingestion_gap", """SELECT CASE WHEN max("timestamp") >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR
            THEN 0 ELSE 1 END FROM readings"""),
        "dq_duplicates": _check("no_duplicates", """SELECT count(*) FROM (SELECT sensor_id, "timestamp" FROM repeated
            GROUP BY 1, 2 HAVING count(*) > 1) d"""),
        "dq_orphans": _check("no_orphans", "SELECT count(*) FROM readings r LEFT JOIN inventory i ON i.id = r.sensor_id WHERE i.id IS NULL"),
        "dq_impossible": _check("no_impossible_values", """SELECT count(*) FROM readings r JOIN sensors s ON s.id = r.sensor_id WHERE
            (s.sensor_type = 'temperature' AND (r.value < -50 OR r.value > 80)) OR (s.sensor_type = 'humidity' AND (r.value < 0 OR r.value > 100))
            OR (s.sensor_type = 'soil_moisture' AND (r.value < 0 OR r.value > 100)) OR (s.sensor_type = 'co2' AND (r.value < 0 OR r.value > 10000))"""),
        "dq_unique": " UNION ALL ".join(
            _check(f"unique:{name}", f"SELECT count(*) FROM (SELECT {keys} FROM {source} GROUP BY {keys} HAVING count(*) > 1) d")
            for name, keys, source in (
                ("readings.id", "id", "readings"), ("sensors.id", "id", "sensors"), ("zones.id", "id", "zones"),
                ("readings.hour", 'sensor_id, "timestamp"', "repeated"),
            )
        ),
        "dq_not_null": _check("not_null:readings", """SELECT count(*) FILTER (id IS NULL) + count(*) FILTER (sensor_id IS NULL)
              + count(*) FILTER ("timestamp" IS NULL) + count(*) FILTER (value IS NULL) FROM readings""")
        + " UNION ALL "
        + _check("not_null:alerts", """SELECT count(*) FILTER (sensor_id IS NULL) + count(*) FILTER (acknowledged_at IS NULL)
              + count(*) FILTER (resolved_at IS NULL) FROM alerts"""),
        "dq_relationships": " UNION ALL ".join(
            _check(f"relationships:{name}", f"SELECT count(*) FROM {child} c WHERE c.{column} IS NOT NULL AND c.{column} NOT IN (SELECT id FROM {parent} )")
            for name, child, column, parent in (
                ("sensors.zone_id", "sensors", "zone_id", "zones"),
                ("zones.greenhouse_id", "zones", "greenhouse_id", "greenhouses"),
                ("readings.sensor_id", "readings", "sensor_id", "inventory"),
            )
        ),
        "dq_accepted_values": " UNION ALL ".join(
            _check(f"accepted_values:{name}", f"SELECT count(*) FROM {source} WHERE {column} NOT IN ({values})")
            for name, source, column, values in (
                ("sensors.sensor_type", "sensors", "sensor_type", "'temperature', 'humidity', 'soil_moisture', 'light', 'co2', 'irrigation'"),
                ("zones.crop_type", "zones", "crop_type", "'tomato', 'lettuce', 'pepper', 'cucumber'"),
                ("alerts.status", "alerts", "status", "'open', 'acknowledged'"),
            )
        ),
        "dq_target_ranges": _check("ordered_targets", """SELECT count(*) FILTER (target_temperature_min >= target_temperature_max)
            + count(*) FILTER (target_humidity_min >= target_humidity_max)
            + count(*) FILTER (target_soil_moisture_min >= target_soil_moisture_max) FROM zones"""),
        "dq_open_unique": _check("one_active_alert", """SELECT count(*) FROM (SELECT sensor_id, alert_type FROM alerts
              WHERE status IN ('open', 'acknowledged') GROUP BY 1, 2 HAVING count(*) > 1) d""")
        + " UNION ALL "
        + _check("one_open_recommendation", """SELECT count(*) FROM (SELECT greenhouse_id, COALESCE(zone_id, 0) AS z, recommendation_type
              FROM recommendations WHERE status = 'open' GROUP BY 1, 2, 3 HAVING count(*) > 1) d"""),
        "yield_features": """SELECT record_id, "max_temperature_C" - "min_temperature_C" AS "temp_range_C",
              abs("avg_temperature_C" - 23.0::DOUBLE) AS "temp_deviation_C", light_intensity_lux * photoperiod_hours AS light_daily_integral,
              "fertilizer_N_kg_ha" + "fertilizer_P_kg_ha" + "fertilizer_K_kg_ha" AS nutrient_total_kg_ha FROM records""",
        "yield_split": "SELECT record_id, crop_type, split FROM parts",
        "yield_medians": "SELECT feature, median FROM (UNPIVOT middle ON COLUMNS(*) INTO NAME feature VALUE median) x",
        "yield_preprocess": "SELECT record_id, split, "
        + ", ".join(f'round("{n}_scaled" + 1e-9, 6) AS "{n}_scaled"' for n in _FEATURES)
        + ", crop_0, crop_1, crop_2, crop_3 FROM prepared",
        "yield_moments": " UNION ALL ".join(
            f"SELECT '{a}' AS first, '{b}' AS second, round(avg(\"{a}\" * \"{b}\") + 1e-9, 6) AS mean_product FROM prepared WHERE split = 'train'"
            for i, a in enumerate(_MOMENTS)
            for b in _MOMENTS[i:]
        ),
        "dataset_fingerprint": f"""SELECT substr(md5((s1 % {_PRIME}) || ':' || (s2 % {_PRIME}) || ':' || row_count), 1, 16) AS fingerprint, row_count
            FROM (SELECT coalesce(sum(CAST('0x' || substr(d, 1, 13) AS BIGINT)), 0) AS s1,
                    coalesce(sum(CAST('0x' || substr(d, 14, 13) AS BIGINT)), 0) AS s2, count(*) AS row_count
                  FROM (SELECT md5({_RECORD_TEXT}) AS d FROM records) x) y""",
        "yield_request_validation": """SELECT record_id, failures, failures = '' AS accepted FROM (SELECT record_id, concat_ws(',',
              CASE WHEN crop_type NOT IN ('Tomato', 'Cucumber', 'Lettuce', 'Pepper') THEN 'crop_type' END, """
        + ", ".join(
            f"""CASE WHEN "{name}" < {low} OR "{name}" > {high} THEN '{name}' END"""
            for name, low, high in (
                ("avg_temperature_C", -10, 50), ("min_temperature_C", -20, 40), ("max_temperature_C", -5, 60),
                ("humidity_percent", 0, 100), ("co2_ppm", 0, 5000), ("light_intensity_lux", 0, 100000),
                ("photoperiod_hours", 0, 24), ("irrigation_mm", 0, 100), ("fertilizer_N_kg_ha", 0, 500),
                ("fertilizer_P_kg_ha", 0, 300), ("fertilizer_K_kg_ha", 0, 400), ("pest_severity", 0, 10),
                ("soil_pH", 3, 10), ("days_to_maturity", 1, 365),
            )
        )
        + ") AS failures FROM records ) x",
        "regression_metrics": """SELECT crop_type, round(avg(abs(y - p)) + 1e-9, 6) AS mae, round(sqrt(avg((y - p) * (y - p))) + 1e-9, 6) AS rmse,
              round(1.0 - avg((y - p) * (y - p)) / var_pop(y) + 1e-9, 6) AS r2,
              round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100 + 1e-9, 4) AS mape, count(*) AS row_count
            FROM (SELECT crop_type, yield_kg_per_m2 AS y, CASE crop_type WHEN 'Tomato' THEN 4.8::DOUBLE WHEN 'Cucumber' THEN 3.6::DOUBLE
                    WHEN 'Lettuce' THEN 2.7::DOUBLE ELSE 3.2::DOUBLE END AS p FROM records ) x GROUP BY crop_type""",
        "zone_yield_inputs": "SELECT * FROM inputs",
    }
    for name in ("greenhouse", "zone", "sensor"):
        plain[f"dim_{name}"] = plain[f"stg_{name}s"]
    prepared = _yield_ctes()
    done = {name: _with(text, prepared if name.startswith("yield_") else None) for name, text in plain.items()}
    done |= {
        "rule_irrigation": rule("irrigation_needed"),
        "sustained_temperature": rule("temperature_high", "temperature_low"),
        "rule_humidity": rule("humidity_high_risk"),
        "rule_co2": rule("co2_out_of_range"),
        "rule_anomaly_review": rule("anomaly_review"),
        "rule_yield_risk": rule("yield_risk"),
        "recommendation_candidates": _with("SELECT * FROM chosen", proposed),
    }
    done["alert_reconcile"] = _with(
        """SELECT a.id, COALESCE(a.greenhouse_id, e.greenhouse_id) AS greenhouse_id, COALESCE(a.zone_id, e.zone_id) AS zone_id,
          COALESCE(a.sensor_id, e.sensor_id) AS sensor_id, COALESCE(a.alert_type, e.alert_type) AS alert_type,
          CASE WHEN e.fired THEN e.severity ELSE a.severity END AS severity,
          CASE WHEN a.id IS NULL THEN 'open' WHEN NOT e.fired THEN 'resolved' ELSE a.status END AS status,
          CASE WHEN e.fired THEN e.message ELSE a.message END AS message, CASE WHEN e.fired THEN e.value ELSE a.value END AS value,
          CASE WHEN e.fired THEN e.threshold ELSE a.threshold END AS threshold,
          COALESCE(a.created_at, (SELECT now FROM clock )) AS created_at, a.acknowledged_at,
          CASE WHEN a.id IS NOT NULL AND NOT e.fired THEN (SELECT now FROM clock ) ELSE a.resolved_at END AS resolved_at,
          CASE WHEN a.id IS NULL THEN 'insert' WHEN e.fired THEN 'update' WHEN NOT e.fired THEN 'resolve' ELSE 'keep' END AS action
        FROM (SELECT * FROM alerts WHERE status IN ('open', 'acknowledged')) a
        FULL OUTER JOIN evaluations e ON e.sensor_id = a.sensor_id AND e.alert_type = a.alert_type
        WHERE a.id IS NOT NULL OR e.fired""",
        evaluated,
    )
    done["recommendation_reconcile"] = _with(
        """SELECT r.id, COALESCE(r.greenhouse_id, c.greenhouse_id) AS greenhouse_id,
          CASE WHEN r.id IS NULL THEN c.zone_id ELSE r.zone_id END AS zone_id,
          CASE WHEN c.message IS NOT NULL THEN c.sensor_id ELSE r.sensor_id END AS sensor_id,
          COALESCE(r.recommendation_type, c.recommendation_type) AS recommendation_type, COALESCE(c.priority, r.priority) AS priority,
          CASE WHEN c.message IS NULL THEN 'completed' ELSE 'open' END AS status, COALESCE(c.message, r.message) AS message,
          COALESCE(c.reason, r.reason) AS reason, COALESCE(r.created_at, (SELECT now FROM clock )) AS created_at,
          (SELECT now FROM clock ) AS updated_at,
          CASE WHEN c.message IS NULL THEN (SELECT now FROM clock ) ELSE r.resolved_at END AS resolved_at,
          CASE WHEN r.id IS NULL THEN 'insert' WHEN c.message IS NULL THEN 'complete' ELSE 'update' END AS action
        FROM (SELECT * FROM recommendations WHERE status = 'open') r
        FULL OUTER JOIN chosen c ON c.greenhouse_id = r.greenhouse_id AND COALESCE(c.zone_id, 0) = COALESCE(r.zone_id, 0)
          AND c.recommendation_type = r.recommendation_type""",
        proposed,
    )
    done["recommendation_reconcile_stats"] = _with(
        """SELECT count(c.message) AS produced, count(*) FILTER (r.id IS NULL) AS created,
          count(*) FILTER (r.id IS NOT NULL AND c.message IS NOT NULL) AS updated,
          count(*) FILTER (c.message IS NULL AND r.zone_id IN (SELECT zone_id FROM touched )) AS closed
        FROM (SELECT * FROM recommendations WHERE status = 'open') r
        FULL OUTER JOIN (SELECT * FROM chosen WHERE zone_id IN (SELECT zone_id FROM touched )) c
          ON c.greenhouse_id = r.greenhouse_id AND COALESCE(c.zone_id, 0) = COALESCE(r.zone_id, 0)
          AND c.recommendation_type = r.recommendation_type""",
        {**proposed, "touched": plain["affected_zones"]},
    )
    return done
