"""Oracle SQL of every registered query, written independently of the operators.

Each statement starts from the same derivation of the publication history from
``events`` and may use any of the shared relations below it.
"""

from __future__ import annotations

from vintager.functions.labels import FUEL_LABELS
from vintager.plans.serving import METHODOLOGY


def _lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _pct(part: str, whole: str, digits: int) -> str:
    """Half-up percentage of non-negative integers, in exact integer arithmetic."""
    scale = 100 * 10**digits
    exact = f"((CAST({part} AS BIGINT) * {2 * scale} + CAST({whole} AS BIGINT))"
    return f"({exact} // (2 * CAST({whole} AS BIGINT))) / {10**digits}.0)"


# Shared relations, in order of dependency: name -> (needs, text).
RELATIONS: dict[str, tuple[list[str], str]] = {
    "e": (
        [],
        """SELECT event_id, user_id, value, ts,
             CASE WHEN hour(ts) >= 12 THEN date_trunc('day', ts) + INTERVAL 12 HOURS
                  ELSE date_trunc('day', ts) END AS pt
           FROM events""",
    ),
    "k": (
        ["e"],
        """SELECT *, CAST(FLOOR((day(pt) - 1) / 5) AS INT) AS blk,
                  CAST(event_id % 2 AS INT) AS lead_no FROM e""",
    ),
    "c": (
        ["k"],
        """SELECT user_id, pt, DATE '2024-01-01' + CAST(5 * (blk + 1) + 5 * lead_no AS INT) AS fd,
                  max_by(value, event_id) AS v, MAX(ts) AS collected_at
           FROM k GROUP BY 1, 2, 3""",
    ),
    "canon": (
        ["c"],
        """SELECT 'SYNTH' AS dataset,
             CASE WHEN user_id % 50 = 7 AND pt >= TIMESTAMP '2024-01-16 00:00:00' THEN 'OTHER'
                  WHEN user_id % 8 = 0 THEN 'CCGT' WHEN user_id % 8 = 1 THEN 'OCGT'
                  WHEN user_id % 8 = 2 THEN 'NUCLEAR' WHEN user_id % 8 = 3 THEN 'WIND'
                  WHEN user_id % 8 = 4 THEN 'BIOMASS' WHEN user_id % 8 = 5 THEN 'PS'
                  WHEN user_id % 8 = 6 THEN 'INTFR' ELSE 'INTNED' END AS fuelType,
             CONCAT('UNIT-', CAST(user_id AS STRING)) AS nationalGridBmUnit,
             CASE WHEN user_id % 3 = 0 THEN NULL
                  ELSE CONCAT('T_UNIT-', CAST(user_id AS STRING)) END AS bmUnit,
             pt AS publishTime, fd AS forecastDate,
             CAST(FLOOR(v / 20) * 20 AS BIGINT) AS outputUsable, collected_at AS collectedAt
           FROM c""",
    ),
    "stored": (
        ["canon"],
        "SELECT * FROM canon WHERE publishTime < TIMESTAMP '2024-01-25 00:00:00'",
    ),
    # A last publication without an overlap, and the newest pair that has revisions before it.
    "ended": (
        ["canon"],
        """SELECT * FROM canon UNION ALL
           SELECT dataset, fuelType, nationalGridBmUnit, bmUnit, publishTime + INTERVAL 12 HOURS,
             forecastDate + 400, outputUsable, collectedAt
           FROM canon WHERE publishTime = (SELECT MAX(publishTime) FROM canon)""",
    ),
    "dup": (
        ["canon"],
        """SELECT * FROM canon UNION ALL SELECT * FROM canon
           WHERE CAST(substr(nationalGridBmUnit, 6) AS INT) % 10 = 0""",
    ),
    "dirty": (
        ["canon"],
        """SELECT dataset,
             CASE WHEN n % 13 = 3 THEN NULL ELSE fuelType END AS fuelType,
             nationalGridBmUnit, bmUnit, publishTime, forecastDate,
             CASE WHEN n % 11 = 2 THEN NULL WHEN outputUsable = 0 AND n % 7 = 1 THEN -20
                  ELSE outputUsable END AS outputUsable, collectedAt
           FROM (SELECT *, CAST(substr(nationalGridBmUnit, 6) AS INT) AS n FROM canon)""",
    ),
    "dupdirty": (
        ["dirty"],
        """SELECT * FROM dirty UNION ALL SELECT * FROM dirty
           WHERE CAST(substr(nationalGridBmUnit, 6) AS INT) % 10 = 0""",
    ),
    "drifted": (
        ["canon"],
        """SELECT * EXCLUDE (n, p, copy) FROM (
             SELECT * REPLACE (
               CASE WHEN p = 31 AND n % 12 = 6 THEN '' ELSE bmUnit END AS bmUnit,
               CASE WHEN p = 25 AND n % 29 = 7 THEN outputUsable + 1 ELSE outputUsable END
                 AS outputUsable), unnest(CASE WHEN p = 9 AND n % 19 = 3 THEN []
                   WHEN p = 17 AND n % 23 = 5 THEN [1, 2] ELSE [1] END) AS copy
             FROM (SELECT *, CAST(substr(nationalGridBmUnit, 6) AS INT) AS n,
               2 * day(publishTime) - CASE WHEN hour(publishTime) < 12 THEN 1 ELSE 0 END AS p
               FROM canon))""",
    ),
    "drift": (
        ["canon", "drifted"],
        """SELECT dataset, fuelType, nationalGridBmUnit, bmUnit, publishTime, forecastDate, outputUsable,
             collectedAt, CAST(SUM(l) AS BIGINT) AS left_copies, CAST(SUM(r) AS BIGINT) AS right_copies
           FROM (SELECT *, 1 AS l, 0 AS r FROM canon UNION ALL SELECT *, 0, 1 FROM drifted)
           GROUP BY ALL HAVING SUM(l) <> SUM(r)""",
    ),
    "fuels": (
        [],
        "SELECT * FROM (VALUES "
        + ", ".join("({})".format(", ".join(map(_lit, row))) for row in FUEL_LABELS)
        + ") AS t(code, long_name, short_name)",
    ),
    # Histories and revisions against the last appearance.
    "fhist": (
        ["canon"],
        """SELECT publishTime, forecastDate, fuelType, CAST(SUM(outputUsable) AS BIGINT) AS availableMW
           FROM canon GROUP BY ALL""",
    ),
    "shist": (
        ["canon"],
        """SELECT publishTime, forecastDate, CAST(SUM(outputUsable) AS BIGINT) AS availableMW
           FROM canon GROUP BY ALL""",
    ),
    "urev": (
        ["canon"],
        """SELECT dataset, fuelType, nationalGridBmUnit, bmUnit, publishTime AS latestPublishTime,
             forecastDate, outputUsable AS latestAvailableMW, collectedAt, previousPublishTime,
             previousAvailableMW, previousFuelType,
             outputUsable - previousAvailableMW AS revisionMW,
             CASE WHEN outputUsable > previousAvailableMW THEN 'up'
                  WHEN outputUsable < previousAvailableMW THEN 'down'
                  ELSE 'unchanged' END AS revisionDirection,
             fuelType IS DISTINCT FROM previousFuelType AS fuelTypeChanged
           FROM (SELECT *, lag(publishTime) OVER s AS previousPublishTime,
                   lag(outputUsable) OVER s AS previousAvailableMW,
                   lag(fuelType) OVER s AS previousFuelType
                 FROM canon
                 WINDOW s AS (PARTITION BY nationalGridBmUnit, forecastDate ORDER BY publishTime))
           WHERE previousPublishTime IS NOT NULL""",
    ),
    "frev": (
        ["fhist"],
        """SELECT fuelType, forecastDate, publishTime AS latestPublishTime,
             availableMW AS latestAvailableMW, previousPublishTime, previousAvailableMW,
             availableMW - previousAvailableMW AS revisionMW,
             CASE WHEN availableMW > previousAvailableMW THEN 'up'
                  WHEN availableMW < previousAvailableMW THEN 'down'
                  ELSE 'unchanged' END AS revisionDirection
           FROM (SELECT *, lag(publishTime) OVER s AS previousPublishTime,
                   lag(availableMW) OVER s AS previousAvailableMW
                 FROM fhist WINDOW s AS (PARTITION BY fuelType, forecastDate ORDER BY publishTime))
           WHERE previousPublishTime IS NOT NULL""",
    ),
    "srev": (
        ["shist"],
        """SELECT forecastDate, publishTime AS latestPublishTime,
             availableMW AS latestAvailableMW, previousPublishTime, previousAvailableMW,
             availableMW - previousAvailableMW AS revisionMW,
             CASE WHEN availableMW > previousAvailableMW THEN 'up'
                  WHEN availableMW < previousAvailableMW THEN 'down'
                  ELSE 'unchanged' END AS revisionDirection
           FROM (SELECT *, lag(publishTime) OVER s AS previousPublishTime,
                   lag(availableMW) OVER s AS previousAvailableMW
                 FROM shist WINDOW s AS (PARTITION BY forecastDate ORDER BY publishTime))
           WHERE previousPublishTime IS NOT NULL""",
    ),
    "win": (
        ["urev"],
        """SELECT * FROM urev WHERE
             latestPublishTime > (SELECT MAX(latestPublishTime) FROM urev) - INTERVAL 24 HOURS
             AND latestPublishTime <= (SELECT MAX(latestPublishTime) FROM urev)""",
    ),
    "fwin": (
        ["frev"],
        """SELECT * FROM frev WHERE
             latestPublishTime > (SELECT MAX(latestPublishTime) FROM frev) - INTERVAL 24 HOURS
             AND latestPublishTime <= (SELECT MAX(latestPublishTime) FROM frev)""",
    ),
    # Publication calendar and revisions against the adjacent publication.
    **{
        name: (
            [source],
            f"""SELECT publishTime, lag(publishTime) OVER (ORDER BY publishTime) AS previousPublishTime,
                 lead(publishTime) OVER (ORDER BY publishTime) AS nextPublishTime,
                 row_number() OVER (ORDER BY publishTime) AS publicationNumber
               FROM (SELECT DISTINCT publishTime FROM {source})""",
        )
        for name, source in (("cal", "canon"), ("calended", "ended"))
    },
    **{
        name: (
            [times, source],
            f"""SELECT l.nationalGridBmUnit, l.fuelType, l.forecastDate, p.publishTime AS previousPublishTime,
                 p.outputUsable AS previousAvailableMW, l.publishTime AS latestPublishTime,
                 l.outputUsable AS latestAvailableMW, l.outputUsable - p.outputUsable AS revisionMW,
                 abs(l.outputUsable - p.outputUsable) AS absoluteRevisionMW,
                 CASE WHEN l.outputUsable > p.outputUsable THEN 'UP'
                      WHEN l.outputUsable < p.outputUsable THEN 'DOWN'
                      ELSE 'UNCHANGED' END AS changeDirection,
                 coalesce(p.outputUsable > 0 AND l.outputUsable = 0, false) AS becameUnavailable,
                 coalesce(p.outputUsable = 0 AND l.outputUsable > 0, false) AS returnedAvailable
               FROM {source} l JOIN {times} cal ON cal.publishTime = l.publishTime
               JOIN {source} p ON p.publishTime = cal.previousPublishTime
                AND p.nationalGridBmUnit = l.nationalGridBmUnit AND p.forecastDate = l.forecastDate
                AND p.fuelType IS NOT DISTINCT FROM l.fuelType""",
        )
        for name, source, times in (
            ("prev", "canon", "cal"), ("prevdirty", "dirty", "cal"), ("prevended", "ended", "calended")
        )
    },
    "pair": (
        ["prev"],
        "SELECT * FROM prev WHERE latestPublishTime = (SELECT MAX(publishTime) FROM canon)",
    ),
    "goldpair": (
        ["prevended"],
        """SELECT * FROM prevended WHERE (latestPublishTime, previousPublishTime) =
             (SELECT (latestPublishTime, previousPublishTime) FROM prevended ORDER BY 1 DESC LIMIT 1)""",
    ),
    **{
        name: (
            [source],
            f"""SELECT previousPublishTime, latestPublishTime, forecastDate{groups},
                 CAST(coalesce(SUM(previousAvailableMW), 0) AS BIGINT) AS previousAvailableMW,
                 CAST(coalesce(SUM(latestAvailableMW), 0) AS BIGINT) AS latestAvailableMW,
                 CAST(coalesce(SUM(revisionMW), 0) AS BIGINT) AS revisionMW,
                 COUNT(*) FILTER (WHERE revisionMW IS NULL OR revisionMW <> 0) AS changedUnits,
                 COUNT(*) FILTER (WHERE becameUnavailable) AS becameUnavailableUnits,
                 COUNT(*) FILTER (WHERE returnedAvailable) AS returnedAvailableUnits
               FROM {source} {where} GROUP BY ALL""",
        )
        for name, source, groups, where in (
            ("pfuel", "prev", ", fuelType", ""),
            ("pfueldirty", "prevdirty", ", fuelType", "WHERE fuelType IS NOT NULL"),
            ("psys", "prev", "", ""),
            ("lastfuel", "goldpair", ", fuelType", ""),
            ("lastsys", "goldpair", "", ""),
        )
    },
    **{
        name: (
            [source],
            f"""SELECT publishTime, forecastDate{groups},
                 CAST(coalesce(SUM(outputUsable), 0) AS BIGINT) AS {total},
                 COUNT(DISTINCT nationalGridBmUnit) AS bm_units,
                 COUNT(*) FILTER (WHERE outputUsable = 0) AS zero_availability_units
               FROM {source} {where} GROUP BY ALL""",
        )
        for name, source, groups, total, where in (
            ("favail", "canon", ", fuelType", "available_mw", ""),
            ("favaildirty", "dirty", ", fuelType", "available_mw", "WHERE fuelType IS NOT NULL"),
            ("savail", "canon", "", "total_available_mw", ""),
            ("savaildirty", "dirty", "", "total_available_mw", ""),
        )
    },
    # Gold.
    "outlook": (
        ["favail"],
        """SELECT publishTime AS publish_time, forecastDate AS forecast_date,
             CAST(SUM(available_mw) AS DOUBLE) AS total_available_mw,
             CAST(SUM(CASE WHEN fuelType LIKE 'INT%' THEN available_mw ELSE 0 END) AS DOUBLE)
               AS interconnector_available_mw,
             CAST(SUM(CASE WHEN fuelType NOT LIKE 'INT%' THEN available_mw ELSE 0 END) AS DOUBLE)
               AS gb_generation_storage_available_mw,
             CAST(SUM(bm_units) AS BIGINT) AS bm_unit_records,
             CAST(SUM(zero_availability_units) AS BIGINT) AS zero_availability_units
           FROM favail WHERE publishTime = (SELECT MAX(publishTime) FROM favail)
           GROUP BY ALL""",
    ),
    "changed": (
        ["goldpair"],
        """SELECT previousPublishTime AS previous_publish_time, latestPublishTime AS latest_publish_time,
             forecastDate AS forecast_date, nationalGridBmUnit AS national_grid_bm_unit,
             fuelType AS fuel_type, CAST(previousAvailableMW AS DOUBLE) AS previous_available_mw,
             CAST(latestAvailableMW AS DOUBLE) AS latest_available_mw,
             CAST(revisionMW AS DOUBLE) AS revision_mw,
             CAST(absoluteRevisionMW AS DOUBLE) AS absolute_revision_mw,
             changeDirection AS change_direction, becameUnavailable AS became_unavailable,
             returnedAvailable AS returned_available
           FROM goldpair WHERE revisionMW <> 0""",
    ),
    "gsys": (
        ["lastsys"],
        """SELECT previousPublishTime AS previous_publish_time, latestPublishTime AS latest_publish_time,
             forecastDate AS forecast_date, CAST(previousAvailableMW AS DOUBLE) AS previous_available_mw,
             CAST(latestAvailableMW AS DOUBLE) AS latest_available_mw,
             CAST(revisionMW AS DOUBLE) AS revision_mw, changedUnits AS changed_units,
             becameUnavailableUnits AS became_unavailable_units,
             returnedAvailableUnits AS returned_available_units
           FROM lastsys""",
    ),
    "runs": (
        ["canon", "cal"],
        """SELECT publicationNumber AS pipeline_run_id, 'publication_run' AS pipeline_name,
             'SYNTH' AS source_dataset, publishTime AS source_publish_time,
             CASE WHEN publicationNumber % 7 <> 0 THEN n END AS rows_processed,
             CASE WHEN publicationNumber % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
             publishTime AS started_at, completed_at,
             CASE WHEN publicationNumber % 7 = 0
                  THEN concat('Stage ''load'' failed: run ', CAST(publicationNumber AS STRING))
                  END AS error_message
           FROM cal JOIN (SELECT publishTime, MAX(collectedAt) AS completed_at, COUNT(*) AS n
                          FROM canon GROUP BY 1) USING (publishTime)""",
    ),
    "health": (
        ["runs"],
        """SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::DOUBLE
             AS duration_seconds
           FROM runs ORDER BY pipeline_run_id DESC LIMIT 1""",
    ),
    # Serving.
    "near": (
        ["fhist"],
        """SELECT fuelType, CAST(SUM(availableMW) AS BIGINT) AS mw FROM fhist
           WHERE publishTime = (SELECT MAX(publishTime) FROM fhist)
             AND forecastDate = (SELECT MIN(forecastDate) FROM fhist
                   WHERE publishTime = (SELECT MAX(publishTime) FROM fhist)
                     AND forecastDate >= publishTime)
           GROUP BY 1""",
    ),
    "mix": (
        ["near", "fuels"],
        f"""SELECT fuelType AS fuel_type, concat(coalesce(long_name, fuelType), ' (', fuelType, ')') AS fuel_label,
              coalesce(short_name, fuelType) AS short_label, mw AS available_mw,
              CASE WHEN total > 0 THEN {_pct("mw", "total", 1)} ELSE 0.0 END AS share_pct
            FROM (SELECT *, SUM(mw) OVER () AS total FROM near) LEFT JOIN fuels ON code = fuelType""",
    ),
    "movers": (
        ["win", "fuels"],
        """SELECT coalesce(nationalGridBmUnit, bmUnit, 'Unknown unit') AS unit,
             coalesce(fuelType, 'Unknown') AS fuel_type, coalesce(long_name, fuelType, 'Unknown') AS fuel_label,
             revisionDirection AS direction, revisionMW AS revision_mw,
             forecastDate AS forecast_date, latestPublishTime AS publication_time
           FROM win LEFT JOIN fuels ON code = fuelType WHERE revisionMW <> 0""",
    ),
    "up": (
        ["movers"],
        """SELECT * EXCLUDE (direction) FROM movers WHERE revision_mw > 0
           ORDER BY revision_mw DESC, publication_time DESC, unit, forecast_date LIMIT 1""",
    ),
    "down": (
        ["movers"],
        """SELECT * EXCLUDE (direction) FROM movers WHERE revision_mw < 0
           ORDER BY revision_mw, publication_time DESC, unit, forecast_date LIMIT 1""",
    ),
    "topfuel": (
        ["movers"],
        """SELECT fuel_type, fuel_label, CAST(SUM(abs(revision_mw)) AS BIGINT) AS absolute_revision_mw,
             CAST(SUM(revision_mw) AS BIGINT) AS net_revision_mw, COUNT(*) AS revision_records
           FROM movers GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1""",
    ),
    "dirs": (
        ["urev"],
        f"""SELECT revisionDirection AS direction, n AS count, {_pct("n", "total", 2)} AS share_pct
            FROM (SELECT *, SUM(n) OVER () AS total FROM
                  (SELECT revisionDirection, COUNT(*) AS n FROM urev GROUP BY 1))""",
    ),
}

_WATCH = "Latest 24-hour revision activity is net {} across the represented fuel categories."

QUERIES: dict[str, tuple[list[str], str]] = {
    "q_canonical_history": (["canon"], "SELECT * FROM canon"),
    "q_publication_calendar": (["cal"], "SELECT * FROM cal"),
    "q_latest_publication": (
        ["canon"],
        "SELECT * FROM canon WHERE publishTime = (SELECT MAX(publishTime) FROM canon)",
    ),
    "q_latest_two_publications": (
        ["canon"],
        """SELECT * FROM canon WHERE publishTime IN
             (SELECT DISTINCT publishTime FROM canon ORDER BY 1 DESC LIMIT 2)""",
    ),
    "q_filter_fuels_units": (
        ["canon"],
        "SELECT * FROM canon WHERE fuelType IN ('CCGT', 'WIND', 'INTFR')",
    ),
    "q_filter_units": (
        ["canon"],
        "SELECT * FROM canon WHERE nationalGridBmUnit IN ('UNIT-3', 'UNIT-17', 'UNIT-40', 'UNIT-x')",
    ),
    "q_mixed_snapshots": (
        ["canon"],
        """SELECT dataset, fuelType, nationalGridBmUnit, bmUnit, publishTime,
             CASE WHEN p <> 2 OR n % 17 <> 0 THEN forecastDate END AS forecastDate,
             CASE WHEN p = 0 THEN CAST(outputUsable AS DOUBLE)
               WHEN p = 1 AND n % 13 <> 1 THEN outputUsable + 0.125::DOUBLE
               WHEN p = 2 AND n % 11 <> 0 THEN CAST(outputUsable AS DOUBLE) END AS outputUsable,
             collectedAt
           FROM (SELECT *, CAST(substr(nationalGridBmUnit, 6) AS INT) AS n,
             (2 * day(publishTime) - CASE WHEN hour(publishTime) < 12 THEN 1 ELSE 0 END) % 3 AS p
             FROM canon)""",
    ),
    "q_publish_range": (
        ["canon"],
        """SELECT * FROM canon WHERE publishTime BETWEEN
             TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""",
    ),
    "q_source_details": (
        ["canon"],
        """SELECT publishTime, COUNT(*) AS rows, CAST(1 AS BIGINT) AS publications FROM canon
           GROUP BY 1 ORDER BY 1 DESC LIMIT 1""",
    ),
    "q_split_publications": (
        ["canon"],
        "SELECT *, strftime(publishTime, '%Y%m%dT%H%M%SZ') AS publish_stamp FROM canon",
    ),
    "q_publication_summary": (
        ["canon"],
        """SELECT publishTime, COUNT(*) AS rows, COUNT(DISTINCT nationalGridBmUnit) AS units,
             COUNT(DISTINCT forecastDate) AS forecastDates, COUNT(DISTINCT fuelType) AS fuelTypes
           FROM canon GROUP BY 1""",
    ),
    "q_new_publications": (
        ["canon", "stored"],
        "SELECT * FROM canon WHERE publishTime NOT IN (SELECT publishTime FROM stored)",
    ),
    "q_ingest_outcome": (
        ["canon"],
        """SELECT * FROM (WITH numbered AS (
             SELECT *, CAST(substr(nationalGridBmUnit, 6) AS INT) AS n,
               2 * day(publishTime) - CASE WHEN hour(publishTime) < 12 THEN 1 ELSE 0 END AS p
             FROM canon),
           landed AS (
             SELECT * REPLACE (CASE WHEN p % 7 = 5 AND n % 97 = 5 THEN NULL ELSE publishTime END
                 AS publishTime), unnest(CASE
               WHEN p % 7 = 3 AND n % 10 = 0 THEN ['a', 'a'] WHEN p % 5 = 2 THEN ['a', 'b']
               WHEN p % 5 = 1 AND n % 2 = 1 THEN ['b'] ELSE ['a'] END) AS file
             FROM numbered),
           firsts AS (
             SELECT * FROM landed WHERE publishTime IS NOT NULL
             QUALIFY file = min(file) OVER (
               PARTITION BY nationalGridBmUnit, publishTime, forecastDate)),
           keys AS (
             SELECT publishTime, count(*) AS n FROM firsts
             GROUP BY publishTime, nationalGridBmUnit, forecastDate),
           fresh AS (
             SELECT publishTime, CAST(sum(n) AS BIGINT) AS n,
               CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS shared
             FROM keys GROUP BY publishTime),
           given AS (
             SELECT publishTime, max(p) AS p, count(*) AS n FROM landed GROUP BY publishTime)
           SELECT publishTime,
             CASE WHEN publishTime IS NULL OR old OR p % 11 = 4 THEN given.n ELSE fresh.n END AS rows,
             CASE WHEN publishTime IS NULL THEN 'rejected' WHEN old THEN 'existing'
               WHEN p % 11 = 4 THEN 'quarantined' WHEN shared > 0 THEN 'rejected'
               ELSE 'created' END AS status,
             CASE WHEN publishTime IS NULL THEN 'no publication time'
               WHEN NOT old AND p % 11 <> 4 AND shared > 0
               THEN shared || ' rows share a source key' END AS reason
           FROM (SELECT *, publishTime < TIMESTAMP '2024-01-25 00:00:00' AS old FROM given) AS given
           LEFT JOIN fresh USING (publishTime))""",
    ),
    "q_publication_manifest": (
        ["canon"],
        """SELECT publishTime, COUNT(*) AS rows, CAST(8 AS BIGINT) AS columns,
             COUNT(DISTINCT nationalGridBmUnit) AS distinct_units,
             COUNT(DISTINCT bmUnit) AS distinct_aliases, COUNT(DISTINCT fuelType) AS distinct_groups,
             MIN(forecastDate) AS earliest_target, MAX(forecastDate) AS latest_target
           FROM canon GROUP BY 1""",
    ),
    "q_raw_load_status": (
        ["canon", "stored"],
        """SELECT publishTime, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.publishTime = c1.publishTime)
             THEN 'already_loaded' ELSE 'loaded' END AS status, COUNT(*) AS rows
           FROM canon c1 GROUP BY 1""",
    ),
    "q_upsert_fuel": (
        ["favail"],
        """SELECT publishTime, forecastDate, fuelType,
             CASE WHEN publishTime < TIMESTAMP '2024-01-20 00:00:00' THEN available_mw + 1
                  ELSE available_mw END AS available_mw, bm_units, zero_availability_units
           FROM favail""",
    ),
    "q_upsert_system": (
        ["savail"],
        """SELECT publishTime AS publish_time, forecastDate AS forecast_date,
             CAST(total_available_mw + CASE WHEN publishTime < TIMESTAMP '2024-01-20 00:00:00' THEN 1
               ELSE 0 END AS DOUBLE) AS total_available_mw, bm_units, zero_availability_units
           FROM savail""",
    ),
    "q_upsert_generic": (
        ["prev"],
        """SELECT previousPublishTime AS previous_publish_time, latestPublishTime AS latest_publish_time,
             forecastDate AS forecast_date, nationalGridBmUnit AS national_grid_bm_unit,
             fuelType AS fuel_type, CAST(previousAvailableMW AS DOUBLE) AS previous_available_mw,
             CAST(latestAvailableMW AS DOUBLE) AS latest_available_mw,
             CAST(revisionMW + CASE WHEN latestPublishTime < TIMESTAMP '2024-01-20 00:00:00'
                  THEN 1 ELSE 0 END AS DOUBLE) AS revision_mw,
             CAST(absoluteRevisionMW AS DOUBLE) AS absolute_revision_mw,
             changeDirection AS change_direction, becameUnavailable AS became_unavailable,
             returnedAvailable AS returned_available FROM prev""",
    ),
    "q_upsert_null_times": (
        ["canon"],
        """SELECT * FROM (WITH rows AS (
             SELECT CASE WHEN fuelType <> 'WIND' THEN publishTime END AS publishTime, forecastDate,
               fuelType, CAST(SUM(outputUsable) AS BIGINT) AS available_mw
             FROM canon GROUP BY ALL)
           SELECT publishTime, forecastDate, fuelType,
             available_mw + CASE WHEN day(forecastDate) >= 11 THEN 20 ELSE 0 END AS available_mw
           FROM rows WHERE day(forecastDate) <= 21 OR day(forecastDate) >= 11)""",
    ),
    "q_verify_load": (
        ["canon", "stored"],
        """SELECT publishTime, a.n AS source_rows, coalesce(b.n, 0) AS target_rows,
             a.n = coalesce(b.n, 0) AS complete
           FROM (SELECT publishTime, COUNT(*) AS n FROM canon GROUP BY 1) a
           FULL JOIN (SELECT publishTime, COUNT(*) AS n FROM stored GROUP BY 1) b USING (publishTime)""",
    ),
    "q_duplicate_keys": (
        ["dup"],
        """SELECT nationalGridBmUnit, publishTime, forecastDate, COUNT(*) AS rows FROM dup
           GROUP BY ALL HAVING COUNT(*) > 1""",
    ),
    "q_duplicate_rows": (
        ["dup"],
        """SELECT COUNT(*) AS duplicate_source_keys, CAST(SUM(n) AS BIGINT) AS duplicate_key_rows FROM
             (SELECT COUNT(*) AS n FROM dup GROUP BY nationalGridBmUnit, publishTime, forecastDate
              HAVING COUNT(*) > 1)""",
    ),
    "q_quality_report": (
        ["dupdirty"],
        """SELECT COUNT(*) AS rows, COUNT(DISTINCT publishTime) AS publications,
             (SELECT COUNT(*) FROM (SELECT 1 FROM dupdirty
                GROUP BY nationalGridBmUnit, publishTime, forecastDate HAVING COUNT(*) > 1))
               AS duplicate_source_keys,
             COUNT(*) FILTER (WHERE nationalGridBmUnit IS NULL) AS null_national_grid_bm_units,
             COUNT(*) FILTER (WHERE publishTime IS NULL) AS null_publish_times,
             COUNT(*) FILTER (WHERE forecastDate IS NULL) AS null_forecast_dates,
             COUNT(*) FILTER (WHERE outputUsable IS NULL) AS null_output_usable
           FROM dupdirty""",
    ),
    "q_ingest_report": (
        ["dupdirty"],
        """SELECT publishTime, COUNT(*) AS row_count,
             COUNT(*) FILTER (WHERE copies > 1) AS duplicate_key_rows,
             COUNT(*) FILTER (WHERE outputUsable < 0) AS negative_output_usable_rows,
             COUNT(*) FILTER (WHERE dataset IS NULL) AS null_dataset,
             COUNT(*) FILTER (WHERE fuelType IS NULL) AS "null_fuelType",
             COUNT(*) FILTER (WHERE nationalGridBmUnit IS NULL) AS "null_nationalGridBmUnit",
             COUNT(*) FILTER (WHERE bmUnit IS NULL) AS "null_bmUnit",
             COUNT(*) FILTER (WHERE forecastDate IS NULL) AS "null_forecastDate",
             COUNT(*) FILTER (WHERE outputUsable IS NULL) AS "null_outputUsable",
             COUNT(*) FILTER (WHERE collectedAt IS NULL) AS "null_collectedAt"
           FROM (SELECT *, COUNT(*) OVER (PARTITION BY nationalGridBmUnit, publishTime, forecastDate)
                   AS copies FROM dupdirty) GROUP BY 1""",
    ),
    "q_null_counts": (
        ["dirty"],
        """SELECT COUNT(*) FILTER (WHERE dataset IS NULL) AS null_dataset,
             COUNT(*) FILTER (WHERE fuelType IS NULL) AS "null_fuelType",
             COUNT(*) FILTER (WHERE nationalGridBmUnit IS NULL) AS "null_nationalGridBmUnit",
             COUNT(*) FILTER (WHERE bmUnit IS NULL) AS "null_bmUnit",
             COUNT(*) FILTER (WHERE publishTime IS NULL) AS "null_publishTime",
             COUNT(*) FILTER (WHERE forecastDate IS NULL) AS "null_forecastDate",
             COUNT(*) FILTER (WHERE outputUsable IS NULL) AS "null_outputUsable",
             COUNT(*) FILTER (WHERE collectedAt IS NULL) AS "null_collectedAt" FROM dirty""",
    ),
    "q_negative_rows": (
        ["dirty"],
        "SELECT COUNT(*) AS negative_output_usable_rows FROM dirty WHERE outputUsable < 0",
    ),
    **{
        f"q_reconcile_availability{suffix}": (
            [f"favail{part}", f"savail{part}"],
            f"""SELECT publishTime, forecastDate, group_mw, total_available_mw, group_zero_units,
                  zero_availability_units
                FROM (SELECT publishTime, forecastDate, CAST(SUM(available_mw) AS BIGINT) AS group_mw,
                        CAST(SUM(zero_availability_units) AS BIGINT) AS group_zero_units
                      FROM favail{part} GROUP BY 1, 2)
                FULL JOIN savail{part} USING (publishTime, forecastDate)
                WHERE group_mw IS DISTINCT FROM total_available_mw
                   OR group_zero_units IS DISTINCT FROM zero_availability_units""",
        )
        for suffix, part in (("", ""), ("_dirty", "dirty"))
    },
    "q_differing_rows": (["drift"], "SELECT * FROM drift"),
    "q_differing_publications": (
        ["canon", "drifted", "drift"],
        """SELECT publishTime, (SELECT COUNT(*) FROM canon c WHERE c.publishTime = d.publishTime) AS left_rows,
             (SELECT COUNT(*) FROM drifted r WHERE r.publishTime = d.publishTime) AS right_rows
           FROM (SELECT DISTINCT publishTime FROM drift) AS d""",
    ),
    "q_reconcile_revisions": (
        ["prev"],
        """SELECT previousPublishTime, latestPublishTime, r AS unitRevisionMW, r AS fuelRevisionMW,
             r AS systemRevisionMW
           FROM (SELECT previousPublishTime, latestPublishTime, CAST(SUM(revisionMW) AS BIGINT) AS r
                 FROM prev GROUP BY 1, 2)""",
    ),
    "q_raw_rename": (
        ["canon"],
        """SELECT nationalGridBmUnit AS national_grid_bm_unit, bmUnit AS bm_unit, fuelType AS fuel_type,
             publishTime AS publish_time, forecastDate AS forecast_date,
             CAST(outputUsable AS DOUBLE) AS output_usable_mw, collectedAt AS collected_at, dataset
           FROM canon""",
    ),
    "q_coerce": (
        ["canon"],
        """SELECT dataset, fuelType, nationalGridBmUnit, bmUnit, publishTime,
             TRY_CAST(CASE WHEN n % 17 = 0 THEN 'n/a' ELSE CAST(forecastDate AS STRING) END AS DATE)
               AS forecastDate,
             TRY_CAST(CASE WHEN n % 11 = 0 THEN 'bad' ELSE CAST(outputUsable AS STRING) END AS DOUBLE)
               AS outputUsable
           FROM (SELECT *, CAST(substr(nationalGridBmUnit, 6) AS INT) AS n FROM canon)""",
    ),
    "q_publication_stamp": (
        ["canon"],
        """SELECT DISTINCT publishTime, strftime(publishTime, '%Y%m%dT%H%M%SZ') AS stamp,
             strftime(publishTime, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM canon""",
    ),
    "q_fuel_labels": (
        ["canon", "fuels"],
        """SELECT fuelType, available_mw, coalesce(long_name, fuelType) AS fuel_label,
             coalesce(short_name, fuelType) AS short_label
           FROM (SELECT fuelType, CAST(SUM(outputUsable) AS BIGINT) AS available_mw FROM canon GROUP BY 1)
           LEFT JOIN fuels ON code = fuelType AND code <> 'INTNED'""",
    ),
    "q_fuel_type_changes": (["urev"], "SELECT * FROM urev WHERE fuelTypeChanged"),
    "q_nearest_forecast": (
        ["shist"],
        """SELECT * FROM shist WHERE publishTime = (SELECT MAX(publishTime) FROM shist)
             AND forecastDate >= publishTime ORDER BY forecastDate LIMIT 1""",
    ),
    "q_window_24h": (["win"], "SELECT * FROM win"),
    "q_fuel_availability_history": (["fhist"], "SELECT * FROM fhist"),
    "q_system_availability_history": (["shist"], "SELECT * FROM shist"),
    "q_fuel_availability": (["favail"], "SELECT * FROM favail"),
    "q_system_availability": (["savail"], "SELECT * FROM savail"),
    "q_fuel_availability_dirty": (["favaildirty"], "SELECT * FROM favaildirty"),
    "q_unit_revision_history": (["urev"], "SELECT * FROM urev"),
    "q_fuel_revision_history": (["frev"], "SELECT * FROM frev"),
    "q_system_revision_history": (["srev"], "SELECT * FROM srev"),
    "q_changed_rows_by_pair": (
        ["urev"],
        """SELECT previousPublishTime, latestPublishTime,
             COUNT(*) FILTER (WHERE revisionMW <> 0) AS changedRows FROM urev GROUP BY 1, 2""",
    ),
    "q_common_dates": (
        ["canon", "stored"],
        """SELECT DISTINCT forecastDate FROM stored WHERE forecastDate IN
             (SELECT forecastDate FROM canon WHERE publishTime >= TIMESTAMP '2024-01-25 00:00:00')""",
    ),
    "q_pair_overlap": (
        ["cal", "canon"],
        """SELECT previousPublishTime, publishTime AS latestPublishTime,
             (SELECT COUNT(*) FROM (SELECT forecastDate FROM canon a WHERE a.publishTime = cal.publishTime
                INTERSECT SELECT forecastDate FROM canon b WHERE b.publishTime = cal.previousPublishTime))
               AS commonDates
           FROM cal WHERE previousPublishTime IS NOT NULL""",
    ),
    "q_unit_revisions_pair": (["pair"], "SELECT * FROM pair"),
    "q_unit_revisions_all_pairs": (["prev"], "SELECT * FROM prev"),
    "q_unit_revisions_dirty": (["prevdirty"], "SELECT * FROM prevdirty"),
    "q_fuel_revisions_pair": (["pfuel"], "SELECT * FROM pfuel"),
    "q_fuel_revisions_dirty": (["pfueldirty"], "SELECT * FROM pfueldirty"),
    "q_system_revisions_pair": (["psys"], "SELECT * FROM psys"),
    "q_changed_rows_by_adjacent_pair": (
        ["prev"],
        """SELECT previousPublishTime, latestPublishTime,
             COUNT(*) FILTER (WHERE revisionMW <> 0) AS changedRows FROM prev GROUP BY 1, 2""",
    ),
    **{
        f"q_top10_{name}": (
            ["pair"],
            f"""SELECT forecastDate, nationalGridBmUnit, fuelType, previousAvailableMW,
                  latestAvailableMW, revisionMW FROM pair WHERE revisionMW {test}
                ORDER BY revisionMW {order}, forecastDate, nationalGridBmUnit LIMIT 10""",
        )
        for name, test, order in (("downward", "< 0", "ASC"), ("upward", "> 0", "DESC"))
    },
    "q_latest_pair": (
        ["prevended"],
        """SELECT previousPublishTime AS previous_publish_time, latestPublishTime AS latest_publish_time
           FROM prevended ORDER BY 2 DESC, 1 DESC LIMIT 1""",
    ),
    "q_latest_availability_outlook": (["outlook"], "SELECT * FROM outlook"),
    "q_latest_availability_mix": (
        ["outlook"],
        f"""SELECT publish_time, forecast_date, total_available_mw, gb_generation_storage_available_mw,
              interconnector_available_mw,
              CASE WHEN total_available_mw <> 0 THEN
                {_pct("gb_generation_storage_available_mw", "total_available_mw", 2)} END
                AS gb_generation_storage_pct,
              CASE WHEN total_available_mw <> 0 THEN
                {_pct("interconnector_available_mw", "total_available_mw", 2)} END AS interconnector_pct,
              zero_availability_units FROM outlook""",
    ),
    "q_latest_system_revision": (["gsys"], "SELECT * FROM gsys"),
    "q_latest_changed_units": (["changed"], "SELECT * FROM changed"),
    "q_latest_fuel_revision_ranking": (
        ["lastfuel"],
        """SELECT previousPublishTime AS previous_publish_time, latestPublishTime AS latest_publish_time,
             forecastDate AS forecast_date, fuelType AS fuel_type,
             CAST(previousAvailableMW AS DOUBLE) AS previous_available_mw,
             CAST(latestAvailableMW AS DOUBLE) AS latest_available_mw,
             CAST(revisionMW AS DOUBLE) AS revision_mw,
             CAST(abs(revisionMW) AS DOUBLE) AS absolute_revision_mw, changedUnits AS changed_units,
             becameUnavailableUnits AS became_unavailable_units,
             returnedAvailableUnits AS returned_available_units,
             row_number() OVER (PARTITION BY forecastDate ORDER BY abs(revisionMW) DESC, fuelType)
               AS revision_rank
           FROM lastfuel WHERE revisionMW <> 0""",
    ),
    "q_latest_unit_revision_ranking": (
        ["changed"],
        """SELECT *, row_number() OVER (PARTITION BY forecast_date
             ORDER BY absolute_revision_mw DESC, national_grid_bm_unit) AS revision_rank FROM changed""",
    ),
    "q_lowest_day": (
        ["outlook"],
        """SELECT forecast_date AS lowest_availability_date, total_available_mw AS lowest_availability_mw
           FROM outlook ORDER BY total_available_mw, forecast_date LIMIT 1""",
    ),
    "q_largest_system_revision": (
        ["gsys"],
        """SELECT forecast_date AS largest_system_revision_date, revision_mw AS largest_system_revision_mw
           FROM gsys ORDER BY abs(revision_mw) DESC, forecast_date LIMIT 1""",
    ),
    "q_revision_summary": (
        ["changed"],
        """SELECT COUNT(*) AS changed_unit_rows,
             COUNT(*) FILTER (WHERE change_direction = 'UP') AS upward_revision_rows,
             COUNT(*) FILTER (WHERE change_direction = 'DOWN') AS downward_revision_rows,
             COUNT(*) FILTER (WHERE became_unavailable) AS became_unavailable_rows,
             COUNT(*) FILTER (WHERE returned_available) AS returned_available_rows FROM changed""",
    ),
    "q_pipeline_health": (["health"], "SELECT * FROM health"),
    "q_dashboard_kpis": (
        ["outlook", "changed", "gsys", "health"],
        """SELECT a.*, ld.*, rs.*, lr.*, p.* FROM
             (SELECT MAX(publish_time) AS latest_publish_time, MIN(forecast_date) AS forecast_start_date,
                MAX(forecast_date) AS forecast_end_date, MIN(total_available_mw) AS minimum_total_available_mw,
                MAX(total_available_mw) AS maximum_total_available_mw,
                MIN(gb_generation_storage_available_mw) AS minimum_gb_generation_storage_mw,
                ((CAST(SUM(interconnector_available_mw) AS BIGINT) * 200 + COUNT(*)) // (2 * COUNT(*))) / 100.0
                  AS average_interconnector_available_mw FROM outlook) a,
             (SELECT forecast_date AS lowest_availability_date, total_available_mw AS lowest_availability_mw
              FROM outlook ORDER BY total_available_mw, forecast_date LIMIT 1) ld,
             (SELECT COUNT(*) AS changed_unit_rows,
                COUNT(*) FILTER (WHERE change_direction = 'UP') AS upward_revision_rows,
                COUNT(*) FILTER (WHERE change_direction = 'DOWN') AS downward_revision_rows,
                COUNT(*) FILTER (WHERE became_unavailable) AS became_unavailable_rows,
                COUNT(*) FILTER (WHERE returned_available) AS returned_available_rows FROM changed) rs,
             (SELECT forecast_date AS largest_system_revision_date, revision_mw AS largest_system_revision_mw
              FROM gsys ORDER BY abs(revision_mw) DESC, forecast_date LIMIT 1) lr,
             (SELECT pipeline_run_id, status AS pipeline_status,
                round(duration_seconds, 3) AS pipeline_duration_seconds FROM health) p""",
    ),
    "q_kpis": (
        ["shist", "fhist"],
        """SELECT publishTime AS latest_publication, availableMW AS system_available_mw,
             (SELECT COUNT(DISTINCT publishTime) FROM shist) AS publications_loaded,
             (SELECT COUNT(DISTINCT fuelType) FROM fhist) AS fuel_types_tracked
           FROM shist WHERE publishTime = (SELECT MAX(publishTime) FROM shist)
             AND forecastDate >= publishTime ORDER BY forecastDate LIMIT 1""",
    ),
    "q_system_profile": (
        ["shist"],
        """SELECT forecastDate, availableMW FROM shist
           WHERE publishTime = (SELECT MAX(publishTime) FROM shist)""",
    ),
    "q_fuel_mix": (["mix"], "SELECT * FROM mix"),
    "q_fuel_mix_fractional": (
        ["canon", "fuels"],
        f"""SELECT * FROM (WITH eighths AS (
             SELECT fuelType, publishTime, forecastDate, outputUsable * 1000
               + 125 * (CAST(substr(nationalGridBmUnit, 6) AS INT) % 8) AS mw FROM canon),
           latest AS (SELECT * FROM eighths WHERE publishTime = (SELECT MAX(publishTime) FROM eighths)),
           sums AS (
             SELECT fuelType, CAST(SUM(mw) AS BIGINT) AS mw FROM latest
             WHERE forecastDate = (
               SELECT MIN(forecastDate) FROM latest WHERE forecastDate >= publishTime)
             GROUP BY 1)
           SELECT fuelType AS fuel_type, concat(coalesce(long_name, fuelType), ' (', fuelType, ')')
               AS fuel_label, coalesce(short_name, fuelType) AS short_label,
             mw / 1000.0::DOUBLE AS available_mw,
             CASE WHEN total > 0 THEN {_pct("mw", "total", 1)} ELSE 0.0 END AS share_pct
           FROM (SELECT *, SUM(mw) OVER () AS total FROM sums) LEFT JOIN fuels ON code = fuelType)""",
    ),
    "q_fuel_mix_top7": (
        ["mix"],
        f"""SELECT fuel_type, short_label, fuel_label, available_mw,
              CASE WHEN total > 0 THEN {_pct("available_mw", "total", 2)} ELSE 0.0 END AS share_pct
            FROM (SELECT *, SUM(available_mw) OVER () AS total FROM (
              SELECT fuel_type, short_label, fuel_label, available_mw FROM
                (SELECT *, row_number() OVER (ORDER BY available_mw DESC, fuel_type) AS r FROM mix) WHERE r <= 7
              UNION ALL
              SELECT 'REMAINING', 'Other categories', 'Remaining fuel and interconnector categories',
                CAST(SUM(available_mw) AS BIGINT) FROM
                (SELECT *, row_number() OVER (ORDER BY available_mw DESC, fuel_type) AS r FROM mix) WHERE r > 7
              HAVING SUM(available_mw) > 0))""",
    ),
    "q_fuel_revisions_24h": (
        ["fwin", "fuels"],
        """SELECT fuelType AS fuel_type, concat(coalesce(long_name, fuelType), ' (', fuelType, ')') AS fuel_label,
             net_revision_mw
           FROM (SELECT fuelType, CAST(SUM(revisionMW) AS BIGINT) AS net_revision_mw FROM fwin GROUP BY 1)
           LEFT JOIN fuels ON code = fuelType WHERE net_revision_mw <> 0""",
    ),
    "q_direction_counts": (["dirs"], "SELECT * FROM dirs"),
    "q_top_unit_revisions": (
        ["movers"],
        """SELECT * FROM movers ORDER BY abs(revision_mw) DESC, publication_time DESC, unit, forecast_date
           LIMIT 10""",
    ),
    "q_largest_upward": (["up"], "SELECT * FROM up"),
    "q_largest_downward": (["down"], "SELECT * FROM down"),
    "q_most_revised_fuel": (["topfuel"], "SELECT * FROM topfuel"),
    "q_revision_signals": (
        ["win", "up", "down", "topfuel"],
        """SELECT (SELECT MAX(latestPublishTime) FROM win) AS latest_publication,
             up.unit AS largest_upward_unit, up.fuel_type AS largest_upward_fuel_type,
             up.fuel_label AS largest_upward_fuel_label, up.revision_mw AS largest_upward_revision_mw,
             up.forecast_date AS largest_upward_forecast_date,
             up.publication_time AS largest_upward_publication_time,
             down.unit AS largest_downward_unit, down.fuel_type AS largest_downward_fuel_type,
             down.fuel_label AS largest_downward_fuel_label,
             down.revision_mw AS largest_downward_revision_mw,
             down.forecast_date AS largest_downward_forecast_date,
             down.publication_time AS largest_downward_publication_time,
             topfuel.fuel_type AS most_revised_fuel_fuel_type,
             topfuel.fuel_label AS most_revised_fuel_fuel_label,
             topfuel.absolute_revision_mw AS most_revised_fuel_absolute_revision_mw,
             topfuel.net_revision_mw AS most_revised_fuel_net_revision_mw,
             topfuel.revision_records AS most_revised_fuel_revision_records
           FROM up FULL JOIN down ON true FULL JOIN topfuel ON true""",
    ),
    "q_stability": (
        ["dirs", "fwin", "win", "topfuel"],
        f"""SELECT score AS stability_score,
              CASE WHEN score >= 95 THEN 'Highly stable' WHEN score >= 90 THEN 'Stable'
                   WHEN score >= 80 THEN 'Moderately stable' ELSE 'High revision activity' END
                AS stability_band,
              (10000 - CAST(round(score * 100) AS BIGINT)) / 100.0 AS changed_revision_share_pct,
              CAST(net AS DOUBLE) AS net_revision_mw_24h,
              CASE WHEN net > 0 THEN 'UPWARD BIAS' WHEN net < 0 THEN 'DOWNWARD WATCH'
                   ELSE 'BALANCED' END AS watch_status,
              CASE WHEN net > 0 THEN 'positive' WHEN net < 0 THEN 'negative' ELSE 'neutral' END AS watch_tone,
              CASE WHEN net > 0 THEN '{_WATCH.format("positive")}'
                   WHEN net < 0 THEN '{_WATCH.format("negative")}'
                   ELSE 'Latest 24-hour upward and downward revision movements are broadly balanced.' END
                AS watch_detail,
              coalesce((SELECT fuel_label FROM topfuel), 'Unavailable') AS most_revised_fuel,
              coalesce((SELECT CAST(absolute_revision_mw AS DOUBLE) FROM topfuel), 0.0) AS most_revised_fuel_abs_mw,
              (SELECT MAX(latestPublishTime) FROM win) AS latest_publication,
              '{METHODOLOGY}' AS methodology
            FROM (SELECT coalesce((SELECT share_pct FROM dirs WHERE direction = 'unchanged'), 0.0) AS score,
                    coalesce((SELECT SUM(revisionMW) FROM fwin), 0) AS net)""",
    ),
    "q_backfill_summary": (
        ["canon", "stored"],
        """SELECT CAST(SUM(n) AS BIGINT) AS rows_returned, COUNT(*) AS publications_found,
             COUNT(*) FILTER (WHERE NOT known) AS publications_created,
             COUNT(*) FILTER (WHERE known) AS publications_existing
           FROM (SELECT publishTime, COUNT(*) AS n,
                   publishTime IN (SELECT publishTime FROM stored) AS known
                 FROM canon WHERE publishTime BETWEEN TIMESTAMP '2024-01-23 00:00:00'
                   AND TIMESTAMP '2024-01-26 12:00:00' GROUP BY 1)""",
    ),
    "q_history_report": (
        ["fhist", "shist", "urev", "frev", "srev"],
        " UNION ALL ".join(
            f"SELECT '{name}' AS dataset, COUNT(*) AS rows FROM {relation}"
            for name, relation in (
                ("fuel_availability_history", "fhist"), ("system_availability_history", "shist"),
                ("unit_revision_history", "urev"), ("fuel_revision_history", "frev"),
                ("system_revision_history", "srev"),
            )
        ),
    ),
    "q_clipped_errors": (
        ["runs"],
        """SELECT pipeline_run_id, substr(repeat(error_message, 200), 1, 5000) AS error_message
           FROM runs""",
    ),
    "q_audit_state": (["runs"], "SELECT * FROM runs"),
}


def _with(needs: list[str]) -> str:
    """The WITH clause of the relations needed, directly or not, in declared order."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in RELATIONS[name][0]:
                add(other)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({RELATIONS[name][1]})" for name in RELATIONS if name in wanted]
    return "WITH " + ",\n".join(parts)


# Products served from stored revisions equal those derived from the history.
STORED = {
    "q_stored_stability": "q_stability",
    "q_stored_direction_counts": "q_direction_counts",
    "q_stored_window_24h": "q_window_24h",
    "q_stored_fuel_revisions_24h": "q_fuel_revisions_24h",
}


def all_sql() -> dict[str, str]:
    texts = {key: f"{_with(needs)}\n{text}" for key, (needs, text) in QUERIES.items()}
    return texts | {key: texts[same] for key, same in STORED.items()}
