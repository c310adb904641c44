"""The event state machine as a recursive query: frame after frame, apart from the window form that it checks."""

from __future__ import annotations

from .adapter import EVENTS, FRAMES_SQL

_BEST = ("foliage_motion_frac", "wind_idx", "zones_active_frac")
_ANY = ("wind_like", "real_override")


def walk_sql() -> str:
    """CTEs ending in ``walk`` (one row a frame: what closed, what was emitted, the state after) and ``ended`` (at the end)."""
    c = EVENTS
    tele = [*_ANY, *_BEST, "wind_state"]
    null = lambda p: ", ".join(f"NULL::{'BOOLEAN' if x in _ANY else 'VARCHAR' if x == 'wind_state' else 'DOUBLE'} AS {p}_{x}" for x in tele)
    keep = lambda p: ", ".join(f"{p}_{x}" for x in tele)
    folded = ", ".join(
        [f"a_{x} OR {x} AS g_{x}" for x in _ANY] + [f"greatest(a_{x}, {x}) AS g_{x}" for x in _BEST] + ["CASE WHEN wind_state <> '' THEN wind_state ELSE a_wind_state END AS g_wind_state"]
    )
    queued = ", ".join(
        [f"CASE WHEN NOT good THEN p_{x} WHEN p_start IS NULL THEN g_{x} ELSE p_{x} OR g_{x} END AS q_{x}" for x in _ANY]
        + [f"CASE WHEN NOT good THEN p_{x} WHEN p_start IS NULL THEN g_{x} ELSE greatest(p_{x}, g_{x}) END AS q_{x}" for x in _BEST]
        + ["CASE WHEN NOT good THEN p_wind_state WHEN p_start IS NULL OR g_wind_state <> '' THEN g_wind_state ELSE p_wind_state END AS q_wind_state"]
    )
    active = ", ".join(f"CASE WHEN opens THEN {x} WHEN shut THEN NULL ELSE g_{x} END AS a_{x}" for x in tele)
    pending = ", ".join(f"CASE WHEN due THEN NULL ELSE q_{x} END AS p_{x}" for x in tele)
    emitted = ", ".join(f"q_{x} AS e_{x}" for x in tele)
    return f"""{FRAMES_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY pts_ms, frame_id) AS n, count(*) OVER (PARTITION BY cam_id) AS total FROM frames
), walk AS (
  SELECT cam_id, 0::BIGINT AS n, max(total) AS total, NULL::DOUBLE AS a_start, NULL::DOUBLE AS a_last, NULL::DOUBLE AS a_max, {null('a')},
         NULL::DOUBLE AS p_start, NULL::DOUBLE AS p_stop, NULL::DOUBLE AS p_max, 0::BIGINT AS p_n, {null('p')},
         FALSE AS good, NULL::DOUBLE AS c_start, NULL::DOUBLE AS c_stop, NULL::DOUBLE AS c_max,
         FALSE AS due, NULL::DOUBLE AS e_start, NULL::DOUBLE AS e_stop, NULL::DOUBLE AS e_max, 0::BIGINT AS e_n, {null('e')}, NULL::DOUBLE AS t
  FROM numbered GROUP BY cam_id
  UNION ALL
  SELECT cam_id, n, total,
         CASE WHEN opens THEN pts_ms WHEN shut THEN NULL ELSE a_start END, CASE WHEN opens THEN pts_ms WHEN shut THEN NULL ELSE g_last END, CASE WHEN opens THEN score WHEN shut THEN NULL ELSE g_max END, {active},
         CASE WHEN due THEN NULL ELSE q_start END, CASE WHEN due THEN NULL ELSE q_stop END, CASE WHEN due THEN NULL ELSE q_max END, CASE WHEN due THEN 0 ELSE q_n END, {pending},
         good, a_start, g_last, g_max, due, q_start, q_stop, q_max, q_n, {emitted}, pts_ms
  FROM (
    SELECT *, coalesce(pts_ms - q_stop >= {c.merge_gap_ms}::DOUBLE, FALSE) AS due, (a_start IS NULL OR closes) AS shut, (a_start IS NULL OR closes) AND score >= {c.score_on}::DOUBLE AS opens
    FROM (
      SELECT *, {queued},
             CASE WHEN NOT good THEN p_start WHEN p_start IS NULL THEN a_start ELSE p_start END AS q_start, CASE WHEN good THEN g_last ELSE p_stop END AS q_stop,
             CASE WHEN NOT good THEN p_max WHEN p_start IS NULL THEN g_max ELSE greatest(p_max, g_max) END AS q_max,
             CASE WHEN NOT good THEN p_n WHEN p_start IS NULL THEN 1 ELSE p_n + 1 END AS q_n
      FROM (
        SELECT *, closes AND g_last - a_start >= {c.min_event_ms}::DOUBLE AS good
        FROM (
          SELECT *, coalesce(a_start IS NOT NULL AND score <= {c.score_off}::DOUBLE AND pts_ms - g_last >= {c.min_gap_ms}::DOUBLE, FALSE) AS closes
          FROM (
            SELECT w.cam_id, f.n, w.total, f.pts_ms, f.score, {', '.join('f.' + x for x in tele)}, a_start, p_start, p_stop, p_max, p_n, {keep('p')},
                   CASE WHEN f.score >= {c.score_on}::DOUBLE THEN f.pts_ms ELSE a_last END AS g_last, greatest(a_max, f.score) AS g_max, {folded}
            FROM walk w JOIN numbered f ON f.cam_id = w.cam_id AND f.n = w.n + 1
          )
        )
      )
    )
  )
), ended AS (
  SELECT *, a_start IS NOT NULL AND a_last - a_start >= {c.min_event_ms}::DOUBLE AS tail FROM walk WHERE n = total
)"""


def activations_sql() -> str:
    return f"""WITH RECURSIVE {walk_sql()}
SELECT cam_id, c_start AS start_ms, c_stop AS stop_ms, c_max AS max_score FROM walk WHERE good
UNION ALL SELECT cam_id, a_start, a_last, a_max FROM ended WHERE tail"""


def events_sql(columns: str) -> str:
    """Events; ``columns`` picks from cam_id, start_ms, stop_ms, max_score, n_activations, emit_ms and telemetry."""
    tele = [*_ANY, *_BEST, "wind_state"]
    last = ", ".join(
        [f"CASE WHEN NOT tail THEN p_{x} WHEN p_start IS NULL THEN a_{x} ELSE p_{x} OR a_{x} END" for x in _ANY]
        + [f"CASE WHEN NOT tail THEN p_{x} WHEN p_start IS NULL THEN a_{x} ELSE greatest(p_{x}, a_{x}) END" for x in _BEST]
        + ["CASE WHEN NOT tail THEN p_wind_state WHEN p_start IS NULL OR a_wind_state <> '' THEN a_wind_state ELSE p_wind_state END"]
    )
    return f"""WITH RECURSIVE {walk_sql()}, found AS (
  SELECT cam_id, e_start AS start_ms, e_stop AS stop_ms, e_max AS max_score, e_n AS n_activations, t AS emit_ms, {', '.join(f'e_{x} AS {x}' for x in tele)} FROM walk WHERE due
  UNION ALL
  SELECT cam_id, coalesce(p_start, a_start), CASE WHEN tail THEN a_last ELSE p_stop END,
         CASE WHEN NOT tail THEN p_max WHEN p_start IS NULL THEN a_max ELSE greatest(p_max, a_max) END, CASE WHEN tail THEN p_n + 1 ELSE p_n END, NULL, {last}
  FROM ended WHERE tail OR p_start IS NOT NULL
)
SELECT {columns} FROM found"""
