"""Oracle SQL for task logs, check-ins and efficiency."""

from casewright.functions.calendar import efficiency_period_list
from casewright.plans.lab_views import CALENDAR, EVENT_DAY

_SIX_DAYS = (
    "(DATE '2024-01-19', DATE '2024-01-18', DATE '2024-01-17', DATE '2024-01-16',"
    " DATE '2024-01-15', DATE '2024-01-12')"
)
_SHORT = """CASE WHEN {0} IS NULL OR trim({0}) = '' THEN 'Unknown' WHEN trim({0}) NOT LIKE '% %' THEN {0}
  ELSE regexp_extract(trim({0}), '^\\S+') || ' ' || substr(regexp_extract(trim({0}), '\\S+$'), 1, 1) || '.' END"""
_EMP_NAME = "coalesce(" + _SHORT.format("e.staff_name").replace("'Unknown'", "NULL") + ", 'ID:' || t.completed_by)"
_LABEL = "strftime(day, '%a ') || month(day) || '/' || day(day)"
_AIRWAY = """
  SELECT completed_by, CAST(complete_date AS DATE) AS day,
    count(DISTINCT CASE WHEN task = '3dplan' THEN case_number END) AS task_1,
    count(DISTINCT CASE WHEN task = '3dfin-exp' THEN case_number END) AS task_2,
    count(DISTINCT CASE WHEN task = '3drevise' THEN case_number END) AS task_3
  FROM task_history WHERE complete_date >= TIMESTAMP '2024-01-12' AND complete_date < TIMESTAMP '2024-01-20'
    AND task IN ('3dplan', '3dfin-exp', '3drevise') GROUP BY 1, 2"""
_CHECKINS = """
  SELECT CASE WHEN created_by NOT LIKE '% %' THEN created_by
           ELSE split_part(created_by, ' ', 1) || ' ' || substr(split_part(created_by, ' ', -1), 1, 1) || '.' END AS emp_name,
    create_date, CAST(create_date AS DATE) AS day,
    CASE WHEN b.category IS NULL OR trim(b.category) IN ('', 'Accessories') THEN 'Other'
      WHEN lower(b.category) LIKE '%expander%' THEN 'E² Expanders' WHEN b.category IN ('Airway', 'Marpe') THEN 'MARPE'
      WHEN b.category = 'Lab to lab' THEN 'Lab to Lab' ELSE trim(b.category) END AS category
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id
          ORDER BY create_date DESC, line DESC, part_id DESC, source_id DESC) AS rn
        FROM audit_trail WHERE create_date >= TIMESTAMP '1998-05-01' AND create_date < TIMESTAMP '1998-06-16'
          AND type IN ('New Case', 'Accept Remote Case') AND created_by IS NOT NULL AND created_by <> 'Web') a
  LEFT JOIN best_category b ON b.case_id = a.case_id WHERE rn = 1"""
_WINDOWED = """
  SELECT CAST(h.complete_date AS DATE) AS data_date, w.name AS window, h.completed_by, h.case_number,
    h.case_id, h.task, h.case_product_id
  FROM task_history h JOIN (VALUES ('noon', 12), ('3pm', 15)) w(name, hi)
    ON h.complete_date >= date_trunc('day', h.complete_date) + INTERVAL 3 HOUR
    AND h.complete_date <= date_trunc('day', h.complete_date) + to_hours(w.hi)
  WHERE h.rejected = 'No' AND h.complete_date >= TIMESTAMP '2024-01-11' AND h.complete_date < TIMESTAMP '2024-01-20'"""
_SNAPSHOT = """
  SELECT x.data_date, x.window, coalesce(e.team, 'Unknown') AS team, e.staff_name AS name,
    count(DISTINCT x.case_number) AS cases_worked_on, count(*) AS tasks_completed,
    CAST(sum(p.duration) AS DOUBLE) AS tasks_duration_hours
  FROM ({windowed}) x JOIN {plan} p ON p.case_id = x.case_id AND p.task = x.task
      AND p.case_product_id = x.case_product_id
    JOIN employees e ON e.employee_id = CAST(x.completed_by AS BIGINT)
  WHERE coalesce(e.team, 'Unknown') <> 'z_Not On Report' {more} GROUP BY 1, 2, 3, 4"""
_EVERY_PLAN = """(SELECT case_id, task, case_product_id,
  CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,4)) * CAST(0.01 AS DECIMAL(3,2)) AS duration FROM task_history)"""
_PERIODS = efficiency_period_list(EVENT_DAY, CALENDAR)


def _period_means() -> str:
    parts = []
    for name, lo, hi in _PERIODS:
        inside = f"date BETWEEN DATE '{lo}' AND DATE '{hi}' AND cents <> 0"
        parts.append(
            f"sum(cents) FILTER (WHERE {inside}) / CAST(100 AS DOUBLE)"
            f" / nullif(count(*) FILTER (WHERE {inside}), 0) * CAST(0.01 AS DOUBLE) AS {name}"
        )
    return ",\n          ".join(parts)


_PERIOD_ROWS = ", ".join(f"('{n}', DATE '{lo}', DATE '{hi}')" for n, lo, hi in _PERIODS)

ORACLE = {
    "airway_task_counts": _AIRWAY,
    "airway_task_leaders": f"""
        WITH t AS (SELECT completed_by, day, '3dplan' AS task, task_1 AS n FROM ({_AIRWAY}) a
          UNION ALL SELECT completed_by, day, '3dfin-exp', task_2 FROM ({_AIRWAY}) a
          UNION ALL SELECT completed_by, day, '3drevise', task_3 FROM ({_AIRWAY}) a)
        SELECT day, {_LABEL} AS label, task, completed_by, {_EMP_NAME} AS emp_name, false AS is_total, n,
          row_number() OVER (PARTITION BY day, task ORDER BY n DESC, completed_by) AS place
        FROM t LEFT JOIN employees e ON e.employee_id = CAST(t.completed_by AS BIGINT)
        WHERE n > 0 AND day IN {_SIX_DAYS}
        UNION ALL
        SELECT day, {_LABEL}, task, NULL, NULL, true, CAST(sum(n) AS BIGINT), 1 FROM t
        WHERE n > 0 AND day IN {_SIX_DAYS} GROUP BY day, task""",
    "design_windows": f"""
        WITH t AS (SELECT CAST(complete_date AS DATE) AS day, w.name, task, completed_by,
                count(DISTINCT case_number) AS n, count(*) AS raw
              FROM task_history JOIN (VALUES ('noon', 3, 12), ('pm3', 3, 15), ('pm11', 15, 24), ('allday', 3, 24))
                w(name, lo, hi) ON hour(complete_date) >= lo AND hour(complete_date) < hi
              WHERE task IN ('3dd', '3dcf') AND CAST(complete_date AS DATE) IN {_SIX_DAYS} GROUP BY ALL)
        SELECT day, {_LABEL} AS label, name AS window, task, completed_by, {_EMP_NAME} AS emp_name,
          false AS is_total, n, raw
        FROM t LEFT JOIN employees e ON e.employee_id = CAST(t.completed_by AS BIGINT)
        UNION ALL
        SELECT day, {_LABEL}, name, task, NULL, NULL, true, CAST(sum(n) AS BIGINT), CAST(sum(raw) AS BIGINT)
        FROM t GROUP BY day, name, task""",
    "checkin_windows": f"""
        WITH t AS (SELECT day, w.name, emp_name, count(*) AS n FROM ({_CHECKINS}) c
              JOIN (VALUES ('noon', 12), ('all', 18)) w(name, hi) ON hour(create_date) < hi
              WHERE day IN (DATE '1998-06-15', DATE '1998-06-12', DATE '1998-06-11', DATE '1998-06-10',
                DATE '1998-06-09', DATE '1998-06-08') GROUP BY ALL)
        SELECT day, {_LABEL} AS label, name AS window, emp_name, false AS is_total, n FROM t
        UNION ALL
        SELECT day, {_LABEL}, name, NULL, true, CAST(sum(n) AS BIGINT) FROM t GROUP BY day, name""",
    "category_trends": f"""
        WITH wd AS (SELECT d FROM all_days WHERE d < DATE '1998-06-15' AND isodow(d) < 6 ORDER BY d DESC LIMIT 30),
        rows_ AS (SELECT category, day FROM ({_CHECKINS}) c WHERE day IN (SELECT d FROM wd)),
        x AS (SELECT k.category, wd.d AS day, count(r.day) AS n
          FROM (SELECT DISTINCT category FROM rows_) k CROSS JOIN wd
          LEFT JOIN rows_ r ON r.category = k.category AND r.day = wd.d GROUP BY ALL)
        SELECT category, day, n,
          round_even(CAST(sum(n) OVER (PARTITION BY category) AS DOUBLE) / 30, 0) AS mean,
          CAST(coalesce((SELECT pos FROM v_checkin_order o WHERE o.category = x.category), 9) AS BIGINT) AS category_rank
        FROM x""",
    "cases_by_operator": """
        SELECT a.created_by, CAST(a.create_date AS DATE) AS day,
          CASE WHEN k.case_id IS NULL THEN NULL WHEN k.category IS NULL OR trim(k.category) IN ('', 'Accessories') THEN 'Other'
            WHEN lower(k.category) LIKE '%expander%' THEN 'E² Expanders'
            WHEN k.category IN ('Airway', 'Marpe') THEN 'MARPE' WHEN k.category = 'Lab to lab' THEN 'Lab to Lab'
            ELSE trim(k.category) END AS category, count(c.case_number) AS n
        FROM audit_trail a LEFT JOIN cases c ON c.case_id = a.case_id
        LEFT JOIN (SELECT s.case_id, b.category FROM numbered_cases s
            LEFT JOIN (SELECT * FROM (
                SELECT n.case_number, CAST(n.ship_date AS DATE) AS d, p.category, row_number() OVER (
                  PARTITION BY n.case_number, CAST(n.ship_date AS DATE) ORDER BY coalesce(v.pos, 99), p.category DESC) AS rn
                FROM numbered_cases n JOIN case_products cp ON cp.case_id = n.case_id JOIN products p ON p.product_id = cp.product_id
                  LEFT JOIN v_priority v ON p.category LIKE v.pattern
                WHERE p.category IS NOT NULL AND n.status IN ('In Production', 'Invoiced')) x WHERE rn = 1) b
              ON b.case_number = s.case_number AND b.d = CAST(s.ship_date AS DATE)
            WHERE s.status IN ('In Production', 'Invoiced')) k ON k.case_id = a.case_id
        WHERE a.type = 'Accept Remote Case' AND a.create_date >= TIMESTAMP '1998-05-16'
          AND a.create_date < TIMESTAMP '1998-06-16' GROUP BY 1, 2, 3""",
    "stage1_tasks": """
        WITH h AS (SELECT * REPLACE (CASE event_id % 31 WHEN 0 THEN 'kiosk' WHEN 1 THEN ' web ' ELSE completed_by END AS completed_by)
          FROM task_history)
        SELECT CAST(try_cast(trim(completed_by) AS DOUBLE) AS BIGINT) AS employee_id,
          CASE WHEN try_cast(trim(completed_by) AS DOUBLE) IS NULL THEN trim(completed_by) END AS employee_text,
          count(DISTINCT case_number) AS cases_worked_on,
          count(*) AS tasks_completed, CAST(sum(coalesce(p.duration, 0)) AS DOUBLE) AS tasks_duration_hours
        FROM h LEFT JOIN planned p ON p.case_id = h.case_id AND p.task = h.task
          AND p.case_product_id = h.case_product_id
        WHERE complete_date >= TIMESTAMP '2024-01-08' AND complete_date < TIMESTAMP '2024-01-15'
          AND (case_number, complete_date, h.task, completed_by) NOT IN (
            SELECT (case_number, complete_date, task, completed_by) FROM h WHERE rejected = 'Yes')
        GROUP BY 1, 2""",
    "task_durations": """
        SELECT event_id, h.case_id, h.task, h.case_product_id, CAST(p.duration AS DOUBLE) AS duration
        FROM task_history h LEFT JOIN planned p ON p.case_id = h.case_id AND p.task = h.task
          AND p.case_product_id = h.case_product_id
        WHERE complete_date >= TIMESTAMP '2024-01-08' AND complete_date < TIMESTAMP '2024-01-15'""",
    "untouched_tasks": """
        WITH r AS (SELECT event_id, CASE WHEN case_id % 9 <> 0 THEN case_id END AS case_id, completed_by,
            CAST(complete_date AS DATE) AS day, rejected FROM task_history)
        SELECT event_id, case_id, completed_by, day FROM r WHERE NOT EXISTS (SELECT 1 FROM r b
          WHERE b.rejected = 'Yes' AND b.case_id IS NOT DISTINCT FROM r.case_id
            AND b.completed_by = r.completed_by AND b.day = r.day)""",
    "midday_snapshot": _SNAPSHOT.format(windowed=_WINDOWED, plan="planned", more=""),
    "midday_snapshot_fan_out": _SNAPSHOT.format(windowed=_WINDOWED, plan=_EVERY_PLAN, more=""),
    "missing_snapshots": _SNAPSHOT.format(
        windowed=_WINDOWED,
        plan="planned",
        more="AND day(x.data_date) % 2 = 1 AND x.data_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-18'",
    ),
    "daily_efficiency": """
        SELECT date, employee_id, staff_name, team, CAST(training_plan AS BIGINT) AS training_plan, work_hours,
          cases_worked_on, tasks_completed, CAST(hours AS DOUBLE) AS tasks_duration_hours,
          cents / CAST(100 AS DOUBLE) AS efficiency FROM daily_eff""",
    "efficiency_periods": f"""
        SELECT staff_name, arg_min(team, date) FILTER (WHERE team IS NOT NULL) AS team,
          CAST(coalesce(max(training_plan) FILTER (WHERE date = (SELECT max(date) FROM daily_eff)), 0) AS BIGINT)
            AS training_plan,
          {_period_means()}
        FROM daily_eff GROUP BY staff_name""",
    "period_efficiency": f"""
        SELECT staff_name, p.name AS period, count(*) AS days,
          sum(cents) / CAST(100 AS DOUBLE) / count(*) AS efficiency
        FROM daily_eff JOIN (VALUES {_PERIOD_ROWS}) p(name, lo, hi) ON date BETWEEN p.lo AND p.hi
        WHERE cents <> 0 GROUP BY 1, 2""",
    "missing_days": """
        SELECT d AS day FROM all_days WHERE d >= DATE '1998-04-16' AND d < DATE '1998-06-15'
          AND d NOT IN (SELECT CAST(date_in AS DATE) FROM cases WHERE status = 'Cancelled')""",
    "scan_alarms": """
        SELECT case_number, max(complete_date) AS last_scan FROM task_history
        WHERE complete_date <= TIMESTAMP '2024-01-19 15:00:00' GROUP BY 1
        HAVING max(complete_date) < TIMESTAMP '2024-01-19 11:00:00'""",
    "hourly_tasks": """
        SELECT date_trunc('hour', complete_date) AS hour, completed_by, task, count(*) AS n
        FROM task_history GROUP BY 1, 2, 3""",
}
