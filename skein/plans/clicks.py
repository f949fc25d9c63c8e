"""Web-analytics query shapes over ``events``: counts, filters, distincts, group top-k, text search."""

K = "CAST(JSON_VALUE(props, '$.k') AS INT)"

QUERIES = {
    "clicks_q01": "SELECT COUNT(*) AS c FROM events",
    "clicks_q02": "SELECT COUNT(*) AS c FROM events WHERE event_type <> 'view'",
    "clicks_q03": "SELECT ROUND(SUM(value), 2) AS s, COUNT(*) AS c, ROUND(AVG(value), 4) AS a FROM events",
    "clicks_q04": "SELECT ROUND(AVG(user_id), 4) AS a FROM events",
    "clicks_q05": "SELECT COUNT(DISTINCT user_id) AS c FROM events",
    "clicks_q06": "SELECT COUNT(DISTINCT props) AS c FROM events",
    "clicks_q07": "SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events",
    "clicks_q08": "SELECT event_type, COUNT(*) AS c FROM events WHERE event_type <> 'error' GROUP BY event_type ORDER BY c DESC, event_type",
    "clicks_q09": "SELECT event_type, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "clicks_q10": "SELECT event_type, ROUND(SUM(value), 2) AS s, COUNT(*) AS c, ROUND(AVG(value), 4) AS a, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "clicks_q11": "SELECT props, COUNT(DISTINCT user_id) AS u FROM events WHERE event_type = 'click' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "clicks_q12": "SELECT event_type, props, COUNT(DISTINCT user_id) AS u FROM events WHERE event_type <> 'error' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10",
    "clicks_q13": "SELECT props, COUNT(*) AS c FROM events WHERE event_type <> 'view' GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "clicks_q14": "SELECT props, COUNT(DISTINCT user_id) AS u FROM events WHERE event_type <> 'view' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "clicks_q15": "SELECT event_type, props, COUNT(*) AS c FROM events GROUP BY event_type, props ORDER BY c DESC, event_type, props LIMIT 10",
    "clicks_q16": "SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "clicks_q17": "SELECT user_id, event_type, COUNT(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10",
    "clicks_q18": "SELECT user_id, event_type, COUNT(*) AS c FROM events GROUP BY user_id, event_type ORDER BY user_id, event_type LIMIT 10",
    "clicks_q19": "SELECT user_id, CAST(EXTRACT(MINUTE FROM ts) AS INT) AS m, event_type, COUNT(*) AS c FROM events GROUP BY user_id, EXTRACT(MINUTE FROM ts), event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10",
    "clicks_q20": "SELECT event_id, user_id FROM events WHERE user_id = 17",
    "clicks_q21": "SELECT COUNT(*) AS c FROM events WHERE props LIKE '%7%'",
    "clicks_q22": "SELECT event_type, MIN(props) AS p, COUNT(*) AS c FROM events WHERE props LIKE '%5%' GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "clicks_q23": "SELECT event_type, MIN(props) AS p, COUNT(*) AS c, COUNT(DISTINCT user_id) AS u FROM events WHERE props LIKE '%1%' AND event_type NOT LIKE '%o%' GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "clicks_q24": "SELECT event_id, user_id, event_type, value, props FROM events WHERE props LIKE '%99%' ORDER BY ts, event_id LIMIT 10",
    "clicks_q25": "SELECT props FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 10",
    "clicks_q26": "SELECT props FROM events WHERE event_type <> 'view' ORDER BY props, event_id LIMIT 10",
    "clicks_q27": "SELECT props FROM events WHERE event_type <> 'view' ORDER BY ts, props, event_id LIMIT 10",
    "clicks_q28": "SELECT event_type, ROUND(AVG(LENGTH(props)), 4) AS l, COUNT(*) AS c FROM events GROUP BY event_type HAVING COUNT(*) > 100 ORDER BY l DESC, event_type LIMIT 25",
    "clicks_q29": "SELECT SUBSTR(props, 1, 7) AS k, ROUND(AVG(LENGTH(props)), 4) AS l, COUNT(*) AS c, MIN(props) AS p FROM events GROUP BY SUBSTR(props, 1, 7) HAVING COUNT(*) > 10 ORDER BY l DESC, k LIMIT 25",
    "clicks_q30": "SELECT " + ", ".join(f"ROUND(SUM(value + {i}), 2) AS s{i:02d}" for i in range(30)) + " FROM events",
    "clicks_q31": "SELECT event_type, user_id, COUNT(*) AS c, ROUND(SUM(value), 2) AS s, ROUND(AVG(value), 4) AS a FROM events WHERE event_type <> 'view' GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10",
    "clicks_q32": "SELECT event_id, user_id, COUNT(*) AS c, ROUND(SUM(value), 2) AS s FROM events WHERE event_type <> 'view' GROUP BY event_id, user_id ORDER BY c DESC, event_id LIMIT 10",
    "clicks_q33": "SELECT event_id, user_id, COUNT(*) AS c, ROUND(SUM(value), 2) AS s FROM events GROUP BY event_id, user_id ORDER BY c DESC, event_id LIMIT 10",
    "clicks_q34": "SELECT props, COUNT(*) AS c FROM events GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "clicks_q35": "SELECT 1 AS one, props, COUNT(*) AS c FROM events GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "clicks_q36": "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, user_id - 3 AS d, COUNT(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY c DESC, user_id LIMIT 10",
    "clicks_q37": "SELECT props, COUNT(*) AS v FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-15' AND event_type = 'view' AND props <> '' GROUP BY props ORDER BY v DESC, props LIMIT 10",
    "clicks_q38": "SELECT event_type, COUNT(*) AS v FROM events WHERE ts BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' AND user_id IN (1, 2, 3, 5, 8, 13) GROUP BY event_type ORDER BY v DESC, event_type LIMIT 10",
    "clicks_q39": "SELECT event_type, COUNT(*) AS v FROM events WHERE user_id NOT IN (1, 2, 3) AND value BETWEEN 10 AND 50 GROUP BY event_type ORDER BY v DESC, event_type LIMIT 10 OFFSET 1",
    "clicks_q40": "SELECT event_type, CASE WHEN user_id % 2 = 0 AND value > 50 THEN 'big' ELSE '' END AS src, COUNT(*) AS v FROM events GROUP BY event_type, CASE WHEN user_id % 2 = 0 AND value > 50 THEN 'big' ELSE '' END ORDER BY v DESC, event_type, src LIMIT 10 OFFSET 2",
    "clicks_q41": "SELECT user_id % 10 AS h, CAST(ts AS DATE) AS d, COUNT(*) AS v FROM events WHERE event_type = 'click' GROUP BY user_id % 10, CAST(ts AS DATE) ORDER BY v DESC, h, d LIMIT 10",
    "clicks_q42": "SELECT MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS v FROM events WHERE event_type IN ('click', 'view') AND value > 1.5",
    "clicks_q43": "SELECT CAST(EXTRACT(HOUR FROM ts) AS INT) AS h, COUNT(*) AS v FROM events WHERE ts >= DATE '2024-01-14' AND ts < DATE '2024-01-16' GROUP BY EXTRACT(HOUR FROM ts) ORDER BY h",
}
