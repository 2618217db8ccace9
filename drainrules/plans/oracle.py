"""DuckDB SQL for every registered query: an independent formulation.

The oracle recomputes each result from the raw tables with plain SQL:
exact quantiles by ``row_number`` rank ``ceil(p * n)``, items by ``CASE``,
frequent itemsets by ``GROUP BY CUBE`` with ``GROUPING`` flags, rules by a
self-join, pruning by ``NOT EXISTS`` over rule pairs, as-of matches by
ranked joins.  Round-trip queries (sink then source) compare against the
data before writing.
"""

from __future__ import annotations

# Parameters and code lists are written out here once more, so that a wrong value in the
# code under test does not pass.
APP, MIN_SUPPORT, MIN_CONFIDENCE = "ECONOMY", 0.01, 0.3
READINGS_APP, READINGS_SUPPORT, READINGS_CONFIDENCE = "click", 0.02, 0.3
SINCE_SECONDS = 835401600.0  # 1996-06-22, UTC
SHOWN_TAB = 3
MOBILE_NETWORKS = ("gprs edge umts cdma evdo_0 evdo_a 1xrtt hsdpa hsupa hspa iden evdo_b lte ehrpd hspap gsm "
                   "td_scdma iwlan").split()  # fixed values: the codes 1 to 18


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


DEVICE_SAMPLES = """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no,
  CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS reading_id,
  CASE WHEN l.l_linenumber = 7 AND l.l_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE (l.l_extendedprice - 20000.0) / 50000.0 END AS rate,
  l.l_quantity / 40.0 - 0.1 AS cpu,
  CASE WHEN l.l_linenumber = 7 AND l.l_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE l.l_quantity * l.l_linenumber END AS distance,
  l.l_quantity * 2.5 AS temp,
  3.0 + l.l_tax * 20.0 AS voltage,
  CASE WHEN l.l_linenumber = 1 THEN -1.0 WHEN l.l_linenumber = 2 THEN -2.0
       ELSE CAST(l.l_suppkey * 3 AS DOUBLE) END AS screen,
  CASE WHEN l.l_partkey % 21 = 19 THEN 'null' WHEN l.l_partkey % 21 = 20 THEN 'lte_a'
       ELSE CAST(l.l_partkey % 21 AS VARCHAR) END AS mobileNetwork,
  CASE WHEN l.l_returnflag = 'A' THEN 'wifi' WHEN l.l_returnflag = 'N' THEN 'mobile'
       ELSE 'unknown' END AS network,
  CAST(5 - l.l_partkey % 120 AS DOUBLE) AS wifiStrength,
  CAST(l.l_orderkey % 150 - 5 AS DOUBLE) AS wifiSpeed,
  p.p_brand AS app1, p.p_type AS app2,
  array_to_string(list_sort(list_distinct([p.p_brand, p.p_type])), ',') AS apps,
  CAST(epoch_us(l.l_shipdate) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS time
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

UUID = ("CASE WHEN user_id % 10 = 0 THEN 'ios-device-000000-' || CAST(user_id AS VARCHAR) "
        "ELSE 'and' || CAST(user_id AS VARCHAR) END")
CTIME = "CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000000 AS DOUBLE)"

READINGS = f"""
SELECT CAST(event_id AS BIGINT) AS reading_id, {UUID} AS uuid, {CTIME} AS time,
  CASE WHEN value > 100 THEN CAST(100 AS DOUBLE) ELSE value END AS battery_level,
  array_to_string(list_sort(list_distinct([event_type, 'app' || regexp_extract(props, '([0-9]+)', 1)])), ',') AS apps,
  list_distinct([event_type, 'app' || regexp_extract(props, '([0-9]+)', 1)]) AS app_list,
  event_type,
  (event_id % 41) / 40.0::DOUBLE AS cpu, CAST(event_id % 200 AS DOUBLE) AS distance, CAST(event_id % 90 + 5 AS DOUBLE) AS temp,
  3.0::DOUBLE + (event_id % 9) / 10.0::DOUBLE AS voltage,
  CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE event_id % 256 END::DOUBLE AS screen,
  CASE WHEN user_id % 21 = 19 THEN 'null' WHEN user_id % 21 = 20 THEN 'lte_a' ELSE CAST(user_id % 21 AS VARCHAR) END AS mobileNetwork,
  CASE event_id % 3 WHEN 0 THEN 'wifi' WHEN 1 THEN 'mobile' ELSE 'unknown' END AS network,
  CAST(5 - user_id % 120 AS DOUBLE) AS wifiStrength, CAST(event_id % 150 - 5 AS DOUBLE) AS wifiSpeed
FROM events
"""

REGISTRATIONS = f"""
SELECT {UUID} AS uuid, {CTIME} AS reg_time, regexp_extract(props, '([0-9]+)', 1) AS os
FROM events WHERE event_type = 'signup'
"""

PAIRS = f"""
SELECT uuid, prev_id, cur_id, prev_time, cur_time, prev_level, cur_level, prev_apps, cur_apps FROM (
  SELECT uuid, reading_id AS cur_id, time AS cur_time, battery_level AS cur_level, app_list AS cur_apps,
    lag(reading_id) OVER w AS prev_id, lag(time) OVER w AS prev_time,
    lag(battery_level) OVER w AS prev_level, lag(app_list) OVER w AS prev_apps
  FROM ({READINGS}) r WHERE length(uuid) <= 16
  WINDOW w AS (PARTITION BY uuid ORDER BY time, reading_id)
) t WHERE prev_id IS NOT NULL AND cur_time > prev_time
"""

EVENT_RATES = f"""
SELECT uuid, cur_id, cur_time,
  (prev_level - cur_level) / (cur_time - prev_time) AS rate,
  list_distinct(list_concat(prev_apps, cur_apps)) AS app_list
FROM ({PAIRS}) p
"""

APP_COUNTS = f"""
SELECT app, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(app_list) AS app FROM ({EVENT_RATES}) r) t GROUP BY app
"""

# --------------------------------------------------------------- discretisation
# (bin name, sample column, probabilities, in-domain condition on x)
_BINNED = [
    ("rate", "rate", [0.25, 0.5, 0.75], "NOT (x < 0 OR x > 1)"),
    ("cpu", "cpu", [0.25, 0.5, 0.75], "NOT (x < 0 OR x > 1)"),
    ("temperature", "temp", [0.25, 0.5, 0.75], "NOT (x < 5 OR x > 100)"),
    ("voltage", "voltage", [(1.0 / 3) * 1, (1.0 / 3) * 2], "TRUE"),
    ("screen", "screen", [0.25, 0.5, 0.75], "NOT (x = -1 OR x < -1 OR x > 255)"),
    ("wifiStrength", "wifiStrength", [0.25, 0.5, 0.75], "NOT (x < -100 OR x > 0)"),
    ("wifiSpeed", "wifiSpeed", [0.25, 0.5, 0.75], "NOT (x < 0)"),
]


def _app_samples() -> str:
    return f"SELECT * FROM ({DEVICE_SAMPLES}) s WHERE list_contains(list_distinct([app1, app2]), '{APP}')"


def _reading_samples() -> str:
    """Samples of the readings that end a rate of the app."""
    return (f"SELECT r.rate, d.* FROM ({EVENT_RATES}) r JOIN ({READINGS}) d ON d.reading_id = r.cur_id "
            f"WHERE list_contains(r.app_list, '{READINGS_APP}')")


def _dom() -> str:
    parts = []
    for name, col, _, cond in _BINNED:
        c = cond.replace("x", col) if cond != "TRUE" else "TRUE"
        parts.append(f"SELECT '{name}' AS feature, {col} AS x FROM app WHERE {col} IS NOT NULL AND NOT isnan({col}) AND {c}")
    return " UNION ALL ".join(parts)


def _probs() -> str:
    rows = [f"('{name}', {i + 1}, {_d(p)})" for name, _, ps, _ in _BINNED for i, p in enumerate(ps)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(feature, qi, p)"


def _bins_ctes(samples: str | None = None) -> str:
    pivots = ", ".join(
        f"max(CASE WHEN feature = '{name}' AND qi = {i + 1} THEN q END) AS {name}_q{i + 1}"
        for name, _, ps, _ in _BINNED for i in range(len(ps)))
    return f"""
app AS ({samples or _app_samples()}),
dom AS ({_dom()}),
ranked AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn,
                  count(*) OVER (PARTITION BY feature) AS n FROM dom),
probs AS ({_probs()}),
qs AS (SELECT pr.feature, pr.qi, r.x AS q FROM probs pr JOIN ranked r ON r.feature = pr.feature
       AND r.rn = greatest(1, least(r.n, CAST(ceil(pr.p * r.n) AS BIGINT)))),
mm AS (SELECT feature, min(x) AS mn, max(x) AS mx, count(*) AS n FROM dom GROUP BY feature),
bins AS (SELECT feature, 0 AS idx, mn AS bound FROM mm
         UNION ALL SELECT feature, qi AS idx, q AS bound FROM qs
         UNION ALL SELECT m.feature, CAST(count(q.qi) + 1 AS INTEGER) AS idx, m.mx AS bound
                   FROM mm m LEFT JOIN qs q ON q.feature = m.feature GROUP BY m.feature, m.mx),
b AS (SELECT {pivots} FROM qs)"""


def _bucket(x: str, name: str, k: int) -> str:
    whens = " ".join(f"WHEN {x} <= b.{name}_q{i} THEN {i}" for i in range(1, k + 1))
    return f"CASE {whens} ELSE {k + 1} END"


def _items_select(excluded: frozenset = frozenset()) -> str:
    codes = " ".join(f"WHEN mobileNetwork = '{k}' THEN '{v}'" for k, v in enumerate(MOBILE_NETWORKS, 1))
    items = {
        "rate": f"CASE WHEN rate IS NULL THEN NULL ELSE 'rate=q' || {_bucket('rate', 'rate', 3)} END",
        "cpu": f"CASE WHEN cpu IS NULL OR isnan(cpu) OR cpu < 0 OR cpu > 1 THEN NULL ELSE 'cpu=q' || {_bucket('cpu', 'cpu', 3)} END",
        "distance": "CASE WHEN distance IS NULL OR isnan(distance) THEN NULL WHEN distance >= 100 THEN 'distance=yes' "
                    "WHEN distance < 100 THEN 'distance=no' END",
        "temperature": f"CASE WHEN temp IS NULL OR isnan(temp) OR temp < 5 OR temp > 100 THEN NULL "
                       f"ELSE 'temperature=q' || {_bucket('temp', 'temperature', 3)} END",
        "voltage": f"CASE WHEN voltage IS NULL THEN NULL ELSE 'voltage=q' || {_bucket('voltage', 'voltage', 2)} END",
        "screen": f"CASE WHEN screen IS NULL OR isnan(screen) THEN NULL WHEN screen = -1 THEN 'screen=auto' "
                  f"WHEN screen < -1 OR screen > 255 THEN NULL ELSE 'screen=q' || {_bucket('screen', 'screen', 3)} END",
        "mobileNetType": "'mobileNetType=' || CASE WHEN mobileNetwork IS NULL OR mobileNetwork IN ('unknown', 'null') "
                         f"THEN 'unknown' {codes} WHEN regexp_full_match(mobileNetwork, '[0-9]+') THEN 'unknown' "
                         "ELSE mobileNetwork END",
        "netType": "'netType=' || CASE WHEN network IS NULL OR network IN ('unknown', 'null') THEN 'unknown' ELSE network END",
        "wifiStrength": f"CASE WHEN wifiStrength IS NULL OR isnan(wifiStrength) OR wifiStrength < -100 OR wifiStrength > 0 "
                        f"THEN NULL ELSE 'wifiStrength=q' || {_bucket('wifiStrength', 'wifiStrength', 3)} END",
        "wifiSpeed": f"CASE WHEN wifiSpeed IS NULL OR isnan(wifiSpeed) OR wifiSpeed < 0 THEN NULL "
                     f"ELSE 'wifiSpeed=q' || {_bucket('wifiSpeed', 'wifiSpeed', 3)} END",
    }
    cols = []
    for k, expr in items.items():
        cols.append(f"CAST(NULL AS VARCHAR) AS i_{k}" if k in excluded else f"{expr} AS i_{k}")
    return ", ".join(cols)


ITEM_COLS = ["rate", "cpu", "distance", "temperature", "voltage", "screen", "mobileNetType", "netType",
             "wifiStrength", "wifiSpeed"]


def _items_ctes(excluded: frozenset = frozenset(), samples: str | None = None) -> str:
    return f"""{_bins_ctes(samples)},
items AS (SELECT reading_id, {_items_select(excluded)} FROM app CROSS JOIN b)"""


def _tx_list() -> str:
    return "list_filter([" + ", ".join(f"i_{c}" for c in ITEM_COLS) + "], lambda x: x IS NOT NULL)"


def _mining_ctes(samples: str | None = None, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> str:
    cols = ", ".join(f"i_{c}" for c in ITEM_COLS)
    flags = ", ".join(f"GROUPING(i_{c}) AS g_{c}" for c in ITEM_COLS)
    present = " AND ".join(f"(g_{c} = 1 OR i_{c} IS NOT NULL)" for c in ITEM_COLS)
    nonempty = " + ".join(f"g_{c}" for c in ITEM_COLS) + f" < {len(ITEM_COLS)}"
    picked = "list_sort(list_filter([" + ", ".join(f"CASE WHEN g_{c} = 0 THEN i_{c} END" for c in ITEM_COLS) + \
             "], lambda x: x IS NOT NULL))"
    return f"""{_items_ctes(samples=samples)},
tx AS (SELECT {cols}, count(*) AS w FROM items GROUP BY {cols}),
cells AS (SELECT {cols}, {flags}, sum(w) AS freq FROM tx GROUP BY CUBE ({cols})),
fi AS (SELECT {picked} AS items, CAST(freq AS BIGINT) AS freq FROM cells
       WHERE {present} AND {nonempty}
         AND freq >= ceil({_d(support)} * (SELECT count(*) FROM items))),
ru AS (SELECT items AS u_items, freq AS freq_u, unnest(items) AS c FROM fi WHERE len(items) >= 2),
rules AS (SELECT list_sort(list_filter(ru.u_items, lambda x: x <> ru.c)) AS antecedent, ru.c AS consequent,
                 CAST(ru.freq_u AS DOUBLE) / CAST(a.freq AS DOUBLE) AS confidence
          FROM ru JOIN fi a ON a.items = list_sort(list_filter(ru.u_items, lambda x: x <> ru.c))
          WHERE CAST(ru.freq_u AS DOUBLE) / CAST(a.freq AS DOUBLE) >= {_d(confidence)}),
rr AS (SELECT * FROM rules WHERE starts_with(consequent, 'rate=')),
pr AS (SELECT * FROM rr r WHERE NOT EXISTS (
         SELECT 1 FROM rr o WHERE o.consequent = r.consequent AND o.confidence = r.confidence
           AND len(o.antecedent) < len(r.antecedent) AND list_has_all(r.antecedent, o.antecedent)))"""


def _rule_out(rel: str, extra: str = "") -> str:
    return (f"SELECT array_to_string(antecedent, ';') AS antecedent, consequent, confidence, "
            f"CAST(len(antecedent) AS INTEGER) AS n_antecedent{extra} FROM {rel}")


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().lstrip(',')}\n{body}"


def _to_precision2(x: str) -> str:
    e0 = f"floor(log10(abs({x})))"
    e = f"CAST(CASE WHEN round(abs({x}) / pow(10, {e0} - 1)) >= 100 THEN {e0} + 1 ELSE {e0} END AS INTEGER)"
    fixed = " ".join(f"WHEN {ee} THEN printf('%.{1 - ee}f', round({x}, {1 - ee}))" for ee in range(-6, 2))
    expo = (f"printf('%.1f', round({x} / pow(10, {e}), 1)) || 'e' || CASE WHEN {e} < 0 THEN '-' ELSE '+' END "
            f"|| CAST(abs({e}) AS VARCHAR)")
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN' WHEN {x} = 0 THEN '0.0' "
            f"ELSE (CASE {e} {fixed} ELSE {expo} END) END)")


def _js_number(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _frac(x: str) -> str:
    return f"({x} IS NULL OR isnan({x}) OR {x} <> floor({x}))"


FLAT = "reading_id, rate, cpu, distance, temp, voltage, screen, mobileNetwork, network, wifiStrength, wifiSpeed"
SAMPLE = "rate, cpu, distance, temp, voltage, screen, mobileNetwork, network, wifiStrength, wifiSpeed"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_rates"] = f"SELECT {FLAT}, apps, time FROM ({DEVICE_SAMPLES}) s"
    q["flatten_rate"] = q["scan_rates"]
    q["scan_readings"] = ("SELECT reading_id, uuid, time, battery_level, apps, cpu, distance, temp, voltage, screen, mobileNetwork, network, "
                         f"wifiStrength, wifiSpeed FROM ({READINGS}) r")
    q["scan_registrations"] = f"SELECT uuid, reg_time, os FROM ({REGISTRATIONS}) g"
    q["pair_samples"] = f"SELECT uuid, prev_id, cur_id, prev_time, cur_time, prev_level, cur_level FROM ({PAIRS}) p"
    q["scan_pairs"] = q["pair_samples"]
    q["csv_roundtrip"] = f"SELECT {SAMPLE} FROM ({DEVICE_SAMPLES}) s"
    q["tsv_roundtrip"] = q["csv_roundtrip"]
    q["csv_odd_roundtrip"] = ("SELECT rate, cpu, distance, temp, voltage, screen, CASE line_no % 4 WHEN 0 THEN ' ' || mobileNetwork || ' ' WHEN 1 THEN '' "
                              f"WHEN 2 THEN chr(34) || mobileNetwork ELSE 'null' END AS mobileNetwork, network, wifiStrength, wifiSpeed FROM ({DEVICE_SAMPLES}) s")
    q["app_usage_counts"] = f"SELECT app, n FROM ({APP_COUNTS}) c"
    q["app_counts_json_roundtrip"] = q["app_usage_counts"]
    q["app_counts_tsv_roundtrip"] = q["app_usage_counts"]
    q["app_counts_odd_names_roundtrip"] = (
        "SELECT CASE n % 3 WHEN 0 THEN ' ' || chr(34) || app || chr(92) || ' ' WHEN 1 THEN app || ', ' || chr(34) || 'x' || chr(34) || ':1,' "
        f"ELSE app END AS app, n FROM ({APP_COUNTS}) c")
    q["popular_apps"] = f"SELECT app, n FROM ({APP_COUNTS}) c WHERE n > 1000"
    q["top_apps"] = (f"SELECT app, n, CAST(row_number() OVER (ORDER BY n DESC, app) AS BIGINT) AS rank "
                     f"FROM ({APP_COUNTS}) c WHERE n > 1000 ORDER BY n DESC, app LIMIT 100")
    q["app_counts_by_name"] = (f"SELECT app, n, CAST(row_number() OVER (ORDER BY app DESC) AS BIGINT) AS rank "
                               f"FROM ({APP_COUNTS}) c")
    q["filter_app"] = q["filter_app_stored"] = (f"SELECT reading_id, rate, apps FROM ({DEVICE_SAMPLES}) s "
                       f"WHERE list_contains(list_distinct([app1, app2]), '{APP}')")
    q["filter_android"] = f"SELECT reading_id, uuid FROM ({READINGS}) r WHERE length(uuid) <= 16"
    q["filter_recent_rates"] = (f"SELECT reading_id, rate, time FROM ({DEVICE_SAMPLES}) s "
                                f"WHERE NOT isnan(rate) AND rate >= 0 AND time > {_d(SINCE_SECONDS)}")
    q["pairs_to_rates"] = f"""
WITH r AS ({EVENT_RATES}),
g AS ({REGISTRATIONS}),
cand AS (SELECT r.cur_id, g.reg_time, g.os,
           row_number() OVER (PARTITION BY r.cur_id ORDER BY g.reg_time DESC, g.os DESC) AS k
         FROM r JOIN g ON g.uuid = r.uuid AND g.reg_time <= r.cur_time)
SELECT r.uuid, r.cur_id, r.rate, array_to_string(list_sort(r.app_list), ',') AS apps, c.reg_time, c.os
FROM r LEFT JOIN cand c ON c.cur_id = r.cur_id AND c.k = 1"""
    q["pair_samples_stored"], q["pairs_to_rates_stored"] = q["pair_samples"], q["pairs_to_rates"]
    q["asof_registration"] = f"""
WITH e AS (SELECT reading_id AS event_id, uuid, time FROM ({READINGS}) r WHERE event_type <> 'signup'),
g AS ({REGISTRATIONS}),
cand AS (SELECT e.event_id, g.reg_time, g.os,
           row_number() OVER (PARTITION BY e.event_id ORDER BY g.reg_time DESC, g.os DESC) AS k
         FROM e JOIN g ON g.uuid = e.uuid AND g.reg_time <= e.time)
SELECT e.event_id, e.uuid, e.time, c.reg_time, c.os FROM e LEFT JOIN cand c ON c.event_id = e.event_id AND c.k = 1"""

    q["feature_bins"] = _with(_bins_ctes(), "SELECT feature, CAST(idx AS INTEGER) AS idx, bound FROM bins")
    q["feature_bins_approx"] = _with(_bins_ctes(), "SELECT b.feature, CAST(b.idx AS INTEGER) AS idx, CAST(mm.n AS BIGINT) AS n_values, "
                                                   "TRUE AS within_error FROM bins b JOIN mm ON mm.feature = b.feature")
    q["feature_min_max"] = _with(_bins_ctes(), "SELECT feature, mn AS min_value, mx AS max_value, "
                                               "CAST(n AS BIGINT) AS n_values FROM mm")
    tx = f"SELECT reading_id, array_to_string({_tx_list()}, ';') AS items, CAST(len({_tx_list()}) AS INTEGER) AS n_items FROM items"
    q["transactions"] = _with(_items_ctes(), tx)
    excluded = frozenset({"cpu", "temperature", "mobileNetType"})
    ex_bins = _bins_ctes()  # bins of non-excluded features are unchanged by exclusion
    q["transactions_excluded"] = _with(
        ex_bins + f",\nitems AS (SELECT reading_id, {_items_select(excluded)} FROM app CROSS JOIN b)", tx)
    for key, item in [("disc_rate", "rate"), ("disc_cpu", "cpu"), ("disc_distance", "distance"),
                      ("disc_temperature", "temperature"), ("disc_voltage", "voltage"), ("disc_screen", "screen"),
                      ("disc_mobile_network", "mobileNetType"), ("disc_network", "netType"),
                      ("disc_wifi_strength", "wifiStrength"), ("disc_wifi_speed", "wifiSpeed")]:
        q[key] = _with(_items_ctes(), f"SELECT reading_id, i_{item} AS item FROM items")

    m = _mining_ctes()
    q["frequent_itemsets"] = _with(m, "SELECT array_to_string(items, ';') AS items, freq, "
                                      "CAST(len(items) AS INTEGER) AS n_items FROM fi")
    q["search_from_readings"] = _with(_mining_ctes(_reading_samples(), READINGS_SUPPORT, READINGS_CONFIDENCE), _rule_out("pr"))
    q["association_rules"] = _with(m, _rule_out("rules"))
    q["rate_rules"] = _with(m, _rule_out("rr"))
    q["pruned_rules"] = _with(m, _rule_out("pr"))
    q["stored_rules"] = q["pruned_rules"]
    q["sorted_rules"] = _with(m, _rule_out(
        "pr", ", CAST(row_number() OVER (ORDER BY confidence DESC, array_to_string(antecedent, ';'), consequent) AS BIGINT) AS rank"))
    q["rule_groups"] = _with(m, "SELECT consequent, confidence, CAST(count(*) AS BIGINT) AS n_rules FROM rr "
                                "GROUP BY consequent, confidence")
    q["rule_counts"] = _with(m, """SELECT CAST(coalesce(TRY_CAST(NULLIF(regexp_extract(consequent, 'rate=q(\\d)', 1), '') AS INTEGER), -1) AS INTEGER) AS rate_bin,
       CAST(count(*) AS BIGINT) AS n_rules FROM pr GROUP BY 1
UNION ALL SELECT 0 AS rate_bin, CAST(count(*) AS BIGINT) AS n_rules FROM pr""")
    q["rules_by_rate_bin"] = _with(m, _rule_out(
        f"(SELECT * FROM pr WHERE regexp_extract(consequent, 'rate=q(\\d)', 1) = '{SHOWN_TAB + 1}') t"))
    q["rules_json"] = _with(m, f"SELECT '{APP}' AS applicationName, {_d(MIN_SUPPORT)} AS minSupport, "
                               f"{_d(MIN_CONFIDENCE)} AS minConfidence, array_to_string(antecedent, ';') AS antecedent, "
                               "consequent, confidence FROM pr")
    lo, hi = "lo.bound", "hi.bound"
    frac = f"({_frac(lo)} OR {_frac(hi)})"
    label = (f"CASE WHEN hb.feature IS NULL THEN it.item ELSE it.f || ' is ' || "
             f"CASE WHEN {lo} IS NULL THEN 'NaN' WHEN {frac} THEN {_to_precision2(lo)} ELSE {_js_number(lo)} END || ' - ' || "
             f"CASE WHEN {hi} IS NULL THEN 'NaN' WHEN {frac} THEN {_to_precision2(hi)} ELSE {_js_number(hi)} END END")
    q["rule_labels"] = _with(m, f""",
its AS (SELECT DISTINCT item FROM (SELECT unnest(antecedent) AS item FROM pr UNION ALL SELECT consequent FROM pr) u),
it AS (SELECT item, CASE WHEN regexp_matches(item, '([^=]*)=q(\\d)') THEN regexp_extract(item, '([^=]*)=q(\\d)', 1) END AS f,
              CASE WHEN regexp_matches(item, '([^=]*)=q(\\d)') THEN CAST(regexp_extract(item, '([^=]*)=q(\\d)', 2) AS INTEGER) END AS qn
       FROM its),
hb AS (SELECT DISTINCT feature FROM bins)
SELECT it.item, {label} AS label
FROM it LEFT JOIN hb ON hb.feature = it.f
LEFT JOIN bins lo ON lo.feature = it.f AND lo.idx = it.qn - 1
LEFT JOIN bins hi ON hi.feature = it.f AND hi.idx = it.qn""")
    q["rate_bin_labels"] = _with(_bins_ctes(), f"""
SELECT CAST(lo.idx AS INTEGER) AS tab, ' Rate is ' || {_to_precision2('lo.bound')} || ' - ' || {_to_precision2('hi.bound')} || ' % / s' AS label
FROM bins lo JOIN bins hi ON hi.feature = lo.feature AND hi.idx = lo.idx + 1 WHERE lo.feature = 'rate'""")
    return q
