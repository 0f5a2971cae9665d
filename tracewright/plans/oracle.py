"""The shared tables of the SQL side: events as frames, their windows and sums, as common table expressions."""

from __future__ import annotations

US = 21_600_000_000

CTES = {
    "frames": """SELECT capture_id, event_id AS line_no, abs_us - min(abs_us) OVER (PARTITION BY capture_id) AS t_us, can_id, payload FROM (
        SELECT printf('cap%02d', user_id % 20) AS capture_id, event_id, epoch_us(ts) AS abs_us,
        CASE event_type WHEN 'click' THEN '0C1' WHEN 'error' THEN '0E0' WHEN 'purchase' THEN '0B0' WHEN 'signup' THEN '0A0' ELSE '0F4' END AS can_id,
        printf('%04X%02X', CAST(round(value * 100) AS BIGINT) % 65536, CAST(json_extract_string(props, '$.k') AS BIGINT) % 256) AS payload FROM events)""",
    "captures": """SELECT capture_id, CASE num % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'development' ELSE 'train' END AS grp, 'masquerade' AS kind, 'f' || (num % 3) AS family,
        '0E0' AS target, last_us // 3 AS lo_us, 2 * last_us // 3 AS hi_us, num % 2 + 1 AS fold
        FROM (SELECT capture_id, CAST(substr(capture_id, 4, 2) AS INT) AS num, max(t_us) AS last_us FROM frames GROUP BY capture_id)""",
    "lastw": f"SELECT capture_id, max(t_us // {US}) AS last_w FROM frames GROUP BY capture_id",
    "spine": f"SELECT capture_id, w, printf('%s_w%04d', capture_id, w) AS window_id, w * {US} AS start_us, (w + 1) * {US} AS end_us FROM (SELECT capture_id, unnest(range(0, last_w)) AS w FROM lastw)",
    "placed": f"SELECT f.*, t_us // {US} AS w FROM frames f JOIN lastw USING (capture_id) WHERE t_us // {US} < last_w",
    "perid": """SELECT capture_id, w, can_id, count(*) AS n, min((t_us, line_no)) AS first, min(gap) AS min_gap_us FROM (
        SELECT *, t_us - lag(t_us) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS gap FROM placed) GROUP BY ALL""",
    "fields": """SELECT capture_id, w, line_no, t_us, can_id, f.field_no AS field_no, f.field AS field, f.value AS value FROM (
        SELECT *, unnest([{'field_no': 0, 'field': 'byte0', 'value': a}, {'field_no': 1, 'field': 'byte1', 'value': b}, {'field_no': 2, 'field': 'byte2', 'value': c},
        {'field_no': 3, 'field': 'pair0_be', 'value': a * 256 + b}, {'field_no': 4, 'field': 'pair0_le', 'value': b * 256 + a},
        {'field_no': 5, 'field': 'pair1_be', 'value': b * 256 + c}, {'field_no': 6, 'field': 'pair1_le', 'value': c * 256 + b}]) AS f FROM (
        SELECT p.*, CAST('0x' || substr(payload, 1, 2) AS BIGINT) AS a, CAST('0x' || substr(payload, 3, 2) AS BIGINT) AS b, CAST('0x' || substr(payload, 5, 2) AS BIGINT) AS c FROM placed p))""",
    "perfield": """SELECT capture_id, w, can_id, field, count(*) AS n, min(value) AS low, max(value) AS high, max(step) AS jump, min((t_us, line_no, field_no)) AS first FROM (
        SELECT *, abs(value - lag(value) OVER (PARTITION BY capture_id, w, can_id, field ORDER BY t_us, line_no)) AS step FROM fields) GROUP BY ALL""",
    "trainw": "SELECT s.* FROM spine s JOIN captures USING (capture_id) WHERE grp = 'train'",
    "normal": f"""SELECT can_id, sum(n) / ((SELECT count(*) FROM trainw) * {US / 1e6}) AS rate, any_value(gap) AS median_gap FROM perid JOIN captures USING (capture_id)
        LEFT JOIN (SELECT can_id, greatest(quantile_cont(gap, 0.5) / 1e6, 1e-6) AS gap FROM (SELECT capture_id, can_id, t_us - lag(t_us) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS gap FROM placed)
        JOIN captures USING (capture_id) WHERE grp = 'train' AND gap IS NOT NULL AND can_id <> '0A0' GROUP BY can_id) USING (can_id) WHERE grp = 'train' AND can_id <> '0A0' GROUP BY can_id""",
    "timing": f"""SELECT s.capture_id, s.w, s.window_id, s.start_us, s.end_us, coalesce(sum(CASE WHEN m.rate IS NULL THEN p.n END), 0)::DOUBLE AS unknown_ids,
        coalesce(max(p.n / {US / 1e6} / m.rate), 0.0) AS rate_excess, coalesce(max(CASE WHEN p.n >= 2 THEN m.median_gap / (greatest(p.min_gap_us, 1) / 1e6) END), 0.0) AS short_gaps
        FROM spine s LEFT JOIN perid p USING (capture_id, w) LEFT JOIN normal m USING (can_id) GROUP BY ALL""",
    "reference": "SELECT rate_excess AS v FROM timing JOIN captures USING (capture_id) WHERE grp = 'train'",
    "ranges": """SELECT capture_id, can_id, field, min(value) AS low, max(value) AS high, coalesce(max(step), 0) AS jump FROM (
        SELECT capture_id, can_id, f.field AS field, f.value AS value, abs(f.value - lag(f.value) OVER (PARTITION BY capture_id, can_id, f.field ORDER BY t_us, line_no)) AS step FROM (
        SELECT *, unnest([{'field': 'byte0', 'value': a}, {'field': 'byte1', 'value': b}, {'field': 'byte2', 'value': c}, {'field': 'pair0_be', 'value': a * 256 + b}, {'field': 'pair0_le', 'value': b * 256 + a},
        {'field': 'pair1_be', 'value': b * 256 + c}, {'field': 'pair1_le', 'value': c * 256 + b}]) AS f FROM (
        SELECT p.*, CAST('0x' || substr(payload, 1, 2) AS BIGINT) AS a, CAST('0x' || substr(payload, 3, 2) AS BIGINT) AS b, CAST('0x' || substr(payload, 5, 2) AS BIGINT) AS c FROM frames p))) GROUP BY ALL""",
    "model2": """SELECT can_id, field, min(low) AS low, max(high) AS high, max(jump) AS max_jump, any_value(constant) AS constant, any_value(seen) AS seen FROM (
        SELECT can_id, field, low, high, jump FROM ranges JOIN captures USING (capture_id) WHERE grp = 'train' AND fold = 1
        UNION ALL SELECT can_id, field, low, high, coalesce(jump, 0) FROM perfield JOIN captures USING (capture_id) WHERE grp = 'train' AND fold = 1)
        LEFT JOIN (SELECT can_id, field, count(*) FILTER (low = high) AS constant, count(*) AS seen FROM perfield JOIN captures USING (capture_id) WHERE grp = 'train' AND fold = 1 AND n >= 2 GROUP BY ALL) USING (can_id, field) GROUP BY ALL""",
    "payloads": """SELECT s.capture_id, s.w, s.window_id, coalesce(max(greatest(m.low - p.low, p.high - m.high, 0) / CASE WHEN m.high > m.low THEN m.high - m.low ELSE 1 END), 0.0)::DOUBLE AS out_of_range,
        coalesce(max(CASE WHEN p.n >= 2 AND p.low = p.high AND m.low IS NOT NULL THEN m.high - m.low END), 0)::DOUBLE AS frozen_width,
        coalesce(max(CASE WHEN p.n >= 2 AND p.low = p.high THEN -ln((m.constant + 1) / (m.seen + 2)) END), 0.0)::DOUBLE AS frozen_rate,
        coalesce(max(CASE WHEN p.jump > m.max_jump THEN CASE WHEN m.max_jump > 0 THEN p.jump / m.max_jump ELSE p.jump END END), 0.0)::DOUBLE AS large_jump
        FROM spine s LEFT JOIN perfield p USING (capture_id, w) LEFT JOIN model2 m USING (can_id, field) GROUP BY ALL""",
    "labels": """SELECT s.capture_id, s.w, s.window_id, s.start_us, s.end_us, c.kind, c.fold, c.grp, c.family AS recording_family, coalesce(m, 0) AS injected_frames, coalesce(m, 0) > 0 AS is_attack, CASE WHEN m > 0 THEN c.family END AS family,
        CASE WHEN m > 0 THEN lo_us / 1e6 END AS start_s, CASE WHEN m > 0 THEN greatest(0, least(end_us, hi_us) - greatest(start_us, lo_us)) / 1e6 END AS interval_overlap_s
        FROM spine s JOIN captures c USING (capture_id) LEFT JOIN (SELECT capture_id, w, count(*) AS m FROM placed JOIN captures USING (capture_id)
        WHERE can_id = target AND t_us BETWEEN lo_us AND hi_us GROUP BY ALL) USING (capture_id, w)""",
    # A plain score that needs no model: a window's share of errors, to hold evaluation operators against.
    "outputs": f"""SELECT s.capture_id, s.w, s.window_id, s.start_us, s.end_us, coalesce(e, 0.0) AS attack_score, 0.25::DOUBLE AS threshold, CASE WHEN coalesce(e, 0.0) >= 0.25 THEN 'ATTACK' ELSE 'ACCEPT' END AS decision
        FROM spine s LEFT JOIN (SELECT capture_id, w, count(*) FILTER (can_id = '0E0') / count(*) AS e FROM placed GROUP BY ALL) USING (capture_id, w)""",
    "results": """SELECT o.capture_id, o.w, o.window_id, o.start_us, o.end_us, o.attack_score, o.threshold, o.decision, l.is_attack, l.family, l.kind, l.start_s, l.fold, l.recording_family,
        CASE WHEN decision = 'ATTACK' THEN CASE WHEN is_attack THEN 'TP' ELSE 'FP' END WHEN is_attack THEN 'FN' ELSE 'TN' END AS outcome FROM outputs o JOIN labels l USING (window_id)""",
}
#: What each one is made of.
NEEDS = {
    "frames": (), "captures": ("frames",), "lastw": ("frames",), "spine": ("lastw",), "placed": ("frames", "lastw"), "perid": ("placed",), "fields": ("placed",), "perfield": ("fields",), "trainw": ("spine", "captures"),
    "normal": ("perid", "trainw"), "timing": ("spine", "perid", "normal"), "reference": ("timing", "captures"), "ranges": ("frames",), "model2": ("ranges", "perfield", "captures"), "payloads": ("spine", "perfield", "model2"), "labels": ("spine", "captures", "placed"),
    "outputs": ("spine", "placed"), "results": ("outputs", "labels"),
}


def sql(body: str, *tables: str) -> str:
    """body with the common tables that it names before it, in an order that SQL takes."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    text = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {text} {body}" if text else body


def _folds(frozen: str, watch: str) -> str:
    """Common tables that fit both stages for every model m of train (m, capture_id), score cases (m, capture_id, role) and
    rank the scores among the windows that trained the model: f_scores (m, capture_id, w, window_id, role, v1, v2)."""
    checks = ("unknown_ids", "rate_excess", "short_gaps", "out_of_range", "frozen_break", "large_jump")
    return f"""gapt AS MATERIALIZED (SELECT capture_id, can_id, gap FROM (SELECT capture_id, can_id, t_us - lag(t_us) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS gap FROM placed) WHERE gap IS NOT NULL),
        f_total AS MATERIALIZED (SELECT m, count(*) AS windows FROM train JOIN spine USING (capture_id) GROUP BY m),
        f_rate AS MATERIALIZED (SELECT m, can_id, sum(n) AS frames FROM train JOIN perid USING (capture_id) GROUP BY ALL),
        f_gap AS MATERIALIZED (SELECT m, can_id, greatest(quantile_cont(gap, 0.5) / 1e6, 1e-6) AS gap FROM train JOIN gapt USING (capture_id) GROUP BY ALL),
        f_ids AS MATERIALIZED (SELECT m, can_id, frames / (windows * {US / 1e6}) AS rate, gap AS median_gap FROM f_rate JOIN f_total USING (m) LEFT JOIN f_gap USING (m, can_id)),
        f_range AS MATERIALIZED (SELECT m, can_id, field, min(low) AS low, max(high) AS high, max(jump) AS max_jump FROM train JOIN (SELECT capture_id, can_id, field, low, high, jump FROM ranges UNION ALL SELECT capture_id, can_id, field, low, high, coalesce(jump, 0) FROM perfield) USING (capture_id) {watch} GROUP BY ALL),
        f_held AS MATERIALIZED (SELECT m, can_id, field, count(*) FILTER (low = high) AS constant, count(*) AS seen FROM train JOIN perfield USING (capture_id) WHERE n >= 2 GROUP BY ALL),
        f_fields AS MATERIALIZED (SELECT m, can_id, field, low, high, max_jump, coalesce(constant, 0) AS constant, coalesce(seen, 0) AS seen FROM f_range LEFT JOIN f_held USING (m, can_id, field)),
        f_met AS MATERIALIZED (SELECT DISTINCT m, capture_id FROM (SELECT m, capture_id FROM train UNION ALL SELECT m, capture_id FROM cases)),
        f_one AS MATERIALIZED (SELECT f_met.m, p.capture_id, w, sum(CASE WHEN rate IS NULL THEN n END)::DOUBLE AS unknown_ids, max(n / {US / 1e6} / rate) AS rate_excess, max(CASE WHEN n >= 2 THEN median_gap / (greatest(min_gap_us, 1) / 1e6) END) AS short_gaps
            FROM f_met JOIN perid p ON p.capture_id = f_met.capture_id LEFT JOIN f_ids i ON i.m = f_met.m AND i.can_id = p.can_id GROUP BY ALL),
        f_two AS MATERIALIZED (SELECT f.m, p.capture_id, w, max(greatest(f.low - p.low, p.high - f.high, 0) / CASE WHEN f.high > f.low THEN f.high - f.low ELSE 1 END)::DOUBLE AS out_of_range, max(CASE WHEN p.n >= 2 AND p.low = p.high THEN {frozen} END)::DOUBLE AS frozen_break,
            max(CASE WHEN p.jump > f.max_jump THEN CASE WHEN f.max_jump > 0 THEN p.jump / f.max_jump ELSE p.jump END END)::DOUBLE AS large_jump FROM f_met JOIN perfield p ON p.capture_id = f_met.capture_id JOIN f_fields f ON f.m = f_met.m AND f.can_id = p.can_id AND f.field = p.field GROUP BY ALL),
        f_checks AS MATERIALIZED (SELECT m, capture_id, w, window_id, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in checks)} FROM f_met JOIN spine USING (capture_id) LEFT JOIN f_one USING (m, capture_id, w) LEFT JOIN f_two USING (m, capture_id, w)),
        f_long AS MATERIALIZED (SELECT c.m, c.capture_id, w, window_id, t.m IS NOT NULL AS ref, unnest([{", ".join(f"{{'k': {i}, 'v': {c}}}" for i, c in enumerate(checks))}]) AS x FROM f_checks c LEFT JOIN train t ON t.m = c.m AND t.capture_id = c.capture_id),
        f_ranked AS MATERIALIZED (SELECT m, capture_id, w, window_id, x.k AS k, x.v AS v, count(*) FILTER (ref) OVER (PARTITION BY m, x.k ORDER BY x.v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) FILTER (ref) OVER (PARTITION BY m, x.k, x.v) AS below,
            (count(*) FILTER (ref) OVER (PARTITION BY m, x.k))::DOUBLE AS n, max(x.v) FILTER (ref) OVER (PARTITION BY m, x.k) AS most FROM f_long),
        f_scores AS MATERIALIZED (SELECT m, capture_id, w, window_id, role, max(score) FILTER (k < 3) AS v1, max(score) AS v2 FROM (SELECT *, CASE WHEN v <= most THEN below / (n + 1) ELSE (n + 1 - 1 / (1 + (v - most) / CASE WHEN most > 0 THEN most ELSE 1 END)) / (n + 1) END AS score FROM f_ranked) JOIN cases USING (m, capture_id) GROUP BY ALL),
        f_versions AS MATERIALIZED (SELECT m, capture_id, window_id, role, 'v1' AS version, v1 AS s FROM f_scores UNION ALL SELECT m, capture_id, window_id, role, 'v2', v2 FROM f_scores)"""


def _boundary(by: str, source: str) -> str:
    """(by, version, boundary): the (floor(0.05 n) + 1)-th highest score of each."""
    return f"SELECT {by}, version, s AS boundary FROM (SELECT {by}, version, s, row_number() OVER (PARTITION BY {by}, version ORDER BY s DESC) AS place, count(*) OVER (PARTITION BY {by}, version) AS n FROM ({source})) WHERE place = floor(0.05::DOUBLE * n)::BIGINT + 1"


_FOLD_TABLES = ("spine", "captures", "placed", "perid", "perfield", "ranges")
LOCO = sql(
    f"""SELECT * FROM (WITH caps AS MATERIALIZED (SELECT capture_id FROM captures WHERE grp = 'train'),
        models AS MATERIALIZED (SELECT a.capture_id || '|' || b.capture_id AS m, a.capture_id AS held, b.capture_id AS within FROM caps a JOIN caps b ON a.capture_id <> b.capture_id UNION ALL SELECT capture_id || '|', capture_id, NULL FROM caps),
        train AS MATERIALIZED (SELECT m, capture_id FROM models JOIN caps ON capture_id <> held AND (within IS NULL OR capture_id <> within)),
        cases AS MATERIALIZED (SELECT m, coalesce(within, held) AS capture_id, CASE WHEN within IS NULL THEN 'test' ELSE 'threshold' END AS role FROM models),
        {_folds("f.high - f.low", "")}, own AS MATERIALIZED (SELECT held, role, version, s FROM f_versions JOIN models USING (m)), limits AS MATERIALIZED ({_boundary("held", "SELECT * FROM own WHERE role = 'threshold'")})
        SELECT held AS outer, version, round(boundary, 9) AS boundary, count(*) FILTER (s > boundary) AS alarms, count(*) AS windows FROM own JOIN limits USING (held, version) WHERE role = 'test' GROUP BY held, version, limits.boundary)""",
    *_FOLD_TABLES,
)
ATTACK_CV = sql(
    f"""SELECT * FROM (WITH caps AS MATERIALIZED (SELECT capture_id, grp, fold, family, lo_us, hi_us, CASE fold WHEN 1 THEN '0E0' ELSE '0B0' END AS target, CASE WHEN substr(capture_id, 4, 2) < '10' THEN 'fabrication' ELSE 'masquerade' END AS kind FROM captures),
        dev AS MATERIALIZED (SELECT * FROM caps WHERE grp = 'development'), names AS MATERIALIZED (SELECT DISTINCT fold, fold::VARCHAR AS m FROM dev),
        train AS MATERIALIZED (SELECT m, capture_id FROM names, caps WHERE grp = 'train'),
        cases AS MATERIALIZED (SELECT m, capture_id, 'threshold' AS role FROM names, caps WHERE grp = 'validation' UNION ALL SELECT fold::VARCHAR, capture_id, 'test' FROM dev),
        watch AS MATERIALIZED (SELECT DISTINCT n.m, d.target AS can_id FROM names n JOIN dev d ON d.fold <> n.fold),
        {_folds("f.high - f.low", "JOIN watch USING (m, can_id)")}, limits AS MATERIALIZED ({_boundary("m", "SELECT * FROM f_versions WHERE role = 'threshold'")}),
        struck AS MATERIALIZED (SELECT DISTINCT p.capture_id, w FROM placed p JOIN caps c ON c.capture_id = p.capture_id AND p.can_id = c.target AND t_us BETWEEN lo_us AND hi_us),
        marked AS MATERIALIZED (SELECT c.fold, v.version, boundary, v.capture_id, c.family, c.kind AS condition, x.w IS NOT NULL AS attack, s > boundary AS alarm FROM f_versions v JOIN limits USING (m, version) JOIN caps c ON c.capture_id = v.capture_id JOIN spine p ON p.window_id = v.window_id LEFT JOIN struck x ON x.capture_id = p.capture_id AND x.w = p.w WHERE role = 'test')
        SELECT fold, version, boundary, capture_id, family, condition, count(*) FILTER (attack) AS attacked, count(*) FILTER (attack AND alarm) AS detected, count(*) FILTER (NOT attack) AS normal, count(*) FILTER (NOT attack AND alarm) AS false_alarms FROM marked WHERE attack OR condition <> 'masquerade' GROUP BY ALL)""",
    *_FOLD_TABLES,
)
DETECTOR = sql(
    f"""SELECT * FROM (WITH train AS MATERIALIZED (SELECT 'all' AS m, capture_id FROM captures WHERE grp = 'train'), cases AS MATERIALIZED (SELECT 'all' AS m, capture_id, CASE grp WHEN 'validation' THEN 'threshold' ELSE 'test' END AS role FROM captures WHERE grp <> 'train'),
        {_folds("-ln((f.constant + 1) / (f.seen + 2))", "")}, limits AS MATERIALIZED ({_boundary("m", "SELECT * FROM f_versions WHERE role = 'threshold'")})
        SELECT window_id, round(s, 9) AS attack_score, CASE WHEN s > boundary THEN 'ATTACK' ELSE 'ACCEPT' END AS decision FROM f_versions JOIN limits USING (m, version) WHERE role = 'test' AND version = 'v2')""",
    *_FOLD_TABLES,
)
