"""SQL for DuckDB that yields the rows of the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from ledgerloom.functions.scalars import SHAPES
from ledgerloom.operators.chain import GENESIS
from ledgerloom.operators.rowscorer import NAMES
from ledgerloom.plans.catalog import BIAS, BUDGETS, REPLAYED, ROW_BIAS, ROW_WEIGHTS, WEIGHTS, WORKED

H = 3_600_000_000
_SHAPES = ", ".join(f"'{s}'" for s in SHAPES)

ALL = f"""
n AS (SELECT max(user_id) + 1 AS n FROM events),
led0 AS (
    SELECT event_id + 1 AS txn_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(ts) AS ts_us,
        'U' || user_id || '|' || (event_id % 4) AS src,
        'U' || ((user_id * 7 + event_id * 13) % (SELECT n FROM n)) || '|' || ((event_id // 4) % 4) AS dst,
        CAST(value AS DECIMAL(20, 2)) AS amount, event_type AS payment_format,
        CAST(CASE WHEN event_type = 'purchase' AND user_id % 10 = 3 THEN (user_id // 10) * 4 + (day(ts) - 1) // 8 + 1 ELSE 0 END AS BIGINT) AS pattern_id,
        (event_type = 'purchase' AND user_id % 10 = 3) OR coalesce(TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) % 25 = 7, false) AS is_laundering
    FROM events
),
led AS (SELECT *, CASE WHEN pattern_id > 0 THEN [{_SHAPES}][pattern_id % 8 + 1] END AS typology FROM led0)
"""
LEDGER = ALL + ", lg AS (SELECT * FROM led WHERE payment_format = 'purchase')"
ORIGIN = LEDGER + ", o AS (SELECT min(ts_us) AS origin, max(ts_us) AS last FROM lg)"


def windows(width: int = 72, stride: int = 24, degree: int = 60) -> str:
    w, s = width * H, stride * H
    return ORIGIN + f""",
spine AS (SELECT unnest(generate_series(0, (last - origin) // {s})) AS w, origin FROM o),
win AS (SELECT s.w, s.origin + s.w * {s} AS window_start, lg.* FROM lg JOIN spine s ON ts_us >= s.origin + s.w * {s} AND ts_us < s.origin + s.w * {s} + {w}),
deg AS (SELECT w, acct, count(*) AS degree FROM (SELECT w, src AS acct FROM win UNION ALL SELECT w, dst FROM win) GROUP BY w, acct),
hubs AS (SELECT w, acct FROM deg WHERE degree > {degree}),
kept AS (SELECT * FROM win WHERE NOT EXISTS (SELECT 1 FROM hubs h WHERE h.w = win.w AND h.acct IN (win.src, win.dst)))"""


def found(width: int = 72, stride: int = 24, degree: int = 60, most: int = 100) -> str:
    return windows(width, stride, degree) + f""",
edge AS (SELECT w, src AS a, dst AS b FROM kept UNION SELECT w, dst, src FROM kept),
reach AS (SELECT w, a, a AS b FROM edge UNION SELECT r.w, r.a, e.b FROM reach r JOIN edge e ON r.w = e.w AND r.b = e.a),
lab AS (SELECT w, a AS node, min(b) AS component FROM reach GROUP BY w, a),
mem AS (SELECT k.*, l.component FROM kept k JOIN lab l ON k.w = l.w AND k.src = l.node),
acc AS (SELECT w, component, count(*) AS accounts FROM lab GROUP BY w, component),
grp AS (SELECT w, component, count(*) AS txns, min(txn_id) AS first_txn, string_agg(CAST(txn_id AS VARCHAR), ',' ORDER BY txn_id) AS txn_ids FROM mem GROUP BY w, component),
fit AS (SELECT g.*, a.accounts FROM grp g JOIN acc a USING (w, component) WHERE txns BETWEEN 3 AND {most} AND accounts BETWEEN 3 AND 60),
cand AS (SELECT txn_ids, min(w) AS w, arg_min(component, w) AS component, min(first_txn) AS first_txn, min(txns) AS txns, min(accounts) AS accounts, (SELECT origin FROM o) + min(w) * {stride * H} AS window_start FROM fit GROUP BY txn_ids),
cm AS (SELECT c.w, c.first_txn, c.window_start, m.txn_id, m.ts_us, m.src, m.dst, CAST(m.amount AS DOUBLE) AS amount, m.is_laundering, m.pattern_id FROM cand c JOIN mem m ON m.w = c.w AND m.component = c.component),
ca AS (
    SELECT w, first_txn, acct, sum(i) AS in_amt, sum(u) AS out_amt, sum(s) AS sends, sum(r) AS recvs FROM (
        SELECT w, first_txn, src AS acct, 0.0 AS i, amount AS u, 1 AS s, 0 AS r FROM cm UNION ALL SELECT w, first_txn, dst, amount, 0.0, 0, 1 FROM cm
    ) GROUP BY w, first_txn, acct
)"""


FEATURES = """,
fa AS (
    SELECT w, first_txn, count(*) AS txns, sum(amount) AS total, greatest(0.0, max(amount)) AS max_amount, avg(amount) AS mean,
        (max(ts_us) - min(ts_us)) / 3600000000.0 AS span_hours, 1 - count(DISTINCT src || '>' || dst) / CAST(count(*) AS DOUBLE) AS pair_reuse,
        CASE WHEN avg(amount) <= 0 THEN 0.0 ELSE 1 / (1 + stddev_pop(amount) / avg(amount)) END AS amount_uniformity
    FROM cm GROUP BY w, first_txn
),
ff AS (
    SELECT w, first_txn, count(*) AS accounts, count(*) FILTER (sends > 0) AS senders, count(*) FILTER (recvs > 0) AS receivers,
        count(*) FILTER (in_amt > 0 AND out_amt > 0) / CAST(count(*) AS DOUBLE) AS pass_through,
        coalesce(avg(least(out_amt / in_amt, in_amt / out_amt)) FILTER (in_amt > 0 AND out_amt > 0), 0.0) AS conservation,
        count(*) FILTER (sends > 0 AND recvs = 0) AS only_s, count(*) FILTER (recvs > 0 AND sends = 0) AS only_r
    FROM ca GROUP BY w, first_txn
),
gaps AS (SELECT w, first_txn, (ts_us - lag(ts_us) OVER (PARTITION BY w, first_txn ORDER BY ts_us, txn_id)) / 1e6 AS gap FROM cm),
gs AS (SELECT w, first_txn, count(gap) AS m, avg(gap) AS mean, stddev_pop(gap) AS sd FROM gaps GROUP BY w, first_txn),
gr AS (SELECT *, CASE WHEN m >= 1 AND mean > 0 THEN sd / mean END AS r FROM gs),
fb AS (
    SELECT w, first_txn, CASE WHEN r IS NOT NULL AND (sqrt(m + 1) - 2) * r + sqrt(m - 1) <> 0
        THEN greatest(-1.0, least(1.0, (sqrt(m + 1) * r - sqrt(m - 1)) / ((sqrt(m + 1) - 2) * r + sqrt(m - 1)))) ELSE 0.0 END AS burstiness FROM gr
),
near AS (SELECT w, first_txn, count(*) OVER (PARTITION BY w, first_txn ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS near FROM cm),
fh AS (SELECT w, first_txn, max(near) / CAST(count(*) AS DOUBLE) AS max_hour_share FROM near GROUP BY w, first_txn),
came AS (SELECT w, first_txn, dst AS acct, min(ts_us) AS came FROM cm GROUP BY ALL),
delay AS (SELECT c.w, c.first_txn, c.acct, min(m.ts_us) - min(c.came) AS delay FROM came c JOIN cm m ON m.w = c.w AND m.first_txn = c.first_txn AND m.src = c.acct AND m.ts_us >= c.came GROUP BY ALL),
med AS (SELECT w, first_txn, quantile_cont(delay, 0.5) AS median FROM delay GROUP BY ALL),
sp AS (SELECT w, first_txn, max(ts_us) - min(ts_us) AS span FROM cm GROUP BY ALL),
fw AS (
    SELECT sp.w, sp.first_txn, CASE WHEN median IS NULL THEN 0.0 WHEN span <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - median / CAST(span AS DOUBLE))) END AS fast_forward
    FROM sp LEFT JOIN med ON med.w = sp.w AND med.first_txn = sp.first_txn
),
feat AS (
    SELECT fa.*, ff.* EXCLUDE (w, first_txn), burstiness, max_hour_share, fast_forward, txns / CAST(accounts AS DOUBLE) AS density,
        CASE WHEN only_s + only_r = 0 THEN 0.0 ELSE 2.0 * least(only_s, only_r) / (only_s + only_r) END AS partition_balance,
        CASE WHEN senders = 1 THEN 'FAN-OUT' WHEN receivers = 1 THEN 'FAN-IN' WHEN senders + receivers - accounts = accounts THEN 'CYCLE' WHEN senders + receivers - accounts = 0 THEN 'BIPARTITE' ELSE 'MIXED' END AS typology
    FROM fa JOIN ff USING (w, first_txn) JOIN fb USING (w, first_txn) JOIN fh USING (w, first_txn) JOIN fw USING (w, first_txn)
)"""

#: The temporal set, in order.
VECTOR = {"log_total": "ln(1 + total)", "log_max": "ln(1 + max_amount)", "log_mean": "ln(1 + mean)", "conservation": "conservation", "pass_through": "pass_through", "log_txns": "ln(1 + txns)", "log_accounts": "ln(1 + accounts)", "density": "density", "span_hours": "span_hours", "burstiness": "burstiness", "max_hour_share": "max_hour_share", "fast_forward": "fast_forward"}
_Z = f"CAST({BIAS} AS DOUBLE)" + "".join(f" + {x} * CAST({w} AS DOUBLE)" for x, w in zip(VECTOR.values(), WEIGHTS, strict=True))
RANKED = FEATURES + f""",
scored AS (SELECT f.w, f.first_txn, f.total, 1 / (1 + exp(-({_Z}))) AS score FROM feat f),
ranked AS (SELECT s.*, c.window_start, c.accounts, c.txns, row_number() OVER (ORDER BY score DESC, s.w, s.first_txn) AS rank FROM scored s JOIN cand c ON c.w = s.w AND c.first_txn = s.first_txn)"""
SIZES = """, rs AS (SELECT pattern_id, count(*) AS ring_txns, min(typology) AS typology FROM lg WHERE pattern_id > 0 GROUP BY pattern_id)"""


def budgets(ks: tuple[int, ...], ranked: str = "ranked") -> str:
    """The ground truth is that of the transfers that the ranked candidates hold, not the ledger's."""
    return f""",
ks AS (SELECT DISTINCT least(k, (SELECT count(*) FROM {ranked})) AS k FROM (SELECT unnest([{", ".join(map(str, ks))}, 1000000000]) AS k)),
fl AS (SELECT cm.*, r.rank FROM cm JOIN {ranked} r ON r.w = cm.w AND r.first_txn = cm.first_txn),
one AS (SELECT txn_id, any_value(is_laundering) AS is_laundering, any_value(pattern_id) AS pattern_id, any_value(amount) AS amount, min(rank) AS rank FROM fl GROUP BY txn_id),
rs AS (SELECT pattern_id, count(*) AS ring_txns FROM one WHERE pattern_id > 0 GROUP BY pattern_id),
per AS (SELECT k, count(*) AS flagged, count(*) FILTER (is_laundering) AS tp, sum(amount) AS value, coalesce(sum(amount) FILTER (NOT is_laundering), 0.0) AS fp_value FROM ks JOIN one ON rank <= k GROUP BY k),
hits AS (SELECT k, pattern_id, count(*) AS hits FROM ks JOIN fl ON fl.rank <= ks.k WHERE pattern_id > 0 GROUP BY k, pattern_id),
fnd AS (SELECT k, count(*) AS rings_found FROM hits JOIN rs USING (pattern_id) WHERE hits >= 0.5 * ring_txns GROUP BY k),
tot AS (SELECT count(*) FILTER (is_laundering) AS laundering, count(DISTINCT pattern_id) FILTER (pattern_id > 0) AS rings FROM one),
bu0 AS (SELECT per.k, flagged, tp, flagged - tp AS fp, laundering - tp AS fn, coalesce(rings_found, 0) AS rings_found, rings, value, fp_value, tp / CAST(flagged AS DOUBLE) AS precision, CASE WHEN laundering = 0 THEN 0.0 ELSE tp / CAST(laundering AS DOUBLE) END AS recall FROM per LEFT JOIN fnd ON fnd.k = per.k, tot),
bud AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM bu0)"""


#: The candidates after the cut, ranked among themselves.
HELD = """,
held AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY score DESC, w, first_txn) AS rank FROM ranked WHERE window_start >= (SELECT origin + CAST(round((last - origin) * 0.7) AS BIGINT) FROM o))"""


def shapes(k: int, ranked: str = "ranked") -> str:
    return f""",
ours AS (SELECT cm.pattern_id, cm.txn_id, r.rank FROM cm JOIN {ranked} r ON r.w = cm.w AND r.first_txn = cm.first_txn WHERE pattern_id > 0),
size AS (SELECT pattern_id, count(DISTINCT txn_id) AS ring_txns FROM ours GROUP BY 1), hit AS (SELECT pattern_id, count(*) AS hits FROM ours WHERE rank <= {k} GROUP BY 1),
name AS (SELECT pattern_id, min(typology) AS typology FROM lg WHERE pattern_id > 0 GROUP BY 1)
SELECT typology, count(*) AS rings, count(*) FILTER (hits >= 0.5 * ring_txns) AS rings_found, round(count(*) FILTER (hits >= 0.5 * ring_txns) / CAST(count(*) AS DOUBLE), 6) AS rate FROM size JOIN name USING (pattern_id) LEFT JOIN hit USING (pattern_id) GROUP BY typology"""


ROWS = ORIGIN + f""",
cut AS (SELECT origin + CAST(round((last - origin) * 0.7) AS BIGINT) AS cut FROM o),
hist AS (SELECT lg.* FROM lg, cut WHERE ts_us < cut), pool AS (SELECT lg.* FROM lg, cut WHERE ts_us >= cut),
sent AS (SELECT src, count(*) AS sent, avg(CAST(amount AS DOUBLE)) AS sent_mean, count(DISTINCT dst) AS out_peers FROM hist GROUP BY src),
got AS (SELECT dst, count(*) AS received, avg(CAST(amount AS DOUBLE)) AS received_mean, count(DISTINCT src) AS in_peers FROM hist GROUP BY dst),
rv AS (
    SELECT p.txn_id, p.pattern_id, p.is_laundering, ln(1 + CAST(amount AS DOUBLE)) AS log_amount, CAST(hour(ts) AS DOUBLE) AS hour, ln(1 + coalesce(sent, 0)) AS log_sent, ln(1 + coalesce(sent_mean, 0)) AS log_sent_mean,
        CASE WHEN coalesce(sent_mean, 0) <= 0 THEN 1.0 ELSE CAST(amount AS DOUBLE) / sent_mean END AS sent_ratio, ln(1 + coalesce(out_peers, 0)) AS log_out_peers,
        ln(1 + coalesce(received, 0)) AS log_received, ln(1 + coalesce(received_mean, 0)) AS log_received_mean,
        CASE WHEN coalesce(received_mean, 0) <= 0 THEN 1.0 ELSE CAST(amount AS DOUBLE) / received_mean END AS received_ratio, ln(1 + coalesce(in_peers, 0)) AS log_in_peers
    FROM pool p LEFT JOIN sent ON sent.src = p.src LEFT JOIN got ON got.dst = p.dst
),
rsc AS (SELECT *, round(1 / (1 + exp(-({ROW_BIAS}{"".join(f" + {n} * CAST({w} AS DOUBLE)" for n, w in ROW_WEIGHTS.items())}))), 9) AS score FROM rv),
pct AS (SELECT txn_id, pattern_id, is_laundering, row_number() OVER (ORDER BY score DESC, txn_id) AS rk, row_number() OVER (ORDER BY score DESC, txn_id) / CAST(count(*) OVER () AS DOUBLE) AS pct FROM rsc)"""

CARDS = """
cards AS (
    SELECT o_orderkey AS transaction_id, o_orderkey % 29 = 0 AS is_fraud, date_diff('second', TIMESTAMP '1995-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP)) AS transaction_dt,
        o_custkey AS card1, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN c_nationkey END AS addr1, o_orderkey % 3 AS d1,
        CASE WHEN o_orderkey % 3 <> 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'generic' ELSE 'dev' || (o_custkey // 2) END END AS device
    FROM orders JOIN customer ON o_custkey = c_custkey
),
keyed AS (SELECT *, CASE WHEN card1 IS NOT NULL AND addr1 IS NOT NULL THEN 'uid:' || card1 || ':' || addr1 || ':' || (CAST(floor(transaction_dt / 86400.0) AS BIGINT) - d1) ELSE 'txn:' || transaction_id END AS client_key FROM cards),
res AS (SELECT *, min(transaction_id) OVER (PARTITION BY client_key) AS client FROM keyed),
mb AS (SELECT DISTINCT 'device_fingerprint' AS rule, device AS value, client FROM res WHERE device IS NOT NULL UNION SELECT DISTINCT 'shared_card', CAST(card1 AS VARCHAR), client FROM res),
lgr AS (SELECT rule, value, count(*) AS members, count(*) <= CASE rule WHEN 'shared_card' THEN 10 ELSE 20 END AS accepted FROM mb GROUP BY rule, value HAVING count(*) >= 2),
ins AS (SELECT mb.*, members FROM mb JOIN lgr USING (rule, value) WHERE accepted),
prs AS (SELECT x.client AS a, y.client AS b, count(*) AS evidence, count(*) >= 2 AS linked FROM ins x JOIN ins y ON x.rule = y.rule AND x.value = y.value AND x.client < y.client GROUP BY ALL)"""
RINGS = CARDS + """,
ce AS (SELECT a, b FROM prs WHERE linked UNION SELECT b, a FROM prs WHERE linked),
cr AS (SELECT a, a AS b FROM ce UNION SELECT r.a, e.b FROM cr r JOIN ce e ON r.b = e.a),
ring AS (SELECT a AS client, min(b) AS ring FROM cr GROUP BY a)"""
USED = RINGS + """,
usd AS (SELECT x.rule, x.value, x.members, min(x.client) AS client FROM ins x JOIN ins y ON x.rule = y.rule AND x.value = y.value AND x.client < y.client JOIN prs p ON p.a = x.client AND p.b = y.client AND p.linked GROUP BY x.rule, x.value, x.members)"""

_TS = "make_timestamp(CAST({} AS BIGINT))"


def ts(x: str) -> str:
    return _TS.format(x)


def decided(width: int = 72, stride: int = 24) -> str:
    return found(width, stride) + RANKED + f""",
dec AS (SELECT *, window_start + {width * H} AS imposed_us, CASE WHEN score >= 0.9 THEN 'block' WHEN score >= 0.5 THEN 'hold_for_review' ELSE 'allow' END AS asked FROM ranked),
act AS (SELECT *, CASE WHEN asked = 'block' AND total > 10000000 THEN 'hold_for_review' ELSE asked END AS action FROM dec),
lea AS (SELECT a.w, a.first_txn, ca.acct AS account, {width} AS pass_hours, CASE action WHEN 'block' THEN 'frozen' ELSE 'watch' END AS tier, imposed_us, imposed_us + CASE action WHEN 'block' THEN {width * H} ELSE {14 * 24 * H} END AS expires_us
    FROM act a JOIN ca ON ca.w = a.w AND ca.first_txn = a.first_txn WHERE action <> 'allow' AND NOT (action = 'block' AND accounts > 25))"""


REGISTER = """,
seq AS (
    SELECT *, row_number() OVER ord AS i, max(expires_us) FILTER (tier = 'frozen') OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fz,
        max(expires_us) FILTER (tier = 'watch') OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wt
    FROM lea WINDOW ord AS (PARTITION BY account ORDER BY imposed_us, pass_hours, w, first_txn)
),
reg AS (SELECT *, CASE WHEN i = 1 THEN 'new' WHEN tier = 'frozen' AND (fz IS NULL OR expires_us > fz) THEN 'extended' WHEN tier = 'watch' AND fz IS NULL AND expires_us > wt THEN 'extended' ELSE 'ignored' END AS outcome FROM seq)"""


#: The replays' bound for blocks.
BLOCKS = REPLAYED.block_score


def replay(passes: list[tuple[int, int, bool]], worked: int = WORKED) -> str:
    """Decisions, leases and transfers of passes (width, stride, enforces) that share a register."""
    each = [(n, w, s, e, found(w, s) + RANKED) for n, (w, s, e) in enumerate(passes)]
    ranked = " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {sql} SELECT {n} AS pass_no, '{w}h/{s}h' AS pass, {w} AS pass_hours, {str(e).lower()} AS enforces, w, first_txn, total, accounts, round(score, 9) AS score, window_start + {w * H} AS at_us FROM ranked)" for n, w, s, e, sql in each)
    accounts = " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {sql} SELECT {n} AS pass_no, w, first_txn, acct FROM ca)" for n, w, s, e, sql in each)
    fast = min((p for p in passes if p[2]), key=lambda p: p[0])
    return f"""WITH {ORIGIN}, rk AS ({ranked}), rc AS ({accounts}),
thr AS (SELECT pass_no, CASE WHEN count(*) <= {worked} THEN 0.0 ELSE list_sort(list(score), 'DESC')[{worked}] END AS thr FROM rk GROUP BY pass_no),
asked AS (SELECT rk.*, CASE WHEN score >= {BLOCKS} AND total > 10000000 THEN 'hold_for_review' WHEN score >= {BLOCKS} THEN 'block' WHEN score >= 0.5 THEN 'hold_for_review' ELSE 'allow' END AS action FROM rk JOIN thr USING (pass_no) WHERE score >= thr),
dec AS (SELECT *, enforces AND action = 'block' AND accounts > 25 AS declined FROM asked),
lea AS (SELECT d.pass_no, d.pass_hours, d.w, d.first_txn, rc.acct AS account, CASE action WHEN 'block' THEN 'frozen' ELSE 'watch' END AS tier, at_us AS imposed_us, at_us + CASE action WHEN 'block' THEN pass_hours * {H} ELSE {14 * 24 * H} END AS expires_us
    FROM dec d JOIN rc ON rc.pass_no = d.pass_no AND rc.w = d.w AND rc.first_txn = d.first_txn WHERE enforces AND action <> 'allow' AND NOT declined){REGISTER},
frm AS (SELECT min(at_us) AS f, count(DISTINCT pass || at_us) AS windows FROM rk),
tx AS (SELECT lg.*, f, windows, CAST(amount AS DOUBLE) AS v, ts_us >= f AS late, EXISTS (SELECT 1 FROM lea WHERE tier = 'frozen' AND lea.account = lg.src AND imposed_us <= ts_us AND ts_us < expires_us) AND ts_us >= f AS hit FROM lg, frm),
ring AS (SELECT pattern_id, ts_us, CAST(amount AS DOUBLE) AS v, row_number() OVER (PARTITION BY pattern_id ORDER BY ts_us, txn_id) AS i FROM lg WHERE pattern_id > 0 AND is_laundering),
seen AS (SELECT pattern_id, origin + {fast[0] * H} + CAST(ceil(greatest(0, ts_us - origin - {fast[0] * H}) / CAST({fast[1] * H} AS DOUBLE)) AS BIGINT) * {fast[1] * H} AS closure FROM ring, o WHERE i = 3),
top AS (SELECT coalesce(sum(v), 0.0) AS ceiling_value FROM ring JOIN seen USING (pattern_id), frm WHERE ts_us >= closure AND ts_us >= f),
dc AS (SELECT count(*) AS decisions, count(*) FILTER (action = 'block') AS blocks, count(*) FILTER (action = 'hold_for_review') AS holds, count(*) FILTER (action = 'allow') AS allows, count(*) FILTER (declined) AS declined FROM dec),
ac AS (SELECT count(DISTINCT account) FILTER (tier = 'frozen') AS accounts_frozen, count(DISTINCT account) FILTER (tier = 'watch') AS accounts_watch FROM lea),
fw AS (SELECT max(windows) AS windows, max(f) AS from_us, max(ts_us) - max(f) AS runway_us, count(*) FILTER (NOT late) AS unprotected, coalesce(sum(v) FILTER (NOT late AND is_laundering), 0.0) AS unprotected_laundering_value,
    count(*) FILTER (late) AS checked, count(*) FILTER (late AND is_laundering) AS laundering, coalesce(sum(v) FILTER (late), 0.0) AS value, coalesce(sum(v) FILTER (late AND is_laundering), 0.0) AS laundering_value,
    count(*) FILTER (hit) AS stopped, count(*) FILTER (hit AND is_laundering) AS stopped_laundering, count(*) FILTER (hit AND NOT is_laundering) AS stopped_clean, coalesce(sum(v) FILTER (hit), 0.0) AS value_stopped,
    coalesce(sum(v) FILTER (hit AND is_laundering), 0.0) AS laundering_value_stopped, coalesce(sum(v) FILTER (hit AND NOT is_laundering), 0.0) AS clean_value_stopped, count(DISTINCT pattern_id) FILTER (hit AND is_laundering AND pattern_id > 0) AS rings_hit FROM tx),
rr AS (SELECT *, CASE WHEN value_stopped = 0 THEN 0.0 ELSE laundering_value_stopped / value_stopped END AS precision, CASE WHEN laundering_value = 0 THEN 0.0 ELSE laundering_value_stopped / laundering_value END AS interception,
    CASE WHEN ceiling_value = 0 THEN 0.0 ELSE laundering_value_stopped / ceiling_value END AS of_ceiling FROM fw, dc, ac, top)"""


_REPLAY = f""" SELECT windows, decisions, blocks, holds, allows, declined, accounts_frozen, accounts_watch, unprotected, checked, laundering, stopped, stopped_laundering, stopped_clean, rings_hit, from_us, runway_us,
{", ".join(f"round({n}, 6) AS {n}" for n in ("unprotected_laundering_value", "value", "laundering_value", "value_stopped", "laundering_value_stopped", "clean_value_stopped", "ceiling_value", "precision", "interception", "of_ceiling"))} FROM rr"""


def fitted(rows: str, names: list[str], epochs: int = 300) -> str:
    """Weights of the logistic ranker after full-batch steps over the rows of ``rows`` (named features and y): table ``mdl`` of one row (m, s, w, b)."""
    k = range(1, len(names) + 1)
    dev = lambda n: f"CASE WHEN stddev_pop({n}) < 1e-9 THEN 1.0 ELSE stddev_pop({n}) END"
    steps = ", ".join(f"any_value(w)[{i}] - 0.1 * (sum(e * x[{i}]) / any_value(n) + 0.0001 * any_value(w)[{i}])" for i in k)
    return f""",
std AS (SELECT [{", ".join(f"avg({n})" for n in names)}] AS m, [{", ".join(map(dev, names))}] AS s, count(*) AS n, sum(y) AS pos FROM {rows}),
scl AS (SELECT [{", ".join(f"({n} - m[{i}]) / s[{i}]" for i, n in zip(k, names, strict=True))}] AS x, y, n, CASE WHEN y > 0 THEN (n - pos) / pos ELSE 1.0 END AS heavy FROM {rows}, std),
gd AS (SELECT 0 AS it, list_value({", ".join("CAST(0 AS DOUBLE)" for _ in k)}) AS w, CAST(0 AS DOUBLE) AS b
    UNION ALL SELECT it + 1, list_value({steps}), any_value(b) - 0.1 * sum(e) / any_value(n)
    FROM (SELECT it, w, b, x, n, (1 / (1 + exp(-(list_dot_product(w, x) + b))) - y) * heavy AS e FROM gd, scl WHERE it < {epochs}) GROUP BY it),
mdl AS (SELECT m, s, w, b FROM gd, std WHERE it = {epochs})"""


def scored(names: list[str]) -> str:
    terms = " + ".join(f"({n} - m[{i}]) / s[{i}] * w[{i}]" for i, n in enumerate(names, 1))
    return f"round(1 / (1 + exp(-({terms} + b))), 6)"


def ceiling(geometries: list[tuple[int, int]], counted: str = "true") -> str:
    g = ", ".join(f"({w}, {s})" for w, s in geometries)
    return f"""WITH {ORIGIN}, g(window_hours, stride_hours) AS (VALUES {g}),
r AS (SELECT pattern_id, ts_us, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY pattern_id ORDER BY ts_us, txn_id) AS i FROM lg WHERE pattern_id > 0 AND is_laundering),
v AS (SELECT pattern_id, ts_us AS visible FROM r WHERE i = 3),
x AS (SELECT r.*, visible, origin, window_hours, stride_hours, origin + window_hours * {H} + CAST(ceil(greatest(0, visible - origin - window_hours * {H}) / CAST(least(stride_hours, window_hours) * {H} AS DOUBLE)) AS BIGINT) * least(stride_hours, window_hours) * {H} AS closure
    FROM r LEFT JOIN v USING (pattern_id), o, g)
SELECT CAST(window_hours AS BIGINT) AS window_hours, CAST(stride_hours AS BIGINT) AS stride_hours, count(DISTINCT pattern_id) AS rings, count(DISTINCT pattern_id) FILTER (visible IS NULL) AS never_visible,
    round(coalesce(sum(amount) FILTER ({counted}), 0.0), 6) AS total, round(coalesce(sum(amount) FILTER ({counted} AND visible IS NOT NULL AND ts_us >= closure), 0.0), 6) AS stoppable,
    round(CASE WHEN coalesce(sum(amount) FILTER ({counted}), 0.0) = 0 THEN 0.0 ELSE coalesce(sum(amount) FILTER ({counted} AND visible IS NOT NULL AND ts_us >= closure), 0.0) / sum(amount) FILTER ({counted}) END, 6) AS share
FROM x GROUP BY window_hours, stride_hours"""


ACTIVE = """
days AS (SELECT ts_us // 86400000000 * 86400000000 AS day, count(*) AS n, max(ts_us) AS last FROM thin GROUP BY 1),
fact AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS median, max(last) + 1000000 AS fin FROM days),
cut AS (SELECT coalesce((SELECT min(day) FROM days, fact WHERE 10 * n < median), fin) AS cut FROM fact)"""
LISTED = """,
seen AS (SELECT account, min(ts_us) AS seen_us, bool_or(is_laundering) AS dirty FROM (SELECT src AS account, ts_us, is_laundering FROM lg UNION ALL SELECT dst, ts_us, is_laundering FROM lg) GROUP BY account),
lst AS (SELECT account, seen_us + 86400000000 AS listed_us FROM seen WHERE dirty AND seen_us % 3 = 0)"""
SHARE = LISTED + """,
shr AS (SELECT c.w, c.first_txn, avg(CASE WHEN l.listed_us <= c.window_start THEN 1.0 ELSE 0.0 END) AS registry_share FROM cand c JOIN ca ON ca.w = c.w AND ca.first_txn = c.first_txn LEFT JOIN lst l ON l.account = ca.acct GROUP BY c.w, c.first_txn)"""
LIFTED = f""",
past AS (SELECT lea.*, CASE WHEN length(account) % 2 = 0 AND origin + {480 * H} >= imposed_us AND origin + {480 * H} < expires_us THEN origin + {480 * H} END AS lifted_us FROM lea, o)"""
#: The row scorer's vectors of the fitting period itself.
HISTORY = ROWS[ROWS.index("SELECT p.txn_id"):ROWS.index("\n),\nrsc")].replace("FROM pool p", "FROM hist p")
CHAINED = "ev AS (SELECT event_id + 1 AS seq, concat_ws(chr(10), event_id, epoch_us(ts), user_id, coalesce(event_type, ''), coalesce(CAST(CAST(value AS DECIMAL(20, 2)) AS VARCHAR), ''), coalesce(props, '')) AS body FROM events)"
_CAND = f"SELECT w, first_txn, {ts('window_start')} AS window_start, txns, accounts, txn_ids FROM cand"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _w(body: str) -> str:
    return "WITH RECURSIVE " + body


def oracles() -> dict[str, str]:
    f, fe = found(), found() + FEATURES
    full = found() + RANKED
    out = {
        "ledger_scan": f"WITH {LEDGER} SELECT txn_id, ts, src, dst, CAST(amount AS DOUBLE) AS amount, is_laundering, pattern_id FROM lg",
        "load_report": f"WITH {ALL} SELECT payment_format, count(*) AS txns, count(*) FILTER (is_laundering) AS laundering, count(*) FILTER (pattern_id > 0) AS labelled, count(DISTINCT src) AS senders, CAST(min(amount) AS DOUBLE) AS least, CAST(max(amount) AS DOUBLE) AS most FROM led GROUP BY payment_format",
        "typology_report": f"WITH {ALL} SELECT typology, count(DISTINCT pattern_id) AS rings, count(*) AS txns FROM led WHERE pattern_id > 0 GROUP BY typology",
        "active_period": f"WITH {LEDGER}, thin AS (SELECT * FROM lg), {ACTIVE} SELECT {ts('cut')} AS cut FROM cut",
        "active_period_quiet_tail": f"WITH {LEDGER}, thin AS (SELECT * FROM lg WHERE NOT (day(ts) > 25 AND (txn_id - 1) % 20 <> 0)), {ACTIVE} SELECT {ts('cut')} AS cut FROM cut",
        "trimmed_ledger": f"WITH {LEDGER}, thin AS (SELECT * FROM lg WHERE NOT (day(ts) > 25 AND (txn_id - 1) % 20 <> 0)), {ACTIVE} SELECT txn_id, ts FROM thin, cut WHERE ts_us < cut",
        "split_time": f"WITH {ORIGIN} SELECT {ts('origin + CAST(round((last - origin) * 0.7) AS BIGINT)')} AS cut FROM o",
        "window_counts": f"WITH {windows()} SELECT s.w, {ts(f's.origin + s.w * {24 * H}')} AS window_start, count(win.txn_id) AS txns FROM spine s LEFT JOIN win ON win.w = s.w GROUP BY s.w, s.origin",
        "tumbling_window_counts": f"WITH {windows(24, 24)} SELECT s.w, {ts(f's.origin + s.w * {24 * H}')} AS window_start, count(win.txn_id) AS txns FROM spine s LEFT JOIN win ON win.w = s.w GROUP BY s.w, s.origin",
        "window_degree": f"WITH {windows()} SELECT w, acct, degree FROM deg",
        "components": _w(f"{f} SELECT w, node, component FROM lab"),
        "candidates": _w(f"{f} {_CAND}"),
        "candidates_hubcap": _w(f"{found(degree=3)} {_CAND}"),
        "candidates_sizecap": _w(f"{found(most=10)} {_CAND}"),
        "candidate_accounts": _w(f"{f} SELECT w, first_txn, acct, {_r('in_amt', 'out_amt')}, CAST(sends AS BIGINT) AS sends, CAST(recvs AS BIGINT) AS recvs FROM ca"),
        "feat_amounts": _w(f"{fe} SELECT w, first_txn, txns, {_r('total', 'max_amount', 'mean', 'span_hours')} FROM feat"),
        "feat_flow": _w(f"{fe} SELECT w, first_txn, accounts, senders, receivers, {_r('pass_through', 'conservation')}, typology FROM feat"),
        "typology_counts": _w(f"{fe} SELECT typology, count(*) AS n FROM feat GROUP BY typology"),
        "feat_burstiness": _w(f"{fe} SELECT w, first_txn, {_r('burstiness')} FROM feat"),
        "feat_hour_share": _w(f"{fe} SELECT w, first_txn, {_r('max_hour_share')} FROM feat"),
        "feat_fast_forward": _w(f"{fe} SELECT w, first_txn, {_r('fast_forward')} FROM feat"),
        "feat_bipartite": _w(f"{fe} SELECT w, first_txn, {_r('partition_balance', 'pair_reuse', 'amount_uniformity')} FROM feat"),
        "vector_temporal": _w(f"{fe} SELECT w, first_txn, {', '.join(f'round({x}, 6) AS {n}' for n, x in VECTOR.items())} FROM feat"),
        "candidate_labels": _w(f"{f} SELECT w, first_txn, bool_or(pattern_id <> 0) AS positive FROM cm GROUP BY w, first_txn"),
        "candidate_split": _w(f"{f} SELECT w, first_txn, CASE WHEN window_start < (SELECT origin + CAST(round((last - origin) * 0.7) AS BIGINT) FROM o) THEN 'train' ELSE 'test' END AS part FROM cand"),
        "feature_separation": _w(f"""{fe}, lb AS (SELECT w, first_txn, bool_or(pattern_id <> 0) AS positive FROM cm GROUP BY w, first_txn),
lng AS (UNPIVOT (SELECT positive, CAST(txns AS DOUBLE) AS txns, CAST(accounts AS DOUBLE) AS accounts, total, conservation, pass_through, density, span_hours, burstiness, max_hour_share FROM feat JOIN lb USING (w, first_txn)) ON txns, accounts, total, conservation, pass_through, density, span_hours, burstiness, max_hour_share INTO NAME feature VALUE x),
srt AS (SELECT feature, positive, list_sort(list(x)) AS xs FROM lng GROUP BY feature, positive),
q AS (SELECT feature, {', '.join(f"max(xs[CAST(floor({v} * (len(xs) - 1)) AS BIGINT) + 1]) FILTER ({'positive' if y == 'ring' else 'NOT positive'}) AS {p}_{y}" for p, v in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99)) for y in ('ring', 'other'))} FROM srt GROUP BY feature)
SELECT feature, {_r('p50_ring', 'p50_other', 'p90_ring', 'p90_other', 'p99_ring', 'p99_other')}, round(CASE WHEN coalesce(p50_other, 0) = 0 THEN 0.0 ELSE p50_ring / p50_other END, 6) AS lift FROM q"""),
        "eval_unranked": _w(f"""{f}{SIZES}, ov AS (SELECT w, first_txn, pattern_id, count(*) AS hit FROM cm WHERE pattern_id > 0 GROUP BY ALL),
bst AS (SELECT pattern_id, max(hit) AS best FROM ov GROUP BY pattern_id), rg AS (SELECT count(*) AS rings, count(*) FILTER (coalesce(best, 0) >= 0.5 * ring_txns) AS rings_found FROM rs LEFT JOIN bst USING (pattern_id)),
sz AS (SELECT w, first_txn, count(*) AS txns FROM cm GROUP BY ALL), pu AS (SELECT w, first_txn, max(hit) AS hit FROM ov GROUP BY ALL),
cn AS (SELECT count(*) AS candidates, count(*) FILTER (hit >= 0.5 * sz.txns) AS true_candidates FROM sz LEFT JOIN pu USING (w, first_txn)),
fl AS (SELECT DISTINCT txn_id, is_laundering, amount FROM cm), ft AS (SELECT count(*) FILTER (is_laundering) AS tp, count(*) FILTER (NOT is_laundering) AS fp, coalesce(sum(amount) FILTER (NOT is_laundering), 0.0) AS fp_value FROM fl),
al AS (SELECT count(*) FILTER (is_laundering) AS l FROM lg), m AS (SELECT *, l - tp AS fn, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(l AS DOUBLE) AS recall FROM rg, cn, ft, al)
SELECT rings, rings_found, candidates, true_candidates, tp, fp, fn, {_r('fp_value', 'precision', 'recall')}, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m"""),
        "ring_cover": _w(f"{f}{SIZES}, ov AS (SELECT w, first_txn, pattern_id, count(*) AS hit FROM cm WHERE pattern_id > 0 GROUP BY ALL), b AS (SELECT pattern_id, max(hit) AS best FROM ov GROUP BY 1) SELECT pattern_id, ring_txns, coalesce(best, 0) AS best, coalesce(best, 0) >= 0.5 * ring_txns AS found FROM rs LEFT JOIN b USING (pattern_id)"),
        "eval_by_typology": _w(f"{f}{SIZES}, ov AS (SELECT w, first_txn, pattern_id, count(*) AS hit FROM cm WHERE pattern_id > 0 GROUP BY ALL), b AS (SELECT pattern_id, max(hit) AS best FROM ov GROUP BY 1) SELECT typology, count(*) AS rings, count(*) FILTER (coalesce(best, 0) >= 0.5 * ring_txns) AS found FROM rs LEFT JOIN b USING (pattern_id) GROUP BY typology"),
        "score_fixed_weights": _w(f"{full} SELECT w, first_txn, {_r('score')} FROM scored"),
        "rank_topk": _w(f"{full} SELECT rank, w, first_txn, {_r('score')} FROM ranked WHERE rank <= 50"),
        "eval_ranked_budgets": _w(f"{full}{budgets(BUDGETS)} SELECT k, flagged, tp, fp, fn, rings_found, rings, {_r('value', 'fp_value', 'precision', 'recall', 'f1')} FROM bud"),
        "eval_heldout_budgets": _w(f"{full}{HELD}{budgets(BUDGETS, 'held')} SELECT k, flagged, tp, fp, fn, rings_found, rings, {_r('value', 'fp_value', 'precision', 'recall', 'f1')} FROM bud"),
        "eval_heldout_shapes": _w(f"{full}{HELD}{shapes(25, 'held')}"),
        "eval_ranked_shapes": _w(f"{full}{shapes(100)}"),
        "lift_at_budget": _w(f"{full}{budgets(BUDGETS)}, br AS (SELECT avg(CAST(is_laundering AS DOUBLE)) AS base_rate FROM lg) SELECT k, round(base_rate, 6) AS base_rate, round(precision / base_rate, 6) AS lift FROM bud, br"),
        "score_threshold": _w(f"{full}, sc AS (SELECT round(score, 9) AS score FROM scored), t AS (SELECT CASE WHEN (SELECT count(*) FROM sc) <= 50 THEN 0.0 ELSE (SELECT min(score) FROM (SELECT score FROM sc ORDER BY score DESC LIMIT 50)) END AS t) SELECT count(*) FILTER (score >= t) AS admitted, round(max(t), 6) AS threshold FROM sc, t"),
        "row_aggregates": f"WITH {LEDGER} SELECT src AS account, 'sent' AS side, count(*) AS txns, round(avg(CAST(amount AS DOUBLE)), 6) AS mean, count(DISTINCT dst) AS peers FROM lg GROUP BY src UNION ALL SELECT dst, 'received', count(*), round(avg(CAST(amount AS DOUBLE)), 6), count(DISTINCT src) FROM lg GROUP BY dst",
        "row_vectors": f"WITH {ROWS} SELECT txn_id, {_r('log_amount', 'hour', 'log_sent', 'log_sent_mean', 'sent_ratio', 'log_out_peers', 'log_received', 'log_received_mean', 'received_ratio', 'log_in_peers')} FROM rv",
        "row_percentiles": f"WITH {ROWS} SELECT txn_id, {_r('pct')} FROM pct",
        "blindness": f"WITH {ROWS} SELECT pattern_id, count(*) AS txns, count(*) FILTER (pct <= 0.1) AS seen, round(min(pct), 6) AS best, round(list_sort(list(pct))[count(*) // 2 + 1], 6) AS median FROM pct WHERE pattern_id > 0 GROUP BY pattern_id",
        "compare_equal_budget": _w(f"""{full}, {ROWS[len(ORIGIN) + 1:]}, gp AS (SELECT DISTINCT cm.txn_id FROM cm JOIN ranked r ON r.w = cm.w AND r.first_txn = cm.first_txn WHERE rank <= 50),
sd AS (SELECT 'groups' AS side, p.* FROM pct p JOIN gp USING (txn_id) UNION ALL SELECT 'rows', p.* FROM pct p WHERE rk <= (SELECT count(*) FROM pct JOIN gp USING (txn_id))),
rz AS (SELECT pattern_id, count(*) AS ring_txns FROM pct WHERE pattern_id > 0 GROUP BY 1), hh AS (SELECT side, pattern_id, count(*) AS n FROM sd WHERE pattern_id > 0 GROUP BY ALL),
hf AS (SELECT side, count(*) AS rings_found FROM hh JOIN rz USING (pattern_id) WHERE 2 * n >= ring_txns GROUP BY side)
SELECT side, count(*) AS flagged, count(*) FILTER (is_laundering) AS hits, coalesce(any_value(rings_found), 0) AS rings_found FROM sd LEFT JOIN hf USING (side) GROUP BY side"""),
        "hero_case": _w(f"""{full}, {ROWS[len(ORIGIN) + 1:]}, rg AS (SELECT pattern_id, count(*) AS txns, count(*) FILTER (src = dst) AS loops FROM lg WHERE pattern_id > 0 GROUP BY 1),
sn AS (SELECT pattern_id, count(*) FILTER (pct <= 0.1) AS seen FROM pct WHERE pattern_id > 0 GROUP BY 1), cv AS (SELECT pattern_id, rank, count(*) AS hit FROM cm JOIN ranked r ON r.w = cm.w AND r.first_txn = cm.first_txn WHERE pattern_id > 0 GROUP BY ALL)
SELECT pattern_id, rg.txns, min(rank) AS rank FROM rg JOIN sn USING (pattern_id) JOIN cv USING (pattern_id) WHERE rg.txns BETWEEN 2 AND 14 AND 3 * loops <= rg.txns AND seen = 0 AND 2 * hit >= rg.txns GROUP BY pattern_id, rg.txns ORDER BY rg.txns DESC, pattern_id LIMIT 3"""),
        "policy_apply": _w(f"""{full}, a AS (SELECT w, first_txn, score, total * 2000 AS total, CASE first_txn % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN 'hold_for_review' ELSE 'escalate' END AS p0, CASE WHEN first_txn % 3 = 0 THEN 1.4 ELSE 0.85 END AS c0 FROM ranked),
b AS (SELECT *, CASE WHEN p0 = 'escalate' THEN 'hold_for_review' ELSE p0 END AS proposed, least(1.0, c0) AS confidence, CASE WHEN score < 0.9 THEN 'score below the block bound' WHEN least(1.0, c0) < 0.8 THEN 'confidence below the block bound' WHEN total > 10000000 THEN 'amount above the block bound' END AS why FROM a)
SELECT w, first_txn, proposed, CASE WHEN proposed = 'block' AND why IS NOT NULL THEN 'hold_for_review' WHEN proposed = 'allow' AND score >= 0.5 THEN 'hold_for_review' ELSE proposed END AS action, CAST(confidence AS DOUBLE) AS confidence,
concat_ws('; ', CASE WHEN p0 = 'escalate' THEN 'unknown action: escalate' END, CASE WHEN c0 <> confidence THEN 'confidence clamped' END, CASE WHEN proposed = 'block' AND why IS NOT NULL THEN 'block withheld: ' || why END, CASE WHEN proposed = 'allow' AND score >= 0.5 THEN 'allow withheld: score at the hold bound' END) AS adjustments FROM b"""),
        "threshold_decider": _w(f"{decided()} SELECT action, count(*) AS n FROM act GROUP BY action"),
        "rule_decider": _w(f"{full} SELECT w, first_txn, CASE WHEN score >= 0.5 THEN 'hold_for_review' ELSE 'allow' END AS proposed, round(CASE WHEN score >= 0.5 THEN score ELSE 1 - score END, 6) AS confidence FROM ranked"),
        "leases": _w(f"{decided()} SELECT w, first_txn, account, tier, {ts('imposed_us')} AS imposed, {ts('expires_us')} AS expires FROM lea"),
        "register_state": _w(f"{decided()}{REGISTER} SELECT w, first_txn, account, tier, outcome FROM reg"),
        "replay_summary": replay([(72, 24, True)]) + _REPLAY,
        "replay_two_passes": replay([(72, 24, True), (24, 6, True)]) + _REPLAY,
        "replay_narrow_enforces": replay([(72, 24, False), (24, 6, True)]) + _REPLAY,
        "replay_by_source": replay([(72, 24, True), (24, 6, True)]) + """, oc AS (SELECT pass_no, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'extended') AS escalations, count(*) FILTER (outcome = 'ignored') AS ignored FROM reg GROUP BY pass_no)
SELECT pass, CAST(pass_hours AS BIGINT) AS pass_hours, count(*) AS decisions, count(*) FILTER (action = 'block') AS blocks, count(*) FILTER (action = 'hold_for_review') AS holds, count(*) FILTER (action = 'allow') AS allows, count(*) FILTER (declined) AS declined,
coalesce(any_value(new), 0) AS new, coalesce(any_value(escalations), 0) AS escalations, coalesce(any_value(ignored), 0) AS ignored FROM dec LEFT JOIN oc USING (pass_no) GROUP BY pass, pass_hours""",
        "lease_history": _w(f"{decided()}{LIFTED} SELECT w, first_txn, account, tier, {ts('lifted_us')} AS lifted FROM past"),
        "lease_lookup": _w(f"""{decided()}{LIFTED}, met AS (SELECT DISTINCT lg.src AS account, lg.ts_us AS at_us, tier, imposed_us, expires_us FROM lg JOIN past p ON p.account = lg.src AND imposed_us <= ts_us AND ts_us < least(expires_us, coalesce(lifted_us, expires_us))),
one AS (SELECT *, row_number() OVER (PARTITION BY account, at_us ORDER BY tier = 'frozen' DESC, expires_us DESC, imposed_us DESC) AS i FROM met)
SELECT account, {ts('at_us')} AS sent, tier, {ts('expires_us')} AS expires FROM one WHERE i = 1"""),
        "ranker_scores": _w(f"""{fe}, lb AS (SELECT w, first_txn, bool_or(pattern_id <> 0) AS positive FROM cm GROUP BY w, first_txn),
vec AS (SELECT f.w, f.first_txn, {', '.join(f'{x} AS {n}' for n, x in VECTOR.items())}, CAST(positive AS DOUBLE) AS y, c.window_start < (SELECT origin + CAST(round((last - origin) * 0.7) AS BIGINT) FROM o) AS early FROM feat f JOIN lb USING (w, first_txn) JOIN (SELECT w, first_txn, window_start FROM cand) c ON c.w = f.w AND c.first_txn = f.first_txn),
trn AS (SELECT * FROM vec WHERE early){fitted('trn', list(VECTOR))} SELECT w, first_txn, {scored([f'vec.{n}' for n in VECTOR]).replace(' * w[', ' * mdl.w[')} AS score FROM (SELECT * FROM vec WHERE NOT early) vec, mdl""").replace("SELECT w, first_txn, round(1 /", "SELECT vec.w, vec.first_txn, round(1 /"),
        "row_ranker_scores": _w(f"""{ROWS}, hv AS ({HISTORY}), trn AS (SELECT *, CAST(is_laundering AS DOUBLE) AS y FROM hv){fitted('trn', NAMES)} SELECT txn_id, {scored(NAMES)} AS score FROM rv, mdl"""),
        "registry_simulated": f"""WITH {LEDGER}, seen AS (SELECT account, min(ts_us) AS seen_us, bool_or(is_laundering) AS dirty FROM (SELECT src AS account, ts_us, is_laundering FROM lg UNION ALL SELECT dst, ts_us, is_laundering FROM lg) GROUP BY account),
u AS (SELECT *, {', '.join(f"(CAST('0x' || md5(account || ':1:{k}')[1:10] AS BIGINT) + 0.5) / CAST({1 << 40} AS DOUBLE) AS u{k}" for k in range(3))} FROM seen),
t AS (SELECT *, seen_us + CAST(trunc(-ln(u1) * 72.0 * {H}) AS BIGINT) AS listed_us FROM u), yes AS (SELECT * FROM t WHERE dirty AND u0 < 0.30),
no AS (SELECT *, row_number() OVER (ORDER BY u2, account) AS i FROM t WHERE NOT dirty)
SELECT account, {ts('listed_us')} AS listed FROM yes UNION ALL SELECT account, {ts('listed_us')} FROM no WHERE i <= (SELECT CAST(floor(count(*) * 0.05 / 0.95) AS BIGINT) FROM yes)""",
        "decision_chain": f"WITH {CHAINED} SELECT count(*) AS entries, CAST(NULL AS BIGINT) AS first_broken FROM ev",
        "chain_head": f"WITH {CHAINED} SELECT count(*) AS entries, list_reduce(list(body ORDER BY seq), lambda a, b: sha256(a || chr(10) || b), '{GENESIS['decisions']}') AS last_hash FROM ev",
        "held_accounts_fold": _w(f"""{decided()}, lv AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY tier = 'frozen' DESC, expires_us DESC, w, first_txn) AS i FROM lea WHERE length(account) % 2 <> 0 OR w * 1000000 + first_txn > 10000000)
SELECT account, tier, {ts('expires_us')} AS expires, NOT (imposed_us <= last AND last < expires_us) AS expired FROM lv, o WHERE i = 1"""),
        "ceiling": ceiling([(72, 24)]),
        "ceiling_sweep": ceiling([(w, 24) for w in (72, 48, 24, 12, 6)]),
        "ceiling_in_span": ceiling([(72, 24)], f"(ts_us >= origin + {240 * H} AND ts_us < origin + {480 * H})"),
        "registry_annotate": _w(f"{f}{SHARE} SELECT w, first_txn, {_r('registry_share')} FROM shr"),
        "registry_control_ranking": _w(f"{f}{SHARE}, rr AS (SELECT w, first_txn, row_number() OVER (ORDER BY registry_share DESC, w, first_txn) AS rank FROM shr){budgets((25, 100), 'rr')} SELECT k, flagged, tp, rings_found FROM bud"),
        "amplification": _w(f"""{full}{LISTED}, hl AS (SELECT r.w, r.first_txn, rank, r.window_start, acct FROM ranked r JOIN ca ON ca.w = r.w AND ca.first_txn = r.first_txn), onl AS (SELECT account FROM lst WHERE account IN (SELECT acct FROM hl)),
rc AS (SELECT DISTINCT w, first_txn FROM hl JOIN lst ON lst.account = acct AND listed_us <= hl.window_start WHERE rank <= 50), im AS (SELECT DISTINCT acct FROM hl JOIN rc USING (w, first_txn) JOIN seen ON seen.account = acct AND dirty WHERE acct NOT IN (SELECT account FROM onl)),
c AS (SELECT (SELECT count(*) FROM onl) AS listed, (SELECT count(*) FROM rc) AS reached, (SELECT count(*) FROM im) AS implicated) SELECT *, round(CASE WHEN listed = 0 THEN 0.0 ELSE implicated / CAST(listed AS DOUBLE) END, 6) AS ratio FROM c"""),
        "client_resolution": f"WITH {CARDS} SELECT transaction_id, client_key, client FROM res",
        "link_groups": f"WITH {CARDS} SELECT rule, value, members, accepted FROM lgr",
        "link_pairs": f"WITH {CARDS} SELECT a, b, evidence, linked FROM prs",
        "entity_rings": _w(f"{RINGS} SELECT client, ring FROM ring"),
        "ring_concentration": _w(f"{RINGS} SELECT ring IS NOT NULL AS in_ring, count(*) AS transactions, count(*) FILTER (is_fraud) AS fraud, round(100 * count(*) FILTER (is_fraud) / CAST(count(*) AS DOUBLE), 3) AS rate FROM res LEFT JOIN ring USING (client) GROUP BY 1"),
        "ring_size_bands": _w(f"{RINGS}, z AS (SELECT ring, count(*) AS clients FROM ring GROUP BY ring) SELECT CASE WHEN clients <= 2 THEN '2' WHEN clients <= 5 THEN '3-5' WHEN clients <= 20 THEN '6-20' ELSE '21+' END AS band, count(*) AS rings, CAST(sum(clients) AS BIGINT) AS clients FROM z GROUP BY 1"),
        "ring_evidence": _w(f"{USED} SELECT ring, rule, value, members FROM usd JOIN ring USING (client)"),
        "rule_stats": _w(f"{USED} SELECT rule, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, (SELECT count(*) FROM usd WHERE usd.rule = lgr.rule) AS used FROM lgr GROUP BY rule"),
        "time_to_decision": f"WITH {ORIGIN} SELECT txn_id, CASE WHEN st <= ts_us AND st <= last THEN st + {72 * H} - ts_us END AS wait_us, ts_us >= origin + {48 * H} AS steady FROM (SELECT *, origin + greatest(0, CAST(floor((ts_us - origin - {72 * H}) / CAST({24 * H} AS DOUBLE)) AS BIGINT) + 1) * {24 * H} AS st FROM lg, o)",
        "decision_summary": f"WITH {ORIGIN}, t AS (SELECT ts_us >= origin + {48 * H} AS steady, origin + greatest(0, CAST(floor((ts_us - origin - {72 * H}) / CAST({24 * H} AS DOUBLE)) AS BIGINT) + 1) * {24 * H} + {72 * H} - ts_us AS wait FROM lg, o), s AS (SELECT 'all' AS scope, wait FROM t UNION ALL SELECT 'steady', wait FROM t WHERE steady) SELECT scope, count(*) AS n, CAST(0 AS BIGINT) AS uncovered, CAST(quantile_disc(wait, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(wait, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(wait, 0.99) AS BIGINT) AS p99, min(wait) AS least, max(wait) AS most, round(avg(wait), 3) AS mean FROM s GROUP BY scope",
        "chain_verify": f"""WITH {CHAINED}, n AS (SELECT count(*) AS n FROM ev), c(change, lost, first_broken) AS (VALUES ('whole', 0, NULL), ('edited', 0, 70), ('relinked', 0, 40), ('removed', 1, 56), ('beheaded', 1, 2), ('exchanged', 0, 20))
SELECT change, n - lost AS entries, CAST(first_broken AS BIGINT) AS first_broken FROM c, n""",
        "hub_accounts": _w(f"{f}, nn AS (SELECT w, first_txn, count(*) AS txns FROM cm GROUP BY ALL), tt AS (SELECT w, first_txn, acct, count(DISTINCT txn_id) AS touched FROM (SELECT w, first_txn, src AS acct, txn_id FROM cm UNION ALL SELECT w, first_txn, dst, txn_id FROM cm) GROUP BY ALL) SELECT w, first_txn, acct, touched FROM tt JOIN nn USING (w, first_txn) WHERE txns >= 4 AND 2 * touched >= txns"),
        "net_flow_roles": _w(f"{f} SELECT w, first_txn, acct, CASE WHEN sends > 0 AND recvs > 0 THEN 'intermediary' WHEN sends > 0 THEN 'source' ELSE 'sink' END AS role, round(out_amt - in_amt, 6) AS net FROM ca"),
        "withheld_truth": _w(f"{f} SELECT w, first_txn, count(*) FILTER (is_laundering) AS laundering, count(DISTINCT pattern_id) FILTER (pattern_id > 0) AS rings FROM cm GROUP BY w, first_txn"),
        "pattern_link": f"WITH {LEDGER} SELECT a.txn_id, min(q.pattern_id) AS pattern_id FROM lg a JOIN lg q ON q.pattern_id > 0 AND q.ts = a.ts AND q.src = a.src AND q.dst = a.dst AND q.amount = a.amount GROUP BY a.txn_id",
    }
    one = lambda g: f"SELECT * FROM ({replay([(*g, True)])} SELECT '{g[0]}h/{g[1]}h' AS pass, rings_hit, laundering_value_stopped, of_ceiling FROM rr)"
    seen = lambda g: f"SELECT * FROM (WITH RECURSIVE {found(*g) + RANKED}, rnd AS (SELECT * EXCLUDE (score, rank), round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, w, first_txn) AS rank FROM ranked){budgets((WORKED,), 'rnd')} SELECT '{g[0]}h/{g[1]}h' AS pass, rings_found, rings, recall FROM bud ORDER BY k LIMIT 1)"
    wide, narrow = (72, 24), (24, 6)
    out["replay_configurations"] = f"""WITH al AS ({one(wide)} UNION ALL {one(narrow)}), rcl AS ({seen(wide)} UNION ALL {seen(narrow)}), best AS (SELECT * FROM rcl ORDER BY recall DESC, pass DESC LIMIT 1),
tg AS (SELECT * FROM ({replay([(*wide, True), (*narrow, True)])} SELECT rings_hit, laundering_value_stopped, of_ceiling FROM rr)),
x AS (SELECT pass || ' alone' AS configuration, rings_found, rings, recall, rings_hit, laundering_value_stopped, of_ceiling FROM al JOIN rcl USING (pass) UNION ALL SELECT 'together', rings_found, rings, recall, rings_hit, laundering_value_stopped, of_ceiling FROM best, tg)
SELECT configuration, rings_found, rings, rings_hit, {_r('recall', 'laundering_value_stopped', 'of_ceiling')} FROM x"""
    return out
