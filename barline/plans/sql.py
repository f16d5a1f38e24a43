"""DuckDB SQL that the registered queries are held against, built from common table expressions that mirror the operators' definitions."""

from __future__ import annotations

import re

from barline.operators.patterns import PATTERNS
from barline.operators.quality import TAILS

BARS = """
ticks AS (SELECT event_type AS symbol, ts, event_id, date_trunc('hour', ts) AS bar, CAST(round(value * 100) AS BIGINT) AS v FROM events),
priced AS (SELECT *, 10000000 + sum(CASE WHEN event_id % 2 = 0 THEN v ELSE -v END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM ticks),
bars0 AS (
  SELECT symbol, bar AS ts, CAST(first(p ORDER BY ts, event_id) AS BIGINT) / 100.0 AS open, CAST(max(p) AS BIGINT) / 100.0 AS high, CAST(min(p) AS BIGINT) / 100.0 AS low,
         CAST(last(p ORDER BY ts, event_id) AS BIGINT) / 100.0 AS close, CAST(sum(v) AS DOUBLE) AS volume
  FROM priced GROUP BY symbol, bar
)"""


def _exp(c: str, a: float, first: int = 1) -> str:
    q = 1 - a
    w = f"CASE WHEN idx = 0 THEN 1.0 ELSE {a!r} END * coalesce({c}, 0) * pow({1 / q!r}, idx)"
    return f"CASE WHEN idx >= {first - 1} THEN pow({q!r}, idx) * sum({w}) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING) END"


def _mean(c: str, n: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY idx ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {over} = {n} THEN avg({c}) {over} END"


def indicators(source: str = "bars0", prefix: str = "") -> str:
    p = prefix
    return f"""
{p}b1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM {source}),
{p}b2 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range, ln(close / pc) AS log_return FROM {p}b1),
{p}ind AS (
  SELECT symbol, ts, idx, open, high, low, close, volume, true_range, log_return, {_exp("true_range", 1 / 14, 14)} AS atr, {_exp("close", 2 / 21)} AS ema20, {_exp("close", 2 / 51)} AS ema50, {_exp("close", 2 / 201)} AS ema200,
         {_mean("close", 20)} AS sma20, {_mean("close", 50)} AS sma50, {_mean("close", 200)} AS sma200,
         CASE WHEN count(log_return) OVER w20 = 20 THEN stddev_samp(log_return) OVER w20 END AS rolling_volatility, volume / nullif(avg(volume) OVER w20, 0) AS volume_ratio,
         abs(close - open) AS body, high - low AS span, CAST(close >= open AS INT) AS is_bullish
  FROM {p}b2 WINDOW w20 AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING)
)"""


IND = BARS + "," + indicators()
_W = "OVER (PARTITION BY symbol ORDER BY idx)"


def _lag(c: str, k: int) -> str:
    return c if k == 0 else f"lag({c}, {k}) {_W}" if k > 0 else f"lead({c}, {-k}) {_W}"


def _tree(f: str, xs: list[str]) -> str:
    return xs[0] if len(xs) == 1 else f"{f}({', '.join(xs)})"


def _bases(p: str) -> str:
    per = []
    for k in (3, 2, 1):
        g = lambda c, k=k: [_lag(c, j) for j in range(k)]
        oc = [(a, b) for a, b in zip(g("open"), g("close"), strict=True)]
        run = " AND ".join(f"coalesce({x}, false)" for x in g("is_base"))
        vols = [f"CASE WHEN {v} > 0 THEN {v} END" for v in g("volume_ratio")]
        per.append(
            f"{run} AS run{k}, {_tree('greatest', g('high'))} AS top{k}, {_tree('least', g('low'))} AS bottom{k}, ({' + '.join(g('atr'))}) / {k} AS atr{k}, "
            f"{_tree('greatest', [f'greatest({a}, {b})' for a, b in oc])} AS bt{k}, {_tree('least', [f'least({a}, {b})' for a, b in oc])} AS bb{k}, "
            f"1 - ({' + '.join(f'abs({b} - {a})' for a, b in oc)}) / nullif({' + '.join(f'({h} - {low})' for h, low in zip(g('high'), g('low'), strict=True))}, 0) AS wick{k}, "
            f"({' + '.join(f'coalesce({v}, 0)' for v in vols)}) / nullif({' + '.join(f'CAST({v} IS NOT NULL AS INT)' for v in vols)}, 0) AS bv{k}"
        )
    pick = lambda n: "CASE n " + " ".join(f"WHEN {k} THEN {n}{k}" for k in (3, 2, 1)) + " END"
    leads = ", ".join(f"{_lag('close', -j)} AS c{j}, coalesce({_lag('volume_ratio', -j)}, 0) AS v{j}" for j in range(1, 5))
    lags = ", ".join(f"{_lag('open', j)} AS o_{j}, {_lag('close', j)} AS c_{j}" for j in range(1, 7))
    return f"""
{p}base AS (SELECT *, coalesce(atr > 0 AND high - low <= 1.6 * atr AND abs(close - open) <= 0.7 * atr, false) AS is_base FROM {p}ind),
{p}runs AS (SELECT *, {", ".join(per)}, {_lag("open", -1)} AS fo, {_lag("high", -1)} AS fh, {_lag("low", -1)} AS fl, {_lag("ts", -1)} AS formation_ts, {_lag("ema200", -1)} AS fema, {_lag("atr", -1)} AS fatr,
  {_lag("volume_ratio", -1)} AS dvr, {leads}, {lags} FROM {p}base),
{p}picked AS (SELECT *, CASE WHEN run3 AND top3 - bottom3 <= 2.5 * atr3 THEN 3 WHEN run2 AND top2 - bottom2 <= 2.5 * atr2 THEN 2 WHEN run1 AND top1 - bottom1 <= 2.5 * atr1 THEN 1 END AS n FROM {p}runs),
{p}bases AS (SELECT *, {pick("top")} AS top, {pick("bottom")} AS bottom, {pick("atr")} AS avg_atr, {pick("bt")} AS body_top, {pick("bb")} AS body_bottom, {pick("wick")} AS wick, {pick("bv")} AS base_volume FROM {p}picked)"""


def _zones(p: str = "") -> str:
    arrive = lambda x, j: "CASE n " + " ".join(f"WHEN {k} THEN {x}_{k + j}" for k in (1, 2, 3)) + " END"
    steps, prev = [], f"{p}l1"
    for j in (2, 3, 4):
        steps.append(
            f"{p}l{j} AS (SELECT * EXCLUDE (ext, leg_n, leg_volume, live), CASE WHEN wins THEN c{j} ELSE ext END AS ext, CASE WHEN wins THEN {j} ELSE leg_n END AS leg_n, leg_volume + CASE WHEN here THEN v{j} ELSE 0 END AS leg_volume, "
            f"here AND (wins OR abs(ext - c{j}) < 0.7 * avg_atr) AS live FROM (SELECT * EXCLUDE (here, wins), live AND c{j} IS NOT NULL AS here, live AND c{j} IS NOT NULL AND CASE WHEN up THEN c{j} > ext ELSE c{j} < ext END AS wins FROM {prev}))"
        )
        prev = f"{p}l{j}"
    parts = [("dep", 0.5), ("tight", 0.2), ("dep_volume", 0.05), ("base_volume_score", 0.1), ("trend", 0.1)]
    quality = [("structure_score", 0.22), ("leg_score", 0.34), ("disp_score", 0.12), ("trend", 0.12), ("volume_score", 0.1)]
    mean = lambda xs: f"least(({' + '.join(f'coalesce({x} * {w}, 0)' for x, w in xs)}) / ({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE {w} END' for x, w in xs)}), 1)"
    clip = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, 1), 0) END"
    peak = lambda x, lo, hi, w: f"greatest(0, 1 - greatest({lo} - {x}, {x} - {hi}, 0) / {w})"
    return f"""{_bases(p)},
{p}l1 AS (SELECT *, c1 >= fo AS up, c1 AS ext, 1 AS leg_n, v1 AS leg_volume, true AS live, true AS here, true AS wins FROM {p}bases WHERE n IS NOT NULL AND c1 IS NOT NULL),
{", ".join(steps)},
{p}dep0 AS (
  SELECT *, fh - fl AS fspan, CASE WHEN up THEN c1 - fl ELSE fh - c1 END / nullif(fh - fl, 0) AS close_ratio, abs(c1 - fo) / avg_atr AS dbody, CASE WHEN up THEN ext - top ELSE bottom - ext END / avg_atr AS clear, abs(ext - c1) / avg_atr AS disp FROM {p}l4
),
{p}dep AS (SELECT *, {", ".join(f"{arrive('o', j)} AS ao{j}, {arrive('c', j)} AS ac{j}" for j in range(3))} FROM {p}dep0 WHERE fspan >= 1e-10 AND close_ratio >= 0.8 AND dbody >= 0.7 AND clear >= 1.0),
{p}arr0 AS (SELECT *, CAST(ac0 IS NOT NULL AS INT) + CAST(ac1 IS NOT NULL AS INT) + CAST(ac2 IS NOT NULL AS INT) AS m, coalesce(ao2, ao1, ao0) AS origin, ac0 - coalesce(ao2, ao1, ao0) AS net FROM {p}dep),
{p}arr AS (SELECT *, CASE WHEN net < 0 THEN 'down' WHEN net > 0 THEN 'up' END AS arrival FROM {p}arr0),
{p}raw AS (
  SELECT *, CASE WHEN up THEN 'demand' ELSE 'supply' END AS type, CASE WHEN arrival = 'up' THEN 'R' WHEN arrival = 'down' THEN 'D' WHEN up THEN 'D' ELSE 'R' END || 'B' || CASE WHEN up THEN 'R' ELSE 'D' END AS structure,
    (({" + ".join(f"CAST(coalesce(CASE WHEN net < 0 THEN ac{j} < ao{j} ELSE ac{j} >= ao{j} END, false) AS INT)" for j in range(3))}) / m) AS clean
  FROM {p}arr WHERE ao0 IS NOT NULL AND CASE WHEN up THEN body_top < c1 ELSE body_bottom > c1 END AND CASE arrival WHEN 'down' THEN body_top < ao0 WHEN 'up' THEN body_bottom > ao0 ELSE true END
),
{p}trust AS (SELECT symbol, avg(CAST(coalesce(volume, 0) <= 0 AS INT)) <= 0.01 AS trusted FROM {p}ind GROUP BY symbol),
{p}met AS (
  SELECT r.*, trusted, round(clear, 4) AS clear4, round(dbody, 4) AS body4, round(close_ratio, 4) AS close4, round(disp, 4) AS disp4, round(leg_volume / leg_n, 4) AS vol4, top - bottom AS width,
    {clip("0.5 + CASE WHEN up THEN 1 ELSE -1 END * (c1 - fema) / nullif(fatr, 0) / 4.0")} AS trend
  FROM {p}raw r JOIN {p}trust USING (symbol)
),
{p}parts AS (
  SELECT *, 0.5 * least(clear4 / 2.0, 1) + 0.3 * least(body4 / 1.4, 1) + 0.2 * least(close4, 1) AS dep, greatest(1 - width / avg_atr / 2.5, 0) AS tight, disp4 * avg_atr / nullif(width, 0) AS disp_base,
    CASE WHEN trusted THEN CASE WHEN dvr > 0 THEN least(dvr / 3, 1) ELSE 0.5 END END AS dep_volume, CASE WHEN trusted THEN CASE WHEN base_volume > 0 THEN {clip("1 - (base_volume - 0.7) / 0.6")} ELSE 0.5 END END AS base_volume_score,
    0.6 * CASE n WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 0.8 END + 0.4 * coalesce({clip("(wick - 0.3) / 0.5")}, 0.5) AS structure_score, {peak("clear4", 0.8, 1.5, 0.8)} AS leg_score,
    CASE WHEN trusted THEN CASE WHEN base_volume IS NULL THEN least(vol4 / 1.5, 1) ELSE (least(vol4 / 1.5, 1) + {clip("1 - (base_volume - 0.7) / 0.6")}) / 2 END END AS volume_score
  FROM {p}met
),
{p}scored AS (SELECT *, CASE WHEN disp_base IS NOT NULL THEN {peak("disp_base", 1.0, 1.5, 1.5)} END AS disp_score FROM {p}parts),
{p}zones AS (
  SELECT symbol, printf('Z%04d', row_number() OVER (PARTITION BY symbol ORDER BY idx)) AS zone_id, type, structure, round(top, 4) AS top, round(bottom, 4) AS bottom, round((top + bottom) / 2, 4) AS midpoint,
    round(CASE WHEN up THEN body_top ELSE body_bottom END, 4) AS proximal, round(CASE WHEN up THEN bottom ELSE top END, 4) AS distal, round(width / avg_atr, 4) AS width_atr, formation_ts, idx + 1 AS formation_idx, idx - n + 1 AS base_start_idx,
    n AS base_length, round(avg_atr, 4) AS avg_atr, clear4 AS leg_out_clear_atr, disp4 AS leg_out_disp_atr, leg_n AS leg_out_candles, vol4 AS leg_out_vol_exp, CASE WHEN arrival IS NOT NULL THEN round(abs(net) / avg_atr, 4) END AS leg_in_disp_atr,
    round(width, 4) AS width, idx AS base_end_idx, ts AS base_end_ts, round(wick, 4) AS base_wick_frac, round(base_volume, 4) AS base_volume_ratio, body4 AS departure_body_atr, close4 AS departure_close_ratio, round(disp / leg_n, 4) AS leg_out_velocity,
    round(dvr, 4) AS departure_volume_ratio, CASE WHEN arrival IS NOT NULL THEN m ELSE 0 END AS leg_in_candles, CASE WHEN arrival IS NOT NULL THEN round(abs(net) / avg_atr / m, 4) END AS leg_in_velocity, round(disp_base, 4) AS disp_base_ratio,
    trend >= 0.5 AS trend_aligned, idx + leg_n AS leg_end_idx, CASE WHEN arrival IS NOT NULL THEN round(clean, 4) END AS arrival_cleanliness, round(trend, 4) AS trend_score, round({mean(parts)}, 4) AS strength, round(100 * round({mean(quality)}, 4), 2) AS quality_score
  FROM {p}scored
)"""


ZONES = IND + "," + _zones()
ZONE_COLUMNS = "symbol, zone_id, type, structure, top, bottom, midpoint, proximal, distal, width_atr, formation_ts, formation_idx, base_length, avg_atr, leg_out_clear_atr, leg_out_disp_atr, leg_out_candles, leg_out_vol_exp, leg_in_disp_atr, arrival_cleanliness, trend_score, strength, quality_score"



def life(source: str = "zones", out: str = "lived") -> str:
    """Every zone with every later bar, without any shortcut."""
    return f""",
later AS (
  SELECT z.symbol, z.zone_id, b.idx, b.ts, CASE WHEN type = 'demand' THEN b.close < z.bottom ELSE b.close > z.top END AS broken, b.low <= z.top AND b.high >= z.bottom AS inside
  FROM {source} z JOIN ind b ON b.symbol = z.symbol AND b.idx > z.formation_idx
),
marked AS (SELECT *, max(CAST(broken AS INT)) OVER w = 1 AS ended, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY symbol, zone_id ORDER BY idx), false) AS entered FROM later WINDOW w AS (PARTITION BY symbol, zone_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
tests AS (SELECT symbol, zone_id, min(ts) FILTER (broken) AS invalidation_ts, count(*) FILTER (entered AND NOT ended) AS test_count, max(ts) FILTER (entered AND NOT ended) AS last_test_ts FROM marked GROUP BY ALL),
{out} AS (
  SELECT z.*, coalesce(test_count, 0) AS test_count, last_test_ts, invalidation_ts, CASE WHEN invalidation_ts IS NOT NULL THEN 'broken' WHEN test_count > 0 THEN 'tested' ELSE 'active' END AS status,
    CASE least(coalesce(test_count, 0), 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 ELSE 0.45 END AS freshness_score
  FROM {source} z LEFT JOIN tests USING (symbol, zone_id)
)"""


LIFE = ZONES + life()

_KEPT = "{'f': formation_idx, 'id': zone_id, 't': top, 'b': bottom, 'q': quality_score, 'n': "
#: The greedy merge as a fold over each symbol's and type's zones, in the order of formation.
MERGED = (
    ZONES
    + f""",
ordered AS MATERIALIZED (SELECT symbol, type, zone_id, formation_idx, top, bottom, quality_score, row_number() OVER (PARTITION BY symbol, type ORDER BY formation_idx, zone_id) AS k FROM zones),
fold AS (
  SELECT symbol, type, k, [{_KEPT}1}}] AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT symbol, type, k, CASE WHEN hit > 0 THEN list_transform(kept, lambda x, i: CASE WHEN i <> hit THEN x WHEN quality_score > x.q THEN {_KEPT}x.n + 1}}
    ELSE {{'f': x.f, 'id': x.id, 't': x.t, 'b': x.b, 'q': x.q, 'n': x.n + 1}} END) ELSE list_append(kept, {_KEPT}1}}) END
  FROM (
    SELECT o.*, f.kept, coalesce(list_position(list_transform(f.kept, lambda x: least(x.t, o.top) - greatest(x.b, o.bottom) > 0 AND least(x.t - x.b, o.top - o.bottom) > 0
      AND least(x.t, o.top) - greatest(x.b, o.bottom) >= 0.5 * least(x.t - x.b, o.top - o.bottom) AND abs(x.f - o.formation_idx) <= 60), true), 0) AS hit
    FROM fold f JOIN ordered o ON o.symbol = f.symbol AND o.type = f.type AND o.k = f.k + 1
  )
),
stays AS (SELECT symbol, unnest(kept) AS u FROM (SELECT symbol, type, arg_max(kept, k) AS kept FROM fold GROUP BY ALL)),
merged AS MATERIALIZED (SELECT z.*, u.n AS merged_count FROM zones z JOIN stays s ON s.symbol = z.symbol AND s.u.id = z.zone_id)"""
)
SIX = """,
six AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, max(ts) AS last_ts FROM bars0 GROUP BY 1, 2)"""


def confluence(source: str = "zones") -> str:
    """Each zone with every longer bar and longer zone that was known at its formation."""
    return (
        SIX
        + ","
        + indicators("six", "h0")
        + """,
h_ind AS MATERIALIZED (SELECT * EXCLUDE (idx), row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM h0ind WHERE atr IS NOT NULL),"""
        + _zones("h_")
        + f""",
hl AS MATERIALIZED (SELECT i.*, s.last_ts AS close_ts FROM h_ind i JOIN six s USING (symbol, ts)),
seen AS (SELECT z.symbol, z.zone_id, hl.close, hl.ema20, hl.atr, row_number() OVER (PARTITION BY z.symbol, z.zone_id ORDER BY close_ts DESC) AS k FROM {source} z JOIN hl ON hl.symbol = z.symbol AND hl.close_ts <= z.formation_ts),
hz AS (SELECT z.symbol, z.zone_id AS h_zone, z.type AS h_type, z.top AS h_top, z.bottom AS h_bottom, z.strength AS h_strength, hl.close_ts AS h_formed FROM h_zones z JOIN hl ON hl.symbol = z.symbol AND hl.idx = z.formation_idx),
hp AS (
  SELECT z.symbol, z.zone_id, z.formation_ts, h_zone, h_top, h_bottom, h_strength, h_formed, greatest(h_bottom - midpoint, midpoint - h_top, 0) AS gap, (least(top, h_top) - greatest(bottom, h_bottom)) / nullif(top - bottom, 0) >= 0.3 AS agrees
  FROM {source} z JOIN hz ON hz.symbol = z.symbol AND h_type = z.type AND h_formed <= z.formation_ts
),
near AS (SELECT *, row_number() OVER (PARTITION BY symbol, zone_id ORDER BY gap, h_formed, h_zone) AS k, bool_or(gap = 0) OVER w AS held, bool_or(agrees) OVER w AS confirmed FROM hp WINDOW w AS (PARTITION BY symbol, zone_id)),
best AS (SELECT n.*, (SELECT count(*) FROM hl WHERE hl.symbol = n.symbol AND close_ts > h_formed AND close_ts <= formation_ts AND low <= h_top AND high >= h_bottom) AS touches FROM near n WHERE k = 1),
conf0 AS (
  SELECT z.*, round(CASE WHEN z.type = 'demand' THEN 1 ELSE -1 END * (s.close - s.ema20) / nullif(s.atr, 0), 4) AS htf_trend_align, coalesce(held, false) AS htf_in_zone, round(gap / avg_atr, 4) AS htf_dist_atr, h_strength AS htf_zone_strength,
         n.zone_id IS NOT NULL AND touches = 0 AS htf_zone_fresh, coalesce(confirmed, false) AS htf_confirmed
  FROM {source} z LEFT JOIN (SELECT * FROM seen WHERE k = 1) s ON s.symbol = z.symbol AND s.zone_id = z.zone_id LEFT JOIN best n ON n.symbol = z.symbol AND n.zone_id = z.zone_id
),
conf AS (
  SELECT *, round(0.3 * CAST(htf_in_zone AS INT) + 0.25 * CASE WHEN htf_dist_atr IS NULL THEN 0 ELSE greatest(least(1 - htf_dist_atr / 2, 1), 0) END + 0.2 * coalesce(htf_zone_strength, 0)
    + 0.15 * CASE WHEN htf_trend_align IS NULL THEN 0.5 ELSE greatest(least(0.5 + htf_trend_align / 4, 1), 0) END + 0.1 * CAST(htf_zone_fresh AS INT) + 1e-9, 4) AS htf_confluence FROM conf0
)"""
    )


#: The flagship chain.
DETECTED = (
    MERGED
    + life("merged")
    + confluence("lived")
    + """,
pit AS (SELECT *, round(least(quality_score / 100 + 0.08 * htf_confluence, 1), 4) AS strength_pit FROM conf),
detected AS (SELECT *, round(least(strength_pit * freshness_score, 1), 4) AS adjusted_strength_posthoc FROM pit)"""
)


def _entries(confirm: bool = False) -> str:
    touch = "b.close BETWEEN z.bottom AND z.top" if confirm else "CASE WHEN type = 'demand' THEN b.low <= z.top ELSE b.high >= z.bottom END"
    return f""",
walk AS (
  SELECT z.symbol, z.zone_id, b.idx, b.ts, b.atr, CASE WHEN type = 'demand' THEN b.low < distal ELSE b.high > distal END AS broken, CASE WHEN type = 'demand' THEN b.high >= proximal ELSE b.low <= proximal END AS fill,
    max(CAST({touch} AS INT)) OVER (PARTITION BY z.symbol, z.zone_id ORDER BY b.idx ROWS UNBOUNDED PRECEDING) = 1 AS opened
  FROM zones z JOIN ind b ON b.symbol = z.symbol AND b.idx > z.formation_idx
),
fills AS (SELECT symbol, zone_id, min(idx) FILTER (fill AND opened) AS fill_idx, min(ts) FILTER (fill AND opened) AS entry_ts, first(atr ORDER BY idx) FILTER (fill AND opened) AS fill_atr, min(idx) FILTER (broken) AS broken_idx FROM walk GROUP BY ALL),
filled AS (SELECT z.*, fill_idx, entry_ts, fill_atr, proximal AS entry_price FROM zones z JOIN fills f USING (symbol, zone_id) WHERE fill_idx IS NOT NULL AND (broken_idx IS NULL OR broken_idx > fill_idx))"""


def _tagged(sql: str, tag: str) -> str:
    """sql with its own tables under other names, so that it can stand beside itself."""
    return re.sub(r"\b(plan|held|ends|decided|r_trades)\b", rf"\1_{tag}", sql)


def _plan(stop: str = "distal", reward: float = 2.0) -> str:
    return f""",
plan0 AS (SELECT *, CASE WHEN type = 'demand' THEN 1.0 ELSE -1.0 END AS side, {stop} AS stop_price FROM filled),
plan AS (SELECT *, abs(entry_price - stop_price) AS risk, entry_price + side * {reward} * abs(entry_price - stop_price) AS target_price FROM plan0 WHERE abs(entry_price - stop_price) > 0)"""


def _held(hold: int) -> str:
    return f""",
held AS (
  SELECT p.*, b.idx - fill_idx - 1 AS hold, b.ts AS bar_ts, b.close AS bar_close, b.atr AS bar_atr, side * CASE WHEN type = 'demand' THEN b.low ELSE b.high END AS worst, side * CASE WHEN type = 'demand' THEN b.high ELSE b.low END AS best
  FROM plan p JOIN ind b ON b.symbol = p.symbol AND b.idx > fill_idx AND b.idx <= fill_idx + {hold} + 1
)"""


def trades(confirm: bool = False, stop: str = "distal", hold: int = 5) -> str:
    return (
        ZONES
        + _entries(confirm)
        + _plan(stop)
        + _held(hold)
        + f""",
ends AS (
  SELECT symbol, zone_id, min(hold) FILTER (hold < {hold} AND worst <= side * stop_price) AS s, min(hold) FILTER (hold < {hold} AND best >= side * target_price) AS w, max(hold) FILTER (hold = {hold}) AS t FROM held GROUP BY ALL
),
decided AS (SELECT *, CASE WHEN w IS NOT NULL AND (s IS NULL OR w < s) THEN 'win' WHEN s IS NOT NULL THEN 'loss' WHEN t IS NOT NULL THEN 'timeout' END AS outcome, CASE WHEN w IS NOT NULL AND (s IS NULL OR w < s) THEN w WHEN s IS NOT NULL THEN s ELSE t END AS at FROM ends),
trades AS (
  SELECT h.symbol, h.zone_id, type, structure, formation_ts, entry_ts, bar_ts AS exit_ts, entry_price, stop_price, target_price, CASE outcome WHEN 'win' THEN target_price WHEN 'loss' THEN stop_price ELSE bar_close END AS exit_price, risk, side, outcome, hold AS hold_candles
  FROM held h JOIN decided d ON d.symbol = h.symbol AND d.zone_id = h.zone_id AND h.hold = d.at WHERE outcome IS NOT NULL
)"""
    )


def trailed(hold: int = 20) -> str:
    """Trades with a trailing stop: what happened first, and the level that the stop had on each bar."""
    return (
        ZONES
        + _entries()
        + _plan()
        + _held(hold)
        + f""",
trig AS (SELECT *, side * entry_price + 1.0 * risk AS reach FROM held),
ends AS (SELECT symbol, zone_id, min(hold) FILTER (hold < {hold} AND worst <= side * stop_price) AS s, min(hold) FILTER (hold < {hold} AND best >= reach) AS onset, max(hold) FILTER (hold = {hold}) AS t FROM trig GROUP BY ALL),
live AS (
  SELECT g.*, onset, max(CASE WHEN bar_atr > 0 OR hold = onset THEN best END) OVER (PARTITION BY g.symbol, g.zone_id ORDER BY hold ROWS UNBOUNDED PRECEDING) AS run
  FROM trig g JOIN ends e ON e.symbol = g.symbol AND e.zone_id = g.zone_id WHERE onset IS NOT NULL AND (s IS NULL OR onset < s) AND hold >= onset AND hold < {hold}
),
levels AS (
  SELECT *, greatest(side * stop_price, max(greatest(CASE WHEN bar_atr > 0 THEN run - 1.5 * bar_atr END, CASE WHEN hold = onset AND bar_atr > 0 THEN reach - 0.5 * bar_atr END)) OVER (PARTITION BY symbol, zone_id ORDER BY hold ROWS UNBOUNDED PRECEDING)) AS level FROM live
),
hits AS (SELECT symbol, zone_id, min(hold) AS x, arg_min(level, hold) AS x_level FROM levels WHERE worst <= level GROUP BY ALL),
decided AS (
  SELECT e.*, x, x_level, CASE WHEN s IS NOT NULL AND (onset IS NULL OR s <= onset) THEN 'loss' WHEN x IS NOT NULL THEN 'trail_win' WHEN t IS NOT NULL THEN 'timeout' END AS outcome FROM ends e LEFT JOIN hits h ON h.symbol = e.symbol AND h.zone_id = e.zone_id
),
trades AS (
  SELECT h.symbol, h.zone_id, type, structure, formation_ts, entry_ts, bar_ts AS exit_ts, entry_price, stop_price, target_price, CASE outcome WHEN 'loss' THEN stop_price WHEN 'trail_win' THEN side * x_level ELSE bar_close END AS exit_price, risk, side, outcome,
         hold + CASE WHEN outcome = 'trail_win' AND x = onset THEN 1 ELSE 0 END AS hold_candles
  FROM held h JOIN decided d ON d.symbol = h.symbol AND d.zone_id = h.zone_id AND h.hold = CASE outcome WHEN 'loss' THEN s WHEN 'trail_win' THEN x ELSE t END WHERE outcome IS NOT NULL
)"""
    )


def exits_r(hold: int, filled: str) -> str:
    """Trades in risk units of a table of filled zones; those without an end stay open."""
    return f""",
plan AS MATERIALIZED (SELECT *, CASE WHEN type = 'demand' THEN 1.0 ELSE -1.0 END AS side, distal AS stop_price, abs(entry_price - distal) AS risk, entry_price + CASE WHEN type = 'demand' THEN 2.0 ELSE -2.0 END * abs(entry_price - distal) AS target_price FROM {filled} WHERE abs(entry_price - distal) > 0)
{_held(hold)},
ends AS (SELECT symbol, zone_id, min(hold) FILTER (hold < {hold} AND worst <= side * stop_price) AS s, min(hold) FILTER (hold < {hold} AND best >= side * target_price) AS w, max(hold) FILTER (hold = {hold}) AS t FROM held GROUP BY ALL),
decided AS (
  SELECT p.*, CASE WHEN w IS NOT NULL AND (s IS NULL OR w < s) THEN 'win' WHEN s IS NOT NULL THEN 'loss' WHEN t IS NOT NULL THEN 'timeout' ELSE 'open' END AS outcome, CASE WHEN w IS NOT NULL AND (s IS NULL OR w < s) THEN w WHEN s IS NOT NULL THEN s ELSE t END AS till
  FROM plan p LEFT JOIN ends e ON e.symbol = p.symbol AND e.zone_id = p.zone_id
),
r_trades AS (
  SELECT d.*, h.bar_ts AS exit_ts, till AS hold_candles, CASE outcome WHEN 'win' THEN target_price_ WHEN 'loss' THEN stop_price_ WHEN 'timeout' THEN bar_close END AS exit_price
  FROM (SELECT * RENAME (target_price AS target_price_, stop_price AS stop_price_) FROM decided) d LEFT JOIN held h ON h.symbol = d.symbol AND h.zone_id = d.zone_id AND h.hold = till
)"""


_CLOSE_IN = """,
inside AS (SELECT z.symbol, z.zone_id, min(b.idx) AS fill_idx, min(b.ts) AS entry_ts FROM zones z JOIN ind b ON b.symbol = z.symbol AND b.idx > z.formation_idx AND b.close BETWEEN z.bottom AND z.top GROUP BY ALL),
entered AS (SELECT z.*, fill_idx, entry_ts, proximal AS entry_price FROM zones z JOIN inside USING (symbol, zone_id))"""
_R = "round(side * (exit_price - entry_price) / risk, 4)"


def rebuilt() -> str:
    """Windows on which a zone forms, rebuilt to zones from their bars, greedily thinned out, with the life of what stays."""
    return (
        ZONES
        + """,
probs AS (SELECT symbol, formation_idx AS idx, max(quality_score) / 100 AS ml_prob FROM zones GROUP BY ALL),
bar AS MATERIALIZED (
  SELECT p.symbol, p.idx, p.ml_prob, e.ts, b.idx - p.idx + 19 AS k, b.open, b.high, b.low, b.close, b.atr, abs(b.close - b.open) AS body, b.high - b.low AS span
  FROM probs p JOIN ind b ON b.symbol = p.symbol AND b.idx BETWEEN p.idx - 19 AND p.idx JOIN ind e ON e.symbol = p.symbol AND e.idx = p.idx WHERE p.idx >= 19 AND ml_prob >= 0.45
),
unit AS (SELECT symbol, idx, avg(atr) AS avg_atr, 1.2 * coalesce(median(body) FILTER (body > 0), 0.3 * avg(atr)) AS mb, 1.3 * coalesce(median(span) FILTER (span > 0), 0.5 * avg(atr)) AS ms FROM bar GROUP BY ALL),
small AS (SELECT b.*, avg_atr, coalesce(body <= mb AND b.span <= ms, false) AS is_base, row_number() OVER (PARTITION BY symbol, idx ORDER BY body + b.span, k) AS place FROM bar b JOIN unit USING (symbol, idx) WHERE k BETWEEN 15 AND 18),
ends0 AS (SELECT symbol, idx, any_value(avg_atr) AS avg_atr, max(k) FILTER (is_base) AS e1, max(k) FILTER (place <= 2) AS e2, min(k) FILTER (place <= 2) AS f2 FROM small GROUP BY ALL),
span0 AS (SELECT e.*, coalesce(e1, e2) AS fin, CASE WHEN e1 IS NULL THEN f2 ELSE coalesce((SELECT max(k) FROM small s WHERE s.symbol = e.symbol AND s.idx = e.idx AND NOT s.is_base AND s.k < e.e1), 14) + 1 END AS beg FROM ends0 e),
geo AS (
  SELECT b.symbol, b.idx, any_value(b.ts) AS ts, any_value(ml_prob) AS ml_prob, any_value(s.avg_atr) AS avg_atr, any_value(fin) AS fin, any_value(beg) AS beg, max(high) FILTER (k BETWEEN beg AND fin) AS top, min(low) FILTER (k BETWEEN beg AND fin) AS bottom,
         max(close) FILTER (k = 19) - CASE WHEN any_value(fin) = 18 THEN max(open) FILTER (k = 19) ELSE max(close) FILTER (k = fin + 1) END AS move, max(close) FILTER (k = beg - 1) - max(close) FILTER (k = 0) AS came
  FROM bar b JOIN span0 s ON s.symbol = b.symbol AND s.idx = b.idx GROUP BY b.symbol, b.idx
),
typed AS (SELECT *, move > 0 OR (move = 0 AND came <= 0) AS up, round(top, 2) AS rt, round(bottom, 2) AS rb FROM geo WHERE top > bottom),
raws AS (SELECT symbol, idx, ts, ml_prob, CASE WHEN up THEN 'demand' ELSE 'supply' END AS type, CASE WHEN up THEN CASE WHEN came < 0 OR move = 0 THEN 'DBR' ELSE 'RBR' END ELSE CASE WHEN came > 0 THEN 'RBD' ELSE 'DBD' END END AS structure,
         rt AS top, rb AS bottom, CASE WHEN up THEN rt ELSE rb END AS proximal, CASE WHEN up THEN rb ELSE rt END AS distal, fin - beg + 1 AS base_length, round(avg_atr, 4) AS avg_atr FROM typed),
queue AS MATERIALIZED (SELECT symbol, idx, top, bottom, row_number() OVER (PARTITION BY symbol ORDER BY ml_prob DESC, idx) AS k FROM raws),
thin AS (
  SELECT symbol, k, [{'i': idx, 't': top, 'b': bottom}] AS kept FROM queue WHERE k = 1
  UNION ALL
  SELECT q.symbol, q.k, CASE WHEN len(list_filter(t.kept, lambda x: abs(x.i - q.idx) <= 5 AND q.bottom <= x.t AND q.top >= x.b)) > 0 THEN t.kept ELSE list_append(t.kept, {'i': q.idx, 't': q.top, 'b': q.bottom}) END
  FROM thin t JOIN queue q ON q.symbol = t.symbol AND q.k = t.k + 1
),
left_over AS (SELECT symbol, unnest(kept).i AS idx FROM (SELECT symbol, arg_max(kept, k) AS kept FROM thin GROUP BY symbol)),
ml AS MATERIALIZED (SELECT r.*, 'ML_' || (row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1) AS zone_id FROM raws r JOIN left_over USING (symbol, idx)),
walk_on AS (SELECT m.symbol, m.zone_id, b.idx, b.ts, CASE WHEN type = 'demand' THEN b.close < bottom ELSE b.close > top END AS broken, b.low <= top AND b.high >= bottom AS inside FROM ml m JOIN ind b ON b.symbol = m.symbol AND b.idx > m.idx),
alive AS (SELECT *, coalesce(max(CAST(broken AS INT)) OVER (PARTITION BY symbol, zone_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM walk_on),
counted AS (SELECT symbol, zone_id, count(*) FILTER (inside) AS test_count, max(ts) FILTER (inside) AS last_test_ts, min(ts) FILTER (broken) AS invalidation_ts FROM alive WHERE over = 0 GROUP BY ALL)"""
    )


TRADE_COLUMNS = "symbol, zone_id, type, structure, formation_ts, entry_ts, exit_ts, round(entry_price, 2) AS entry_price, round(stop_price, 2) AS stop_price, round(target_price, 2) AS target_price, round(exit_price, 2) AS exit_price, outcome, hold_candles, round(side * (exit_price - entry_price) / risk, 4) AS r_multiple"

EQUITY = (
    trades()
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY formation_ts, zone_id) AS seq, side * (exit_price - entry_price) / risk AS r FROM trades),
curve AS (
  SELECT symbol, seq, zone_id, structure, outcome, hold_candles, entry_ts, r, CAST(500000 AS DOUBLE) AS before, round(CAST(500000 AS DOUBLE) * 0.01 * r, 2) AS net, greatest(CAST(500000 AS DOUBLE) + round(CAST(500000 AS DOUBLE) * 0.01 * r, 2), 0) AS after FROM numbered WHERE seq = 1
  UNION ALL
  SELECT n.symbol, n.seq, n.zone_id, n.structure, n.outcome, n.hold_candles, n.entry_ts, n.r, c.after, round(c.after * 0.01 * n.r, 2), greatest(c.after + round(c.after * 0.01 * n.r, 2), 0) FROM curve c JOIN numbered n ON n.symbol = c.symbol AND n.seq = c.seq + 1
)"""
)


def stats(keys: str, group: str) -> str:
    closed, won = "outcome IN ('win', 'loss', 'trail_win')", "outcome IN ('win', 'trail_win')"
    return f"""SELECT {keys}, count(*) AS trades, count(*) FILTER ({closed}) AS closed, count(*) FILTER ({won}) AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'timeout') AS timeouts,
  round(100.0 * count(*) FILTER ({won}) / nullif(count(*) FILTER ({closed}), 0), 2) AS win_rate, round(sum(net) FILTER ({won}) / nullif(abs(sum(net) FILTER (outcome = 'loss')), 0), 3) AS profit_factor,
  round(avg(round(r, 4)) FILTER ({closed}), 4) AS avg_r, round(sum(round(r, 4)) FILTER ({closed}), 4) AS total_r,
  CASE WHEN count(*) FILTER ({closed}) >= 2 THEN round(avg(round(r, 4)) FILTER ({closed}) / nullif(stddev_pop(round(r, 4)) FILTER ({closed}), 0) * sqrt(252 / greatest(avg(hold_candles) FILTER ({closed}), 1)), 3) END AS sharpe_r,
  round(sum(net), 2) AS total_pnl, round(avg(net) FILTER (outcome = 'timeout'), 2) AS avg_timeout, round(avg(net) FILTER ({won}), 2) AS avg_win, round(avg(net) FILTER (outcome = 'loss'), 2) AS avg_loss, round(avg(net) FILTER (outcome = 'trail_win'), 2) AS avg_trail_win FROM curve GROUP BY {group}"""


def q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


PCT = IND + ", pct AS (SELECT *, 100 * atr / close AS pct FROM ind WHERE atr IS NOT NULL)"


def _window_features() -> str:
    out = []
    for k in range(19, -1, -1):
        o, h, low, c, v = (_lag(x, k) for x in ("open", "high", "low", "close", "volume_ratio"))
        name = f"cm{k}" if k else "cp0"
        each = {
            "close_rel": f"({c} - close) / atr",
            "body_atr": f"abs({c} - {o}) / atr",
            "range_atr": f"({h} - {low}) / atr",
            "upper_wick_atr": f"greatest({h} - greatest({o}, {c}), 0) / atr",
            "lower_wick_atr": f"greatest(least({o}, {c}) - {low}, 0) / atr",
            "is_bullish": f"CAST({c} >= {o} AS DOUBLE)",
            "volume_ratio": f"coalesce({v}, 1.0)",
        }
        out += [f"round({x}, 4) AS {name}_{n}" for n, x in each.items()]
    out += [f"round((close - {_lag('close', 19)}) / atr, 4) AS net_move_atr", f"round(CASE WHEN {_lag('atr', 19)} > 0 THEN atr / {_lag('atr', 19)} ELSE 1 END, 4) AS volatility_ratio"]
    return ", ".join([*out, *(f"round(coalesce((close - ema{n}) / atr, 0), 4) AS ema{n}_dist" for n in (20, 50, 200))])


def _oscillators() -> str:
    lag = f"lag(close) {_W}"
    last = lambda n: f"OVER (PARTITION BY symbol ORDER BY idx ROWS {n - 1} PRECEDING)"
    return (
        IND
        + f""",
o1 AS (SELECT *, close - {lag} AS change, high - lag(high) {_W} AS up, lag(low) {_W} - low AS down FROM ind),
o2 AS (SELECT *, greatest(change, 0.0) AS gain, greatest(-change, 0.0) AS loss, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus FROM o1),
o3 AS (SELECT *, {_exp("close", 2 / 13)} AS e12, {_exp("close", 2 / 27)} AS e26, {_exp("gain", 1 / 14, 15)} AS ag, {_exp("loss", 1 / 14, 15)} AS al, {_exp("plus", 1 / 14, 14)} AS ap, {_exp("minus", 1 / 14, 14)} AS am FROM o2),
o4 AS (SELECT *, e12 - e26 AS macd, 100 * abs(ap - am) / nullif(ap + am, 0) AS dx FROM o3),
o5 AS (SELECT *, {_exp("macd", 0.2)} AS signal, {_exp("dx", 1 / 14, 28)} AS adx, avg(close) {last(20)} AS mean, stddev_pop(close) {last(20)} AS dev, max(high) {last(14)} AS t, min(low) {last(14)} AS l, lag(close, 10) {_W} AS c10,
  sum(sign(change) * volume) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING) AS obv FROM o4)"""
    )


#: 1 where a bar is a pattern.
_PATTERN_FLAGS = ", ".join(f"CAST(coalesce({x}, false) AS INT) AS {n}" for n, x in PATTERNS.items())
_FORMED = ", ".join(f"CAST(coalesce(f.structure = '{s}', false) AS INT) AS \"is_{s}\"" for s in ("DBR", "RBD", "RBR", "DBD"))
#: What a bar tells of the market, and what a stretch of three bars as a base and three before it as a leg-in tell.
_MARKET = f"""
market AS (
  SELECT symbol, idx AS base_end_idx, ts AS base_end_ts, atr AS atr_level, round((close - ema200) / nullif(atr, 0), 4) AS close_vs_ema200, round((close - ema50) / nullif(atr, 0), 4) AS close_vs_ema50, volume_ratio, rolling_volatility,
         body / nullif(atr, 0) AS body_to_atr, is_bullish AS is_bullish_last, avg(is_bullish) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS leg_in_bullish_ratio FROM ind
),
fixed0 AS (
  SELECT symbol, idx, atr, {_lag("close", 3)} - {_lag("open", 5)} AS came, avg(atr) OVER w AS a, max(high) OVER w - min(low) OVER w AS width, sum(body) OVER w AS bodies, sum(span) OVER w AS spans, avg(CASE WHEN volume_ratio > 0 THEN volume_ratio END) OVER w AS heard
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 2 PRECEDING)
),
close_by AS (SELECT DISTINCT symbol, unnest(range(formation_idx - 5, formation_idx + 6)) AS idx FROM zones),
free AS (SELECT f.*, row_number() OVER (PARTITION BY f.symbol ORDER BY md5(f.symbol || ':' || f.idx || ':42'), f.idx) AS place FROM fixed0 f ANTI JOIN close_by c ON c.symbol = f.symbol AND c.idx = f.idx WHERE atr IS NOT NULL AND f.idx >= 5),
negatives AS (
  SELECT f.symbol, f.idx AS base_end_idx, round(came / nullif(a, 0), 4) AS leg_in_disp_atr, CASE WHEN came < 0 THEN -1 ELSE 1 END AS leg_in_direction, round(abs(came) / nullif(a, 0) / 3, 4) AS leg_in_velocity, 3 AS base_length,
         round(1 - bodies / nullif(spans, 0), 4) AS base_wick_frac, round(width / nullif(a, 0), 4) AS base_range_atr, round(heard, 4) AS base_volume_ratio
  FROM free f JOIN (SELECT symbol, 3 * count(*) AS wanted FROM zones GROUP BY symbol) USING (symbol) WHERE place <= wanted
),
examples AS (
  SELECT symbol, 'positive' AS example_type, 1 AS is_zone, zone_id, base_end_idx, leg_in_disp_atr, CASE WHEN structure IN ('DBR', 'DBD') THEN -1 ELSE 1 END AS leg_in_direction, leg_in_velocity, base_length, base_wick_frac, width_atr AS base_range_atr, base_volume_ratio FROM zones
  UNION ALL SELECT symbol, 'negative', 0, NULL, base_end_idx, leg_in_disp_atr, leg_in_direction, leg_in_velocity, base_length, base_wick_frac, base_range_atr, base_volume_ratio FROM negatives
)"""
EXAMPLE_COLUMNS = "symbol, example_type, is_zone, zone_id, base_end_ts, leg_in_disp_atr, leg_in_direction, leg_in_velocity, base_length, base_wick_frac, base_range_atr, base_volume_ratio, atr_level, close_vs_ema200, close_vs_ema50, is_bullish_last, leg_in_bullish_ratio"

_FORMATIONS = f""", f AS (SELECT *, row_number() OVER (PARTITION BY symbol, formation_ts ORDER BY strength DESC, zone_id) AS k, count(*) OVER (PARTITION BY symbol, formation_ts) AS formed FROM lived),
formations AS (
  SELECT i.symbol, i.ts, f.structure AS zone_formed_structure, f.type AS zone_formed_type, coalesce(f.strength, 0) AS zone_formed_strength, coalesce(formed, 0) AS zone_formed_count, {_FORMED}
  FROM ind i LEFT JOIN f ON f.symbol = i.symbol AND f.formation_ts = i.ts AND k = 1
)"""
_CONTEXT = (
    """, pairs AS (
  SELECT b.symbol, b.ts, z.type, z.structure, z.top, z.bottom, z.strength, CASE WHEN type = 'demand' THEN close - top ELSE bottom - close END AS dist, close BETWEEN bottom AND top AS within, b.close, z.formation_ts, z.zone_id
  FROM ind b JOIN lived z ON z.symbol = b.symbol AND z.formation_ts <= b.ts AND (z.invalidation_ts IS NULL OR b.ts < z.invalidation_ts)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts, type ORDER BY CASE WHEN dist >= 0 THEN 0 ELSE 1 END, abs(dist), formation_ts, zone_id) AS k FROM pairs
), sums AS (
  SELECT symbol, ts, """
    + ", ".join(
        f"count(*) FILTER (type = '{t}') AS active_{t}_count, max(CAST(within AS INT)) FILTER (type = '{t}') AS in_{t}, any_value(dist) FILTER (type = '{t}' AND k = 1) AS dist_{t}, any_value(strength) FILTER (type = '{t}' AND k = 1) AS strength_{t}, any_value(structure) FILTER (type = '{t}' AND k = 1) AS structure_{t}"
        for t in ("demand", "supply")
    )
    + " FROM ranked GROUP BY ALL), context AS (SELECT i.symbol, i.ts, i.close, "
    + ", ".join(f"coalesce(active_{t}_count, 0) AS active_{t}_count, coalesce(in_{t}, 0) AS price_in_{t}_zone, round(100 * dist_{t} / close, 4) AS nearest_{t}_dist_pct, strength_{t} AS nearest_{t}_strength, structure_{t} AS nearest_{t}_structure" for t in ("demand", "supply"))
    + ", CAST(coalesce(active_demand_count > 0 AND active_supply_count > 0, false) AS INT) AS zone_confluence FROM ind i LEFT JOIN sums USING (symbol, ts))"
)

SQL = {
    "bars_ohlcv": q(BARS, "SELECT symbol, ts, open, high, low, close, volume FROM bars0"),
    "indicators": q(IND, "SELECT symbol, ts, idx, round(true_range, 2) AS true_range, round(atr, 3) AS atr, round(ema20, 3) AS ema20, round(ema50, 3) AS ema50, round(ema200, 3) AS ema200, round(sma20, 6) AS sma20, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, round(log_return, 9) AS log_return, round(rolling_volatility, 9) AS rolling_volatility, round(volume_ratio, 6) AS volume_ratio, round(body / nullif(span, 0), 6) AS body_ratio, is_bullish, CAST(coalesce(span > 5 * atr, false) AS INT) AS is_outlier FROM ind"),
    "row_gate": q(BARS, "SELECT symbol, count(*) AS bars, count(*) < 252 AS short FROM bars0 GROUP BY symbol"),
    "base_windows": q(IND + "," + _bases(""), "SELECT symbol, idx, n, round(top, 2) AS top, round(bottom, 2) AS bottom, round(avg_atr, 3) AS avg_atr, round(wick, 5) AS wick FROM bases WHERE n IS NOT NULL"),
    "zones_scored": q(ZONES, f"SELECT {ZONE_COLUMNS} FROM zones"),
    "zone_lifecycle": q(LIFE, "SELECT symbol, zone_id, type, status, test_count, last_test_ts, invalidation_ts, freshness_score FROM lived"),
    "zone_summary": q(MERGED + life("merged"), "SELECT symbol, type, status, count(*) AS zones, round(avg(quality_score), 3) AS mean_quality, CAST(sum(merged_count) AS BIGINT) AS raw_zones FROM lived GROUP BY ALL", True),
    "zones_merged": q(MERGED, "SELECT symbol, zone_id, type, formation_ts, quality_score, merged_count FROM merged", True),
    "zones_detected": q(DETECTED, "SELECT * FROM detected", True),
    "htf_confluence": q(ZONES + confluence(), "SELECT symbol, zone_id, htf_trend_align, htf_in_zone, htf_dist_atr, htf_zone_strength, htf_zone_fresh, htf_confirmed, htf_confluence FROM conf"),
    "zones_reversal": q(
        ZONES, "SELECT symbol, formation_ts, type, structure, round(abs(net) / avg_atr, 4) AS leg_in_disp_atr FROM raw WHERE arrival = CASE WHEN up THEN 'down' ELSE 'up' END AND abs(net) / avg_atr >= 0.5 AND CASE WHEN net < 0 THEN origin > top ELSE origin < bottom END"
    ),
    "zone_ranks": q(
        ZONES + ", p AS (SELECT *, CASE WHEN strength >= 0.5 THEN strength END AS ml_prob FROM zones)",
        "SELECT symbol, zone_id, ml_prob, CASE WHEN ml_prob IS NOT NULL THEN row_number() OVER (PARTITION BY symbol ORDER BY ml_prob DESC NULLS LAST, zone_id) END AS ml_rank FROM p",
    ),
    "zone_reactions": q(
        ZONES
        + """,
touch0 AS (SELECT z.symbol, z.zone_id, z.type, z.top, z.bottom, b.idx, b.ts, b.atr, row_number() OVER (PARTITION BY z.symbol, z.zone_id ORDER BY b.idx) AS k, b.low <= z.top AND b.high >= z.bottom AND b.atr > 0 AS inside,
  CASE WHEN type = 'demand' THEN b.close < z.bottom ELSE b.close > z.top END AS broken FROM zones z JOIN ind b ON b.symbol = z.symbol AND b.idx > z.formation_idx),
first_in AS (SELECT symbol, zone_id, type, top, bottom, min(idx) FILTER (inside) AS enter, arg_min(ts, idx) FILTER (inside) AS entered_ts, arg_min(atr, idx) FILTER (inside) AS unit FROM touch0 GROUP BY ALL),
ahead AS (
  SELECT f.*, b.idx - enter AS k, CASE WHEN type = 'demand' THEN b.high >= top + 1.5 * unit ELSE b.low <= bottom - 1.5 * unit END AS away, CASE WHEN type = 'demand' THEN b.close < bottom - 0.5 * unit ELSE b.close > top + 0.5 * unit END AS beyond,
    b.close BETWEEN bottom AND top AS back FROM first_in f JOIN ind b ON b.symbol = f.symbol AND b.idx BETWEEN enter AND enter + 20
),
cases AS (SELECT symbol, zone_id, type, entered_ts, max(k) AS seen, min(k) FILTER (away AND k BETWEEN 1 AND 15) AS a, min(k) FILTER (beyond AND k <= 15) AS b FROM ahead GROUP BY ALL),
again AS (SELECT x.symbol, x.zone_id, bool_or(back) AS back, bool_or(away) AS away FROM ahead x JOIN cases c ON c.symbol = x.symbol AND c.zone_id = x.zone_id AND x.k > c.b AND x.k <= c.b + 5 GROUP BY ALL)""",
        "SELECT c.symbol, c.zone_id, c.type, c.entered_ts, CASE WHEN a IS NOT NULL AND (b IS NULL OR a < b) THEN 'reversal' WHEN b IS NULL THEN 'consolidation' WHEN coalesce(g.back AND g.away, false) THEN 'false_breakout' ELSE 'breakout' END AS reaction FROM cases c LEFT JOIN again g ON g.symbol = c.symbol AND g.zone_id = c.zone_id WHERE seen = 20",
    ),
    "rebuilt_zones": q(
        rebuilt(),
        "SELECT m.symbol, zone_id, ts, round(ml_prob, 4) AS ml_prob, type, structure, top, bottom, proximal, distal, base_length, avg_atr, coalesce(test_count, 0) AS test_count, last_test_ts, invalidation_ts, CASE WHEN invalidation_ts IS NULL THEN 'active' ELSE 'invalidated' END AS status FROM ml m LEFT JOIN counted USING (symbol, zone_id)",
        True,
    ),
    "filled_bars": q(
        BARS
        + ", grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars0 GROUP BY symbol), g AS (SELECT grid.symbol, grid.ts, close, volume FROM grid LEFT JOIN bars0 USING (symbol, ts))",
        "SELECT symbol, ts, last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume, 0) AS volume FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING)",
    ),
    "htf_bars": q(
        BARS + ", six AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars0 GROUP BY ALL)",
        "SELECT * FROM six",
    ),
    "weekly_bars": q(BARS, "SELECT symbol, CAST(CAST(date_trunc('week', CAST(ts AS DATE) - INTERVAL 5 DAY) AS DATE) + INTERVAL 11 DAY AS TIMESTAMP) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars0 GROUP BY 1, 2"),
    "formation_stamp": q(LIFE + _FORMATIONS, "SELECT * FROM formations"),
    "active_context": q(LIFE + _CONTEXT, "SELECT * EXCLUDE (close) FROM context"),
    "labelled_formations": q(
        LIFE + _FORMATIONS + _CONTEXT,
        "SELECT symbol, ts, close, zone_formed_structure, zone_formed_type, zone_formed_strength, zone_formed_count, active_demand_count, active_supply_count, zone_confluence FROM formations JOIN context USING (symbol, ts) WHERE zone_formed_count > 0",
    ),
    "trades_fixed": q(trades(), f"SELECT {TRADE_COLUMNS} FROM trades"),
    "trades_confirm": q(trades(True), f"SELECT {TRADE_COLUMNS} FROM trades"),
    "trades_trailing": q(trailed(), f"SELECT {TRADE_COLUMNS} FROM trades"),
    "trades_filtered": q(trades().replace("WHERE fill_idx IS NOT NULL", "WHERE round(least(quality_score / 100, 1), 4) BETWEEN 0.6 AND 0.85 AND structure IN ('DBR', 'RBD') AND fill_idx IS NOT NULL"), f"SELECT {TRADE_COLUMNS} FROM trades"),
    "trades_r": q(
        ZONES + _CLOSE_IN + exits_r(60, "entered"),
        f"SELECT symbol, zone_id, type, structure, formation_ts, entry_ts, exit_ts, round(entry_price, 2) AS entry_price, round(stop_price_, 2) AS stop_price, round(target_price_, 2) AS target_price, round(exit_price, 2) AS exit_price, outcome, hold_candles, {_R} AS r_multiple FROM r_trades",
    ),
    "trades_modes": q(
        ZONES
        + _CLOSE_IN
        + exits_r(60, "entered")
        + f", m AS (SELECT *, {_R} AS r, strength AS ml_prob, unnest(CASE WHEN strength >= 0.6 THEN ['baseline', 'filtered'] ELSE ['baseline'] END) AS mode FROM r_trades)",
        "SELECT mode, count(*) AS trades, count(*) FILTER (outcome IN ('win', 'loss')) AS closed, count(*) FILTER (outcome = 'open') AS open, round(100.0 * count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome IN ('win', 'loss')), 0), 2) AS win_rate, "
        "round(sum(r) FILTER (outcome = 'win') / nullif(abs(sum(r) FILTER (outcome = 'loss')), 0), 3) AS profit_factor, round(avg(r) FILTER (outcome IN ('win', 'loss')), 4) AS avg_r, round(sum(r) FILTER (outcome IN ('win', 'loss')), 4) AS total_r, "
        "round(avg(ml_prob) FILTER (outcome = 'win'), 4) AS mean_prob_won, round(avg(ml_prob) FILTER (outcome = 'loss'), 4) AS mean_prob_lost FROM m GROUP BY mode",
    ),
    "drawdown_r": q(
        trades()
        + ", c AS (SELECT symbol, zone_id, entry_ts, round(side * (exit_price - entry_price) / risk, 4) AS r FROM trades WHERE outcome IN ('win', 'loss')), t AS (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY entry_ts, zone_id ROWS UNBOUNDED PRECEDING) AS total FROM c), f AS (SELECT *, max(total) OVER (PARTITION BY symbol ORDER BY entry_ts, zone_id ROWS UNBOUNDED PRECEDING) - total AS fall FROM t)",
        "SELECT symbol, round(max(fall), 4) AS max_drawdown_r, round(sum(r), 4) AS total_r FROM f GROUP BY symbol",
    ),
    "trade_statistics": q(
        trades() + ", c AS (SELECT symbol, round(side * (exit_price - entry_price) / risk, 4) AS r FROM trades)",
        "SELECT symbol, count(*) AS n, round(avg(CAST(r > 0 AS INT)), 4) AS win_share, round(sum(r) FILTER (r > 0) / nullif(abs(sum(r) FILTER (r < 0)), 0), 4) AS profit_factor, round(avg(r), 4) AS avg_r, round(sum(r), 4) AS total_r FROM c WHERE r IS NOT NULL GROUP BY symbol",
    ),
    "trades_atr_stop": q(trades(False, "entry_price - CASE WHEN type = 'demand' THEN 1 ELSE -1 END * 1.5 * fill_atr"), f"SELECT {TRADE_COLUMNS} FROM trades"),
    "equity_curve": q(EQUITY, "SELECT symbol, seq, zone_id, outcome, round(before, 2) AS capital_at_entry, round(net, 2) AS net_pnl, round(after, 2) AS equity_after_trade FROM curve", True),
    "performance": q(EQUITY, stats("symbol", "symbol"), True),
    "pooled_summary": q(
        EQUITY + ", p AS (" + stats("symbol", "symbol") + ")",
        "SELECT CAST(sum(closed) AS BIGINT) AS closed, round(sum(closed * win_rate) / sum(closed), 3) AS win_rate, round(quantile_cont(profit_factor, 0.5), 4) AS median_profit_factor, round(quantile_cont(total_pnl, 0.5), 3) AS median_pnl FROM p",
        True,
    ),
    "structure_rollup": q(EQUITY, stats("symbol, structure", "ROLLUP (symbol, structure)"), True),
    "drawdown": q(
        EQUITY + ", falls AS (SELECT *, max(after) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) - after AS fall FROM curve)",
        "SELECT symbol, round(max(fall), 2) AS max_drawdown, round(100 * max(fall) / max(after), 4) AS max_drawdown_pct, round(last(after ORDER BY seq), 2) AS final_equity FROM falls GROUP BY symbol",
        True,
    ),
    "quality_profile": q(BARS, "SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM bars0 GROUP BY symbol"),
    "quality_nulls": q(
        IND + ", n AS (SELECT unnest([{'c': 'close', 'x': count(*) - count(close)}, {'c': 'atr', 'x': count(*) - count(atr)}, {'c': 'sma200', 'x': count(*) - count(sma200)}, {'c': 'rolling_volatility', 'x': count(*) - count(rolling_volatility)}]) AS u, count(*) AS n FROM ind)",
        "SELECT u.c AS column_name, u.x AS n_null, round(100.0 * u.x / n, 4) AS pct_null FROM n",
    ),
    "quality_integrity": q(BARS, "SELECT symbol, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (open > high) AS open_above_high, count(*) FILTER (open < low) AS open_below_low, count(*) FILTER (close > high) AS close_above_high, count(*) FILTER (close < low) AS close_below_low, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive, count(*) FILTER (volume <= 0) AS no_volume FROM bars0 GROUP BY symbol"),
    "quality_gaps": q(BARS + ", g AS (SELECT symbol, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 3600 AS gap_hours FROM bars0)", "SELECT symbol, gap_hours, count(*) AS gaps FROM g WHERE gap_hours > 1 GROUP BY ALL"),
    "quality_duplicates": "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "atr_stats": q(PCT, "SELECT symbol, round(avg(pct), 4) AS mean, round(stddev_samp(pct), 4) AS std, round(min(pct), 4) AS least, round(max(pct), 4) AS most, round(quantile_cont(pct, 0.05), 4) AS p05, round(quantile_cont(pct, 0.25), 4) AS p25, round(quantile_cont(pct, 0.5), 4) AS p50, round(quantile_cont(pct, 0.75), 4) AS p75, round(quantile_cont(pct, 0.95), 4) AS p95, first(ts ORDER BY round(pct, 6), ts) AS least_ts, first(ts ORDER BY round(pct, 6) DESC, ts) AS most_ts FROM pct GROUP BY symbol"),
    "volatility_regimes": q(
        PCT + ", bounds AS (SELECT symbol, quantile_cont(pct, 0.25) AS q1, quantile_cont(pct, 0.75) AS q3 FROM pct GROUP BY symbol), s AS (SELECT *, " + _mean("pct", 60) + " AS smooth FROM pct)",
        "SELECT symbol, CASE WHEN pct < q1 THEN 'low' WHEN pct > q3 THEN 'high' ELSE 'normal' END AS regime, count(*) AS bars, round(avg(smooth), 4) AS mean_smooth FROM s JOIN bounds USING (symbol) GROUP BY ALL",
    ),
    "atr_by_day": q(PCT, "SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS bars, round(quantile_cont(pct, 0.25), 4) AS q1, round(quantile_cont(pct, 0.5), 4) AS median, round(quantile_cont(pct, 0.75), 4) AS q3 FROM pct GROUP BY ALL"),
    "return_moments": q(IND, "SELECT symbol, count(log_return) AS returns, round(1e4 * avg(log_return), 4) AS mean_bp, round(stddev_samp(log_return), 6) AS std, round(stddev_samp(log_return) * sqrt(252), 5) AS annual_std, round(skewness(log_return), 4) AS skew, round(kurtosis(log_return), 4) AS excess_kurtosis FROM ind GROUP BY symbol"),
    "return_normality": q(
        IND + ", m AS (SELECT symbol, count(log_return) AS n, skewness(log_return) AS g, kurtosis_pop(log_return) AS k FROM ind GROUP BY symbol), j AS (SELECT *, n / 6 * (pow(g * (n - 2) / sqrt(n * (n - 1)), 2) + k * k / 4) AS jb FROM m)",
        "SELECT symbol, n AS returns, round(jb, 2) AS jarque_bera, round(exp(-jb / 2), 6) AS p_normal FROM j",
    ),
    "quality_describe": q(
        IND + ", l AS (SELECT unnest(['close', 'volume', 'atr', 'log_return']) AS column_name, unnest([close, volume, atr, log_return]) AS v FROM ind)",
        "SELECT column_name, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS least, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS most FROM l GROUP BY column_name",
    ),
    "tail_frequency": q(
        IND + ", m AS (SELECT symbol, avg(log_return) AS mu, stddev_samp(log_return) AS sd FROM ind GROUP BY symbol), k(k, normal_share) AS (VALUES " + ", ".join(str(x) for x in TAILS) + "), z AS (SELECT symbol, abs((log_return - mu) / sd) AS z FROM ind JOIN m USING (symbol) WHERE log_return IS NOT NULL)",
        "SELECT symbol, k, CAST(normal_share AS DOUBLE) AS normal_share, count(*) FILTER (z > k) AS beyond, round(avg(CAST(z > k AS INT)), 6) AS share FROM z, k GROUP BY ALL",
    ),
    "candle_shape": q(IND + ", c AS (SELECT *, body / nullif(span, 0) AS br FROM ind)", "SELECT symbol, count(*) FILTER (is_bullish = 1) AS bullish, count(*) FILTER (is_bullish = 0) AS bearish, round(avg(br), 4) AS mean_body_ratio, " + ", ".join(f"round(quantile_cont(br, {p}), 4) AS {n}" for n, p in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))) + " FROM c GROUP BY symbol"),
    "volume_links": q(IND, "SELECT symbol, round(avg(volume_ratio), 4) AS mean_ratio, round(quantile_cont(volume_ratio, 0.95), 4) AS p95_ratio, round(corr(volume_ratio, abs(log_return)), 6) AS corr_abs_return FROM ind GROUP BY symbol"),
    "range_outliers": q(
        IND + ", far AS (SELECT symbol, idx AS at, ts AS outlier_ts, round(span / atr, 4) AS atr_multiple FROM ind WHERE span > 2 * atr)",
        "SELECT far.symbol, outlier_ts, atr_multiple, count(*) AS bars_around, round(max(close) - min(close), 2) AS span_around FROM far JOIN ind ON ind.symbol = far.symbol AND ind.idx BETWEEN far.at - 15 AND far.at + 14 GROUP BY ALL",
    ),
    "ma_alignment": q(
        IND + ", r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM ind), l AS (SELECT symbol, close, atr, unnest(['ema20', 'ema50', 'ema200']) AS mean_name, unnest([ema20, ema50, ema200]) AS mean_value FROM r WHERE k <= 252)",
        "SELECT symbol, mean_name, count(*) AS bars, round(avg(CAST(close > mean_value AS INT)), 6) AS share_above, round(avg((close - mean_value) / atr), 4) AS mean_distance_atr FROM l GROUP BY ALL",
    ),
    "return_histogram": q(IND, "SELECT symbol, CASE WHEN log_return < -0.005 THEN 0 WHEN log_return >= 0.005 THEN 21 ELSE CAST(floor((log_return + 0.005) / 0.01 * 20) AS BIGINT) + 1 END AS bin, count(*) AS bars FROM ind WHERE log_return IS NOT NULL GROUP BY ALL"),
    "plotting_positions": q(IND, "SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY log_return, ts) AS place, round((row_number() OVER (PARTITION BY symbol ORDER BY log_return, ts) - 0.5) / count(*) OVER (PARTITION BY symbol), 6) AS position FROM ind WHERE log_return IS NOT NULL"),
    "window_features": q(IND, f"SELECT * EXCLUDE (atr, idx) FROM (SELECT symbol, ts, idx, atr, {_window_features()} FROM ind) WHERE idx >= 19 AND atr > 0"),
    "window_labels": q(
        ZONES + ", f AS (SELECT symbol, formation_ts AS ts, arg_min(type, zone_id) AS type FROM zones GROUP BY ALL)",
        "SELECT i.symbol, coalesce(type, 'none') AS zone_type, CAST(type IS NOT NULL AS INT) AS label, count(*) AS windows FROM ind i LEFT JOIN f ON f.symbol = i.symbol AND f.ts = i.ts WHERE i.idx >= 19 AND i.atr > 0 GROUP BY ALL",
    ),
    "base_end_examples": q(ZONES + "," + _MARKET, f"SELECT {EXAMPLE_COLUMNS} FROM examples JOIN market USING (symbol, base_end_idx)"),
    "example_nulls": q(
        ZONES + "," + _MARKET + """, e AS (SELECT e.*, m.close_vs_ema200, m.rolling_volatility, CASE WHEN is_zone = 1 THEN 1 END AS quality FROM examples e JOIN market m USING (symbol, base_end_idx)),
n AS (SELECT count(*) AS n, unnest([{'c': 'leg_in_disp_atr', 'x': count(*) - count(leg_in_disp_atr)}, {'c': 'base_volume_ratio', 'x': count(*) - count(base_volume_ratio)}, {'c': 'close_vs_ema200', 'x': count(*) - count(close_vs_ema200)},
  {'c': 'rolling_volatility', 'x': count(*) - count(rolling_volatility)}, {'c': 'quality_score_ao', 'x': count(*) - count(quality)}]) AS u FROM e)""",
        "SELECT u.c AS column_name, u.x AS n_null, round(100.0 * u.x / n, 4) AS pct_null FROM n",
    ),
    "oscillators": q(
        _oscillators(),
        "SELECT symbol, ts, round(macd, 3) AS macd, round(signal, 3) AS macd_signal, round(100 - 100 / (1 + ag / nullif(al, 0)), 3) AS rsi, round(100 * (close - l) / nullif(t - l, 0), 3) AS stochastic_k, round(100 * (close - c10) / nullif(c10, 0), 4) AS roc10, round(4 * dev / nullif(mean, 0), 5) AS bollinger_width, round(coalesce(obv, 0), 0) AS obv, round(adx, 2) AS adx FROM o5",
    ),
    "merged_ranges": q(
        ZONES
        + ", r AS (SELECT *, max(top + avg_atr) OVER (PARTITION BY symbol, type ORDER BY bottom, top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM zones), n AS (SELECT *, CASE WHEN bottom <= reach THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY symbol, type ORDER BY bottom, top ROWS UNBOUNDED PRECEDING) AS island FROM n)",
        "SELECT symbol, type, CAST(island AS BIGINT) AS island, min(bottom) AS bottom, max(top) AS top, count(*) AS zones FROM i GROUP BY ALL",
    ),
    "swing_points": q(
        BARS
        + ", s AS (SELECT *, high > max(high) OVER b AND high > max(high) OVER a AND count(*) OVER a = 3 AND count(*) OVER b = 3 AS sh, low < min(low) OVER b AND low < min(low) OVER a AND count(*) OVER a = 3 AND count(*) OVER b = 3 AS sl FROM bars0 WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))",
        "SELECT symbol, ts, 'high' AS swing, high AS zone_top, greatest(open, close) AS zone_bottom FROM s WHERE sh UNION ALL SELECT symbol, ts, 'low', least(open, close), low FROM s WHERE sl",
    ),
    "price_clusters": q(
        BARS
        + ", p AS (SELECT symbol, CAST(floor(unnest([open, high, low, close]) / 50) AS BIGINT) AS bin FROM bars0), h AS (SELECT symbol, bin, count(*) AS hits FROM p GROUP BY ALL), k AS (SELECT h.*, coalesce(l.hits, 0) AS lh, coalesce(r.hits, 0) AS rh FROM h LEFT JOIN h l ON l.symbol = h.symbol AND l.bin = h.bin - 1 LEFT JOIN h r ON r.symbol = h.symbol AND r.bin = h.bin + 1)",
        "SELECT symbol, bin, hits, row_number() OVER (PARTITION BY symbol ORDER BY hits DESC, bin) AS density_rank FROM k WHERE hits > lh AND hits > rh",
    ),
    "volume_profile": q(
        BARS
        + ", f AS (SELECT *, CAST(floor(low / 50) AS BIGINT) AS a, CAST(floor(high / 50) AS BIGINT) AS b FROM bars0), s AS (SELECT symbol, unnest(range(a, b + 1)) AS bin, volume / (b - a + 1) AS part FROM f), v AS (SELECT symbol, bin, round(sum(part), 6) AS volume FROM s GROUP BY ALL)",
        "SELECT v.symbol, v.bin, v.volume, row_number() OVER (PARTITION BY v.symbol ORDER BY v.volume DESC, v.bin) = 1 AS poc, v.volume > coalesce(l.volume, 0) AND v.volume > coalesce(r.volume, 0) AS hvn, coalesce(v.volume < l.volume AND v.volume < r.volume, false) AS lvn "
        "FROM v LEFT JOIN v l ON l.symbol = v.symbol AND l.bin = v.bin - 1 LEFT JOIN v r ON r.symbol = v.symbol AND r.bin = v.bin + 1",
    ),
    "price_cluster_zones": q(
        BARS
        + ", p AS (SELECT symbol, CAST(floor(unnest([open, high, low, close]) / 50) AS BIGINT) AS bin FROM bars0), h AS (SELECT symbol, bin, count(*) AS hits FROM p GROUP BY ALL), k AS (SELECT h.*, coalesce(l.hits, 0) AS lh, coalesce(r.hits, 0) AS rh FROM h LEFT JOIN h l ON l.symbol = h.symbol AND l.bin = h.bin - 1 LEFT JOIN h r ON r.symbol = h.symbol AND r.bin = h.bin + 1)"
        + ", t AS (SELECT symbol, avg(high - low) AS reach FROM bars0 GROUP BY symbol), z AS (SELECT k.symbol, k.hits, (bin + 0.5) * 50 - reach / 2 AS bottom, (bin + 0.5) * 50 + reach / 2 AS top FROM k JOIN t USING (symbol) WHERE hits > lh AND hits > rh)"
        + ", g AS (SELECT *, CASE WHEN bottom <= max(top) OVER (PARTITION BY symbol ORDER BY bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM z), i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY bottom ROWS UNBOUNDED PRECEDING) AS island FROM g)"
        + ", m AS (SELECT symbol, island, round(min(bottom), 4) AS bottom, round(max(top), 4) AS top, count(*) AS peaks, CAST(sum(hits) AS BIGINT) AS hits FROM i GROUP BY ALL)",
        "SELECT symbol, bottom, top, peaks, hits, row_number() OVER (PARTITION BY symbol ORDER BY hits DESC, bottom) AS density_rank FROM m",
    ),
    "trades_target_first": q(trades().replace("s IS NULL OR w < s", "s IS NULL OR w <= s"), f"SELECT {TRADE_COLUMNS} FROM trades"),
    "zones_of_quality": q(ZONES, "SELECT symbol, printf('Z%04d', row_number() OVER (PARTITION BY symbol ORDER BY formation_idx)) AS zone_id, type, structure, formation_ts, quality_score FROM zones WHERE quality_score >= 70"),
    "trade_baselines": q(
        ZONES
        + _CLOSE_IN
        + exits_r(20, "entered")
        + """,
late AS (SELECT z.symbol, z.zone_id, r.fill_idx + 1 + CAST('0x' || md5(z.symbol || ':' || z.zone_id || ':42')[1:6] AS BIGINT) % 10 AS fill_idx FROM zones z JOIN r_trades r ON r.symbol = z.symbol AND r.zone_id = z.zone_id),
randomly AS (SELECT z.* EXCLUDE (distal), b.idx AS fill_idx, b.ts AS entry_ts, b.close AS entry_price, b.close - CASE WHEN type = 'demand' THEN 1.0 ELSE -1.0 END * abs(z.proximal - z.distal) AS distal
  FROM zones z JOIN late l ON l.symbol = z.symbol AND l.zone_id = z.zone_id JOIN ind b ON b.symbol = z.symbol AND b.idx = l.fill_idx)"""
        + _tagged(exits_r(20, "randomly"), "b")
        + """,
shapes AS (SELECT *, abs(close - open) AS body, high - low AS wide, high - greatest(open, close) AS up, least(open, close) - low AS down FROM ind WHERE atr > 0),
marked AS (SELECT symbol, idx AS fill_idx, ts AS entry_ts, close AS entry_price, close AS proximal, atr, CASE WHEN down >= 2 * body AND up <= 0.3 * body AND body > 0 THEN 'demand' ELSE 'supply' END AS type FROM shapes WHERE wide > 0 AND body > 0 AND (down >= 2 * body AND up <= 0.3 * body OR up >= 2 * body AND down <= 0.3 * body)),
signals AS (SELECT *, 'S' || fill_idx AS zone_id, CAST(NULL AS VARCHAR) AS structure, entry_ts AS formation_ts, entry_price - CASE WHEN type = 'demand' THEN 1.0 ELSE -1.0 END * atr AS distal FROM marked)"""
        + _tagged(exits_r(20, "signals"), "c")
        + f""",
every AS (SELECT 'always_reversal' AS baseline, outcome, {_R} AS r FROM r_trades UNION ALL SELECT 'random_entry', outcome, {_R} FROM r_trades_b UNION ALL SELECT 'indicator', outcome, {_R} FROM r_trades_c)""",
        "SELECT baseline, outcome, count(*) AS trades, round(avg(r), 4) AS avg_r FROM every GROUP BY ALL",
    ),
    "candle_patterns": q(
        BARS
        + ", r0 AS (SELECT symbol, ts, open AS o, high AS h, low AS l, close AS c FROM bars0), r1 AS (SELECT *, "
        + ", ".join(f"lag({x}, {k}) OVER w AS {x}{k}" for k in (1, 2) for x in "ohlc")
        + " FROM r0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)), r2 AS (SELECT *, abs(c - o) AS body, h - l AS span, abs(c1 - o1) AS body1, h1 - l1 AS span1, abs(c2 - o2) AS body2, h2 - l2 AS span2, h - greatest(o, c) AS up, least(o, c) - l AS down FROM r1), r3 AS (SELECT symbol, ts, "
        + _PATTERN_FLAGS
        + " FROM r2)",
        "SELECT * FROM r3 WHERE " + " + ".join(PATTERNS) + " > 0",
    ),
    "movement_labels": q(
        IND + ", m AS (SELECT *, max(high) OVER w - close >= atr AS rise, close - min(low) OVER w >= atr AS fall, count(*) OVER w = 10 AS whole FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))",
        "SELECT symbol, ts, CASE WHEN rise AND fall THEN 'both' WHEN rise THEN 'breakout_up' WHEN fall THEN 'breakout_down' ELSE 'consolidation' END AS movement FROM m WHERE atr IS NOT NULL AND whole",
    ),
    "buy_and_hold": q(BARS, "SELECT symbol, round(100 * (last(close ORDER BY ts) / first(open ORDER BY ts) - 1), 4) AS return_pct, count(*) AS bars FROM bars0 GROUP BY symbol"),
}
