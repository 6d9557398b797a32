"""The checking engine's side of the registered queries: each relation as SQL over the ones it names.

It says the same as the DataFrame operators in another form, so that a wrong one shows. Whole-calendar relations have plain
names; those of walk-forward windows begin with w_ and have the test year y as one more key.
"""

from __future__ import annotations

import re

#: Trading days and risk-free rate a year, cost of one side, stress factor, days of history that a member needs.
DAYS, RF, COST, STRESS, HISTORY = 365, "4.0e-2", "6.0e-4", 2, 20
OFFSETS = (0, 5, 10, 15)
FIRST_YEAR, LAST_YEAR, LOOKBACK = 1997, 2000, 2
CUTOFF = "2000-12-31"
UPTO = "rows between unbounded preceding and current row"
BEFORE = "rows between unbounded preceding and 1 preceding"


def sales(price: str) -> tuple[str, str]:
    daily = f"""select p_type code, cast(l_shipdate as date) dt, sum(cast({price} as decimal(18,2))) ext, sum(cast(l_quantity as decimal(18,2))) qty
        from lineitem join part on l_partkey = p_partkey group by p_type, cast(l_shipdate as date)"""
    last = "over (partition by code order by dt rows between 19 preceding and current row)"
    return daily, f"select code, dt, close from (select code, dt, cast(sum(ext) {last} as double) / cast(sum(qty) {last} as double) close, row_number() over (partition by code order by dt) k from DAILY) x where k >= 20"


def chain(p: str, k: str) -> dict[str, str]:
    """Panel to net returns, with the key k (and its comma) in front and the prefix p."""
    same = (lambda a, b: f" and {a}.y = {b}.y") if k else (lambda a, b: "")
    on = (lambda a, b: f"on {a}.y = {b}.y") if k else (lambda a, b: "on true")
    of = (lambda a: f"{a}.y, ") if k else (lambda a: "")
    by_code = f"partition by {k}code order by dt"
    run = f"partition by {k}off order by dt"
    r = {}
    r["calendar"] = f"select distinct {k}dt from {p}panel"
    r["instruments"] = f"select distinct {k}code from {p}panel"
    r["dense"] = f"select {of('c')}i.code, c.dt, q.close from {p}calendar c join {p}instruments i {on('c', 'i')} left join {p}panel q on q.code = i.code and q.dt = c.dt{same('q', 'c')}"
    r["filled"] = f"select {k}code, dt, close, last_value(close ignore nulls) over ({by_code} {UPTO}) f from {p}dense"
    r["returns"] = f"select {k}code, dt, close, f, f / lag(f) over ({by_code}) - 1 r, count(close) over ({by_code} {BEFORE}) seen from {p}filled"
    r["growth"] = f"select {k}code, dt, close, f, r, seen, product(1 + coalesce(r, 0)) over ({by_code} {UPTO}) g from {p}returns"
    r["ranked"] = f"select {k}dt, cast(date_trunc('month', dt) as date) m, row_number() over (partition by {k}date_trunc('month', dt) order by dt) k, count(*) over (partition by {k}date_trunc('month', dt)) n from {p}calendar"
    r["monthly"] = f"select {k}off, dt from {p}ranked cross join offsets where k = least(off + 1, n)"
    r["bar0"] = f"select {k}min(dt) dt from {p}calendar {'group by y' if k else ''}"
    r["decisions"] = f"select {of('m')}m.off, m.dt from {p}monthly m join {p}bar0 b on m.dt > b.dt{same('m', 'b')}"
    r["members"] = f"select {of('s')}s.off, s.dt decided, g.code, g.g from {p}decisions s join {p}growth g on g.dt = s.dt{same('g', 's')} where g.seen >= {HISTORY}"
    r["targets"] = f"select {k}off, decided, code, g, cast(1 as double) / count(*) over (partition by {k}off, decided) w from {p}members"
    r["runs_by_day"] = f"select {of('c')}c.dt, o.off, s.dt is not null rebal, last_value(s.dt ignore nulls) over (partition by {of('c')}o.off order by c.dt {BEFORE}) decided from {p}calendar c cross join offsets o left join {p}decisions s on s.off = o.off and s.dt = c.dt{same('s', 'c')}"
    r["held"] = f"select {of('y')}y.off, y.dt, y.decided, t.code, t.w, t.w * g.g / t.g v from {p}runs_by_day y join {p}targets t on t.off = y.off and t.decided = y.decided{same('t', 'y')} join {p}growth g on g.code = t.code and g.dt = y.dt{same('g', 'y')}"
    r["sums"] = f"select {k}off, dt, decided, 1 - sum(w) + sum(v) v, sum(v) inside from {p}held group by {k}off, dt, decided"
    r["value"] = f"select {of('y')}y.off, y.dt, y.rebal, y.decided, coalesce(s.v, 1) v, coalesce(s.inside / s.v, 0) invested from {p}runs_by_day y left join {p}sums s on s.off = y.off and s.dt = y.dt{same('s', 'y')}"
    r["gross"] = f"select {k}off, dt, rebal, v, invested, case when decided is null then 0 else v / (case when lag(dt) over ({run}) = decided then 1 else lag(v) over ({run}) end) - 1 end gross from {p}value"
    r["pre"] = f"select {of('h')}h.off, h.dt, h.code, h.v / s.v w from {p}held h join {p}sums s on s.off = h.off and s.dt = h.dt{same('s', 'h')}"
    r["trades"] = f"""select {of('t')}t.off, t.decided dt, t.code, t.w new, coalesce(q.w, 0) old from {p}targets t left join {p}pre q on q.off = t.off and q.dt = t.decided and q.code = t.code{same('q', 't')}
        union all select {of('q')}q.off, q.dt, q.code, 0 new, q.w old from {p}pre q join {p}decisions s on s.off = q.off and s.dt = q.dt{same('s', 'q')} left join {p}targets t on t.off = q.off and t.decided = q.dt and t.code = q.code{same('t', 'q')} where t.code is null"""
    r["turnover"] = f"select {k}off, dt, sum(abs(new - old)) turnover from {p}trades group by {k}off, dt"
    r["net"] = f"select {of('g')}g.off, p.profile, g.dt, g.gross, g.invested, coalesce(t.turnover, 0) turnover, g.gross - p.cost * coalesce(t.turnover, 0) net from {p}gross g cross join tiers p left join {p}turnover t on t.off = g.off and t.dt = g.dt{same('t', 'g')}"
    return {p + n: re.sub(r"\s+", " ", x) for n, x in r.items()}


def relations() -> dict[str, str]:
    by_code = "partition by code order by dt"
    r = {}
    r["daily"], panel = sales("l_extendedprice")
    r["panel"] = panel.replace("DAILY", "daily")
    r["daily2"], panel = sales("l_extendedprice * (1 - l_discount)")
    r["second"] = panel.replace("DAILY", "daily2")
    r["offsets"] = " union all ".join(f"select {o} off" for o in OFFSETS)
    r["tiers"] = f"select 'single' profile, {COST} cost union all select 'double' profile, {COST} * {STRESS} cost"
    r |= chain("", "")
    r["weekly"] = "select max(dt) dt from calendar group by date_trunc('week', dt) union select min(dt) dt from calendar group by date_trunc('month', dt)"
    r["equity"] = f"select *, product(1 + net) over (partition by off, profile order by dt {UPTO}) equity from net"
    r["w_years"] = f"select cast(y as int) y from (select unnest(generate_series({FIRST_YEAR}, {LAST_YEAR})) y) x"
    r["w_all"] = f"select w.y, q.code, q.dt, q.close from panel q join w_years w on year(q.dt) between w.y - {LOOKBACK} and w.y"
    r["w_panel"] = "select * from w_all where y in (select y from w_all group by y having count(distinct dt) >= 60)"
    r |= chain("w_", "y, ")
    r["w_bench"] = "select y, dt, coalesce(close / lag(close) over (partition by y order by dt) - 1, 0) b from w_dense where year(dt) = y and code = (select min(code) from instruments)"
    r["tested"] = "select * from (select n.*, coalesce(b.b, 0) b, count(*) over (partition by n.y, n.off, n.profile) n_days from w_net n left join w_bench b on b.y = n.y and b.dt = n.dt where year(n.dt) = n.y) x where n_days >= 20"
    r["steps"] = f"select *, product(1 + net) over (partition by off, profile, y order by dt {UPTO}) e from tested"
    r["drops"] = f"select *, e / max(e) over (partition by off, profile, y order by dt {UPTO}) - 1 dd from steps"
    r["scored"] = f"""select off, profile, y, count(*) n, product(1 + net) p, product(1 + gross) pg, product(1 + b) pb, avg(net) m, stddev_pop(net) s, min(dd) mdd,
        stddev_pop(case when net < {RF} / {DAYS} then net - {RF} / {DAYS} end) down, count(case when net < {RF} / {DAYS} then 1 end) n_down, avg(turnover) * {DAYS} turnover, avg(net - b) a, stddev_pop(net - b) te from drops group by off, profile, y"""
    grow = lambda p, n="n": f"case when {n} < 2 then 0 when {p} <= 0 then -1 else power({p}, {DAYS} / cast({n} as double)) - 1 end"
    r["metrics"] = f"""select off, profile, y, n, {grow('p')} annual, {grow('pg')} before_cost, {grow('pb')} bench,
        s * sqrt({DAYS}) vol, case when s > 0 then (m - {RF} / {DAYS}) * {DAYS} / (s * sqrt({DAYS})) else 0 end sharpe, case when s > 0 then m * {DAYS} / (s * sqrt({DAYS})) else 0 end sharpe_no_rf,
        case when n_down > 1 and down > 0 then (m - {RF} / {DAYS}) * {DAYS} / (down * sqrt({DAYS})) else 0 end sortino, mdd, turnover, case when te > 0 then a * {DAYS} / (te * sqrt({DAYS})) else 0 end ir from scored"""
    r["wide"] = "select *, annual - bench excess, case when abs(mdd) > 1e-9 then annual / abs(mdd) else 0 end calmar from metrics"
    r["months"] = "select off, profile, y, avg(case when p > 1 then 1.0e0 else 0 end) win_rate from (select off, profile, y, date_trunc('month', dt) mo, product(1 + net) p from tested group by off, profile, y, date_trunc('month', dt)) x group by off, profile, y"
    mean = lambda n: f"case when count(f) over ({by_code} rows between {n - 1} preceding and current row) = {n} then avg(f) over ({by_code} rows between {n - 1} preceding and current row) end"
    r["averages"] = f"select code, dt, f, {mean(20)} a, {mean(60)} b from filled where f is not null"
    state = "case when a is null or b is null then 'sideways' when a / b - 1 > 0.02 then 'bull' when a / b - 1 < -0.02 then 'bear' else 'sideways' end"
    r["regimes"] = f"select code, dt, {state} label from averages"
    r["stitched"] = f"select *, product(1 + net) over (partition by off, profile order by dt {UPTO}) e from tested"
    r["fallen"] = f"select *, e / max(e) over (partition by off, profile order by dt {UPTO}) - 1 dd from stitched"
    r["paths"] = f"select off, profile, count(*) n, min(dd) mdd, power(arg_max(e, dt), {DAYS} / cast(count(*) as double)) - 1 annual from fallen group by off, profile"
    r["worst"] = "select profile, off, n, mdd, annual from (select *, row_number() over (partition by profile order by mdd, off) k from paths) x where k = 1"
    r["index"] = f"select 'x' code, dt, net, turnover, product(1 + b) over (order by dt {UPTO}) * 100 f from tested where off = {OFFSETS[0]} and profile = 'single'"
    r["labelled"] = f"select *, coalesce(f / lag(f) over (order by dt) - 1, 0) b, {state} label from (select *, {mean(20)} a, {mean(60)} b from index) x"
    r["regime_report"] = f"""select s.label, coalesce(n, 0) n_days, coalesce({grow('p')}, 0) annual, coalesce({grow('p')} - {grow('q')}, 0) excess, coalesce(t * {DAYS}, 0) turnover, coalesce({grow('p')}, 0) after_cost
        from (select 'bull' label union all select 'bear' union all select 'sideways') s left join (select label, count(*) n, product(1 + net) p, product(1 + step) q, avg(turnover) t from (select *, coalesce(f / lag(f) over (order by dt) - 1, 0) step from labelled) z group by label) g on g.label = s.label"""
    r["stability"] = """select a.*, w.mdd continuous_drawdown, w.annual continuous_annual from (select profile, count(*) windows, avg(annual) mean_annual, median(annual) median_annual, stddev_pop(annual) std_annual, avg(excess) mean_excess, max(annual) best, min(annual) worst, avg(case when annual > 0 then 1.0e0 else 0 end) positive,
        avg(case when excess > 0 then 1.0e0 else 0 end) beats, avg(case when annual > 0 then 1.0e0 else 0 end) after_cost_positive, min(mdd) worst_drawdown, avg(sharpe) sharpe_mean, avg(calmar) calmar_mean, avg(turnover) turnover_mean from wide group by profile) a join worst w on w.profile = a.profile"""
    r["by_offset"] = "select off, profile, avg(annual) annual, avg(mdd) mdd, avg(sharpe) sharpe from wide group by off, profile"
    r["luck"] = "select profile, count(*) offsets, avg(annual) mean_annual, stddev_pop(annual) std_annual, min(annual) min_annual, max(annual) max_annual, avg(mdd) mean_mdd, min(mdd) worst_mdd, stddev_pop(mdd) std_mdd, avg(sharpe) mean_sharpe, stddev_pop(sharpe) std_sharpe from by_offset group by profile"
    r["stepwise"] = f"select code, dt, close, close / lag(close) over ({by_code}) - 1 r from dense"
    r["present"] = f"select code, dt, close, lag(close) over ({by_code}) prev, lag(dt) over ({by_code}) prev_dt, row_number() over ({by_code}) k, count(*) over (partition by code) n from panel"
    r["adjusted"] = "select code, dt, close raw, close * (case when code = 'PROMO' then 1 else power(1.03e0, date_diff('day', cast('1995-01-01' as date), dt) / 365.25e0) end) * (case when dt >= cast('1998-06-01' as date) and code = (select min(code) from instruments) then 5 else 1 end) tr from panel"
    r["factors"] = f"select code, dt, tr, raw, tr / raw factor, (tr / raw) / lag(tr / raw) over ({by_code}) step from adjusted"
    r["spans"] = "select code, min(dt) a, max(dt) z, count(*) n, date_diff('day', min(dt), max(dt)) / 365.25e0 yrs from panel group by code"
    r["ends"] = "select p.code, s.n, s.yrs, max(case when p.dt = s.a then p.close end) first_close, max(case when p.dt = s.z then p.close end) last_close from panel p join spans s on s.code = p.code group by p.code, s.n, s.yrs"
    r["corrs"] = "select a.code code_a, b.code code_b, corr(a.r, b.r) rho, covar_pop(a.r, b.r) c from returns a join returns b on a.dt = b.dt where a.r is not null and b.r is not null group by a.code, b.code"
    r["momentum"] = f"select code, dt, f / lag(f, 60) over ({by_code}) - 1 signal, lead(f, 20) over ({by_code}) / f - 1 ahead from filled where f is not null"
    r["signal_ranks"] = "select dt, code, signal, ahead, rank() over (partition by dt order by signal) rs, rank() over (partition by dt order by ahead) ra, count(*) over (partition by dt) n from momentum where signal is not null and ahead is not null"
    r["ics"] = "select dt, corr(cast(rs as double), cast(ra as double)) ic from signal_ranks where n >= 3 group by dt"
    # orders of offset 0 in lots of 10, at the last close up to the signal
    r["orders"] = "select t.decided signal, t.code, t.w, f.f px, f.close is null stale, floor(t.w * 100000 / f.f / 10) * 10 units from targets t join filled f on f.code = t.code and f.dt = t.decided where t.off = 0"
    r["holdings"] = "select * from (select signal, coalesce(lead(signal) over (order by signal), (select max(dt) from panel)) until, lead(signal) over (order by signal) is null open from (select distinct signal from orders) a) b where date_diff('day', signal, until) >= 1"
    r["moves"] = "select h.signal, p.code, count(*) n, arg_min(p.close, p.dt) a, arg_max(p.close, p.dt) z from holdings h join panel p on p.dt between h.signal and h.until group by h.signal, p.code"
    r["books"] = "select signal, 'backtest' book, code, w from orders union all select h.signal, 'blend', i.code, 1.0e0 / (select count(*) from instruments) from holdings h cross join instruments i union all select signal, 'benchmark', (select min(code) from instruments), 1.0e0 from holdings"
    r["book_returns"] = f"select h.signal, b.book, case when min(coalesce(m.n, 0)) >= 2 then sum(b.w * (m.z / m.a - 1)) - {COST} * sum(b.w) end ret from holdings h join books b on b.signal = h.signal left join moves m on m.signal = b.signal and m.code = b.code group by h.signal, b.book"
    r["paper"] = f"select o.signal, case when min(coalesce(m.n, 0)) >= 2 then (sum(o.units * m.z) + 100000 - sum(o.units * o.px) - {COST} * sum(o.units * m.a)) / 100000 - 1 end ret from orders o join holdings h on h.signal = o.signal left join moves m on m.signal = o.signal and m.code = o.code group by o.signal"
    r["revised"] = "select code, dt, close * case when code = (select min(code) from instruments) and month(dt) = 3 then 1.1e0 else 1 end close from panel where not (code = (select max(code) from instruments) and month(dt) = 7)"
    # literal panels in which every check fires; fixtures.py has the same in expressions
    r["f_days"] = "select cast(k as int) k, cast('2020-01-01' as date) + cast(k as int) dt from (select unnest(generate_series(0, 599)) k) x"
    r["f_base"] = "select c.code, d.k, d.dt, 100 * exp(0.0003e0 * d.k) * (1 + 0.004e0 * sin(0.7e0 * d.k + c.i)) close from f_days d cross join (select * from (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5), ('F', 6), ('G', 7), ('H', 8)) v(code, i)) c"
    r["f_raw"] = """select code, k, dt, case when code = 'G' and k between 400 and 411 then 50 when code = 'G' and k >= 250 then close / 2 when code = 'H' and k = 100 then 0
        when code = 'H' and k >= 160 then close * 1.106e0 * 1.104e0 when code = 'H' and k >= 150 then close * 1.106e0 else close end close from f_base where not (code = 'G' and k between 450 and 489)"""
    r["f_adjusted"] = """select code, dt, close * case when code = 'D' then power(0.98e0, k / 365.25e0) else power(1.03e0, k / 365.25e0) end * case when code = 'B' and k >= 300 then 5 when code = 'C' and k >= 200 then 2 else 1 end close from f_raw"""
    r["f_universe"] = "select * from (values ('A', 'ten', 0.03e0, cast(null as double), cast(null as double)), ('B', 'ten', 0.03e0, null, 3.0e0), ('C', 'none', 0.03e0, null, null), ('D', null, 0.0e0, null, null), ('E', 'none', 0.01e0, 0.2e0, 0.5e0), ('F', 'none', null, null, null), ('G', 'none', 0.03e0, null, null), ('H', 'ten', 0.03e0, null, null), ('I', 'none', 0.03e0, null, null)) v(code, limit_group, expect_yield, low, high)"
    r["f_declared"] = "select * from (values ('B', cast('2020-01-01' as date) + 300)) v(code, dt)"
    return r


def resolve(query: str, recursive: bool = False) -> str:
    """query behind a WITH of the relations that it needs, in order."""
    known = relations()
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for x in re.findall(r"\b(?:from|join)\s+(\w+)", known[name]):
            if x in known:
                visit(x)
        seen.append(name)

    for name in re.findall(r"\b(?:from|join)\s+(\w+)", query):
        if name in known:
            visit(name)
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(f"{n} as materialized ({known[n]})" for n in seen) + "\n" if seen else "") + query
