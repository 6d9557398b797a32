"""Walk-forward evaluation: offsets x test years x cost tiers in one plan.

Every test year is a window of its own: it starts from cash at the first day of its warm-up, `lookback` years before, trades
through it, and is scored on the test year alone. Strategies, entry dates and pending orders know nothing of other windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.operators import schedule, scores, series, setpath, strategies
from tarnwise.operators.simulator import simulate
from tarnwise.sources.store import stored

#: Why an evaluation that was not made is not a passed one.
WEEKLY = ("timing_luck", "NOT PERFORMED", "a weekly schedule has no offset within the month, so all offsets would be one run", "how much the choice of the weekday matters is unknown, not zero")


@dataclass(frozen=True)
class Spec:
    """Settings of an evaluation. breaker: settings of simulator.SETTINGS, or none."""

    strategy: str = "s0_passive"
    settings: dict = field(default_factory=dict)
    benchmark: str = ""
    offsets: tuple[int, ...] = (0, 5, 10, 15)
    first_year: int = 2015
    last_year: int = 2024
    lookback: int = 2
    cost: float = 0.0006
    stress: float = 2.0
    days: float = 252
    rf: float = 0.0
    freq: str = "monthly"
    lag: int = 0
    min_hold: int = 0
    penalty: float = 0.015
    breaker: dict | None = None
    signal: int = 60
    tag: str = ""

    @classmethod
    def from_config(cls, values: dict, strategy: str = "s0_passive", **more: object) -> Spec:
        """The settings of a project's config; `more` goes before it. The breaker's block and top_n are read, too."""
        part = lambda name: values.get(name) or {}
        wf, cost, cal, bal, bench, stop = map(part, ("walk_forward", "cost", "calendar", "rebalance", "benchmark", "circuit_breaker"))
        known = {
            "offsets": tuple(bal["offsets"]) if bal.get("offsets") else None, "freq": bal.get("freq"), "lag": bal.get("trade_lag"), "min_hold": cost.get("min_hold_days"),
            "first_year": wf.get("first_test_year"), "last_year": wf.get("last_test_year"), "lookback": wf.get("lookback_years"), "cost": cost.get("one_way"), "stress": cost.get("stress_multiplier"),
            "penalty": cost.get("short_hold_penalty"), "days": cal.get("trading_days_per_year"), "rf": cal.get("risk_free_annual"), "benchmark": bench.get("primary"),
        }
        settings = {"top_n": bal["top_n"]} if bal.get("top_n") else {}
        if bench.get("passive_blend") and strategy in ("s0_passive", "never_rebalanced"):
            settings["blend"] = {str(x["code"]): float(x["weight"]) for x in bench["passive_blend"]}
        names = {"daily_loss_cool": "daily_cool", "defensive_code": "shelter"}
        breaker = {names.get(k, k): v for k, v in stop.items() if k != "enabled"} if stop.get("enabled") else None
        return replace(cls(strategy=strategy, settings=settings, breaker=breaker, **{k: v for k, v in known.items() if v is not None}), **more)

    @property
    def experiment(self) -> str:
        """The strategy and whatever else makes the result another one."""
        top = self.settings.get("top_n")
        marks = [f"n{top}" if top else "", "wk" if self.freq == "weekly" else "", f"lag{self.lag}" if self.lag else "", f"hold{self.min_hold}" if self.min_hold else "", "cb" if self.breaker else "", self.tag]
        return "_".join([self.strategy, *filter(None, marks)])

    @property
    def tiers(self) -> tuple[tuple[str, float], ...]:
        return ("single", self.cost), ("double", self.cost * self.stress)

    @property
    def folded(self) -> bool:
        """Whether days have to be folded: sets can't say lag, breaker and early sales."""
        return bool(self.lag or self.min_hold or self.breaker)

    @property
    def runs(self) -> tuple[int, ...]:
        return self.offsets[:1] if self.freq == "weekly" else self.offsets


class Evaluation:
    """What walk_forward() found. Relations are built when they are asked for; those with several readers are written once."""

    def __init__(self, panel: DataFrame, spec: Spec):
        self.panel, self.spec, self.spark = panel, spec, panel.sparkSession

    @cached_property
    def parts(self) -> DataFrame:
        s = self.spec
        return series.windows(self.panel, s.first_year, s.last_year, s.lookback)

    @cached_property
    def view(self) -> DataFrame:
        """growth() of every window of 60 days and more, and the history that strategies see."""
        return stored(strategies.history(series.growth(series.dense(self.parts, ["y"], 60), ["y"]), ["y"], self.spec.signal))

    @cached_property
    def plan(self) -> DataFrame:
        s, days = self.spec, series.calendar(self.parts, ["y"])
        return schedule.marked(days, None if s.freq == "weekly" else s.runs, ["y"], off=s.runs[0])

    @cached_property
    def decisions(self) -> DataFrame:
        return schedule.decisions(self.plan, ["y"])

    @cached_property
    def targets(self) -> DataFrame:
        return strategies.load(self.spec.strategy)(self.view, self.decisions, ["y"], **self.spec.settings)

    @cached_property
    def benchmark(self) -> DataFrame:
        """(y, dt, b): the benchmark's returns within each test year; its first day has none, nor has a day without a print, or the one after."""
        own = self.view.where((F.col("code") == self.spec.benchmark) & (F.year("dt") == F.col("y")))
        w = Window.partitionBy("y").orderBy("dt")
        return own.select("y", "dt", F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1, F.lit(0.0)).alias("b"))

    def _sets(self) -> DataFrame:
        s, by, plan = self.spec, ["y"], self.plan
        if s.strategy == "never_rebalanced":
            bought = self.targets.select("y", "off", F.col("decided").alias("dt"), F.lit(True).alias("__b")).distinct()
            plan = plan.join(bought, ["y", "off", "dt"], "left").withColumn("rebal", F.coalesce("__b", F.lit(False))).drop("__b")
        return setpath.net(setpath.value(setpath.held(plan, self.targets, self.view, by), by), s.tiers, by)

    def _folds(self) -> DataFrame:
        s = self.spec
        grid = [(f"{y} {off} {p}", y, off, p, float(c)) for y in range(s.first_year, s.last_year + 1) for off in s.runs for p, c in s.tiers]
        runs = F.broadcast(self.spark.createDataFrame(grid, "run_id string, y int, off int, profile string, cost double"))
        settings = {"lag": s.lag, "min_hold": s.min_hold, "penalty": s.penalty, **(s.breaker or {})}
        lits = [F.lit(v).alias(k) for k, v in settings.items() if v is not None]
        start = F.make_date("y", F.lit(1), F.lit(1)).alias("eval_start")
        of = lambda df: runs.select("run_id", "y", "off").join(df, ["y", "off"])
        plan = of(self.decisions).select("run_id", "dt")
        book = of(self.targets).select("run_id", F.col("decided").alias("dt"), "code", "w")
        market = self.view.select(F.col("y").cast("string").alias("market"), "dt", "code", "close", "r")
        found = simulate(market, plan, book, runs.select("run_id", F.col("y").cast("string").alias("market"), "cost", start, *lits))
        total = F.coalesce(F.expr("aggregate(map_values(holdings), 0d, (a, x) -> a + x)"), F.lit(None).cast("double"))
        return found.join(runs.drop("cost"), "run_id").select("y", "off", "profile", "dt", "gross", "turnover", "net", total.alias("invested"), "violations", "cooling")

    @cached_property
    def daily(self) -> DataFrame:
        """(y, off, profile, dt, gross, turnover, net, b, ...): the test years' days, windows of 20 days and more."""
        rows = self._folds() if self.spec.folded else self._sets()
        tested = rows.where(F.year("dt") == F.col("y")).join(self.benchmark, ["y", "dt"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
        n = F.count("*").over(Window.partitionBy("y", "off", "profile"))
        return stored(tested.withColumn("__n", n).where("__n >= 20").drop("__n"))

    @cached_property
    def windows(self) -> DataFrame:
        """One row a window and cost tier: who it is, and its scores."""
        keys, s = ["y", "off", "profile"], self.spec
        got = scores.metrics(self.daily, keys, s.days, s.rf).join(scores.monthly_wins(self.daily, keys), keys)
        ident = F.concat(F.lit("W-"), F.col("y").cast("string"), F.lit("-"), F.col("profile"), F.lit("-off"), F.col("off").cast("string"))
        more = self.daily.groupBy(*keys).agg(*([F.sum("violations").alias("short_hold_violations")] if s.folded else [F.lit(0).cast("long").alias("short_hold_violations")]))
        return got.join(more, keys).select(F.lit(s.experiment).alias("experiment_id"), ident.alias("window_id"), *got.columns, "short_hold_violations")

    @cached_property
    def paths(self) -> DataFrame:
        return scores.continuous(self.daily, ["off", "profile"], self.spec.days)

    def stability(self) -> DataFrame:
        """By cost tier, with the drawdown and return of the worst continuous path."""
        worst = scores.worst_path(self.paths, ["profile"]).select("profile", F.col("mdd").alias("continuous_drawdown"), F.col("annual").alias("continuous_annual"))
        return scores.stability(self.windows, ["profile"]).join(worst, "profile")

    def luck(self) -> DataFrame:
        return scores.timing_luck(self.windows, ["profile"])

    def regimes(self) -> DataFrame:
        """Of the first offset at single cost, over all test years one after another."""
        return scores.regime_report(self.daily.where((F.col("off") == self.spec.runs[0]) & (F.col("profile") == "single")), self.spec.days)

    def limitations(self) -> DataFrame:
        rows = [WEEKLY] if self.spec.freq == "weekly" and len(self.spec.offsets) > 1 else []
        return self.spark.createDataFrame(rows, "check string, status string, reason string, consequence string")

    def triggers(self) -> DataFrame:
        return triggers(self.stability(), self.luck())

    def block(self) -> DataFrame:
        return report_block(self)


def walk_forward(panel: DataFrame, spec: Spec) -> Evaluation:
    """Evaluates a strategy on a panel (dt, code, close). A benchmark without a price is a KeyError; no window with enough days a ValueError."""
    rows = panel.where("close is not null and not isnan(close)")
    years = rows.where(F.year("dt").between(spec.first_year, spec.last_year))
    seen = years.agg(F.max(F.when(F.col("code") == spec.benchmark, 1)).alias("b"), F.count("*").alias("n")).first()
    if seen["b"] is None and rows.where(F.col("code") == spec.benchmark).limit(1).count() == 0:
        raise KeyError(f"the panel has no price of the benchmark {spec.benchmark!r}")
    if not seen["n"]:
        raise ValueError("no test year has any price")
    return Evaluation(rows, spec)


def triggers(stable: DataFrame, luck: DataFrame) -> DataFrame:
    """(flag, value): what makes a result suspect, read off its numbers; none is no row.

    stable: scores.stability() by profile; luck: scores.timing_luck() by profile.
    """
    one = stable.where("profile = 'single'").select("sharpe_mean", "mean_excess", F.col("mean_annual").alias("__a"))
    two = stable.where("profile = 'double'").select(F.col("mean_annual").alias("__d"))
    own = luck.where("profile = 'single'").select("offsets", "std_annual")
    row = one.join(two, how="left").join(own, how="left")
    checks = [
        ("high sharpe", F.col("sharpe_mean") > 1.5, F.col("sharpe_mean")), ("high excess", F.col("mean_excess") > 0.02, F.col("mean_excess")),
        ("identical offsets", (F.col("offsets") > 1) & (F.col("std_annual") < 1e-9), F.col("std_annual")), ("offsets disagree", F.col("std_annual") > 0.01, F.col("std_annual")),
        ("identical tiers", F.abs(F.col("__a") - F.col("__d")) < 1e-9, F.col("__a") - F.col("__d")),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("flag"), F.coalesce(x, F.lit(False)).alias("on"), v.cast("double").alias("value")) for n, x, v in checks))
    return row.select(F.explode(each).alias("x")).where("x.on").select("x.flag", "x.value")


def ship_gate(own: DataFrame, control: DataFrame, luck: DataFrame, bar: dict[str, float]) -> DataFrame:
    """(gate, passed): the conjunction that a candidate must meet against the passive control, at single and at double cost.

    own, control: stability() by profile of the candidate and of the control under the same protocol. bar: least mean_annual,
    sharpe_mean, worst_drawdown and positive, each of which must hold at double cost. The edge must exceed the offsets' spread.
    """
    a = own.groupBy().pivot("profile", ["single", "double"]).agg(*(F.first(c).alias(c) for c in ("mean_annual", "sharpe_mean", "worst_drawdown", "positive")))
    c = control.groupBy().pivot("profile", ["single", "double"]).agg(F.first("mean_annual").alias("m"), F.first("positive").alias("p")).select(F.col("single_m").alias("c1"), F.col("double_m").alias("c2"))
    s = luck.where("profile = 'single'").select(F.col("std_annual").alias("spread"))
    row = a.join(c).join(s)
    edge = F.col("single_mean_annual") - F.col("c1")
    some = 1e-12  # equal runs may differ in the last digit
    gates = [("beats control", edge > some), ("beats control at double cost", F.col("double_mean_annual") - F.col("c2") > some), ("edge exceeds offsets", edge > F.col("spread"))]
    gates += [(f"{k} at double cost", F.col(f"double_{k}") >= v) for k, v in sorted(bar.items())]
    each = F.array(*(F.struct(F.lit(n).alias("gate"), F.coalesce(x, F.lit(False)).alias("passed")) for n, x in gates))
    rows = row.select(F.explode(each).alias("x")).select("x.*")
    return rows.unionByName(rows.agg(F.lit("ship").alias("gate"), F.bool_and("passed").alias("passed")))


def compare(panel: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """stability() of several specs, by experiment and profile: sweeps of lag, cost or layers are lists of specs."""
    out = None
    for s in specs:
        own = walk_forward(panel, s).stability().withColumn("experiment_id", F.lit(s.experiment))
        out = own if out is None else out.unionByName(own)
    return out


def lag_sweep(panel: DataFrame, spec: Spec, lags: Sequence[int] = (0, 1, 3)) -> DataFrame:
    return compare(panel, [replace(spec, lag=k) for k in lags])


def ablation(panel: DataFrame, spec: Spec) -> DataFrame:
    """(layer, profile, contribution): the mean annual return with all layers of the spec less that without the one layer."""
    layers = {"breaker": replace(spec, breaker=None), "lag": replace(spec, lag=0), "min_hold": replace(spec, min_hold=0), "selection": replace(spec, strategy="s0_passive", settings={})}
    layers = {k: s for k, s in layers.items() if s != spec}
    if not layers:
        raise ValueError("the spec has no layer to take away")
    full = walk_forward(panel, spec).stability().select("profile", F.col("mean_annual").alias("__full"))
    out = None
    for name, s in layers.items():
        own = walk_forward(panel, s).stability().select("profile", F.lit(name).alias("layer"), "mean_annual")
        out = own if out is None else out.unionByName(own)
    return out.join(full, "profile").select("layer", "profile", (F.col("__full") - F.col("mean_annual")).alias("contribution"))


def random_control(panel: DataFrame, spec: Spec, draws: int, split: int) -> DataFrame:
    """(is_pct, oos_pct, meaning): where the spec stands among `draws` random picks under the same protocol, up to year `split` and after."""
    def halves(s: Spec, name: str) -> DataFrame:
        w = walk_forward(panel, s).windows.where("profile = 'single'")
        return w.agg(F.lit(name).alias("who"), F.avg(F.when(F.col("y") <= split, F.col("annual"))).alias("a"), F.avg(F.when(F.col("y") > split, F.col("annual"))).alias("b"))

    rows = halves(spec, "own")
    for k in range(draws):
        rows = rows.unionByName(halves(replace(spec, strategy="random", settings={**spec.settings, "seed": k}, tag=f"draw{k}"), f"draw{k}"))
    own = rows.where("who = 'own'").select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    pct = rows.where("who <> 'own'").join(own).agg(F.avg((F.col("a") < F.col("__a")).cast("double")).alias("is_pct"), F.avg((F.col("b") < F.col("__b")).cast("double")).alias("oos_pct"))
    return pct.withColumn("meaning", direction(F.col("is_pct"), F.col("oos_pct")))


def direction(seen, unseen):
    """What the two percentiles say together."""
    return (
        F.when((seen >= 0.5) & (unseen < 0.5), "hindsight bias").when((seen < 0.5) & (unseen >= 0.5), "robust, not fitted")
        .when(seen >= 0.5, "edge or shared regime").otherwise("not where the edge lies")
    )


#: What the evaluation can't rule out, said every time.
CAVEATS = ("the universe was chosen with hindsight", "costs are a rate, without impact", "one history, whose regimes may not come again")


def report_block(e: Evaluation) -> DataFrame:
    """(part, key, profile, value, text): all that has to stand in a result for it to be read, one number a row."""
    as_rows = lambda df, part, key, cols: df.select(F.lit(part).alias("part"), key.alias("key"), "profile", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select("part", F.concat_ws(" ", "key", "x.c").alias("key"), "profile", F.col("x.v").alias("value"), F.lit(None).cast("string").alias("text"))
    stable, luck = e.stability(), e.luck()
    year = F.concat(F.col("y").cast("string"), F.lit(" off"), F.col("off").cast("string"))
    out = as_rows(e.windows, "1 windows", year, ["annual"])
    out = out.unionByName(as_rows(stable, "2 stability", F.lit(""), [c for c in stable.columns if c != "profile"]))
    out = out.unionByName(as_rows(e.regimes().withColumn("profile", F.lit("single")), "3 regimes", F.col("label"), ["annual", "excess", "turnover", "n_days"]))
    out = out.unionByName(as_rows(luck, "4 offsets", F.lit(""), [c for c in luck.columns if c != "profile"]))
    se = e.windows.groupBy("profile").agg((1 / F.sqrt(F.count_distinct("y"))).alias("sharpe_standard_error"))
    out = out.unionByName(as_rows(se, "5 context", F.lit(""), ["sharpe_standard_error"]))
    said = [("6 caveats", str(k), None, None, c) for k, c in enumerate(CAVEATS)]
    out = out.unionByName(e.spark.createDataFrame(said, "part string, key string, profile string, value double, text string"))
    skipped = e.limitations().select(F.lit("7 limitations").alias("part"), F.col("check").alias("key"), F.lit(None).cast("string").alias("profile"), F.lit(None).cast("double").alias("value"), F.concat_ws("; ", "status", "reason", "consequence").alias("text"))
    return out.unionByName(skipped)
