"""Whether a panel can be believed: every check is a relation of findings (check, code, problem, payload), and what could not be checked is a row as well.

Panels are (dt, code, close). universe (code, limit_group, expect_yield, low, high) says what is expected of an instrument; all
but code may be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.operators.series import along, calendar, dense, missing, present, stepwise

#: Price steps that a split leaves.
SPLITS = (0.1, 0.25, 1 / 3, 0.5, 2.0, 3.0, 4.0, 10.0)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the checks."""

    observations: int = 250
    returns: int = 100
    step: float = 0.25
    tolerance: float = 0.005
    negative: float = -0.002
    low: float = -0.1
    high: float = 0.35
    near: float = 0.02
    absent: float = 0.02
    buffer: float = 0.005
    flat: int = 10
    gap: int = 30
    monotone: float = 0.995


def limits_of(qc: dict) -> Limits:
    """Thresholds of a config's block; what it doesn't say stays."""
    names = {"yield_tolerance": "tolerance", "negative_yield_floor": "negative", "max_missing_fraction": "absent", "min_observations": "observations"}
    said = {own: type(getattr(Limits, own))(qc[k]) for k, own in names.items() if qc.get(k) is not None}
    if qc.get("plausible_cagr"):
        said["low"], said["high"] = map(float, qc["plausible_cagr"])
    return Limits(**said)


def finding(check: str, code: Column, problem: Column, payload: Sequence[str]) -> list[Column]:
    return [F.lit(check).alias("check"), code.alias("code"), problem.alias("problem"), F.to_json(F.struct(*payload)).alias("payload")]


def years(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / 365.25


def cagr(panel: DataFrame) -> DataFrame:
    """(code, n, yrs, cagr): the growth a year between the first price and the last; null where there is no time between them or it isn't a number."""
    got = panel.where("close is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("dt").alias("a"), F.max("dt").alias("z"), F.min_by("close", "dt").alias("x"), F.max_by("close", "dt").alias("y"))
    yrs = years(F.col("a"), F.col("z"))
    return got.select("code", "n", yrs.alias("yrs"), F.when((yrs > 0) & (F.col("x") > 0) & (F.col("y") > 0), F.pow(F.col("y") / F.col("x"), 1 / yrs) - 1).alias("cagr"))


def factors(adjusted: DataFrame, raw: DataFrame, declared: DataFrame) -> DataFrame:
    """(code, dt, factor, step, kind): adjusted over raw on the days that both have, its step, and whether that is ordinary, declared or undeclared.

    declared (code, dt): re-denominations, which are taken out whatever their size.
    """
    both = adjusted.where("close is not null").select("code", "dt", F.col("close").alias("tr")).join(raw.where("close is not null").select("code", "dt", F.col("close").alias("pr")), ["code", "dt"])
    factor = F.when(F.col("pr") != 0, F.col("tr") / F.col("pr"))
    rows = both.withColumn("factor", factor).withColumn("step", F.try_divide("factor", F.lag("factor").over(along())))
    said = F.broadcast(declared.select("code", "dt").distinct().withColumn("__said", F.lit(True)))
    kind = F.when(F.col("step").isNull(), None).when(F.col("__said"), "declared").when(F.abs(F.col("step") - 1) > Limits.step, "undeclared").otherwise("ordinary")
    return rows.join(said, ["code", "dt"], "left").select("code", "dt", "factor", "step", kind.alias("kind"))


def implied_yield(adjusted: DataFrame, raw: DataFrame, declared: DataFrame, universe: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(code, n, yrs, implied, expected, declared_steps, undeclared_steps, verdict) of every instrument with enough common days.

    The first of these that holds is the verdict: undeclared, negative, no expectation, off expectation, ok.
    """
    steps = factors(adjusted, raw, declared)
    got = steps.groupBy("code").agg(
        F.count("*").alias("n"), years(F.min("dt"), F.max("dt")).alias("yrs"), F.product(F.when(F.col("kind") == "ordinary", F.col("step")).otherwise(1.0)).alias("p"),
        F.count(F.when(F.col("kind") == "declared", 1)).alias("declared_steps"), F.count(F.when(F.col("kind") == "undeclared", 1)).alias("undeclared_steps"),
    )
    got = got.where((F.col("n") >= limits.observations) & (F.col("yrs") > 0)).withColumn("implied", F.pow("p", 1 / F.col("yrs")) - 1)
    met = got.join(F.broadcast(universe.select("code", F.col("expect_yield").alias("expected"))), "code", "left")
    verdict = (
        F.when(F.col("undeclared_steps") > 0, "undeclared").when(F.col("implied") < limits.negative, "negative").when(F.col("expected").isNull(), "no expectation")
        .when(F.abs(F.col("implied") - F.col("expected")) > limits.tolerance, "off expectation").otherwise("ok")
    )
    return met.select("code", "n", "yrs", "implied", "expected", "declared_steps", "undeclared_steps", verdict.alias("verdict"))


def magnitude(panel: DataFrame, universe: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(code, cagr, low, high, bad): outside of the instrument's own band or, without one, of the general band."""
    met = cagr(panel).where(F.col("n") >= limits.observations).join(F.broadcast(universe.select("code", "low", "high")), "code", "left")
    low, high = F.coalesce("low", F.lit(limits.low)), F.coalesce("high", F.lit(limits.high))
    return met.select("code", "cagr", low.alias("low"), high.alias("high"), F.coalesce(~F.col("cagr").between(low, high), F.lit(True)).alias("bad"))


def split_jumps(panel: DataFrame, limits: Limits = Limits(), most: int = 20) -> DataFrame:
    """(code, dt, target, ratio): steps from one price to the next that look like a split, the first `most` of every instrument; one may hit several targets."""
    each = present(panel).where("prev is not null and prev <> 0").withColumn("ratio", F.col("close") / F.col("prev")).withColumn("target", F.explode(F.array(*map(F.lit, SPLITS))))
    hits = each.where(F.abs(F.col("ratio") - F.col("target")) / F.col("target") < limits.near)
    w = Window.partitionBy("code").orderBy("dt", "target")
    return hits.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).select("code", "dt", "target", "ratio")


def gaps(panel: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(code, span_days, n, bad): days of the calendar within the instrument's own span that it has no price on; one without any price is bad."""
    span = panel.groupBy("code").agg(F.count("close").alias("n"), F.min(F.when(F.col("close").isNotNull(), F.col("dt"))).alias("a"), F.max(F.when(F.col("close").isNotNull(), F.col("dt"))).alias("z"))
    days = calendar(panel).agg(F.sort_array(F.collect_set("dt")).alias("__days"))
    inside = F.size(F.filter("__days", lambda d: d.between(F.col("a"), F.col("z")))).cast("long")
    rows = span.crossJoin(F.broadcast(days)).select("code", F.when(F.col("n") > 0, inside).otherwise(0).alias("span_days"), "n")
    return rows.withColumn("bad", (F.col("n") == 0) | F.coalesce(F.try_divide(F.col("span_days") - F.col("n"), F.col("span_days")) > limits.absent, F.lit(False)))


def generic(panel: DataFrame) -> DataFrame:
    """(code, duplicates, non_positive)."""
    return panel.groupBy("code").agg((F.count("*") - F.count_distinct("dt")).alias("duplicates"), F.count(F.when(F.col("close") <= 0, 1)).alias("non_positive"))


def with_limits(universe: DataFrame, rules: dict[str, float | None], default: str = "none") -> DataFrame:
    """(code, move): the daily limit of every instrument by its group, null for none; an unknown group raises when the rows are read."""
    known = F.create_map(*(x for g, v in rules.items() for x in (F.lit(g), F.lit(v).cast("double"))))
    group = F.coalesce("limit_group", F.lit(default))
    safe = F.when(F.array_contains(F.map_keys(known), group), True).otherwise(F.raise_error(F.concat(F.col("code"), F.lit(": no such limit group: "), group)).cast("boolean"))
    return universe.select("code", F.when(safe, F.element_at(known, group)).alias("move"))


def price_limits(panel: DataFrame, allowed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(code, n, worst_up, worst_down, by_year, first_days): days that move more than the instrument's limit allows.

    Returns are positional on the common calendar, so a gap hides no move behind it. Instruments without a limit, or with too
    few returns, have no row.
    """
    rows = stepwise(dense(panel)).where("r is not null").join(F.broadcast(allowed.where("move is not null")), "code")
    enough = rows.withColumn("__n", F.count("*").over(Window.partitionBy("code"))).where(F.col("__n") >= limits.returns)
    hits = enough.where(F.abs("r") > F.col("move") + limits.buffer)
    yearly = hits.groupBy("code", F.year("dt").alias("y")).count().groupBy("code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "count")))).alias("by_year"))
    first = hits.withColumn("__k", F.row_number().over(Window.partitionBy("code").orderBy("dt"))).where("__k <= 20").groupBy("code").agg(F.sort_array(F.collect_list("dt")).alias("first_days"))
    return hits.groupBy("code").agg(F.count("*").alias("n"), F.max("r").alias("worst_up"), F.min("r").alias("worst_down")).join(yearly, "code").join(first, "code")


def flat_runs(panel: DataFrame) -> DataFrame:
    """(code, longest): the longest run of one unchanged price."""
    run = F.sum(F.when(F.col("close") == F.col("prev"), 0).otherwise(1)).over(along().rowsBetween(Window.unboundedPreceding, 0))
    return present(panel).withColumn("__run", run).groupBy("code", "__run").count().groupBy("code").agg(F.max("count").alias("longest"))


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """(code, longest): the most days from one price to the next."""
    return present(panel).where("prev_dt is not null").groupBy("code").agg(F.max(F.datediff("dt", "prev_dt")).alias("longest"))


def anomalies(panel: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Findings: prices of 0 or less, unchanged for `flat` days or more, and gaps of more than `gap` days."""
    code = F.col("code")
    low = generic(panel).where("non_positive > 0").select(*finding("anomaly", code, F.lit("non-positive"), ["non_positive"]))
    flat = flat_runs(panel).where(F.col("longest") >= limits.flat).select(*finding("anomaly", code, F.lit("flat"), ["longest"]))
    long = calendar_gaps(panel).where(F.col("longest") > limits.gap).select(*finding("anomaly", code, F.lit("gap"), ["longest"]))
    return low.unionByName(flat).unionByName(long)


def adjustment(adjusted: DataFrame, raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(code, ok, n, same_start): ordinary steps of the factor never fall, both series begin on one day, and neither is empty."""
    none = adjusted.sparkSession.createDataFrame([], "code string, dt date")
    steps = factors(adjusted, raw, none).where("kind = 'ordinary'").groupBy("code").agg(F.count("*").alias("n"), F.min("step").alias("least"))
    start = lambda df, name: df.where("close is not null").groupBy("code").agg(F.min("dt").alias(name))
    begin = start(adjusted, "a").join(start(raw, "b"), "code", "full").select("code", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_start"))
    met = begin.join(steps, "code", "left")
    return met.select("code", (F.col("same_start") & F.coalesce(F.col("least") >= limits.monotone, F.lit(False))).alias("ok"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "same_start")


def fake_volatility(panel: DataFrame, bonds: DataFrame | None = None, days: float = 252) -> DataFrame:
    """(code, zero_share, vol, corr, stale, too_quiet, bond_like): zero returns on over a fifth of the days, under 2 % a year, and over 0.5 with the mean of the bonds (code)."""
    r = present(panel).where("prev is not null").select("code", "dt", (F.try_divide("close", "prev") - 1).alias("r"))
    if bonds is None:
        bonds = panel.sparkSession.createDataFrame([], "code string")
    bond = r.join(F.broadcast(bonds.select("code").distinct()), "code", "left_semi").groupBy("dt").agg(F.avg("r").alias("b"))
    got = r.join(bond, "dt", "left").groupBy("code").agg(F.avg(F.when(F.col("r") == 0, 1.0).otherwise(0.0)).alias("zero_share"), (F.stddev_pop("r") * F.sqrt(F.lit(float(days)))).alias("vol"), F.corr("r", "b").alias("corr"))
    return got.select("code", "zero_share", "vol", "corr", (F.col("zero_share") > 0.2).alias("stale"), (F.col("vol") < 0.02).alias("too_quiet"), F.coalesce(F.col("corr") > 0.5, F.lit(False)).alias("bond_like"))


def coverage(panel: DataFrame) -> DataFrame:
    """(code, first_day, last_day, n)."""
    return panel.where("close is not null").groupBy("code").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.count("*").alias("n"))


def year_totals(panel: DataFrame, r: str = "r") -> DataFrame:
    """(code, y, total) from returns (code, dt, r): what each year made."""
    return panel.where(F.col(r).isNotNull()).groupBy("code", F.year("dt").alias("y")).agg((F.product(1 + F.col(r)) - 1).alias("total"))


def adjudicate(one: DataFrame, other: DataFrame, wide: float = 0.1, violent: float = 0.05, quiet: float = 0.005, expected: DataFrame | None = None) -> DataFrame:
    """(code, rho, worst_year, alone, verdict) of two chains of prices for the same instruments.

    A day on which one chain moves by more than `violent` and the other by less than `quiet` stands alone: an error, as a real
    move is in both. Years that differ by more than `wide` are systematic. The verdict is exclude, repair (days alone), flag (the
    code is in `expected`, whose chains may differ) or agree; a low correlation by itself is no evidence.
    """
    move = lambda df, n: present(df).where("prev is not null and prev <> 0").select("code", "dt", (F.col("close") / F.col("prev") - 1).alias(n))
    both = move(one, "a").join(move(other, "b"), ["code", "dt"])
    alone = ((F.abs("a") > violent) & (F.abs("b") < quiet)) | ((F.abs("b") > violent) & (F.abs("a") < quiet))
    daily = both.groupBy("code").agg(F.corr("a", "b").alias("rho"), F.count(F.when(alone, 1)).alias("alone"), F.count("*").alias("days"))
    yearly = both.groupBy("code", F.year("dt").alias("y")).agg(F.abs(F.product(1 + F.col("a")) - F.product(1 + F.col("b"))).alias("d")).groupBy("code").agg(F.max("d").alias("worst_year"))
    if expected is None:
        expected = one.sparkSession.createDataFrame([], "code string")
    met = daily.join(yearly, "code").join(F.broadcast(expected.select("code").distinct().withColumn("__e", F.lit(True))), "code", "left")
    verdict = F.when(F.col("__e"), "flag").when(F.col("worst_year") > wide, "exclude").when(F.col("alone") > 0, "repair").otherwise("agree")
    return met.select("code", "days", "rho", "worst_year", "alone", verdict.alias("verdict"))


def repair(panel: DataFrame, source: DataFrame, codes: DataFrame, coverage_least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(panel, log): whole series of `codes` (code) taken from source where that covers enough of them; never single points.

    log (code, old, new, replaced). Scan the panel again afterwards: a repair that was not is a guess.
    """
    n = lambda df, name: df.where("close is not null").groupBy("code").agg(F.count("*").alias(name))
    log = codes.select("code").distinct().join(n(panel, "old"), "code", "left").join(n(source, "new"), "code", "left").fillna(0, ["old", "new"])
    log = log.withColumn("replaced", (F.col("old") > 0) & (F.col("new") >= coverage_least * F.col("old")))
    out = F.broadcast(log.where("replaced").select("code"))
    days = calendar(panel)
    taken = source.join(out, "code", "left_semi").join(F.broadcast(days), "dt", "left_semi").select("dt", "code", "close")
    return panel.join(out, "code", "left_anti").select("dt", "code", "close").unionByName(taken), log


def limitations(panel: DataFrame, raw: DataFrame | None, universe: DataFrame) -> DataFrame:
    """(check, status, reason, consequence): what was not checked. Without raw prices nothing says that the panel is adjusted."""
    spark = panel.sparkSession
    if raw is None:
        row = ("implied_yield", "NOT PERFORMED", "there are no unadjusted prices", "whether the prices include distributions is unknown, and a price-only series falls short by them")
        return spark.createDataFrame([row], "check string, status string, reason string, consequence string")
    silent = panel.select("code").distinct().join(universe, "code").where("expect_yield is null")
    named = silent.agg(F.array_join(F.sort_array(F.collect_list("code")), ", ").alias("__c")).where("__c <> ''")
    return named.select(F.lit("implied_yield").alias("check"), F.lit("PARTIAL").alias("status"), F.concat(F.lit("no expected yield for: "), F.col("__c")).alias("reason"), F.lit("only the sign was checked for these").alias("consequence"))


def findings(panel: DataFrame, raw: DataFrame | None, universe: DataFrame, declared: DataFrame, limits: Limits = Limits(), rules: dict[str, float | None] | None = None) -> DataFrame:
    """All findings of all checks, one relation; no row is a panel that passed what limitations() doesn't name."""
    code, say = F.col("code"), F.lit
    parts = [
        magnitude(panel, universe, limits).where("bad").select(*finding("magnitude", code, say("outside the band"), ["cagr", "low", "high"])),
        split_jumps(panel, limits).select(*finding("split", code, say("looks like a split"), ["dt", "target", "ratio"])),
        gaps(panel, limits).where("bad").select(*finding("gaps", code, say("days are missing"), ["span_days", "n"])),
        generic(panel).where("duplicates > 0").select(*finding("generic", code, say("days come twice"), ["duplicates"])),
        missing(panel, universe).select(*finding("universe", code, say("no prices"), ["code"])),
        anomalies(panel, limits),
    ]
    if raw is not None:
        bad = implied_yield(panel, raw, declared, universe, limits).where("verdict in ('undeclared', 'negative', 'off expectation')")
        parts.append(bad.select(*finding("implied_yield", code, F.col("verdict"), ["implied", "expected", "declared_steps", "undeclared_steps"])))
        bare = missing(raw, panel.select("code").distinct())
        parts.append(bare.select(*finding("implied_yield", code, say("no unadjusted series"), ["code"])))
    if rules is not None:
        parts.append(price_limits(panel, with_limits(universe, rules), limits).select(*finding("price_limit", code, say("beyond the limit"), ["n", "worst_up", "worst_down", "by_year", "first_days"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
