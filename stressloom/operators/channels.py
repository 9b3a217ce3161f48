"""Channel inputs from coin and protocol snapshots.

Snapshots reduce by partial aggregation. Global top-k uses an ordered limit; top-k per key ranks inside salts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.functions import scoring as fn


def hhi(x: str) -> Column:
    """Concentration aggregate on the 10000 scale; 0 for empty or zero totals."""
    v = F.col(x).cast("double")
    t = F.sum(v)
    return F.coalesce(F.when(t != 0, F.lit(10000.0) * F.sum(v * v) / (t * t)), F.lit(0.0))


def concentration(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(hhi(value).alias("hhi"))


def top_k(df: DataFrame, keys: list[str], value: str, k: int, tie: str, salts: int = 32) -> DataFrame:
    """The k largest rows per key in two steps. The first rank runs per (key, salt), so a hot key is spread over
    `salts` tasks; the second sees at most k*salts rows per key."""
    order = [F.col(value).desc(), F.col(tie)]
    salt = F.pmod(F.xxhash64(tie), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(second))
        .filter(F.col("_rn") <= k)
        .drop("_salt")
        .withColumnRenamed("_rn", "rank")
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side: stacked with nulls and folded, not joined."""
    cols = [(c, t, i) for i, p in enumerate(parts) for c, t in p.dtypes]
    stacked = [p.select(*[F.col(c) if i == k else F.lit(None).cast(t).alias(c) for c, t, i in cols]) for k, p in enumerate(parts)]
    u = stacked[0]
    for p in stacked[1:]:
        u = u.unionByName(p)
    return u.groupBy().agg(*[F.first(c, ignorenulls=True).alias(c) for c, _, _ in cols])


def coin_risk(coins: DataFrame, keys: list[str], backing: DataFrame | None = None) -> DataFrame:
    """Supply-weighted risk of the non-fiat coins. `backing` maps token -> (volatility_30d, supply_growth_30d)."""
    c = coins.withColumn("mechanism", fn.coin_mechanism("symbol", "peg_type" if "peg_type" in coins.columns else None))
    c = c.withColumn("token", fn.backing_token("symbol"))
    if backing is not None:
        c = c.join(backing, "token", "left")
    else:
        c = c.withColumn("volatility_30d", F.lit(None).cast("double")).withColumn("supply_growth_30d", F.lit(None).cast("double"))
    ratio = F.col("backing_ratio") if "backing_ratio" in coins.columns else F.lit(None).cast("double")
    algo = F.col("mechanism") != "fiat-collateral"
    supply = F.when(algo, F.col("circulating")).otherwise(0.0)
    total, part = F.sum("circulating"), F.sum(supply)

    def mean(risk):
        return F.coalesce(F.sum(risk * supply) / F.nullif(part, F.lit(0.0)), F.lit(0.0))

    w = S.COIN_COMPONENT_WEIGHTS
    g = c.groupBy(*keys).agg(
        mean(fn.backing_ratio_risk(ratio)).alias("backing_risk"),
        mean(fn.collateral_vol_risk("volatility_30d")).alias("volatility_risk"),
        mean(fn.dilution_risk("supply_growth_30d")).alias("dilution_risk"),
        total.alias("_total"),
        part.alias("_part"),
    )
    g = g.withColumn("concentration_risk", fn.share_risk("_part", "_total"))
    score = (
        F.col("backing_risk") * w["backing"]
        + F.col("volatility_risk") * w["volatility"]
        + F.col("dilution_risk") * w["dilution"]
        + F.col("concentration_risk") * w["concentration"]
    )
    return g.select(
        *keys, "backing_risk", "volatility_risk", "dilution_risk", "concentration_risk",
        fn.clamp(score).alias("algo_risk"),
        fn.safe_ratio("_part", "_total").alias("algo_weight"),
    )


def weighted_peg(default: float = 50.0) -> Column:
    w = F.when(F.col("circulating") > 0, F.col("circulating")).otherwise(0.0)
    dev = F.sum(F.col("peg_deviation") * w) / F.nullif(F.sum(w), F.lit(0.0))
    return F.coalesce(fn.scale_100(dev * 100.0, 0, 5), F.lit(default))


def stablecoin_inputs(coins: DataFrame, tvl: Column, tvl_max: Column, treasury: Column) -> DataFrame:
    live = F.when(F.col("circulating") > 0, F.col("circulating")).otherwise(0.0)
    base = coins.withColumn("_c", live).groupBy().agg(fn.hhi_risk(hhi("_c")).alias("concentration_hhi"), weighted_peg().alias("peg_volatility"))
    return one_row(base, coin_risk(coins, [])).select(
        fn.tvl_risk(tvl, tvl_max).alias("tvl_ratio"),
        fn.treasury_stress(treasury).alias("treasury_stress"),
        "concentration_hhi", "peg_volatility", "algo_risk", "algo_weight",
    )


def audit_ratio() -> Column:
    return F.coalesce(F.avg(F.when(fn.has_audit("audits"), 1.0).otherwise(0.0)), F.lit(0.0))


def category_share(name: str, empty: float) -> Column:
    part = F.sum(F.when(F.col("category") == name, F.col("tvl")).otherwise(0.0))
    return F.coalesce(part / F.nullif(F.sum("tvl"), F.lit(0.0)) * 100.0, F.lit(empty))


def mean_abs_change() -> Column:
    return F.coalesce(F.avg(F.abs(F.coalesce("change_1d", F.lit(0.0)))), F.lit(5.0))


def positive_tvl(p: DataFrame) -> DataFrame:
    return p.filter(F.coalesce("tvl", F.lit(0.0)) > 0)


def variation_risk(x: str) -> Column:
    """stddev_pop/mean scaled on [0,20] percent; 30 with fewer than two points."""
    cv = F.when(F.avg(x) > 0, F.stddev_pop(x) / F.avg(x)).otherwise(0.0)
    return F.when(F.count(x) > 1, fn.scale_100(cv * 100.0, 0, 20)).otherwise(30.0)


def liquidity_inputs(protocols: DataFrame, history: DataFrame, rows: int = 30) -> DataFrame:
    live = positive_tvl(protocols)
    top = live.select("tvl").orderBy(F.desc("tvl")).limit(10).groupBy().agg(fn.hhi_risk(hhi("tvl")).alias("top10_concentration"))
    vol = history.orderBy(F.desc("ds")).limit(rows).groupBy().agg(variation_risk("tvl").alias("tvl_volatility"))
    rest = live.groupBy().agg(
        ((1.0 - audit_ratio()) * 100.0).alias("smart_contract_risk"),
        fn.scale_100(mean_abs_change(), 0, 20).alias("flash_loan_proxy"),
        fn.scale_100(category_share("Lending", 10.0), 0, 30).alias("leverage_change"),
    )
    return one_row(top, vol, rest)


def contagion_inputs(protocols: DataFrame, treasury: Column, vix: Column, spread: Column, corr: Column) -> DataFrame:
    return protocols.groupBy().agg(
        fn.scale_100(category_share("RWA", 0.0), 0, 10).alias("rwa_growth_rate"),
        fn.bridge_risk(F.count_if(F.col("category") == "Bridge")).alias("bridge_exploit_frequency"),
    ).select(
        "rwa_growth_rate",
        fn.bank_exposure(treasury, vix).alias("bank_exposure"),
        fn.curve_linkage(spread).alias("tradfi_linkage"),
        fn.correlation_risk(corr).alias("crypto_equity_correlation"),
        "bridge_exploit_frequency",
    )


def issuer_risk(n: Column) -> Column:
    return F.when(n < 3, F.lit(70.0)).when(n < 10, F.lit(30.0)).otherwise(F.lit(50.0) + (n - 10) * 2.0)


def opacity_inputs(coins: DataFrame, protocols: DataFrame, sentiment: float = 50.0) -> DataFrame:
    top2 = coins.orderBy(F.desc("circulating")).limit(2).groupBy().agg(F.sum("circulating").alias("_top2"))
    base = coins.groupBy().agg(
        issuer_risk(F.count_if(F.col("circulating") > 1e9)).alias("multi_issuer_risk"),
        F.sum(F.when(F.col("circulating") > 0, F.col("circulating"))).alias("_total"),
    )
    audit = positive_tvl(protocols).groupBy().agg((audit_ratio() * 100.0).alias("transparency_score"))
    share = fn.safe_ratio("_top2", "_total") * 100.0
    return one_row(base, top2, audit).select(
        F.lit(35.0).alias("unregulated_exposure"),
        "multi_issuer_risk",
        fn.scale_100(share, 50, 100).alias("custody_concentration"),
        F.lit(sentiment).alias("regulatory_sentiment"),
        "transparency_score",
    )


# Stand-ins for inputs without history, per snapshot variant (None = taken from the data).
SNAPSHOT_FIELDS = [
    "flash_loan_proxy", "leverage_change", "rwa_growth_rate", "unregulated_exposure", "regulatory_sentiment",
    "top10_concentration", "smart_contract_risk", "transparency_score",
]
SNAPSHOT_CONSTANTS = {
    "service": [30.0, 40.0, 25.0, 35.0, 40.0, None, None, None],
    "standalone": [30.0, 40.0, 25.0, 35.0, 40.0, 45.0, 35.0, 70.0],
}


def with_snapshot_constants(df: DataFrame) -> DataFrame:
    """One row per variant; a field without a constant keeps the column of that name, if there is one."""
    from stressloom.operators.grids import explode_grid

    grid = [dict(variant=v, _c=vals) for v, vals in SNAPSHOT_CONSTANTS.items()]
    out = explode_grid(df, grid)
    have = set(df.columns)
    cols = [F.coalesce(F.col("_c")[i], F.col(f) if f in have else F.lit(None).cast("double")).alias(f) for i, f in enumerate(SNAPSHOT_FIELDS)]
    return out.select(*[c for c in df.columns if c not in SNAPSHOT_FIELDS], "variant", *cols)
