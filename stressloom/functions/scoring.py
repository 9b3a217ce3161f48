"""Column expressions for scores, bands and channel formulas. Everything stays in whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stressloom import schema as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x, lo=0.0, hi=100.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(lo))), F.lit(float(hi)))


def scale_100(x, lo: float, hi: float) -> Column:
    """Linear 0-100 scaling with clamping; 50 for an empty range."""
    if lo == hi:
        return F.when(col(x).isNotNull(), F.lit(50.0))
    return clamp((col(x) - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(100.0))


def scale_between(x, lo, hi) -> Column:
    """100*(x-lo)/(hi-lo) against column bounds, not clamped; 50 for an empty range."""
    x, lo, hi = col(x), col(lo), col(hi)
    return F.when(hi == lo, F.lit(50.0)).otherwise(F.lit(100.0) * (x - lo) / (hi - lo))


def piecewise(x, segments, cap: float | None = 100.0) -> Column:
    """Piecewise-linear curve given as (upper, base, origin, slope) rows."""
    x = col(x)
    expr = None
    for upper, base, origin, slope in reversed(segments):
        val = F.lit(base) + (x - F.lit(origin)) * F.lit(float(slope))
        if upper is None:
            expr = F.least(F.lit(cap), val) if cap is not None else val
        else:
            expr = F.when(x < F.lit(upper), val).otherwise(expr)
    return F.when(x.isNotNull(), expr)


def hhi_risk(hhi) -> Column:
    return piecewise(hhi, S.HHI_SEGMENTS, cap=None)


def tvl_risk(current, peak) -> Column:
    ratio = F.when(col(peak) > 0, col(current) / col(peak)).otherwise(F.lit(0.5))
    return scale_100(F.lit(1.0) - ratio, 0, 0.5)


def treasury_stress(y) -> Column:
    return scale_100(y, 2.0, 6.0)


def bank_exposure(y, vix) -> Column:
    return treasury_stress(y) * F.lit(0.6) + scale_100(vix, 12.0, 40.0) * F.lit(0.4)


def curve_linkage(spread) -> Column:
    s = col(spread)
    return F.when(s < 0, scale_100(F.abs(s), 0, 2) + F.lit(50.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(50.0) - scale_100(s, 0, 2))
    )


def correlation_risk(c) -> Column:
    return scale_100(F.abs(col(c)), 0, 1)


def bridge_risk(n) -> Column:
    return scale_100(col(n).cast("double"), 0, 150)


def weighted_sum(inputs: dict, weights: dict, missing: float = 50.0) -> Column:
    """clamp(sum w*input); a missing input counts as 50."""
    terms = [F.coalesce(inputs.get(k, F.lit(None).cast("double")), F.lit(missing)) * F.lit(w) for k, w in weights.items()]
    return clamp(reduce(lambda a, b: a + b, terms))


def safe_ratio(num, den) -> Column:
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(0.0))


def stablecoin_channel(tvl, tvl_max, treasury, reserves, hhi_fraction, peg_vol) -> Column:
    score = (
        F.lit(0.4) * safe_ratio(tvl, tvl_max)
        + F.lit(0.3) * safe_ratio(treasury, reserves)
        + F.lit(0.2) * col(hhi_fraction)
        + F.lit(0.1) * col(peg_vol)
    )
    return clamp(score * F.lit(100.0))


def fraction_channel(inputs: dict, weights: dict, invert: tuple = ()) -> Column:
    """Fraction-scaled channel: clamp(100*sum w*x), inverting the named inputs as 1-x."""
    terms = [F.lit(w) * (F.lit(1.0) - inputs[k] if k in invert else inputs[k]) for k, w in weights.items()]
    return clamp(reduce(lambda a, b: a + b, terms) * F.lit(100.0))


def composite(weights: dict | None = None, prefix: str = "") -> Column:
    w = weights or S.CHANNEL_WEIGHTS
    return reduce(lambda a, b: a + b, [F.lit(float(v)) * F.col(prefix + k) for k, v in w.items()])


def band(x, bands) -> Column:
    x = col(x)
    expr = F.lit(bands[-1][1])
    for lower, label in reversed(bands[:-1]):
        expr = F.when(x >= F.lit(lower), F.lit(label)).otherwise(expr)
    return F.when(x.isNotNull(), expr)


def alert_five(x) -> Column:
    return band(x, S.FIVE_BANDS)


def alert_four(x, top: str = "high") -> Column:
    return band(x, [(S.FOUR_BANDS[0][0], top)] + S.FOUR_BANDS[1:])


def trend_vs_avg(current, avg, width: float = 2.0) -> Column:
    d = col(current) - col(avg)
    return F.when(d > width, F.lit("rising")).when(d < -width, F.lit("falling")).otherwise(F.lit("stable"))


def trend_vs_previous(current, previous) -> Column:
    c, p = col(current), col(previous)
    return F.when(c > p, F.lit("increasing")).when(c < p, F.lit("decreasing")).otherwise(F.lit("stable"))


def trend_relative(newest, oldest, share: float = 0.05) -> Column:
    n, o = col(newest), col(oldest)
    return (
        F.when(o.isNull(), F.lit("stable"))
        .when(n > o * F.lit(1 + share), F.lit("increasing"))
        .when(n < o * F.lit(1 - share), F.lit("decreasing"))
        .otherwise(F.lit("stable"))
    )


def coin_mechanism(symbol, hint=None) -> Column:
    sym = F.upper(col(symbol))
    known = F.create_map(*[F.lit(v) for k, (_, m) in S.KNOWN_COINS.items() for v in (k, m)])
    h = F.lower(col(hint)) if hint is not None else F.lit(None).cast("string")
    by_hint = (
        F.when(h.contains("fiat") | h.contains("usd"), F.lit("fiat-collateral"))
        .when(h.contains("algo"), F.lit("algorithmic"))
        .when(h.contains("crypto"), F.lit("crypto-collateral"))
        .when(h.contains("hybrid"), F.lit("hybrid"))
    )
    return (
        F.when(sym.isin(S.FIAT_SYMBOLS), F.lit("fiat-collateral"))
        .when(sym.isin(list(S.KNOWN_COINS)), known[sym])
        .otherwise(F.coalesce(by_hint, F.lit("unknown")))
    )


def backing_token(symbol) -> Column:
    pairs = [F.lit(v) for k, (tok, _) in S.KNOWN_COINS.items() if tok for v in (k, tok)]
    return F.try_element_at(F.create_map(*pairs), F.upper(col(symbol)))


def backing_ratio_risk(r) -> Column:
    r = col(r)
    return (
        F.when(r.isNull(), F.lit(50.0))
        .when(r >= 1.5, F.greatest(F.lit(0.0), F.lit(20.0) - (r - 1.5) * 20.0))
        .when(r >= 1.0, F.lit(20.0) + (F.lit(1.5) - r) * 60.0)
        .when(r >= 0.8, F.lit(50.0) + (F.lit(1.0) - r) * 150.0)
        .otherwise(F.least(F.lit(100.0), F.lit(80.0) + (F.lit(0.8) - r) * 100.0))
    )


def collateral_vol_risk(v) -> Column:
    return F.coalesce(piecewise(col(v) * 100.0, S.COLLATERAL_VOL_SEGMENTS), F.lit(50.0))


def dilution_risk(g) -> Column:
    return F.coalesce(piecewise(col(g) * 100.0, S.DILUTION_SEGMENTS), F.lit(30.0))


def share_risk(part, total) -> Column:
    share = col(part) / F.nullif(col(total), F.lit(0.0)) * 100.0
    return F.coalesce(piecewise(share, S.SHARE_SEGMENTS), F.lit(0.0))


def adjust_for_coins(base, risk, weight) -> Column:
    b, r, w = col(base), col(risk), col(weight)
    return F.when(w < 0.01, b).otherwise(clamp((1 - w) * b + w * (F.lit(0.6) * b + F.lit(0.4) * r)))


def duration_risk(y, duration: float | Column = 0.25, lo: float = 2.0, hi: float = 6.0) -> Column:
    d = duration if isinstance(duration, Column) else F.lit(float(duration))
    level = clamp((col(y) - lo) / (hi - lo), 0.0, 1.0)
    return F.least(F.lit(100.0), level * (F.lit(1.0) + F.lit(0.2) * d) * 100.0)


def term_hits(text, terms) -> Column:
    """Number of distinct terms that occur as substrings of the lower-cased text."""
    low = F.lower(col(text))
    return reduce(lambda a, b: a + b, [F.when(low.contains(t), 1).otherwise(0) for t in terms])


def has_term(text, terms) -> Column:
    low = F.lower(col(text))
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(t) for t in terms]), F.lit(False))


def term_weight(text, terms) -> Column:
    return F.least(term_hits(text, terms).cast("double") / 5.0, F.lit(1.0))


def sentiment_risk(s, negative) -> Column:
    base = (F.lit(1.0) - col(s)) / 2.0 * 100.0
    return F.when(col(negative), F.least(F.lit(100.0), base * 1.3)).otherwise(base)


def has_audit(a) -> Column:
    """An integer counts when positive, any other non-empty text counts as yes, null as no."""
    a = col(a)
    n = a.try_cast("bigint")
    return F.when(a.isNull(), F.lit(False)).when(n.isNotNull(), n > 0).otherwise(F.length(a) > 0)


def stars(p) -> Column:
    p = col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


# Rational approximation of the normal quantile.
_PPF_A = (2.515517, 0.802853, 0.010328)
_PPF_B = (1.432788, 0.189269, 0.001308)


def normal_ppf_approx(p) -> Column:
    p = col(p)
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(F.lit(-2.0) * F.log(q))
    a, b = _PPF_A, _PPF_B
    z = t - (a[0] + a[1] * t + a[2] * t * t) / (1 + b[0] * t + b[1] * t * t + b[2] * t * t * t)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).when(p < 0.5, -z).otherwise(z)


def normal_cdf_approx(z) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + F.tanh(col(z) * F.lit(0.7978845608)))


def parse_when(text) -> Column:
    """ISO date or time, optional Z, or RFC-822; null when none fits."""
    t = F.regexp_replace(col(text), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s+GMT$", " +0000")
    patterns = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in patterns])
