"""Canonical columns, table types and the fixed parameter values of the index."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["series_id", "ds"]

# ---------------------------------------------------------------- fixed values
# Channel names and composite weights.
CHANNEL_WEIGHTS = {
    "stablecoin_risk": 0.30,
    "defi_liquidity_risk": 0.25,
    "contagion_risk": 0.25,
    "arbitrage_opacity": 0.20,
}
CHANNELS = list(CHANNEL_WEIGHTS)

# Input weights inside each channel.
STABLECOIN_INPUT_WEIGHTS = {
    "tvl_ratio": 0.4,
    "treasury_stress": 0.3,
    "concentration_hhi": 0.2,
    "peg_volatility": 0.1,
}
LIQUIDITY_INPUT_WEIGHTS = {
    "top10_concentration": 0.35,
    "tvl_volatility": 0.25,
    "smart_contract_risk": 0.20,
    "flash_loan_proxy": 0.10,
    "leverage_change": 0.10,
}
CONTAGION_INPUT_WEIGHTS = {
    "rwa_growth_rate": 0.30,
    "bank_exposure": 0.25,
    "tradfi_linkage": 0.20,
    "crypto_equity_correlation": 0.15,
    "bridge_exploit_frequency": 0.10,
}
OPACITY_INPUT_WEIGHTS = {
    "unregulated_exposure": 0.25,
    "multi_issuer_risk": 0.25,
    "custody_concentration": 0.20,
    "regulatory_sentiment": 0.15,
    "transparency_score": 0.15,
}

# Alert bands: (lower bound, label), highest first; the last label has no lower bound.
FIVE_BANDS = [(95.0, "critical"), (85.0, "high"), (70.0, "elevated"), (50.0, "moderate"), (None, "low")]
FOUR_BANDS = [(70.0, "high"), (50.0, "elevated"), (30.0, "moderate"), (None, "low")]
BAND_ORDER = ["low", "moderate", "elevated", "high", "critical"]

# Piecewise-linear risk curves: (upper bound, base, origin, slope); None = no upper bound.
HHI_SEGMENTS = [
    (1500.0, 0.0, 0.0, 30 / 1500),
    (2500.0, 30.0, 1500.0, 30 / 1000),
    (5000.0, 60.0, 2500.0, 30 / 2500),
    (None, 90.0, 5000.0, 10 / 5000),
]
COLLATERAL_VOL_SEGMENTS = [
    (30.0, 0.0, 0.0, 1.0),
    (60.0, 30.0, 30.0, 1.0),
    (100.0, 60.0, 60.0, 0.625),
    (None, 85.0, 100.0, 0.15),
]
DILUTION_SEGMENTS = [
    (5.0, 0.0, 0.0, 4.0),
    (20.0, 20.0, 5.0, 2.0),
    (50.0, 50.0, 20.0, 1.0),
    (None, 80.0, 50.0, 0.4),
]
SHARE_SEGMENTS = [
    (5.0, 0.0, 0.0, 4.0),
    (15.0, 20.0, 5.0, 3.0),
    (30.0, 50.0, 15.0, 2.0),
    (None, 80.0, 30.0, 0.67),
]

# Weights of the four algorithmic-coin components.
COIN_COMPONENT_WEIGHTS = {"backing": 0.35, "volatility": 0.30, "dilution": 0.20, "concentration": 0.15}

# Coin classification.
FIAT_SYMBOLS = ["USDT", "USDC", "BUSD", "TUSD", "USDP", "GUSD", "PYUSD"]
KNOWN_COINS = {  # symbol: (backing token, mechanism)
    "UST": ("LUNA", "algorithmic"),
    "USTC": ("LUNC", "algorithmic"),
    "FRAX": ("FXS", "hybrid"),
    "FEI": ("TRIBE", "algorithmic"),
    "BEAN": (None, "algorithmic"),
    "FLOAT": ("BANK", "algorithmic"),
    "RAI": ("ETH", "crypto-collateral"),
    "LUSD": ("ETH", "crypto-collateral"),
    "GHO": ("AAVE", "crypto-collateral"),
}

# Headline word lists.
REGULATORY_TERMS = [
    "regulation", "regulatory", "sec", "cftc", "congress", "senate",
    "legislation", "law", "legal", "compliance", "enforcement",
    "ban", "crackdown", "lawsuit", "investigation", "subpoena",
    "license", "framework", "policy", "government", "federal",
    "treasury", "irs", "tax", "aml", "kyc", "sanctions",
    "gensler", "warren", "binance", "coinbase", "kraken",
    "stablecoin", "cbdc", "etf", "approval", "reject",
    "europe", "mica", "uk", "fca", "china", "hong kong",
]
NEGATIVE_TERMS = [
    "ban", "crackdown", "lawsuit", "investigation", "enforcement",
    "reject", "denied", "fraud", "scam", "illegal", "criminal",
    "fine", "penalty", "warning", "risk", "concern", "threat",
]

# Macro defaults: (historic, live).
MACRO_DEFAULTS = {"treasury_10y": (3.5, 4.0), "vix": (20.0, 15.0), "curve_spread": (0.5, 0.5)}

# Publication lag per source, in hours.
PUBLICATION_LAG_HOURS = {
    "tvl": 6,
    "stablecoins": 12,
    "treasury": 48,
    "vix": 24,
    "yield_spread": 48,
    "equity_index": 24,
    "coin_price": 1,
    "news": 2,
    "protocols": 6,
    "bridges": 6,
}

# Event-study profiles.
EVENT_PROFILES = {
    "legacy_v1": dict(est=(-90, -31), evt=(-30, 10), lead_method="first_sigma_breach", lookback=60),
    "paper_v2": dict(est=(-90, -31), evt=(-30, 10), lead_method="first_sigma_breach", lookback=30),
    "counterfactual_60d": dict(est=(-60, -31), evt=(-30, 10), lead_method="final_sustained_threshold", lookback=60),
}
LEAD_SIGMA = 1.5
LEAD_LEVEL = 50.0
HAC_LAGS = [3, 10, 20, 30]
HAC_PRIMARY_LAG = 20
FIXED_B_CRITICAL = 3.52
CUSUM_CRITICAL = {0.01: 1.63, 0.05: 1.36, 0.10: 1.22}
# ------------------------------------------------------------ end fixed values

DAILY_SERIES = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("ds", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in CHANNELS]
    + [T.StructField("idx", T.DoubleType())]
)

# Cointegration of two series. Critical values, the p-value reported below each of them, and the line above the last.
EG_CRITICAL = {"1%": -3.90, "5%": -3.34, "10%": -3.04}
EG_P_BELOW = {"1%": 0.005, "5%": 0.025, "10%": 0.075}
EG_P_ABOVE = {"start": 0.15, "slope": 0.05, "least": 0.001, "most": 0.999}

SERVING_TABLE = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("ds", T.DateType()),
        T.StructField("idx", T.DoubleType()),
        T.StructField("avg_30", T.DoubleType()),
        T.StructField("trend", T.StringType()),
        T.StructField("alert_level", T.StringType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in CHANNELS]
    + [T.StructField("updated_at", T.TimestampType()), T.StructField("month", T.StringType())]
)

PEG_HISTORY = T.StructType(
    [T.StructField("ds", T.DateType()), T.StructField("symbol", T.StringType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ["price", "peg_deviation", "peg_volatility_7d", "peg_volatility_30d", "price_low", "peg_deviation_low"]
    ]
    + [T.StructField("low_source", T.StringType()), T.StructField("source", T.StringType())]
)

OBSERVATIONS_JSON = "observations array<struct<date: string, value: string>>"
TVL_JSON = "array<struct<date: bigint, tvl: double>>"
PRICES_JSON = "coins map<string, struct<prices: array<struct<timestamp: bigint, price: double>>>>"
PEGGED_JSON = (
    "peggedAssets array<struct<name: string, symbol: string, pegType: string, pegMechanism: string, "
    "circulating: struct<peggedUSD: double>, price: string>>"
)
PROTOCOLS_JSON = "array<struct<name: string, tvl: double, category: string, audits: string, change_1d: double>>"
