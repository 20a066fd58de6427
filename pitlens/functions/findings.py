"""Per-finding scalars: documentary direction, weights, ages; SQL expressions over the findings view."""

from __future__ import annotations

#: A reader's marks on a finding, told by its payload.
DISMISSED, REVIEWED = "k >= 92", "k BETWEEN 83 AND 91"

from pitlens.functions.text import quoted_years

# Reading direction of a guided metric.
HIGHER_IS_BETTER = ("revenue", "sales", "earnings", "eps", "earnings per share", "income", "profit", "margin", "cash flow", "fcf",
                    "ebitda", "bookings", "backlog", "orders", "subscribers", "users", "units", "shipments", "yield", "utilisation",
                    "utilization", "same-store", "comparable sales")
HIGHER_IS_WORSE = ("cost", "costs", "expense", "expenses", "opex", "sg&a", "churn", "attrition", "tax rate", "leverage", "debt",
                   "dilution", "interest expense", "impairment", "provision", "loss", "deficit", "warranty")
POLARITY_UNCLEAR = ("capital expenditure", "capex", "capital investment", "headcount", "employees", "inventory",
                    "research and development", "r&d", "buyback", "repurchase", "dividend", "spend", "investment")
# Weights of finding types, magnitudes and horizons.
TYPE_WEIGHT = {"new_risk_factor": 1.0, "qoq_anomaly": 1.0, "resolved_risk_factor": 0.95, "emerging_pattern": 1.0,
               "guidance_change": 0.9, "insider_activity": 0.85, "short_interest_spike": 0.75, "sentiment_shift": 0.7,
               "notable_quote": 0.6}
PRIORITY_MAGNITUDE = {"major": 1.35, "moderate": 1.0, "minor": 0.75}
MAGNITUDE_WEIGHT = {"minor": 0.5, "moderate": 1.0, "major": 2.0}
DIRECTION_BEARING = ("new_risk_factor", "resolved_risk_factor", "qoq_anomaly", "insider_activity", "short_interest_spike",
                     "sentiment_shift", "emerging_pattern", "guidance_change")
# Reading horizons as (window days, least findings, weights by finding horizon).
READING_HORIZONS = {
    "1w": (45, 2, {"near_term": 1.0, "multi_quarter": 0.25, "structural": 0.05, "unset": 0.3}),
    "1m": (120, 2, {"near_term": 1.0, "multi_quarter": 0.6, "structural": 0.2, "unset": 0.5}),
    "1y": (400, 3, {"near_term": 0.35, "multi_quarter": 1.0, "structural": 0.85, "unset": 0.7}),
    "5y": (1825, 3, {"near_term": 0.1, "multi_quarter": 0.5, "structural": 1.0, "unset": 0.5}),
}
ALWAYS_NEW = ("guidance_change", "qoq_anomaly")
METRICS = ("revenue", "operating margin", "capex", "tax rate", "headcount", "eps", "churn", "inventory")
MOVEMENTS = ("raised", "lowered", "withdrawn", "maintained")


def lookup(key: str, table: dict[str, float], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in table.items())
    return f"(CASE {key} {cases} ELSE {default} END)"


def metric_polarity(metric: str) -> str:
    """The unclear list beats the worse list beats the better list."""
    has = lambda words: " OR ".join(f"contains(lower(trim({metric})), '{w}')" for w in words)
    return (f"(CASE WHEN {metric} IS NULL OR {has(POLARITY_UNCLEAR)} THEN NULL WHEN {has(HIGHER_IS_WORSE)} THEN -1D"
            f" WHEN {has(HIGHER_IS_BETTER)} THEN 1D END)")


def guidance_sign(movement: str, metric: str) -> str:
    m = f"lower(trim({movement}))"
    p = metric_polarity(metric)
    return f"(CASE WHEN {m} = 'withdrawn' THEN -1D WHEN {m} = 'raised' THEN {p} WHEN {m} = 'lowered' THEN -({p}) END)"


def documentary_sign(kind: str, sentiment: str, rule: str, movement: str, metric: str, comparison: str = "''") -> str:
    """What the document itself says: -1, +1, or nothing."""
    return (f"(CASE WHEN {kind} IN ('new_risk_factor', 'short_interest_spike') THEN -1D"
            f" WHEN {kind} = 'resolved_risk_factor' THEN 1D"
            f" WHEN {kind} = 'qoq_anomaly' THEN CASE WHEN {comparison} = 'year_over_year_risk_factors' THEN -1D END"
            f" WHEN {kind} = 'insider_activity' THEN CASE WHEN contains(lower({rule}), 'sell') THEN -1D WHEN contains(lower({rule}), 'buy') THEN 1D END"
            f" WHEN {kind} IN ('sentiment_shift', 'emerging_pattern') THEN nullif(signum({sentiment}), 0D)"
            f" WHEN {kind} = 'guidance_change' THEN {guidance_sign(movement, metric)} END)")


def direction_label(sign: str) -> str:
    return f"(CASE WHEN {sign} IS NULL THEN 'unassessed' WHEN {sign} > 0 THEN 'positive' ELSE 'negative' END)"


def recency_factor(occurred: str, now: str) -> str:
    age = f"greatest((unix_micros({now}) - unix_micros({occurred})) / 86400000000D, 0D)"
    return f"exp(-{age} / 90D)"


def priority_score(kind: str, confidence: str, occurred: str, magnitude: str, now: str, reliability: str = "1D") -> str:
    conf = f"least(greatest({confidence}, 0D), 1D)"
    return (f"{conf} * {lookup(kind, TYPE_WEIGHT, '0.5D')} * {lookup(f'lower({magnitude})', PRIORITY_MAGNITUDE, '1D')}"
            f" * {reliability} * {recency_factor(occurred, now)}")


def reliability_multiplier(n: str, t: str, edge: str) -> str:
    trusted = f"{n} >= 30 AND abs({t}) >= 2 AND {edge} IS NOT NULL"
    return f"(CASE WHEN {trusted} THEN greatest(0.8D, least(1.25D, 1 + {edge} / 0.1 * 0.25)) ELSE 1D END)"


def newest_quoted_year(quote: str) -> str:
    return f"array_max({quoted_years(quote)})"


def is_stale(occurred: str, quote: str) -> str:
    return f"coalesce(year({occurred}) - {newest_quoted_year(quote)} >= 2, false)"


def effective_age_days(occurred: str, quote: str, now: str) -> str:
    """Older of the document and the end of the newest year it quotes."""
    days = lambda at: f"floor((unix_micros({now}) - unix_micros({at})) / 86400000000D)"
    ends = f"timestamp(make_date({newest_quoted_year(quote)}, 12, 31))"
    return f"greatest({days(occurred)}, {days(ends)})"


# Bounds of believable figures and the words of an earnings release.
EPS_BOUNDS, MIN_REVENUE = (-100, 100), 1_000_000
EARNINGS_WORDS = "earnings per|diluted eps|\\\\bEPS\\\\b|net revenue|total revenue"


def plausible_eps(value: str) -> str:
    return f"CASE WHEN {value} BETWEEN {EPS_BOUNDS[0]} AND {EPS_BOUNDS[1]} THEN {value} END"


def plausible_revenue(value: str) -> str:
    return f"CASE WHEN {value} >= {MIN_REVENUE} THEN {value} END"


def looks_like_earnings(text: str) -> str:
    return f"coalesce({text} RLIKE '(?i)({EARNINGS_WORDS})', false)"
