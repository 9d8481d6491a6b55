"""Score arithmetic and display features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IPFS_GATEWAY, NEUTRAL_MIN, POSITIVE_MIN, TIER_HIGH, TIER_LOW, TIER_MEDIUM


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int) -> Column:
    """ROUND(x, digits), half away from zero, once; exact for DECIMAL input."""
    return F.round(_c(x), digits).cast("double")


def clamp01(x) -> Column:
    """clamp to [0, 1], NULL stays NULL (greatest/least would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def decay_weight(as_of: Column, ts, half_life_days: float) -> Column:
    """0.5 ^ (whole UTC days between ts and the snapshot / half-life)."""
    return F.pow(F.lit(0.5), F.datediff(F.to_date(as_of), F.to_date(_c(ts))) / F.lit(float(half_life_days)))


def is_positive(q) -> Column:
    return _c(q) >= POSITIVE_MIN


def is_neutral(q) -> Column:
    q = _c(q)
    return (q >= NEUTRAL_MIN) & (q < POSITIVE_MIN)


def is_negative(q) -> Column:
    return _c(q) < NEUTRAL_MIN


def shrunk_score(eff_n, wq, k_prior: float, prior_q: float) -> Column:
    """100 * (eff/(eff+K) * wq + K/(eff+K) * prior), rounded to 4 places."""
    eff = F.coalesce(_c(eff_n), F.lit(0.0))
    k = F.lit(float(k_prior))
    prior = F.lit(float(prior_q))
    return round_half_up(F.lit(100.0) * ((eff / (eff + k)) * F.coalesce(_c(wq), prior) + (k / (eff + k)) * prior), 4)


def score_tier(score) -> Column:
    """High (>=70) / medium (40-70) / low (<40)."""
    s = _c(score)
    return (F.when(s >= TIER_HIGH[1], F.lit(TIER_HIGH[0]))
            .when(s >= TIER_MEDIUM[1], F.lit(TIER_MEDIUM[0]))
            .otherwise(F.lit(TIER_LOW)))


def js_round(x: Column) -> Column:
    """JavaScript Math.round: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def bucket_percent(n, total) -> Column:
    """Share of one bucket in percent, NULL when there is no feedback."""
    total = _c(total)
    return F.when(total > 0, js_round((_c(n) / total) * F.lit(100.0)).cast("bigint"))


def age_days(ts, as_of: Column) -> Column:
    """Whole days between ts and as_of (floor of elapsed microseconds)."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(_c(ts))) / F.lit(86_400_000_000.0))


def relative_age(ts, as_of: Column) -> Column:
    """B12: 'today' / '1d ago' / 'Nd ago' / 'Nmo ago' (30-day months) / 'Ny ago'.

    Future timestamps give negative day counts and fall in the 'Nd ago' arm."""
    d = age_days(ts, as_of)
    months = F.floor(d / 30)
    return (F.when(d == 0, F.lit("today"))
            .when(d == 1, F.lit("1d ago"))
            .when(d < 30, F.concat(d.cast("string"), F.lit("d ago")))
            .when(months < 12, F.concat(months.cast("string"), F.lit("mo ago")))
            .otherwise(F.concat(F.floor(months / 12).cast("string"), F.lit("y ago"))))


def shorten(s, head: int, tail: int) -> Column:
    """First ``head`` and last ``tail`` characters joined by an ellipsis."""
    s = _c(s)
    return F.when(s.isNotNull(), F.concat(F.substring(s, 1, head), F.lit("…"), F.right(s, F.lit(tail))))


def gateway_url(uri) -> Column:
    """Ipfs://X -> https gateway URL, anything else unchanged."""
    u = _c(uri)
    return F.when(u.startswith("ipfs://"), F.concat(F.lit(IPFS_GATEWAY), F.substr(u, F.lit(8)))).otherwise(u)


def tx_url(tx) -> Column:
    return F.concat(F.lit("https://etherscan.io/tx/"), _c(tx))


def address_url(addr) -> Column:
    return F.concat(F.lit("https://etherscan.io/address/"), _c(addr))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))


def viz_hue(score) -> Column:
    """Hue ramp 0->40: 350->10, 40->70: 10->45, 70->100: 45->210."""
    s = _c(score)
    return (F.when(s >= 70, interpolate(s, 70, 100, 45, 210))
            .when(s >= 40, interpolate(s, 40, 70, 10, 45))
            .otherwise(interpolate(s, 0, 40, 350, 10)))


def viz_size(feedback_count) -> Column:
    """min(2 + 4 log10(n + 1), 12) for rated nodes, 1.5 for unrated."""
    n = _c(feedback_count)
    return F.when(n > 0, F.least(F.lit(2.0) + F.lit(4.0) * F.log10(n + F.lit(1)), F.lit(12.0))).otherwise(F.lit(1.5))
