"""Thresholds of the models, all in one place."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    material: str = "0.001"  # share of the old value that a change must reach
    horizon_days: int = 180
    look_back_days: int = 30
    longest_lag: int = 1095
    longest_duration: int = 40  # quarters
    custom_heavy: float = 0.2
    rank_floor: int = 4  # periods or filings that a company must have to be ranked
    run_length: int = 3
    buckets: int = 10
    top_tags: int = 15
    top_filers: int = 25
    deadline_margin: int = 1
    season: int = 4
    fit_bar: float = 0.5
    long_chain: int = 3
    financial: tuple[int, int] = (6000, 6799)
    quartiles: int = 4
    least_peers: int = 20
    percentile_shift: float = 0.05
    salts: int = 16  # parts that the rows of a frequent tag are dealt into


DEFAULT = Settings()
#: Columns that say which fact a number reports, whoever files it when.
FACT_KEY = ["cik", "coregistrant", "segments", "tag", "period_end_date", "qtrs", "unit_of_measure"]
