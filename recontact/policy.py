"""The fixed rules of a study, kept in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY = 86400
HOUR = 3600


@dataclass(frozen=True)
class Policy:
    """Defaults are those of a 5-minute device scan log."""

    snapshot_hour: int = 8
    bin_seconds: int = 300
    expected_bins: int = 288
    min_scan_coverage: float = 0.5
    scan_coverage_available: bool = True
    windows: tuple[int, ...] = (1, 3, 7)
    bank_windows: tuple[int, ...] = (1, 3, 7, 14)
    # None: no documented weekday for relative day zero, so weekday stays null.
    weekday_origin: int | None = None
    min_class_rows: int = 20
    min_train_rows: int = 200
    min_set_times: int = 2
    fractions: tuple[float, float, float] = (0.6, 0.2, 0.2)
    validation_times: int = 3
    min_train_times: int = 4
    ranking_k: tuple[int, ...] = (5, 10)
    retrieval_k: tuple[int, ...] = (5, 10, 20)
    small_group: int = 5
    reference_min_rows: int = 200
    reference_min_class: int = 20
    bootstrap_min_days: int = 8
    bootstrap_draws: int = 1000
    half_life_hours: tuple[float, ...] = (0.5, 2.0, 8.0, 24.0)
    short_half_life_minutes: tuple[int, ...] = (5, 10, 15, 30, 60, 120, 480, 1440)
    seed: int = 42
    contrasts: tuple[tuple[str, int, str, int], ...] = field(
        default=(("time_rule", 7, "time_rule", 1),
                 ("historical_frequency", 7, "historical_frequency", 1),
                 ("time_rule", 7, "historical_frequency", 7)))

    def __post_init__(self):
        if not 0 <= self.snapshot_hour < 24:
            raise ValueError("snapshot_hour must be 0..23")
        if not 0 < self.min_scan_coverage <= 1:
            raise ValueError("min_scan_coverage must be in (0, 1]")
        if (self.snapshot_hour * HOUR) % self.bin_seconds:
            # Distinct bins add up over rolling days only when no bin straddles a snapshot.
            raise ValueError("the snapshot hour must fall on a scan-bin edge")
        if self.weekday_origin is not None and not 0 <= self.weekday_origin < 7:
            raise ValueError("weekday_origin must be 0..6")
        if max((*self.windows, *self.bank_windows)) > 14:
            raise ValueError("history windows are limited to 14 days")

    @property
    def offset(self) -> int:
        """Seconds between midnight and the daily snapshot."""
        return self.snapshot_hour * HOUR
