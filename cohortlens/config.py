"""Run parameters shared by the report plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RunConfig:
    """What one analysis run is called and which cut-offs it uses.

    ``thresholds`` lists every abnormality cut-off of the run.  They are analysed together: the
    threshold becomes one more grouping column instead of one more run of the whole script.
    """

    analysis: str = "main"
    variant: str = "unadjusted"
    thresholds: tuple[float, ...] = (-1.0, -2.0)
    main_threshold: float = -2.0
    osteoporosis_threshold: float = -2.5
    not_done: str = "zero"  # "zero" reads a not-done lab as 0, "na" reads it as missing
    overwrite: bool = True

    def __post_init__(self) -> None:
        if self.not_done not in ("zero", "na"):
            raise ValueError(f"not_done must be 'zero' or 'na', got {self.not_done!r}")
        if not self.thresholds:
            raise ValueError("at least one threshold is needed")
