"""What the engine reports about its work."""

from __future__ import annotations

from collections import Counter


class Metrics:
    """Receives every measure; this one ignores them all."""

    def write(self, events: int, refused: int) -> None: ...

    def degraded_write(self, ok: bool) -> None: ...

    def journal(self, operation: str, seconds: float) -> None:
        """A state table was read or replaced."""

    def flush(self, rows: int, seconds: float, ok: bool) -> None: ...

    def pending(self, rows: int) -> None: ...

    def depth(self, bands: dict[int, int]) -> None:
        """Pending keys of each band, before a flush; counted only if this is overridden."""

    def contract_error(self, rows: int) -> None: ...

    def dead_letter(self, rows: int, reason: str) -> None: ...

    def dlq(self, strategy: str, processed: int, succeeded: int, failed: int) -> None: ...


class CountingMetrics(Metrics):
    """Adds everything up."""

    def __init__(self) -> None:
        self.total: Counter[str] = Counter()

    def write(self, events: int, refused: int) -> None:
        self.total.update(events=events, refused=refused)

    def degraded_write(self, ok: bool) -> None:
        self.total.update(degraded_ok=ok, degraded_failed=not ok)

    def flush(self, rows: int, seconds: float, ok: bool) -> None:
        self.total.update(flushed=rows if ok else 0, failed_flushes=not ok)

    def journal(self, operation: str, seconds: float) -> None:
        self.total.update({f"journal_{operation}": 1})

    def pending(self, rows: int) -> None:
        self.total["pending"] = rows

    def depth(self, bands: dict[int, int]) -> None:
        self.total["deepest_band"] = max(bands.values(), default=0)

    def contract_error(self, rows: int) -> None:
        self.total.update(contract_errors=rows)

    def dead_letter(self, rows: int, reason: str) -> None:
        self.total.update({f"dead_{reason}": rows})

    def dlq(self, strategy: str, processed: int, succeeded: int, failed: int) -> None:
        self.total.update(dlq_processed=processed, dlq_succeeded=succeeded, dlq_failed=failed)
