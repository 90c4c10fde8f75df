"""Errors of plans: one finding, and a group of findings of one stage of checks."""

from __future__ import annotations

from collections.abc import Iterable

#: What the static checks can find.
CODES = (
    "closed-keys", "missing-section", "empty-section", "step-header", "bad-type", "bad-rule", "bad-nullable", "bad-value", "unknown-kind",
    "unknown-step", "unknown-service", "unknown-embed", "embed-cycle", "shape-mismatch", "unknown-port", "dangling-port", "unclosed-read",
    "two-writers", "read-write-overlap", "unwired-merge", "merge-type", "dead-boundary", "duplicate-name", "binding-missing", "binding-unknown",
    "binding-value", "identity-missing", "identity-unknown", "config-missing", "config-unknown", "transport-missing", "transport-unknown",
    "hook-transport-missing", "secret-form", "service-count", "stream-placement", "step-signature", "backend-capability", "drift",
    "transport-value", "artifact-unknown", "artifact-ambiguous", "manifest-missing", "manifest-form",
)


class PlanError(ValueError):
    """One finding: a code, what is wrong, and where."""

    def __init__(self, code: str, message: str, where: str = ""):
        if code not in CODES:
            raise AssertionError(f"no check has the code {code!r}")
        super().__init__(f"{code}: {message}" + (f" ({where})" if where else ""))
        self.code, self.where = code, where


class PlanErrorGroup(PlanError):
    """All findings of one stage; the code is that of the first."""

    def __init__(self, found: Iterable[PlanError]):
        self.found = list(found)
        first = self.found[0]
        ValueError.__init__(self, "; ".join(map(str, self.found)))
        self.code, self.where = first.code, first.where

    @property
    def codes(self) -> set[str]:
        return {e.code for e in self.found}


class Findings:
    """Collects a stage's findings and raises them together."""

    def __init__(self):
        self.found: list[PlanError] = []

    def add(self, code: str, message: str, where: str = "") -> None:
        self.found.append(PlanError(code, message, where))

    def done(self) -> None:
        if self.found:
            raise self.found[0] if len(self.found) == 1 else PlanErrorGroup(self.found)
