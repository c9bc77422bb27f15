"""Issues found by operations, reports, and the rule that says which of them abort."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Issue:
    level: str  # info, warning or error
    code: str
    message: str
    field: str | None = None
    source_field: str | None = None
    row_count: int | None = None
    details: dict[str, Any] | None = None


class OperationError(Exception):
    """An operation that can't go on, with the issues found so far."""

    def __init__(self, message: str, issue: Issue | None = None, issues: list[Issue] | None = None):
        super().__init__(message)
        self.issue, self.issues = issue, issues or []
        self.code = issue.code if issue else None


class SchemaError(OperationError): ...
class ImportFailed(OperationError): ...
class ValidationFailed(OperationError): ...
class FixFailed(OperationError): ...
class CleanFailed(OperationError): ...
class FilterFailed(OperationError): ...
class InferenceFailed(OperationError): ...
class BuildFailed(OperationError): ...
class QueryFailed(OperationError): ...
class ExportFailed(OperationError): ...
class StorageFailed(OperationError): ...


class Issues:
    """Collects issues; fatal ones raise at once, other errors where `strict` asks, when the evidence is complete."""

    def __init__(self, error: type[OperationError], strict: bool = False, max_issues: int | None = None):
        self.error, self.strict, self.max_issues = error, strict, max_issues
        self.all: list[Issue] = []

    def add(self, level: str, code: str, message: str, *, fatal: bool = False, **rest: Any) -> Issue:
        issue = Issue(level, code, message, **rest)
        self.all.append(issue)
        if fatal:
            raise self.error(f"{code}: {message}", issue, self.all)
        return issue

    def info(self, code: str, message: str, **rest: Any) -> Issue:
        return self.add("info", code, message, **rest)

    def warn(self, code: str, message: str, **rest: Any) -> Issue:
        return self.add("warning", code, message, **rest)

    def err(self, code: str, message: str, **rest: Any) -> Issue:
        return self.add("error", code, message, **rest)

    def fatal(self, code: str, message: str, **rest: Any) -> None:
        self.add("error", code, message, fatal=True, **rest)

    @property
    def ok(self) -> bool:
        return not any(i.level == "error" for i in self.all)

    def kept(self, code: str) -> list[Issue]:
        """The issues, or the first max_issues - 1 and one that tells of the rest."""
        if self.max_issues is None or len(self.all) <= self.max_issues:
            return list(self.all)
        note = Issue("warning", code, f"{len(self.all)} issues were found, {self.max_issues - 1} are kept", details={"detected": len(self.all), "limit": self.max_issues})
        return [*self.all[: self.max_issues - 1], note]

    def raise_if_strict(self) -> None:
        first = next((i for i in self.all if i.level == "error"), None)
        if self.strict and first:
            raise self.error(f"{first.code}: {first.message}", first, self.all)

    def summary(self) -> dict[str, Any]:
        return {"counts": dict(Counter(i.level for i in self.all)), "codes": dict(Counter(i.code for i in self.all))}


@dataclass
class Report:
    """What an operation did. `summary` has its counts, `parameters` its effective options."""

    ok: bool
    issues: list[Issue] = field(default_factory=list)
    summary: dict[str, Any] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)
    details: dict[str, Any] = field(default_factory=dict)

    def codes(self) -> list[str]:
        return [i.code for i in self.issues]
