"""Source contracts: which columns a snapshot has and what each may be used for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The roles a column may play.
ROLES = ("identity", "category", "date", "amount", "unique", "internal", "public", "restricted")
# Name fragments that make a column restricted wherever they occur.
DEFAULT_RESTRICTED_PATTERNS = (
    "address", "email", "phone", "telephone", "contact", "city", "zip", "employer", "occupation",
)
FIELD_SCHEMA = "source string, field string, role string, position int"
PATTERN_SCHEMA = "source string, pattern string"
SOURCE_SCHEMA = "source string, dataset_id string, expected_minimum_rows bigint"


class ContractError(ValueError):
    """A contract contradicts itself or a snapshot does not satisfy it."""


@dataclass(frozen=True)
class SourceContract:
    """Column roles, row floor and organization controls of one source.

    ``columns`` maps a field to its roles, in publication order. A field is public unless it is
    marked restricted or internal: anything not listed at all is internal, and never leaves.
    """

    slug: str
    dataset_id: str
    title: str
    columns: Mapping[str, tuple[str, ...]]
    expected_minimum_rows: int = 0
    role: str = "canonical"
    portal: str = ""
    restricted_patterns: tuple[str, ...] = DEFAULT_RESTRICTED_PATTERNS
    name_field: str | None = None
    type_field: str | None = None
    type_values: tuple[str, ...] = ()
    code_field: str | None = None
    code_prefixes: tuple[str, ...] = ()
    candidate_amount: str | None = None
    _by_role: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        for name, roles in self.columns.items():
            unknown = set(roles) - set(ROLES)
            if unknown:
                raise ContractError(f"{self.slug}.{name}: unknown role {sorted(unknown)}")
            if "restricted" in roles and len(roles) > 1:
                raise ContractError(f"{self.slug}.{name}: a restricted field has no other role")
        for role in ROLES:
            self._by_role[role] = tuple(n for n, roles in self.columns.items() if role in roles)
        self._by_role["public"] = tuple(
            n for n, roles in self.columns.items() if not {"restricted", "internal"} & set(roles)
        )
        if self.candidate_amount and self.candidate_amount not in self.fields("amount"):
            raise ContractError(f"{self.slug}: candidate amount must be an amount field")

    def fields(self, *roles: str) -> tuple[str, ...]:
        """Fields holding any of the roles, in publication order, each once."""
        wanted = {name for role in roles for name in self._by_role[role]}
        return tuple(name for name in self.columns if name in wanted)

    @property
    def public_fields(self) -> tuple[str, ...]:
        return self._by_role["public"]

    @property
    def tracked_fields(self) -> tuple[str, ...]:
        """Fields whose distinct values a profile counts."""
        return self.fields("identity", "category", "date", "amount", "unique")

    def is_restricted(self, name: str) -> bool:
        lowered = name.lower()
        return name in self._by_role["restricted"] or any(
            pattern.lower() in lowered for pattern in self.restricted_patterns
        )

    def require_fields(self, observed: Iterable[str], names: Iterable[str | None]) -> None:
        missing = sorted({name for name in names if name} - set(observed))
        if missing:
            raise ContractError(f"{self.slug}: required fields missing: {', '.join(missing)}")


class Inventory(dict):
    """Contracts by slug."""

    def __init__(self, contracts: Iterable[SourceContract]):
        contracts = list(contracts)
        for kind in ("slug", "dataset_id"):
            seen = [getattr(c, kind) for c in contracts]
            if len(seen) != len(set(seen)):
                raise ContractError(f"{kind} values must be unique")
        super().__init__((c.slug, c) for c in contracts)

    def require(self, slug: str) -> SourceContract:
        if slug not in self:
            raise ContractError(f"unknown source {slug!r}; choose one of: {', '.join(sorted(self))}")
        return self[slug]


def contract_fields(spark: SparkSession, contracts: Iterable[SourceContract]) -> DataFrame:
    """(source, field, role, position): one row per role a field holds. Size: the contracts'."""
    rows = []
    for contract in contracts:
        position = {name: i for i, name in enumerate(contract.columns)}
        for role in ROLES:
            rows += [(contract.slug, n, role, position[n]) for n in contract._by_role[role]]
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def restricted_patterns(spark: SparkSession, contracts: Iterable[SourceContract]) -> DataFrame:
    rows = [(c.slug, p.lower()) for c in contracts for p in c.restricted_patterns]
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


def contract_sources(spark: SparkSession, contracts: Iterable[SourceContract]) -> DataFrame:
    rows = [(c.slug, c.dataset_id, c.expected_minimum_rows) for c in contracts]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)
