"""De-identification policy: plain data resolved once, when the plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace as _replace
from collections.abc import Iterable, Mapping

from . import fixed_values as fv


def norm_terms(terms: Iterable[str | None] | None) -> tuple[str, ...]:
    """Trim, drop blanks, and dedupe without regard to case (first spelling wins)."""
    by_key: dict[str, str] = {}
    for term in terms or ():
        clean = (term or "").strip()
        if clean:
            by_key.setdefault(clean.lower(), clean)
    return tuple(by_key.values())


@dataclass(frozen=True)
class Policy:
    """What to find and how to rewrite it.

    ``entities`` empty means the whole catalogue.  ``operators`` overrides
    ``operator`` per entity type.  ``salt`` is required by ``hash`` and ``seed``
    by ``synthesize``; neither has a default.
    """

    entities: tuple[str, ...] = ()
    threshold: float = fv.DEFAULT_THRESHOLD
    operator: str = "replace"
    operators: Mapping[str, str] = field(default_factory=dict)
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    salt: str | None = None
    seed: str | None = None
    explain: bool = True

    def __post_init__(self):
        object.__setattr__(self, "entities", tuple(self.entities or ()))
        object.__setattr__(self, "allow", norm_terms(self.allow))
        object.__setattr__(self, "deny", norm_terms(self.deny))
        used = {self.operator, *self.operators.values()}
        unknown = sorted(used - set(fv.OPERATORS))
        if unknown:
            raise ValueError(f"unknown operator(s): {', '.join(unknown)}")
        strange = sorted(set(self.entities) - set(fv.ENTITIES))
        if strange:
            raise ValueError(f"unknown entity type(s): {', '.join(strange)}")
        if "hash" in used and self.salt is None:
            raise ValueError("the hash operator needs a salt")
        if "synthesize" in used and self.seed is None:
            raise ValueError("the synthesize operator needs a seed")

    def operator_for(self, entity: str) -> str:
        return self.operators.get(entity, self.operator)

    def but(self, **changes) -> "Policy":
        return _replace(self, **changes)
