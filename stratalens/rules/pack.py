"""What a rule pack holds.  Order matters in every list: the first match wins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from ..functions.terms import Terms


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class SignalRule:
    kind: str
    title: str
    topics: tuple[str, ...]
    keywords: tuple[str, ...]
    strength: str  # a decimal
    description: str = ""  # the title where it is empty


@dataclass(frozen=True)
class Blueprint:
    title: str
    priority: str
    signals: tuple[str, ...]  # titles of signal rules


@dataclass(frozen=True)
class Unit:
    name: str
    topics: tuple[str, ...]
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Pack:
    """Everything the engine reads from a domain; weights are decimals as text."""

    topics: tuple[Rule, ...]
    default_topic: str
    signals: tuple[SignalRule, ...]
    blueprints: tuple[Blueprint, ...]
    entities: tuple[str, ...]
    units: tuple[Unit, ...]
    partners: tuple[tuple[str, str], ...]
    radar: tuple[str, ...]
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    impact_base: dict[str, str]
    impact_default: str
    impact_terms: tuple[str, ...]
    urgency_terms: tuple[str, ...]
    source_bonus: dict[str, str]
    name_trust: tuple[tuple[str, str], ...] = ()
    default_name_trust: str = "0.65"
    probes: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    @cached_property
    def terms(self) -> Terms:
        """Everything that is looked for in texts."""
        rules = [*self.topics, *self.signals, *self.units]
        names = [*self.entities, *self.radar, *(name for name, _ in self.partners), *self.positive, *self.negative, *self.impact_terms, *self.urgency_terms]
        return Terms([*(k for r in rules for k in r.keywords), *names])
