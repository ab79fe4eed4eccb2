"""Rule packs: keyword rules, weights and thresholds as data."""

from .domain import DOMAIN
from .pack import Pack, Rule, SignalRule
from .sample import SAMPLE

__all__ = ["DOMAIN", "SAMPLE", "Pack", "Rule", "SignalRule"]
