"""All registered queries; importing the modules fills the registry."""

from lettermill.plans import correspondence, mailbox, mime, records, streams, triage  # noqa: F401
from lettermill.plans.registry import ORACLES, QUERIES

FLAGSHIP = "cascade_decisions"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
