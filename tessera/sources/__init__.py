"""Where updates come from and where changes go: JSON change feeds, files, and facts."""

from .jsonfeed import changes_to_json, updates_from_json

__all__ = ["changes_to_json", "updates_from_json"]
