"""noteframe: Spark operators over large collections of linked markdown notes."""

from noteframe.config import NoteConfig
from noteframe.plans.tables import NoteTables

__all__ = ["NoteConfig", "NoteTables"]
