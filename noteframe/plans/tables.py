"""The tables of one corpus: as the snapshot keeps them, else derived lazily from the notes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from noteframe.config import DEFAULT, NoteConfig
from noteframe.operators import derived
from noteframe.operators import links as L
from noteframe.operators import parse as P
from noteframe.sources import snapshots


@dataclass(frozen=True)
class NoteTables:
    notes: DataFrame
    links: DataFrame
    config: NoteConfig = DEFAULT
    stored: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_raw(cls, raw_notes: DataFrame, config: NoteConfig = DEFAULT) -> "NoteTables":
        notes = P.parse_notes(raw_notes, config)
        return cls(notes, L.resolve_links(notes), config)

    @classmethod
    def load(cls, spark: SparkSession, root: str, config: NoteConfig = DEFAULT) -> "NoteTables | None":
        found = snapshots.load_snapshot(spark, root)
        return None if found is None else cls(*found, config, snapshots.load_derived(spark, root))

    def save(self, spark: SparkSession, root: str) -> "NoteTables":
        """Write notes first; links and narrow tables follow from what was written."""
        snapshots.save_snapshot(spark, root, self.notes, L.resolve_links, derived.TABLES)
        return type(self).load(spark, root, self.config)

    def _table(self, name: str) -> DataFrame:
        return self.stored[name] if name in self.stored else derived.TABLES[name](self.notes)

    @cached_property
    def titles(self) -> DataFrame:
        return self._table("titles")

    @cached_property
    def sections(self) -> DataFrame:
        return P.note_sections(self.notes)

    @cached_property
    def tasks(self) -> DataFrame:
        return self._table("tasks")

    @cached_property
    def tags(self) -> DataFrame:
        return self._table("tags")

    @cached_property
    def fields(self) -> DataFrame:
        return self._table("fields")

    @cached_property
    def edges(self) -> DataFrame:
        return L.edges(self.links)
