"""Narrow tables that a snapshot keeps beside its notes, so that queries need no bodies."""

from __future__ import annotations

from noteframe.operators import links as L
from noteframe.operators import parse as P

TABLES = {
    "titles": L.title_dict,
    "tags": P.note_tags,
    "tasks": P.note_tasks,
    "fields": P.note_fields,
}
