"""Corpus conventions: folder roots, frontmatter field names, edit routing."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class NoteConfig:
    customers_root: str = "Customers/"
    people_root: str = "People/"
    meetings_root: str = "Meetings/"
    opportunities_subdir: str = "opportunities/"
    milestones_subdir: str = "milestones/"
    insights_subdir: str = "insights/"

    customer_field: str = "customer"
    tags_field: str = "tags"
    date_field: str = "date"
    status_field: str = "status"
    project_field: str = "project"
    tpid_field: str = "tpid"
    accountid_field: str = "accountid"

    auto_sections: tuple[str, ...] = ("Agent Insights", "Connect Hooks")
    auto_operations: tuple[str, ...] = (
        "log_agent_action",
        "capture_connect_hook",
        "patch_note_designated",
    )
    # Heading names under which a team list may appear, best first (fixed values).
    team_headings: tuple[str, ...] = (
        "Team",
        "Microsoft Team",
        "Key Stakeholders",
        "Stakeholders",
    )
    stale_days: int = 30
    field_names: dict = field(default_factory=dict, hash=False)

    def physical_field(self, name: str) -> str:
        """Frontmatter key behind a logical field name."""
        known = {
            "customer": self.customer_field,
            "date": self.date_field,
            "status": self.status_field,
            "project": self.project_field,
            "tpid": self.tpid_field,
            "accountid": self.accountid_field,
        }
        known.update(self.field_names)
        return known.get(name, name)


DEFAULT = NoteConfig()
