"""Guidance files for report writing, read on the driver: fail fast if one is missing."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Where the files lie below the root unless the caller says otherwise, and (fixed values) the heading of each in the combined
#: prompt, in its order.
FILES = {
    "ai_guidelines": ("guidance/ai_guidelines.md", "## AI Report Guidelines"),
    "seo_skill": ("guidance/methodology.md", "## SEO Audit Methodology (Skill)"),
    "report_specification": ("guidance/report_specification.md", "## Report Structure Specification"),
    "audit_prompt": ("guidance/audit_prompt.md", "## Audit Prompt"),
}
PLACEHOLDER = "{{website_url}}"
BETWEEN = "\n\n---\n\n"


@dataclass(frozen=True)
class Guidance:
    ai_guidelines: str
    seo_skill: str
    report_specification: str
    audit_prompt: str

    def system_prompt(self, url: str | None = None) -> str:
        """All files under their headings; the audit prompt with the URL put in."""
        parts = {name: getattr(self, name) for name in FILES}
        if url is not None:
            parts["audit_prompt"] = parts["audit_prompt"].replace(PLACEHOLDER, url)
        return BETWEEN.join(f"{FILES[name][1]}\n\n{text}" for name, text in parts.items())

    def system_prompt_column(self, url: Column) -> Column:
        """The same for a column of URLs: two literals around what differs."""
        prompt = F.replace(F.lit(self.audit_prompt), F.lit(PLACEHOLDER), url)
        head = BETWEEN.join(f"{FILES[name][1]}\n\n{getattr(self, name)}" for name in FILES if name != "audit_prompt")
        return F.concat(F.lit(f"{head}{BETWEEN}{FILES['audit_prompt'][1]}\n\n"), prompt)


def read_guidance(root: str | Path, places: dict[str, str] | None = None) -> Guidance:
    """All four files, whole; ``places`` overrides where some of them lie below the root."""
    found = {}
    for name, (place, _) in FILES.items():
        place = (places or {}).get(name, place)
        path = Path(root) / place
        if not path.is_file():
            raise FileNotFoundError(f"Required guidance file not found: {path} (expected at {place} below the root)")
        found[name] = path.read_text(encoding="utf-8")
        if not found[name].strip():
            log.warning("guidance file is empty: %s", path)
    return Guidance(**found)
