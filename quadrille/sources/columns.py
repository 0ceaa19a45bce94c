"""Which column of a file holds which marker: exact names, the instrument's naming, aliases, similar names."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher

# Other names of common markers.
ALIASES = {
    "DNA1": ["dna1", "hoechst", "nucleus", "nuclei"],
    "DNA2": ["dna2", "hoechst2", "pi", "propidium"],
    "CD206": ["cd206", "mrc1", "mannose_receptor"],
    "CD44": ["cd44", "pgp1", "hermes"],
    "CD68": ["cd68", "macrosialin"],
    "CD31": ["cd31", "pecam1", "endothelial"],
    "αSMA": ["asma", "alpha_sma", "smooth_muscle_actin", "acta2"],
    "Collagen": ["collagen", "col1a1", "col3a1"],
    "Background": ["background", "bg", "blank", "control"],
}
# How sure a match of each kind is.
SURE = {"exact": 1.0, "tagged": 0.95, "underscore": 0.85, "alias": 0.85, "prefix": 0.75}
SIMILAR, SIMILAR_SHARE, BOOST, MOST = 0.8, 0.7, 0.1, 0.98


@dataclass(frozen=True)
class Match:
    marker: str
    column: str
    confidence: float
    how: str


def instrument_form(marker: str) -> re.Pattern:
    """A marker, its digits perhaps after a hyphen, a number perhaps, and an isotope in brackets: CD11b(Nd143Di), but CD38 is not CD3."""
    spelled = re.sub(r"(\d)", r"-?\1", re.escape(marker))
    return re.compile(rf"^{spelled}(?:[_-]\d+)?[_-]?\s*\([^)]+\)$", re.IGNORECASE)


def assigned(markers: list[str], columns: list[str]) -> dict[str, Match | None]:
    """One column a marker and one marker a column, the surest first: exact names, then the instrument's form. None if there is no column."""
    found: list[Match] = []
    for m in markers:
        form = instrument_form(m)
        for c in columns:
            if m.lower() == c.lower():
                found.append(Match(m, c, SURE["exact"], "exact"))
            elif form.match(c):
                found.append(Match(m, c, SURE["tagged"], "regex"))
    out: dict[str, Match] = {}
    taken: set[str] = set()
    for match in sorted(found, key=lambda x: -x.confidence):
        if match.marker not in out and match.column not in taken:
            out[match.marker] = match
            taken.add(match.column)
    return {m: out.get(m) for m in markers}


def candidates(marker: str, columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> list[Match]:
    """All columns that may hold a marker, each by its surest reading, the surest first."""
    name = marker.lower()
    other = {a.lower() for known, names in aliases.items() if name in (known.lower(), *map(str.lower, names)) for a in (known, *names)}
    best: dict[str, Match] = {}

    def offer(column: str, confidence: float, how: str) -> None:
        if column not in best or confidence > best[column].confidence:
            best[column] = Match(marker, column, confidence, how)

    escaped = re.escape(marker)
    for c in columns:
        if c.lower() == name:
            offer(c, SURE["exact"], "exact")
        for kind, form in (("tagged", rf"^{escaped}\s*\([^)]+\)$"), ("prefix", escaped), ("underscore", rf"^{escaped}(_[^_]*)?$")):
            if re.match(form, c, re.IGNORECASE):
                offer(c, min(MOST, SURE[kind] + BOOST) if len(marker) / len(c) > 0.5 else SURE[kind], "regex")
        if any(a in c.lower() for a in other):
            offer(c, SURE["alias"], "alias")
        if (r := SequenceMatcher(None, name, c.lower()).ratio()) >= SIMILAR:
            offer(c, r * SIMILAR_SHARE, "fuzzy")
    return sorted(best.values(), key=lambda m: -m.confidence)


def coverage(matches: dict[str, Match | None], columns: list[str]) -> dict:
    """How many markers have a column, of which kinds, which have none, and which columns nothing asked for."""
    found = [m for m in matches.values() if m]
    kinds = {k: sum(m.how == k for m in found) for k in sorted({m.how for m in found})}
    used = {m.column for m in found}
    return {"n_markers": len(matches), "n_matched": len(found), "share": len(found) / len(matches) if matches else 0.0, "by_kind": kinds, "unmatched": [m for m, x in matches.items() if x is None], "unused": [c for c in columns if c not in used]}
