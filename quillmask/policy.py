"""What a run redacts, and how: every tunable in one immutable object, read while the
plan is built, so that a detector that isn't wanted is never part of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

# The labels, and which wins where spans of equal length overlap.
TEXT_PRIORITY = {
    "CREDIT_CARD": 100,
    "SSN": 100,
    "IP_ADDRESS": 95,
    "EMAIL": 90,
    "NATIONAL_ID": 85,
    "BANK_ACCOUNT": 85,
    "PHONE": 80,
    "URL": 75,
    "DOB": 70,
    "ADDRESS": 60,
    "PERSON": 50,
    "ORG": 40,
    "LOCATION": 30,
}
IMAGE_LABELS = ("IMAGE_ID_DOCUMENT", "IMAGE_SIGNATURE", "IMAGE_LOGO", "IMAGE_CODE", "IMAGE_UNCLASSIFIED")
IDENTITY_LABELS = ("PERSON", "NATIONAL_ID", "DOB", "ADDRESS", "SSN", "CREDIT_CARD", "BANK_ACCOUNT")
TEXT_LABELS = tuple(TEXT_PRIORITY)
ALL_LABELS = TEXT_LABELS + IMAGE_LABELS


@dataclass(frozen=True)
class Policy:
    """The knobs of a run; defaults redact everything but public institutions."""

    labels: tuple[str, ...] = ALL_LABELS
    #: "fake" (consistent invented values) or "tag" (numbered labels)
    mode: str = "fake"
    locale: str = "en_US"
    seed: int = 20260813
    redact_institutions: bool = False
    redact_all_dates: bool = False
    #: a function Iterator[pandas.Series of texts] -> Iterator[Series of lists of spans], or None
    tagger: object = None
    min_tagger_votes: int = 1
    extra_terms: dict[str, str] = field(default_factory=dict)
    scrub_metadata: bool = True
    disable_images: bool = False
    keep_images: bool = False
    redact_all_images: bool = False
    keep_unclassified_images: bool = False
    redact_locations: bool = True
    #: also search table cells with their row and column labels in front
    use_cell_labels: bool = False

    def __post_init__(self):
        unknown = set(self.labels) - set(ALL_LABELS) - set(_REGISTERED)
        if unknown or self.mode not in ("fake", "tag"):
            raise ValueError(f"no such label or mode: {sorted(unknown) or self.mode}")

    def wants(self, label: str) -> bool:
        return label in self.labels and (label != "LOCATION" or self.redact_locations)


_REGISTERED: dict[str, int] = {}


def register_label(label: str, priority: int) -> None:
    """Add a label of one's own, with its place in overlaps of equal length."""
    _REGISTERED[label] = priority


def priorities() -> dict[str, int]:
    return TEXT_PRIORITY | _REGISTERED
