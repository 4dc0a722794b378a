"""Run settings. Plain frozen values; the lists act as small rule tables."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults a run must start from to give the expected results.
SKIP_FOLDERS = ("node_modules", ".git", "__pycache__", ".obsidian", ".vscode", "venv", ".env")
SKIP_EXTENSIONS = (".md", ".log", ".tmp", ".bak")
PROCESS_EXTENSIONS = (".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".pdf", ".txt", ".csv")
# Samples to be replaced by a run's own: what a text says -> where it goes, first hit first.
CONTENT_PHRASES = (
    ("Governance/Questionnaires", ("questionnaire", "due diligence form", "risk review")),
    ("Vendors", ("bill to us", "quote for us", "renewal notice", "licence fee")),
    ("Customers", ("account ended", "not approved", "kick-off", "statement of work", "onboarding")),
    ("Internal/Finance", ("budget", "costs by month")),
    ("HR/Expenses", ("travel claim", "receipts attached")),
    ("Templates/Sales", ("pitch template",)),
)
# Areas of a tree that a review is grouped by, (part of the lower-cased path, label), first hit first; files of a split area
# are told apart by the folder below it. The mail folder and the name of the rest are samples, to be replaced by a run's own.
REVIEW_AREAS = (
    ("mailattachments", "Downloads/MailAttachments"),
    ("/downloads/", "Downloads"),
    ("/desktop/", "Desktop"),
    ("/archive/", "Archive"),
    ("work documents", "Work Documents"),
)
SPLIT_AREAS = ("Work Documents",)
OTHER_AREA = "Drive Root"


@dataclass(frozen=True)
class Settings:
    source_paths: tuple[str, ...] = ()
    archive_root: str = "/archive"
    skip_folders: tuple[str, ...] = SKIP_FOLDERS
    skip_extensions: tuple[str, ...] = SKIP_EXTENSIONS
    process_extensions: tuple[str, ...] = PROCESS_EXTENSIONS

    # content
    max_content_bytes: int = 50 * 1024 * 1024
    preview_chars: int = 5000
    request_preview_chars: int = 3000
    csv_preview_lines: int = 20

    # decisions
    confidence_threshold: int = 7
    critique_enabled: bool = True
    critique_min: int = 6
    critique_max: int = 8
    skip_content_for_clear_signals: bool = True

    # scoring
    score_batch_rows: int = 10
    max_retries: int = 3
    retry_delay_seconds: float = 2.0
    sibling_limit: int = 10
    sibling_context_enabled: bool = True

    # context tables for request texts
    entity_type: str = "customer"
    own_names: tuple[str, ...] = ()
    employees: dict[str, dict[str, str]] = field(default_factory=dict)
    vendors: dict[str, list[str]] = field(default_factory=dict)
    customers: dict[str, list[str]] = field(default_factory=dict)
    former_customers: dict[str, dict] = field(default_factory=dict)
    filename_rules: dict[str, str] = field(default_factory=dict)
    content_phrases: tuple[tuple[str, tuple[str, ...]], ...] = CONTENT_PHRASES

    # review
    review_page_rows: int = 100
    cleanup_folders: tuple[str, ...] = ("Downloads", "MailAttachments")
    archived_folders: tuple[str, ...] = ("Archive",)

    # near duplicates
    shingle_words: int = 3
    near_threshold: float = 0.8
    judge_chars: int | None = None  # whole texts; a length limit for a judge that needs one
