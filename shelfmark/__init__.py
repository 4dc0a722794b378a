"""Curation of large file and document collections as Spark tables."""

from shelfmark.settings import Settings
from shelfmark.session import build_session, materialize

__all__ = ["Settings", "build_session", "materialize"]
