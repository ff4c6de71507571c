"""Limits and profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """Fixed default limits of ingestion; `for_profile` applies the stricter demo ones."""

    max_upload_mb: int = 50
    max_pages: int = 500
    max_words: int = 120_000
    max_zip_members: int = 2_000
    max_uncompressed_mb: int = 500
    max_compression_ratio: float = 100.0
    max_tex_files: int = 200
    max_include_depth: int = 8
    max_bib_files: int = 5
    default_language: str = "pl"
    fold_l: bool = False

    @staticmethod
    def for_profile(profile: str = "full") -> Settings:
        if profile not in ("full", "demo"):
            raise ValueError(f"unknown profile: {profile}")
        return Settings() if profile == "full" else replace(Settings(), max_upload_mb=15)
