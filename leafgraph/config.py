"""Every threshold of the library in one place; operators take them as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

# The four ontology domains and their keywords, in matching order.
ONTOLOGY_DOMAINS = {
    "technical": ["algorithm", "data_structure", "system", "protocol"],
    "business": ["process", "strategy", "metric", "organization"],
    "academic": ["theory", "methodology", "research", "hypothesis"],
    "general": ["concept", "definition", "example", "summary"],
}


@dataclass(frozen=True)
class Settings:
    domain: str = "documents"
    tag_prefix: str = "pdf:"
    min_content_length: int = 50
    page_offset: int = -1  # printed page numbers are 1-based, ours 0-based
    heading_confidence: float = 0.5
    significance_threshold: float = 0.1
    key_terms_per_page: int = 20
    relation_strength: float = 0.5
    decay_rate: float = 0.1
    similarity_threshold: float = 0.7
    summary_ratio: float = 0.2
    summary_max_words: int = 75
    context_summaries: int = 3
    context_window: int = 4096
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    ontology_domains: dict = field(default_factory=lambda: dict(ONTOLOGY_DOMAINS))
    # Layout: how many pages (or outline entries) share one block of an ordered
    # scan, and how many pages of a section share one row of content.
    pages_per_block: int = 4096
    entries_per_block: int = 4096
    pages_per_part: int = 256
