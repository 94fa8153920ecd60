"""Schemas of the tables of a vault, and the versions they went through."""

from __future__ import annotations

ENTRIES = "id long, title string, url string, file_path string, source_type string, created_at timestamp_ntz, updated_at timestamp_ntz, status string, tags array<string>, flags array<string>, read_at timestamp_ntz, indexed_mtime double"
TAGS = "id long, name string, normalized string"
ENTRY_TAGS = "entry_id long, tag_id long"
MARKDOWN = "entry_id long, markdown string, mtime double"
REFS = "source_id long, ordinal int, target_text string, is_hashtag boolean, heading string, pre string, highlight string, post string"
NODES = "node_id string, label string, kind string, source_type string"
EDGES = "source string, target string, weight long"

STATUSES, FLAGS = ("unread", "read"), ("bookmark", "gem", "archive")
SOURCE_TYPES = ("article", "youtube", "substack", "x")
