"""Declared schemas of the data model."""

from __future__ import annotations

# The fields of a canon record, a manifest entry and a fetch.
CANON = ", ".join(f"{c} STRING" for c in ("chunk_id", "canon_number", "libro", "parte", "sezione", "titolo", "capitolo", "articolo", "hierarchy_path", "source_url", "in_force_note", "text", "embed_text"))
MANIFEST_FIELDS = ("etag", "last_modified", "sha256", "local_filename", "source_page_url", "source_title", "first_seen", "last_checked")
MANIFEST = ", ".join(f"{c} STRING" for c in ("pdf_url", *MANIFEST_FIELDS))
FETCH = "pdf_url STRING, ts TIMESTAMP_NTZ, status INT, sha256 STRING, etag STRING, last_modified STRING, robots_ok BOOLEAN, transport_error STRING, arrived_at TIMESTAMP_NTZ"
