from .notes import scan_notes
from .store import Store, emit_json, json_rows
from .transcripts import (
    raw_lines,
    resolve_transcripts,
    scan_transcripts,
    transcript_inventory,
)

__all__ = [n for n in dir() if not n.startswith("_")]
