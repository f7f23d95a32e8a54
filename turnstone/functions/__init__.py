from .content import extract_text, parent_if_string, string_if_string, tool_use_names
from .notes import best_excerpt, extract_title, keyword_contains, keyword_score, matched_keywords
from .rank import bm25_score, bm25_term, idf, team_rank
from .redact import load_redaction_rules, redact, union_rules
from .stem import porter_stem, stem_word
from .text import (
    cap_block,
    fmt_iso_short,
    fmt_iso_team,
    iso_timestamp,
    normalize_user_id,
    preview,
    session_from_path,
    slug_from_cwd,
    slug_from_path,
    slugify,
    strip,
    tool_json,
    tools_line,
    top_tools,
    trim_turn,
)
from .tokens import doc_length, fold_text, normalized, tokenize

__all__ = [n for n in dir() if not n.startswith("_")]
