from .digest import digest_text, session_digest, tail_turns_full
from .ingest import ingest, publish_team
from .notes import notes_search
from .requests import ingest_requests, scan_paths
from .search import corpus_stats, score_hits, search, search_many, search_store, topk_per_project
from .team import team_activity, team_recent, team_search

__all__ = [n for n in dir() if not n.startswith("_")]
