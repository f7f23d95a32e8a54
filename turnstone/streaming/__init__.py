from .ingest import landed_lines, stream_dedup, stream_ingest, stream_redact

__all__ = ["landed_lines", "stream_dedup", "stream_ingest", "stream_redact"]
