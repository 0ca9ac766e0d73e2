"""Reading raw logs, files and event-stream text; reading and writing tables."""

from chatledger.sources.files import scan_files, write_text_files
from chatledger.sources.requests import parse_requests
from chatledger.sources.sse_text import sse_lines
from chatledger.sources.tables import (
    VersionedCache,
    append_audit,
    append_audit_stream,
    read_audit,
    read_response_cache,
    shared_path,
    write_response_cache,
)

__all__ = [
    "VersionedCache",
    "append_audit",
    "append_audit_stream",
    "parse_requests",
    "read_audit",
    "read_response_cache",
    "scan_files",
    "shared_path",
    "sse_lines",
    "write_response_cache",
    "write_text_files",
]
