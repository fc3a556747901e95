"""Declared schemas of stored inputs; nothing is inferred."""

from __future__ import annotations

CAPTURED_PAGE = "url string, html string, sha256 string, charset string"
CAPTURE_MANIFEST = "url string, final_url string, bytes bigint, sha256 string, charset string"
ENTITY = "collection string, key string, data string, relations map<string, array<string>>, _corrupt string"
MEDIA = "key string, path string, sha256 string, alt string, url string, targets array<struct<collection string, key string, field string, order int, caption string>>"
SOURCE = "version int, kind string, manifestHash string, capturedAt string, complete boolean"
ISSUE = "code string, url string, key string, detail string"
ROUTE = "kind string, id bigint, published boolean, legacy_path string, slug string, path string"
REDIRECT = "id bigint, published boolean, src string, dst string"
DOCUMENT = "id bigint, legacy_path string, url string"
FILE = "path string, size bigint, sha256 string"
RUN = "run_key string, attempt int, status string, counts map<string, bigint>, unresolved array<string>, started_at timestamp, finished_at timestamp"

# columns each collection may expose to routing; anything else is refused
ROUTE_COLUMNS = ["id", "published", "legacy_path", "slug", "path"]
REDIRECT_COLUMNS = ["id", "published", "src", "dst"]
