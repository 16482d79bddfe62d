"""Fixed schemas of the index; children are keyed by path, which no run reuses."""

from __future__ import annotations

DOCUMENTS = "doc_id long, path string, content string, mtime long, hash string"
PARAGRAPHS = "para_id long, doc_id long, path string, seq int, start_line int, end_line int, text string, heading string"
DOC_TAGS = "doc_id long, path string, tag string"
VECTORS = "para_id long, embedding array<float>, path string"
POSTINGS = "gram string, para_id long, n int, places array<int>, path string"
QUERIES = "query_id long, query string"
CASES = "query string, doc string, para int"
TABLES = {"documents": DOCUMENTS, "paragraphs": PARAGRAPHS, "doc_tags": DOC_TAGS, "vectors": VECTORS, "postings": POSTINGS}
EMBED_DIM = 768
