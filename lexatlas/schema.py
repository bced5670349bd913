"""Table layouts of a store. Arrays stand for vectors and term lists, structs for JSON."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


VERSION = 1

_DDL = {
    "corpora": "id string, title string, jurisdiction string, profile string, created_at timestamp",
    "documents": "id long, corpus_id string, title string, layer string, version string, source_path string, sha256 string, page_count int, ingested_at timestamp",
    "sections": "id long, document_id long, corpus_id string, parent_id long, number string, number_norm string, title string, depth int, path string, body string, page_start int, page_end int, ordinal int, supersedes_number string",
    "chunks": "id long, section_id long, corpus_id string, kind string, ordinal int, text string, content string, token_count int, page_start int, page_end int, embedding array<float>, terms array<string>",
    "cross_refs": "id long, from_section_id long, ref_text string, ref_number string, ref_kind string, to_section_id long",
    "postings": "term string, key long, places array<int>",
    "embedding_config": "provider string, model string, dimensions int, query_prefix string, doc_prefix string",
    "ingest_runs": "id long, document_id long, started_at timestamp, finished_at timestamp, status string, stats struct<sections:long,chunks:long,tables:long,exceptions:long,definitions:long,cross_refs:long,unresolved_refs:long,page_count:long>, error string",
}

BLOCK_DDL = "document string, ord int, kind string, text string, page int, level int, font_size double, bold boolean"
LAYERS = ("base", "amendment")
CHUNK_KINDS = ("body", "table", "definition", "exception")
BLOCK_KINDS = ("heading", "paragraph", "table", "list-item")


def schema(name: str) -> T.StructType:
    return _table(_DDL[name])


TABLES = tuple(_DDL)
