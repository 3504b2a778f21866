"""Record types of the audit data model as Spark schemas (DDL)."""

URL_RESULT = "is_valid boolean, normalized_url string, error_code string, error_message string"
RESOURCE = "audit_id string, seq int, kind string, url string, label string, final_url string, status_code int, content string, is_success boolean, is_fetched boolean, error_message string"
IMAGE = "struct<src: string, alt: string, has_alt_attribute: boolean>"
ROBOTS = "struct<is_accessible: boolean, http_status: int, disallow_rules: array<string>, allow_rules: array<string>, sitemap_urls: array<string>, blocks_root_path: boolean>"
SITEMAP = "struct<url: string, is_accessible: boolean, http_status: int, url_count: int>"
LINKS = "array<struct<raw: string, absolute: string>>"
#: What one parse of a page yields; links are ``(raw, absolute)`` in document order, those that cannot be resolved left out.
PARSED = (
    "page_title string, meta_description string, canonical_url string, page_language string, h1_tags array<string>, h2_tags array<string>, "
    f"links {LINKS}, images array<{IMAGE}>, og_tags map<string, string>, robots_meta string, json_ld array<string>"
)
EVIDENCE_FIELDS = (
    "base_url", "final_url", "http_status", "is_https", "page_title", "page_title_length", "meta_description", "meta_description_length",
    "canonical_url", "page_language", "h1_tags", "h2_tags", "internal_links", "external_links", "images", "images_missing_alt_count",
    "images_empty_alt_count", "robots_txt", "sitemaps", "unverifiable_fields",
)
REPORT = "audit_id string, url string, markdown_report string, created_at string"
BLOCK = "seq int, kind string, level int, text string, items array<string>"
