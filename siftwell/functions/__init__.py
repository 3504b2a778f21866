"""Column functions: text, URLs, robots.txt and sitemaps, all native expressions."""
