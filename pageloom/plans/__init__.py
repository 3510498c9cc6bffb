"""Multi-step jobs: crawl, ingest, merging by level, the whole report."""
