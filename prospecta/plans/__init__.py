"""End-to-end jobs: ingest and publish versions, export with audit, retention,
ledger-driven re-ingest."""
