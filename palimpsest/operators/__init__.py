"""Column and DataFrame operators: span detection, overlap resolution, rewriting, vaults, requests, payloads."""
