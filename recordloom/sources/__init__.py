"""Contracts, snapshot scans, manifests, column catalogs and sinks."""
