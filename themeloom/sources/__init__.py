"""Readers, sinks, dataset catalog and corpus adapters."""
