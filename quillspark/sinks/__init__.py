"""Sinks: office documents, files, stores."""
