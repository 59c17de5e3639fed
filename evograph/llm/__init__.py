"""Corpus preparation: deduplication, archives, token counts, packing, quality, licences, toxicity."""
