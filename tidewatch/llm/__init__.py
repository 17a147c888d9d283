"""Training-data operators: packing, deduplication, decontamination, language ID, extraction, privacy, sharding."""
