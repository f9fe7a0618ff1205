"""Training-data operators: rules, packing, deduplication, decontamination and scoring."""
