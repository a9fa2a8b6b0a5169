"""Training-data operators: deduplication, filters, decontamination, mixing, nearest neighbours."""
