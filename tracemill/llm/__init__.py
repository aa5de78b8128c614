"""Training-data operators: filtering, deduplication, decontamination and tokenisation."""
