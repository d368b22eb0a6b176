"""Training-data operators: secrets, extraction, deduplication, decontamination, classifiers, WARC, tokens."""
