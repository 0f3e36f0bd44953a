"""Training-data operators: token counts, line and suffix-array deduplication,
BPE, set-similarity joins, quality rules, WARC derivatives, personal data,
benchmark decontamination and main-text extraction. Nothing else in the
library imports this subpackage."""
