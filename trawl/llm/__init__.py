"""Training-data operators: sharding, mixing, language-model scoring, PII, near duplicates, chat
formatting, media columns, similarity join, BPE and toxicity.  Nothing outside this folder imports it."""
