"""Move-sequence corpus, tokenizer, puzzle and evaluation jobs for PySpark."""
