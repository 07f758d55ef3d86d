"""Training-data operators: packing, token files, quotation linking, toxicity, nearest neighbours,
embedding and text near-duplicates, language-model scoring, source mixing and language labels."""
