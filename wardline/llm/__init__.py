"""Training-data operators: quality, secrets, URLs, language, decontamination, mixing,
near-duplicates, language-model scores and token output, each a Spark job."""
