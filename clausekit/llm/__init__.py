"""Training-data operators: decontamination, toxicity, quality rules, secrets,
licences, quality classifier, chat formatting, near-duplicate join, repeated
passages and source mixing.  Nothing else in the library imports this package."""
