"""Training-data operators: archives, chat repair, quality, extraction, dedup, decontamination, mixing."""
