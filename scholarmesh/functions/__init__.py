"""Column functions: text folding, grounding, dates, labels, cleaning, hashing."""
