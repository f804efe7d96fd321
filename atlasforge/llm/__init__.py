"""Training-data operators: chat threading, near-duplicates, tokens, media, scoring."""
