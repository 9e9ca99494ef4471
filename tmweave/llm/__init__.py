"""Training-data operators: archives, filters, decontamination, duplicates,
quality, tokens, secrets, mixtures and page text.  Nothing outside this
subpackage imports it."""
