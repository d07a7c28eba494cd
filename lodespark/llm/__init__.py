"""Training-data operators: quality, decontamination, token counts, licences,
chat formatting, near and exact duplicates, personal data, BPE and line dedup.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library intact."""
