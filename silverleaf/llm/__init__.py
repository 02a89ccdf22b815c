"""Training-data operators: dedup, formatting, token counts, scoring, packing, search and scans."""
