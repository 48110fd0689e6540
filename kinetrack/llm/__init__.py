"""Training-data operators: deduplication, tokenising, packing, media, WARC and URL filtering.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
