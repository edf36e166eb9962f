"""Training-data operators: mixing, quality, near-dedup, toxicity, BPE, media,
language-model scoring, HTML extraction, nearest neighbours, chat formatting, conversation repair,
sharding, hard negatives.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
