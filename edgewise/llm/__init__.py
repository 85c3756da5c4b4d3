"""Training-data operators: dedup, language, safety, mixing, tokens, chat.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
