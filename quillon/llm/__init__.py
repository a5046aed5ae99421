"""Training-data operators: dedup, decontamination, mixing, scoring, formatting, binary output.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
