"""chronotext: dating a text corpus with Spark.

Corpus and metadata go in; per-document features, cleaned model tables, scored
predictions and the evaluation, comparison and importance tables come out.
Every operator takes and returns DataFrames.
"""
