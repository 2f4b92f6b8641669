"""Training-data operators: text in, decisions out, as Spark jobs.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
