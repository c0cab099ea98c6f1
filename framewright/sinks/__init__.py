"""Dataset layouts written by Spark.

Spark writes directories of part files. Where a layout names one file
(``metadata.jsonl``, ``dataset.csv``), a directory of that name is written;
``single_file=True`` makes it one real file and is meant for small exports.
"""
