"""segmetrics: segment price analytics as Spark DataFrame jobs.

Raw sale records go in; a segment cube of price series (by year sold) and
appreciation grids (year bought x year sold) comes out, for every
location / house type / tenure combination including all roll-ups.

Sub-packages:
    sources    readers for raw sale files, the test-data adapter, serving tables
    functions  Column-expression helpers (text cleaning, keys, labels, JSON)
    operators  DataFrame-in / DataFrame-out building blocks
    plans      end-to-end jobs (build the serving tables, answer lookups)
    streaming  Structured Streaming loader for key/value drops
"""

__version__ = "0.1.0"
