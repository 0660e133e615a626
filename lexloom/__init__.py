"""lexloom: analytics over large legal corpora, written as Spark DataFrame jobs.

Sub-packages

* ``functions``  column expressions and text jobs (cleaning, identifiers, dates, citations, references)
* ``sources``    readers and sinks (XML, JSON, CSV, SKOS, HTML, tables, index tables)
* ``operators``  relational building blocks (filters, as-of joins, patches, aggregates, windows, merges)
* ``plans``      whole query plans (index and BM25 search, federation, reference resolution, thesaurus, directory)
* ``streaming``  incremental flows on Structured Streaming
"""

__version__ = "0.1.0"
