"""Conversation-history analytics as PySpark DataFrame operations.

Layout
------
``functions``  Column -> Column building blocks (text, redaction, tokens, ranking)
``sources``    readers and writers (transcripts, notes, the table store)
``operators``  DataFrame -> DataFrame relational steps
``plans``      the reports users call (ingest, search, digests, team, notes)
``streaming``  Structured Streaming ingest
"""
