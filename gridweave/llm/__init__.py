"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; the thin
queries over the driver tables are in :mod:`gridweave.llm.queries`. Nothing
outside this package imports it.

Conventions shared by all operators:

* Inputs are read by named columns only, so extra columns, whatever they are
  called, never clash with names used inside.
* A null text is an empty text; a null id is an ordinary id value; a repeated
  row is processed like any other row and gives its own result row (pair and
  group operators say in their docstring what repeated rows mean there).
* An empty table gives an empty result with the same columns.
* Python code runs inside Spark tasks on Arrow batches; what it keeps in
  memory is bounded by a batch slice or by one text, never by a group.
"""
