"""Operators for preparing text corpora; nothing outside this subpackage imports it.

Shared rules for rows, stated once:

* ``doc_id`` names a document. Rows that repeat a ``doc_id`` and a text are one document: each of them is
  returned, all with the same result.
* A NULL ``doc_id`` sorts before all others. A NULL text is an empty text.
* Columns other than those an operator names are ignored, whatever they are called.
* An empty table gives an empty result with the same columns.
"""
