"""Training-data operators over a documents table (``doc_id``, ``text``, ``source``).

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames and names its id and text columns as parameters; it selects
only the columns it needs, so extra columns of any name are harmless.
"""
