"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; :mod:`talweg.llm.queries` applies them to whole tables.
"""
