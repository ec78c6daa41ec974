"""Operators for preparing training data: mixing, filtering, near duplicates, extraction, packing and vector search.

Nothing outside this subpackage imports it.  General helpers (lineage cuts,
shared folder, package shipping) come from ``sheetlake.session``.
"""
