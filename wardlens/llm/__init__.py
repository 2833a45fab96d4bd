"""Operators of a large-scale training-data pipeline (dedup, extraction, language,
licences, mixing, packing, nearest neighbours).  Nothing else in the library imports
this package; it uses only general helpers of the rest."""
