"""The queries of this folder and their SQL."""

from . import alignment, fingerprints, jaccard, language, licenses, mixing, neighbours, packing, prefixtrie, sharding, substrings, tokenfiles, warc

_MODULES = (warc, neighbours, mixing, substrings, packing, language, tokenfiles, fingerprints, jaccard, sharding, alignment, prefixtrie, licenses)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
