"""The queries of this folder and their SQL."""

from sedimenta.llm import density, gif, lines, minhash, mixing, pieces, simhash, substrings, tokenids, toxicity

_MODULES = (lines, tokenids, mixing, density, pieces, substrings, minhash, toxicity, gif, simhash)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
