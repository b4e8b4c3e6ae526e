"""All queries of the library by name, and their SQL."""

from plumbline.plans import answers, arms, extraction, market, pairs, statements

_PLANS = (market, answers, arms, pairs, statements, extraction)
QUERIES = {name: q for plan in _PLANS for name, q in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
