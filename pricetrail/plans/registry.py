"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import history, rates, reporting, resolution, searching, watch, wording

MODULES = [history, watch, rates, wording, resolution, reporting, searching]

#: Sequence queries that run once more with so few rows to a segment that most keys are cut, against the same SQL.
CUT_ROWS = {"offer_diff": 8, "offer_asof": 8, "failure_streak": 20, "change_marks": 8, "title_similarity": 10, "cosine_pairs": 4, "candidate_rank": 20, "gtin_running": 3,
            "quota_audit": 12, "spacing_audit": 12, "adaptive_ttl": 6, "fx_accept": 12, "fx_failures": 12}
CUT_SETTING = "pricetrail.sequence.cutRows"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def cut(fn, rows: int):
    """The query with at most about ``rows`` rows of a key in a segment; cut points are chosen while it is defined."""

    def run(spark, sf_dir):
        before = spark.conf.get(CUT_SETTING, None)
        spark.conf.set(CUT_SETTING, str(rows))
        try:
            return fn(spark, sf_dir)
        finally:
            spark.conf.unset(CUT_SETTING) if before is None else spark.conf.set(CUT_SETTING, before)

    return run


for module in MODULES:
    for name in module.QUERIES:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
for name, rows in CUT_ROWS.items():
    QUERIES[f"{name}_cut"] = cut(QUERIES[name], rows)
    ORACLES[f"{name}_cut"] = ORACLES[name]
