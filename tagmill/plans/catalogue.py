"""All queries over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from tagmill.plans import documents, evaluation, forecast, layout, planner, quality, text, vectors, weightage

_FAMILIES = (weightage, evaluation, quality, text, vectors, forecast, layout, planner, documents)

#: Columns whose type DuckDB widens (sums) or narrows otherwise than Spark: they are cast to Spark's.
_BIGINT = {
    "item_weightage": "primary_marks_1998 primary_marks_1999 primary_marks_2000 primary_questions primary_marks_total secondary_uses",
    "marks_per_question": "marks",
    "unit_marks": "marks_1998 marks_1999 marks_2000",
    "tag_sensitivity": "max_abs_change_marks",
    "key_findings": "questions",
    "report_tables": "n_f n_o n_p",
    "map_default": "marks",
    "item_set_prf": "tp fp fn",
    "classification_report": "support",
    "dq_passed": "failed",
    "validation_summary": "marks",
    "mirror_agreement": "digests",
    "usage_cost": "tokens",
    "dirichlet_marks": "total",
    "streamed_totals": "cents",
}
_INTEGER = {
    "question_records": "n_secondary",
    "tags_parse": "n",
    "normalize_text": "n",
    "content_words": "n_words n_distinct",
    "prompt_block": "n",
    "unicode_clean": "n",
    "zero_shot_topk": "rank",
    "similar_top5": "rank",
    "knn_blend": "rank",
    "targeted_revision": "place",
}


def _typed(name: str, sql: str) -> str:
    casts = [f'CAST("{c}" AS {kind}) AS "{c}"' for kind, table in (("BIGINT", _BIGINT), ("INTEGER", _INTEGER)) for c in table.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS oracle" if casts else sql


QUERIES: dict = {}
ORACLES: dict = {}
for _family in _FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= {name: _typed(name, sql) for name, sql in _family.ORACLES.items()}
