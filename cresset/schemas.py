"""Schemas of the files, stated so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SLOTS = 8
CATALOG = _of(item_id=_S, title=_S, normalized_title=_S, interaction_count=_L, popularity_quartile=_S)
INTERACTIONS = _of(user_id=_S, item_id=_S, timestamp=_L)
HOLDOUT_USERS = _of(user_id=_S, history=T.ArrayType(_S), target_item_id=_S, target_quartile=_S)
VERDICTS = _of(title=_S, in_catalog=_B, judged=_B, match_title=_S, match_id=_S, match_quartile=_S)
CELL_METRICS = _of(dataset=_S, llm=_S, grounded=_D, conf=_D, gap=_D, ece=_D, brier=_D, n=_L)
SAMPLING_FRAME = _of(catalog=_S, llm_in_catalog=_B, llm_match_id=_S, llm_match_title=_S, llm_match_quartile=_S)
_CANDIDATES = {f"cand_{k}": _S for k in range(1, SLOTS + 1)}
_CANDIDATE_IDS = {f"cand_{k}_id": _S for k in range(1, SLOTS + 1)}
SCORED_LABELS = _of(catalog=_S, model=_S, generated_title=_S, llm_says=_S, llm_pick=_S, **_CANDIDATES, same_item=_S, human_in=_B, llm_dep=_B, llm_in=_B, llm8_in=_B, tset_in=_B, tsort_in=_B, surf_in=_B, **_CANDIDATE_IDS)
BLIND_LABELS = _of(catalog=_S, generated_title=_S, **_CANDIDATES, same_item=_S, **_CANDIDATE_IDS)
