"""The question catalogue with one set of parameter values."""

from __future__ import annotations

from cohortline.plans.catalogue import QUESTIONS, ask
from oracle.catalogue import PARAMS

from .common import Query, bound

_EXTRA = {"D123": ("more_than",), "T182": ("fewer_cases", "more_people")}


def arguments(qid: str) -> dict[str, object]:
    """What a question is asked with."""
    return {p: PARAMS[p] for p in (*QUESTIONS[qid].params, *_EXTRA.get(qid, ()))}


def catalogue_queries() -> dict[str, Query]:
    out = {}
    for qid, question in QUESTIONS.items():
        out[f"{qid}_{question.family}"] = bound(lambda t, q=qid, kw=arguments(qid): ask(t, q, **kw))
    return out
