"""The question catalogue: fixed dashboards (D..) and parameterised templates (T..) over the operational model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import access, care, claims, enrolment, hospitals  # noqa: F401  (each module registers its questions)
from .base import QUESTIONS, Model, Question, StoredModel

__all__ = ["QUESTIONS", "Model", "Question", "StoredModel", "ask"]


def ask(tables, qid: str, dates: tuple[str, str] | None = None, **params) -> DataFrame:
    """Answer one question.

    ``tables`` gives the model tables by attribute. ``dates`` is an optional
    closed range on the question's date column; questions about the registry or
    about enrolment as a whole have none and refuse it.
    """
    question = QUESTIONS[qid]
    model = tables if isinstance(tables, Model) else Model(tables)
    if dates is not None:
        if question.dated is None:
            raise ValueError(f"{qid} cannot be restricted by date")
        model = model.within(question.dated, *dates)
    return question.run(model, **params)
