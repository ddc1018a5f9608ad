"""Interfaces that a domain may implement, all over DataFrames.

The core calls nothing here by itself: :func:`extract` and :func:`adapted` apply
what a caller passes.  ``clock`` is any function that gives an ISO time, so that
a build can be repeated exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from veridock.operators import claims as _claims
from veridock.operators import evaluation, prediction

Clock = Callable[[], str]


@runtime_checkable
class ClaimExtractor(Protocol):
    """Texts to source claims (the columns of ``claims.source_claims``), under a version."""

    version: str

    def extract_claims(self, sources: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


@runtime_checkable
class DomainProfileProvider(Protocol):
    def domain_profile(self) -> Mapping[str, Any]: ...


@runtime_checkable
class EvaluationRubricProvider(Protocol):
    """Rubrics as (dimension_id, weight, missing_policy, minimum, maximum) by name."""

    def evaluation_rubrics(self) -> Mapping[str, DataFrame]: ...


@runtime_checkable
class PredictiveEligibilityProvider(Protocol):
    """(canonical_id, status, reasons) of canonical claims."""

    def determine_eligibility(self, claims: DataFrame) -> DataFrame: ...


@runtime_checkable
class AuthorizedOutcomeResolver(Protocol):
    """Observations of specs from sources that it may read; they are still checked."""

    def resolve_outcomes(self, specs: DataFrame) -> DataFrame: ...


@runtime_checkable
class DomainAdapter(DomainProfileProvider, EvaluationRubricProvider, PredictiveEligibilityProvider, AuthorizedOutcomeResolver, Protocol):
    """A domain's policy: terms, condition fields, metrics, and its own rendering."""

    id: str
    version: str

    def normalize_terminology(self, claims: DataFrame) -> DataFrame: ...

    def condition_fields(self) -> tuple[str, ...]: ...

    def metric_definitions(self) -> Mapping[str, Mapping[str, Any]]: ...

    def render_skill(self, documents: DataFrame) -> DataFrame: ...

    def validate_skill(self, documents: DataFrame) -> DataFrame: ...


@runtime_checkable
class PredictivePower(Protocol):
    """The lifecycle of predictions."""

    def check_eligibility(self, claims: DataFrame) -> DataFrame: ...

    def register_and_freeze(self, specs: DataFrame, claims: DataFrame, registered_at: Column) -> DataFrame: ...

    def record_outcomes(self, specs: DataFrame, observations: DataFrame) -> DataFrame: ...

    def score(self, specs: DataFrame, observations: DataFrame, scored_at: Column) -> DataFrame: ...

    def aggregate(self, scores: DataFrame, minimum: int) -> DataFrame: ...


class LineClaims:
    """The built-in extractor: marked lines, or with ``prose`` every line."""

    version = "veridock-claims-1"

    def __init__(self, prose: bool = False):
        self.prose = prose

    def extract_claims(self, sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return _claims.source_claims(sources, id_col, text_col, self.prose)


class BuiltInPrediction:
    """The built-in lifecycle."""

    check_eligibility = staticmethod(prediction.eligibility)
    register_and_freeze = staticmethod(prediction.freeze)
    record_outcomes = staticmethod(prediction.outcomes)
    score = staticmethod(prediction.score)
    aggregate = staticmethod(prediction.aggregate)


def extract(extractor: ClaimExtractor, sources: DataFrame, id_col: str = "source_id", text_col: str = "text", adapter: DomainAdapter | None = None) -> DataFrame:
    """Claims of an extractor, in an adapter's terms; ids and places that it leaves
    out are an error."""
    found = extractor.extract_claims(sources, id_col, text_col)
    missing = {"claim_id", "source_id", "proposition", "claim_type", "start_offset", "end_offset"} - set(found.columns)
    if missing:
        raise ValueError(f"an extractor must give {sorted(missing)}")
    return found.transform(adapter.normalize_terminology) if adapter is not None else found


def assess(targets: DataFrame, rubric: DataFrame, assessor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluation by an assessor, a function from every (target, dimension_id) pair to
    (target, dimension_id, score, status); pairs that it leaves out take their policy."""
    from pyspark.sql import functions as F

    dims = rubric.select("dimension_id")
    grid = targets.select("target", F.explode(F.lit([r.dimension_id for r in dims.collect()])).alias("dimension_id"))  # a rubric is a few rows
    return evaluation.evaluate(targets, rubric, assessor(grid).select("target", "dimension_id", "score", "status"))
