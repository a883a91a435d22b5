"""Operators on a table without numbers: an empty or a plain result, never an error."""

import pytest

from sondage.operators import facts, ml, profile, quality, stats, types

EMPTY = {
    "describe": lambda d: profile.describe(d, []), "numeric_summary": lambda d: profile.numeric_summary(d), "moments_table": lambda d: profile.moments_table(d, []),
    "quantiles": lambda d: stats.quantiles_long(d, [], [0.5]), "quantiles_by": lambda d: stats.quantiles_long(d, [], [0.5], ["kind"]),
    "outlier_table": lambda d: quality.outlier_table(d), "distribution_shape": lambda d: stats.distribution_shape(d, []),
    "pearson": lambda d: stats.corr_matrix(d, []), "spearman": lambda d: stats.corr_matrix(d, [], "spearman"), "kendall": lambda d: stats.corr_matrix(d, [], "kendall"),
    "ranked_pairs": lambda d: stats.ranked_pairs(d, []), "dagostino_k2": lambda d: stats.dagostino_k2(d, []), "shapiro_wilk": lambda d: stats.shapiro_wilk(d, []),
    "ks_normal": lambda d: stats.ks_normal(d, []), "normality_table": lambda d: stats.normality_table(d, []), "eta_matrix": lambda d: stats.eta_matrix(d, ["kind"], []),
    "scenario_bounds": lambda d: ml.scenario_bounds(d, []),
}
FILLED = {
    "missing_table": profile.missing_table, "nunique_table": profile.nunique_table, "dataset_summary": profile.dataset_summary, "column_profile": profile.column_profile,
    "data_dictionary": profile.data_dictionary, "kpis": profile.kpis, "quality_score": quality.quality_score, "dqi": quality.dqi, "health_scores": quality.health_scores,
    "cleaning_recommendations": quality.cleaning_recommendations, "detect_issues": quality.detect_issues, "root_causes": quality.root_causes,
    "auto_clean": lambda d: quality.auto_clean(d)[0], "important_columns": stats.important_columns, "column_types": types.column_types, "semantic_types": types.semantic_types,
    "auto_insights": facts.auto_insights, "column_facts": facts.column_facts, "executive_facts": facts.executive_facts, "story_facts": lambda d: facts.story_facts(d, "name"),
    "business_facts": facts.business_facts, "chart_candidates": facts.chart_candidates,
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(f"a{i}", "x" if i % 3 else None) for i in range(40)], "name string, kind string")


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_nothing_to_say_about_numbers(texts, name):
    out = EMPTY[name](texts)
    assert out.count() == 0 and len(out.columns) > 1


@pytest.mark.parametrize("name", sorted(FILLED))
def test_texts_are_described(texts, name):
    assert FILLED[name](texts).count() > 0
