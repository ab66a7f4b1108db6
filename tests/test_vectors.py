"""The hash vectors as a plan."""

from tidemark.functions.vectors import vector_checks


def test_a_canonical_text_is_computed_once_and_by_many_tasks(spark, tables):
    checks = vector_checks(tables.customer.coalesce(1), "c_name")
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    # One call of the normalizer per text that the vectors are built around.
    assert 0 < plan.count("com.ibm.icu.text.Normalizer") <= 40
    assert "Repartition" in plan
