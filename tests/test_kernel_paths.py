import pytest

from tsuzuri.functions import text as X


@pytest.mark.parametrize("fn", [X.convert, X.normalize_text, X.normalize_body, X.normalize_query, X.nfkc, X.count_historical_kana])
def test_one_arrow_pass(spark, fn):
    """All rules in one pass over slices; no chain of Python workers, each with a whole batch, nor one of regular expressions."""
    plan = spark.createDataFrame([("國",)], "text string").select(fn("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan and "translate" not in plan
