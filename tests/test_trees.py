from tidemark.catalog import evaluation
from tidemark.plans import learners as ln


def test_tree_query_has_the_operators_rounds(spark, monkeypatch):
    for name in ("feats_of", "folds_of"):
        monkeypatch.setattr(evaluation, name, lambda x: None)
    monkeypatch.setattr(ln, "walk_forward", lambda events, folds, features, heads, name: heads())
    assert [h.getMaxIter() for h in evaluation.ml_boosted_trees(None)] == [500, 500]
