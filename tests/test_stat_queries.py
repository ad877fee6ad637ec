from __future__ import annotations

from types import SimpleNamespace

import pytest

from voxtally.plans import stat_queries as Q

MATRIX = SimpleNamespace(rows=None, sizes=[3, 3], features=["a", "b"], groups=["x", "y"])


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """What a query passes to the operator that draws, which is not run."""

    def ask(query, module, operator):
        def caught(*args, **named):
            raise Asked(args, named)

        monkeypatch.setattr(Q, "_matrix", lambda spark, sf: MATRIX)
        monkeypatch.setattr(Q, "_behaviour_rows", lambda spark, sf: (MATRIX, None))
        monkeypatch.setattr(Q.RS, "make_blocks", lambda rows, sizes: None)
        monkeypatch.setattr(module, operator, caught)
        with pytest.raises(Asked) as found:
            getattr(Q, query)(None, None)
        return found.value.args

    return ask


@pytest.mark.parametrize(
    ("query", "operator", "draws"),
    [
        ("pls_lv_pvalues", "meancentered_pls", {"n_perm": 1000}),
        ("pls_salience", "meancentered_pls", {"n_boot": 1000}),
        ("pls_estimated_lv", "meancentered_pls", {"n_boot": 1000}),
        ("pls_contrast_table", "meancentered_pls", {"n_boot": 1000}),
        ("pls_split_half", "meancentered_pls", {"n_perm": 1000, "n_split": 100}),
        ("behavioral_pls", "behavioral_pls", {"n_perm": 1000, "n_boot": 1000}),
        ("behavioral_loadings", "behavioral_pls", {"n_boot": 1000}),
        ("pls_regression", "pls_regression", {"n_perm": 1000, "n_boot": 1000}),
    ],
)
def test_queries_draw_as_often_as_the_operators_defaults(asked, query, operator, draws):
    _, named = asked(query, Q.L, operator)
    assert {k: named[k] for k in draws} == draws


def test_cross_validation_and_graph_draw_as_often_too(asked):
    assert asked("cross_validate", Q.L, "cross_validate")[0][5] == 100
    assert asked("network_graphml", Q.N, "network")[0][1] == 1000
