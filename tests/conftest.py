import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from recallkit.session import get_session

    return get_session("tests", "4", 4)


def most_joined(df):
    """The rows of df, and the most rows that one join of its plan gave out."""
    rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            most = max(most, node.metrics().apply("numOutputRows").value()) if "Join" in kind else most
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows, most
